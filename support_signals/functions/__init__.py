"""Column-level helpers (all JVM-side built-ins, code-generated where Spark can)."""
