"""Sources: driver tables, canonical ticket views, raw dataset ingest, stores."""
