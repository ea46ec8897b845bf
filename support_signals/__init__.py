"""support_signals: support-ticket trend analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames; nothing is collected to the
driver.  Parameters live in :class:`TrendConfig`.
"""

from support_signals.config import TrendConfig

__all__ = ["TrendConfig"]


def _ship_by_value() -> None:
    """Serialise this package's functions by value inside Python UDFs, so
    executors need no installed copy of the package."""
    try:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
