"""Run parameters shared by the similarity, trend and evaluation jobs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference behaviour:
# cosine threshold 0.60, at least 3 earlier matches, 7-day trailing window,
# 5 nearest neighbours.
DEFAULT_THRESHOLD = 0.60
DEFAULT_MIN_COUNT = 3
DEFAULT_WINDOW_DAYS = 7
DEFAULT_TOP_K = 5


@dataclass(frozen=True)
class TrendConfig:
    """Parameters of the trend rule plus physical knobs of the pair join.

    threshold / min_count / window_days / top_k are semantic.  The rest only
    change how the work is spread over tasks, never the result:

    * ``bucket_hours``: width of the time buckets used to turn the trailing
      range predicate into an equi-join key.  Smaller buckets mean fewer
      candidate pairs checked per trigger but more trigger replicas
      (window / bucket + 1 of them).
    * ``target_rows_per_group``: rows per side a (key, bucket) join group may
      hold before it is split by salts.  A category-day holding a third of all
      tickets becomes ``ceil(rows / target)`` sub-groups per side.
    * ``block_rows``: rows per block or tile of the NumPy products (memory per
      task ~ block_rows^2 * 8 B).
    * ``stream_salts``: fixed split of each (category, day) key of the
      streaming interval join (no statistics exist in a stream); raise it
      when one category-day is hot.
    """

    threshold: float = DEFAULT_THRESHOLD
    min_count: int = DEFAULT_MIN_COUNT
    window_days: int = DEFAULT_WINDOW_DAYS
    top_k: int = DEFAULT_TOP_K
    bucket_hours: int = 24
    target_rows_per_group: int = 20_000
    block_rows: int = 2_048
    stream_salts: int = 1
    sweep: tuple[float, ...] = field(default=(0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75))

    def with_(self, **kw) -> "TrendConfig":
        return replace(self, **kw)

    @property
    def window_seconds(self) -> int:
        return int(self.window_days) * 86_400

    @property
    def bucket_seconds(self) -> int:
        return int(self.bucket_hours) * 3_600


# Parameters for the driver test tables: the vectors are random 64-d unit
# vectors, so 0.60 matches nothing; 0.20 yields a few hundred matches.
TEST_CONFIG = TrendConfig(threshold=0.20, sweep=(0.10, 0.125, 0.15, 0.175, 0.20, 0.25, 0.30))
