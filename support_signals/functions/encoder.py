"""Default text encoder (A15): Spark ML hashed TF-IDF, L2 normalised.

Pluggable: any ``DataFrame -> DataFrame`` that adds a unit ``embedding``
array column can replace it (e.g. a model run in ``mapInPandas``).  No
pre-trained weights ship here, so its similarity quality is far below a
sentence-transformer and the published accuracy figures do not apply.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticket_text(df: DataFrame) -> DataFrame:
    """Text of a ticket: ``subject + " " + body``."""
    return df.withColumn("text", F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))


def fit_encoder(corpus: DataFrame, dims: int = 512) -> PipelineModel:
    stages = [RegexTokenizer(inputCol="text", outputCol="_tok", pattern=r"\W+", minTokenLength=1),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims),
              IDF(inputCol="_tf", outputCol="_tfidf"),
              Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0)]
    return Pipeline(stages=stages).fit(ticket_text(corpus))


def encode(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(ticket_text(df))
    return out.withColumn("embedding", vector_to_array("_vec", "float32")).drop("_tok", "_tf", "_tfidf", "_vec")


def incremental(model: PipelineModel, cache: DataFrame, tickets: DataFrame) -> DataFrame:
    """Encode only tickets that are new or whose text changed since the
    cache was built (anti-join on id + text hash); cached rows are kept."""
    keyed = ticket_text(tickets).withColumn("text_sha", F.sha2("text", 256))
    fresh = keyed.join(cache.select("id", "text_sha"), ["id", "text_sha"], "left_anti")
    reason = F.when(F.col("_known").isNull(), "new").otherwise("changed")
    fresh = fresh.join(cache.select("id", F.lit(True).alias("_known")), "id", "left").withColumn("reason", reason)
    return encode(model, fresh.drop("text")).drop("_known")
