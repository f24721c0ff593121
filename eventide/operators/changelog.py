"""Change-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.dates import day_key
from eventide.functions.priors import lookup
from eventide.functions.text import nearest

KEYS = {"verdict_log": "drug_id", "sentiment": "ticker"}


def verdict_signature() -> Column:
    return F.struct("verdict", "setup", F.floor(F.col("conviction") / 10).alias("decile"),
                    "evidence", day_key(F.col("catalyst_date")).alias("day"))


def sentiment_signature() -> Column:
    return F.struct(nearest(F.col("sentiment"), 2).alias("score"), "scored_articles", "eightk_90d",
                    F.col("thin").cast("boolean").alias("thin"))


SIGNATURES = {"verdict_log": verdict_signature, "sentiment": sentiment_signature}


def latest_signatures(log: DataFrame, key: str, signature: Column,
                      order: str = "snapshot_date") -> DataFrame:
    """Signature of the last logged row per key."""
    return (log.groupBy(key).agg(F.max_by(signature, order).alias("last_signature")))


def changed_rows(new: DataFrame, log: DataFrame, key: str, signature: Column,
                 order: str = "snapshot_date") -> DataFrame:
    """New rows whose signature differs from the last logged one of their key.

    Rows of one batch are compared with the stored row only, never with each other.
    """
    known = latest_signatures(log, key, signature, order).withColumn("known", F.lit(True))
    same = F.coalesce(F.col("known"), F.lit(False)) & signature.eqNullSafe(F.col("last_signature"))
    return (new.join(known, key, "left").where(~same).select(*[new[x] for x in new.columns]))


def compact(log: DataFrame, key: str, signature: Column,
            order: str = "snapshot_date") -> DataFrame:
    """The first row per key and every row whose signature differs from the one before it."""
    w = W.partitionBy(key).orderBy(order)
    return (log.withColumn("_sig", signature)
            .withColumn("_prev", F.lag("_sig").over(w))
            .withColumn("_first", F.row_number().over(w) == 1)
            .where(F.col("_first") | ~F.col("_sig").eqNullSafe(F.col("_prev")))
            .drop("_sig", "_prev", "_first"))


def repair_evidence(log: DataFrame) -> DataFrame:
    """Fill blank evidence labels from the setup."""
    blank = F.coalesce(F.col("evidence"), F.lit("")) == ""
    known = lookup(F.col("setup"), fv.EVIDENCE, None)
    return log.withColumn("evidence", F.when(blank & known.isNotNull(), known)
                          .otherwise(F.col("evidence")))
