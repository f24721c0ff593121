"""Forward logs: read, seed, append, compact, repair and dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide import schemas
from eventide.operators import changelog as cl
from eventide.operators.tables import last_per_key, upsert
from eventide.sources.readers import read_log


def committed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A committed log, one row per key."""
    log = read_log(spark, name, path)
    return last_per_key(log, schemas.KEYS[name], F.struct(*log.columns))


def seed(table: DataFrame, spark: SparkSession, name: str, path: str) -> DataFrame:
    """Table rows plus the committed log. Seeding twice changes nothing."""
    return upsert(table, committed(spark, name, path), schemas.KEYS[name])


def row_counts(before: DataFrame, seed_rows: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """What a seeding did: log, rows read, rows that were new, rows of the log afterwards."""
    key = schemas.KEYS[name]
    new = seed_rows.join(before.select(*key), key, "left_anti")
    told = [rows.select(*[F.lit(int(c == name_)).alias(c) for c in ("read", "added", "total")])
            for name_, rows in (("read", seed_rows), ("added", new), ("total", after))]
    return (told[0].unionAll(told[1]).unionAll(told[2])
            .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "added", "total")])
            .select(F.lit(name).alias("log"), "read", "added", "total"))


def delta(log: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The new rows whose signature changed."""
    return cl.changed_rows(new, log, cl.KEYS[name], cl.SIGNATURES[name]())


def append(log: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The log after appending only the rows whose signature changed."""
    return upsert(log, delta(log, new, name), schemas.KEYS[name])


def compact(log: DataFrame, name: str) -> DataFrame:
    return cl.compact(log, cl.KEYS[name], cl.SIGNATURES[name]())


def dump(log: DataFrame, name: str, path: str) -> None:
    """Write a log as CSV in order of snapshot date and key."""
    (log.orderBy("snapshot_date", cl.KEYS[name]).write.mode("overwrite")
     .option("header", True).csv(path))
