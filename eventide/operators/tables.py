"""Keyed tables on Parquet: upsert, slice replace, schema reconciliation, safe overwrite."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventide.storage import stash


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without an equal key in `new`, plus the new rows.

    An anti join rather than a window over the union: old and new rows of a key never meet in one
    task beyond the join, which adaptive execution can split. `new` must be unique on the key.
    """
    kept = old.join(new.select(*key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def last_per_key(rows: DataFrame, key: list[str], order) -> DataFrame:
    """The row with the greatest `order` per key, by partial aggregation."""
    packed = F.struct(*[F.col(x) for x in rows.columns])
    return rows.groupBy(*key).agg(F.max_by(packed, order).alias("_row")).select("_row.*")


def replace_slice(old: DataFrame, new: DataFrame, today, lookback: int,
                  key: list[str]) -> DataFrame:
    """Drop rows whose window reaches past today - lookback, keep history, then upsert.

    Rows without an upper date are kept, as a delete by comparison keeps them.
    """
    floor = F.date_sub(F.lit(today).cast("date"), lookback)
    hi = F.col("catalyst_date_hi")
    return upsert(old.where((hi < floor) | hi.isNull()), new, key)


def reconcile(rows: DataFrame, schema: StructType) -> DataFrame:
    """Columns of a table schema in order: missing ones added as NULL, the rest cast, extras
    kept at the end. Applying it twice changes nothing."""
    have = set(rows.columns)
    want = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    extra = [F.col(x) for x in rows.columns if x not in set(schema.fieldNames())]
    return rows.select(*want, *extra)


def read_months(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A log kept by month of its day, with the month as a last column; empty where nothing is stored.

    A filter on `month` reads only the folders of those months.
    """
    full = StructType([*schema.fields, StructField(MONTH, StringType())])
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def month_of(day: str) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))


def upsert_months(rows: DataFrame, path: str, key: list[str], day: str) -> None:
    """Put rows into a log kept by month: the new ones of a stored key replace the old.

    Only months in which a stored row has the key of a new one are written anew, each as a whole by
    dynamic partition overwrite; for the others the rows are new files beside the old. `rows` must be
    unique on the key, which holds the day, so equal keys meet in one month. A run that breaks off
    while it replaces a month can be repeated; two runs must not replace the same month at once.
    """
    spark, columns = rows.sparkSession, rows.columns
    rows = stash(rows.withColumn(MONTH, month_of(day)))
    old = read_months(spark, path, rows.drop(MONTH).schema)
    months = [r[MONTH] for r in rows.select(MONTH).distinct().collect()]  # one per month of a run's rows
    touched = old.where(F.col(MONTH).isin(months)) if months else old.limit(0)
    again = [r[MONTH] for r in touched.join(rows.select(*key), key, "left_semi")
             .select(MONTH).distinct().collect()]
    fresh = rows.where(~F.col(MONTH).isin(again)) if again else rows
    if again:
        whole = stash(upsert(old.where(F.col(MONTH).isin(again)), rows.where(F.col(MONTH).isin(again)),
                             key).select(*columns, MONTH))
        (whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(MONTH).parquet(path))
    if set(months) - set(again):
        fresh.write.mode("append").partitionBy(MONTH).parquet(path)


MONTH = "month"
VERSION = "seq long, folder string"


def current_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the newest complete version of a table."""
    try:
        rows = spark.read.schema(VERSION).parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = rows.agg(F.max(F.struct("seq", "folder")).alias("v")).first()["v"]
    return None if newest is None else (newest["seq"], newest["folder"])


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    if version is None:
        return None
    return spark.read.parquet(*[f"{path}/{f}" for f in version[1].split(",")])


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table: a new folder joins those of the version in force, none is rewritten."""
    _commit(rows, path, keep=True)


def overwrite(rows: DataFrame, path: str) -> None:
    """Replace a Parquet table that may be among the inputs of `rows`.

    The new version goes to a folder of its own; one row that names it is appended last, and readers
    follow the newest such row. A run that breaks off leaves the old version in force, and nothing is
    deleted or renamed, so runs that collide leave one of their versions whole. Of two that read the
    same version the last one counts, and what the other changed is lost: one writer per table. Older
    folders stay until they are cleared by whoever owns the store.
    """
    _commit(rows, path, keep=False)


def _commit(rows: DataFrame, path: str, keep: bool) -> None:
    spark, path = rows.sparkSession, path.rstrip("/")
    version = current_version(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    folders = [version[1], folder] if version and keep else [folder]
    (spark.createDataFrame([(version[0] + 1 if version else 1, ",".join(folders))], VERSION).coalesce(1)
     .write.mode("append").parquet(f"{path}/versions"))
