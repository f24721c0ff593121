"""Refresh of all tables in order, each persisted as it lands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.tables import (MONTH, overwrite, read_current, read_months, reconcile,
                                       replace_slice, upsert, upsert_months)
from eventide.plans import current, logs, outcomes
from eventide.plans.board import Tables, board
from eventide.schemas import KEYS, LOGS, TABLES
from eventide.storage import scope, stash


@dataclass
class Landed:
    """Typed landed inputs of one refresh."""

    calendar: DataFrame
    trials: DataFrame
    facts: DataFrame
    bars: DataFrame
    splits: DataFrame
    headlines: DataFrame
    filings: DataFrame
    insider_tx: DataFrame
    short_interest: DataFrame
    quotes: DataFrame
    docs: DataFrame
    benchmark: str = "BENCH"


class Store:
    """Parquet tables under one root: logs by month, all others by version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        if name in LOGS:
            return read_months(self.spark, self.path(name), TABLES[name]).drop(MONTH)
        found = read_current(self.spark, self.path(name))
        if found is None:
            return self.spark.createDataFrame([], TABLES[name])
        return reconcile(found, TABLES[name])

    def write(self, name: str, rows: DataFrame) -> None:
        schema = TABLES[name]
        overwrite(reconcile(rows, schema).select(*schema.fieldNames()), self.path(name))

    def upsert(self, name: str, rows: DataFrame) -> None:
        schema = TABLES[name]
        new = reconcile(rows, schema).select(*schema.fieldNames())
        self.write(name, upsert(self.read(name), new, KEYS[name]))

    def log(self, name: str, rows: DataFrame) -> None:
        """Add the changed rows; a rerun of a logged day rewrites the month of that day only."""
        self.put(name, logs.delta(self.read(name), rows, name))

    def put(self, name: str, rows: DataFrame) -> None:
        """Put rows into a log as they are."""
        schema = TABLES[name]
        upsert_months(reconcile(rows, schema).select(*schema.fieldNames()), self.path(name),
                      KEYS[name], LOGS[name])

    def tables(self) -> Tables:
        return Tables(**{n: self.read(n) for n in Tables.__dataclass_fields__})


def refresh(store: Store, landed: Landed, today, horizon: int = 180, lookback: int = 45,
            implied_horizon: int = 45, seeds: dict[str, str] | None = None,
            dumps: dict[str, str] | None = None) -> None:
    """Rebuild the calendar slice and every current table, score, log changes, measure outcomes.

    `seeds` names committed logs that are loaded first, so a run on an empty store keeps the
    history; `dumps` names the folders the logs are written to at the end. A failure in a later step
    leaves the earlier tables in place. Intermediate results go when the refresh ends, well or not.
    """
    with scope(store.spark):
        _refresh(store, landed, today, horizon, lookback, implied_horizon, seeds or {}, dumps or {})


def _refresh(store: Store, landed: Landed, today, horizon: int, lookback: int, implied_horizon: int,
             seeds: dict[str, str], dumps: dict[str, str]) -> None:
    day = F.lit(today).cast("date")
    for name, path in seeds.items():
        store.put(name, logs.committed(store.spark, name, path))
    schema = TABLES["catalysts"]
    # Read by six later steps, so the extraction behind it runs once.
    fresh = stash(reconcile(landed.calendar, schema).select(*schema.fieldNames()))
    store.write("catalysts", replace_slice(store.read("catalysts"), fresh, today, lookback,
                                           KEYS["catalysts"]))
    wanted = fresh.where("ticker is not null").select("ticker").distinct()
    store.upsert("trials", landed.trials.join(fresh.select("nct_id").distinct(), "nct_id",
                                              "left_semi"))

    def of_wanted(rows):
        return rows.join(wanted, "ticker", "left_semi")
    store.upsert("financials", current.financials(of_wanted(landed.facts), today=today))
    fins = store.read("financials")
    store.upsert("prices", current.prices(of_wanted(landed.bars), fins, landed.splits, today))
    names = fresh.where("ticker is not null").groupBy("ticker").agg(
        F.min("company_name").alias("company_name"))
    mood = current.sentiment(landed.headlines, names, landed.filings, today)
    mood = reconcile(mood, TABLES["sentiment"]).select(*TABLES["sentiment"].fieldNames())
    store.log("sentiment", mood)
    pairs = current.implied_pairs(fresh, store.read("prices"), today, implied_horizon)
    store.upsert("implied", current.implied_moves(pairs, landed.quotes, today))
    store.upsert("short_interest", current.latest_short_interest(of_wanted(landed.short_interest),
                                                                 today=today))
    store.write("financing", current.financing(wanted, landed.filings, fins, today))
    store.upsert("insider", current.insiders(wanted, landed.filings, landed.insider_tx, today))
    store.write("guidance", current.guidance(landed.docs, today))

    scored = stash(board(store.tables(), today, horizon))
    snap = outcomes.snapshot(scored, today)
    store.log("verdict_log", snap)
    store.upsert("outcomes", outcomes.outcomes(
        store.read("catalysts"), landed.bars, today, lookback, landed.benchmark)
        .withColumn("computed_at", day.cast("timestamp")))
    for name, path in dumps.items():
        logs.dump(store.read(name), name, path)
