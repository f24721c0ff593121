"""Realised outcomes, the verdict that was live before them, and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.operators.asof import asof_join
from eventide.operators.panel import price_panel, realised_moves
from eventide.operators.tables import last_per_key


def passed_catalysts(catalysts: DataFrame, today, lookback: int = 45) -> DataFrame:
    """Passed catalysts of the window whose date is precise enough to measure a move."""
    day = F.lit(today).cast("date")
    return (catalysts.where((F.col("catalyst_date_hi") < day)
                            & (F.col("catalyst_date_lo") >= F.date_sub(day, lookback))
                            & F.col("ticker").isNotNull()
                            & F.col("date_precision").isin(*fv.USABLE_PRECISION))
            .select("drug_id", "ticker", F.col("catalyst_date_lo").alias("catalyst_date")))


def outcomes(catalysts: DataFrame, bars: DataFrame, today, lookback: int = 45,
             benchmark: str = "BENCH") -> DataFrame:
    past = passed_catalysts(catalysts, today, lookback)
    day = F.lit(today).cast("date")
    seen = bars.where(F.col("day") <= day)
    return realised_moves(past, price_panel(seen, F.date_sub(day, lookback + 30), day, past, benchmark))


def recent(outcome_rows: DataFrame, catalysts: DataFrame, verdict_log: DataFrame, today,
           lookback: int = 45) -> DataFrame:
    """Outcomes of the window with the last verdict logged strictly before the event.

    Snapshots on or after the event are filtered before the latest is chosen.
    """
    o = outcome_rows.where(
        F.col("catalyst_date") >= F.date_sub(F.lit(today).cast("date"), lookback))
    text = catalysts.select("drug_id", "drug_name", "indication", "stage", "company_name",
                            "catalyst_date_raw")
    one = last_per_key(text, ["drug_id"], F.struct(F.col("catalyst_date_raw")))
    log = verdict_log.select(
        "drug_id", "snapshot_date", F.col("verdict").alias("prior_verdict"),
        F.col("setup").alias("prior_setup"), F.col("conviction").alias("prior_conviction"),
        F.col("snapshot_date").alias("verdict_asof"))
    judged = asof_join(o, log, "drug_id", "catalyst_date", "snapshot_date",
                       ["prior_verdict", "prior_setup", "prior_conviction", "verdict_asof"],
                       strict=True)
    return judged.join(one, "drug_id", "left")


def order_recent(rows: DataFrame, by: str = "move") -> DataFrame:
    """Largest absolute move to date first, or newest first; the id settles ties."""
    first = (F.abs(F.coalesce("move_todate", F.lit(0.0))).desc() if by == "move"
             else F.col("catalyst_date").desc())
    return rows.orderBy(first, "drug_id")


def up_down(rows: DataFrame) -> DataFrame:
    up = F.coalesce(F.col("move_todate"), F.lit(0.0)) > 0
    return rows.agg(F.count_if(up).alias("up"), F.count_if(~up).alias("down"))


def snapshot(board: DataFrame, today, pulled_at=None) -> DataFrame:
    """Today's verdicts, one per drug: the most convinced row when a drug has several."""
    rows = board.select(
        "drug_id", F.lit(today).cast("date").alias("snapshot_date"), "ticker",
        F.col("catalyst_date_lo").alias("catalyst_date"), "verdict", "setup", "conviction",
        "evidence", F.lit(pulled_at).cast("timestamp").alias("pulled_at"))
    return last_per_key(rows, ["drug_id", "snapshot_date"], F.struct(
        F.col("conviction"), -F.datediff("catalyst_date", F.lit("1970-01-01").cast("date"))))
