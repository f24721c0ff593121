"""The catalyst calendar: trial readouts and decision dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.dates import fuzzy_date
from eventide.functions.text import (all_matches, drug_near, html_text, indication_mentions,
                                     indication_near, simple_stage, stable_id)
from eventide.operators.tables import reconcile
from eventide.schemas import TABLES
from eventide.sources.readers import candidate_readouts, filing_hits


def readout_rows(readouts: DataFrame) -> DataFrame:
    """Trial readouts as windows that open at completion."""
    lo = F.col("catalyst_date_lo")
    return (readouts.where("ticker is not null")
            .withColumn("catalyst_date_lo", fuzzy_date(F.col("primary_completion"))["lo"])
            .withColumns({
                "catalyst_date_hi": F.date_add(lo, fv.READOUT_WINDOW_DAYS),
                "date_precision": F.lit("readout_window"),
                "catalyst_date_raw": F.concat("primary_completion", F.lit(" + window")),
                "simplified_stage": simple_stage(F.col("stage")),
                "next_catalyst": F.lit("Primary completion"),
                "company_name": F.col("lead_sponsor"), "note": F.lit("clinicaltrials")}))


def decision_details(hits: DataFrame, text: str = "text", first_only: bool = False) -> DataFrame:
    """Decision dates that filing texts state, each with the drug and indication near it.

    A text gives a row for each stated date that is a date, at its offset `_at`; with `first_only` it
    gives one at most, for the first statement, and none if that is no date.
    """
    stated = all_matches(F.col(text), "(?i)" + fv.DECISION_DATE, 1)
    if first_only:
        stated = F.slice(stated, 1, 1)
    # Mentions are sought once per text, not once per date it states.
    rows = (hits.withColumn("_mentions", indication_mentions(F.col(text)))
            .withColumn("_m", F.explode(stated))
            .withColumn("catalyst_date_lo",
                        fuzzy_date(F.replace(F.col("_m.found"), F.lit(","), F.lit("")))["lo"])
            .where("catalyst_date_lo is not null").withColumn("_at", F.col("_m.at")))
    return (rows.withColumns({"drug_name": drug_near(F.col(text), F.col("_at")),
                              "indication": indication_near(F.col("_mentions"), F.col("_at"))})
            .drop("_m", "_mentions"))


def decision_rows(docs: DataFrame, today, months_back: int = 12,
                  first_only: bool = False) -> DataFrame:
    """Decision dates announced in event filings of the trailing year."""
    hits = filing_hits(docs, fv.DECISION_PHRASES, today, months_back).where("ticker is not null")
    read = hits.withColumn("text", html_text(F.col("html")))
    found = decision_details(read, first_only=first_only).drop("text", "html")
    # All hits are read; of those that state one date the first mention in the earliest filing stays.
    rest = F.struct("filed", "doc_id", "_at", *[c for c in found.columns if c not in (
        "ticker", "catalyst_date_lo", "filed", "doc_id", "_at")])
    found = (found.groupBy("ticker", "catalyst_date_lo").agg(F.min(rest).alias("r"))
             .select("ticker", "catalyst_date_lo", "r.*").drop("_at"))
    return (found.withColumns({
        "catalyst_date_hi": F.col("catalyst_date_lo"),
        "drug_name": F.coalesce("drug_name", F.lit(fv.NO_DRUG_NAME)),
        "date_precision": F.lit("day"),
        "catalyst_date_raw": F.col("catalyst_date_lo").cast("string"),
        "simplified_stage": F.lit("pdufa"), "stage": F.lit("PDUFA"),
        "next_catalyst": F.lit("PDUFA date"), "nct_id": F.lit(None).cast("string"),
        "note": F.lit("edgar")}))


def most_informative(calendar: DataFrame) -> DataFrame:
    """Best row per ticker, raw date and trial; decision dates then one per ticker and date.

    Rank is two for an indication plus one for a real drug name; the id settles ties.
    """
    rank = (F.col("indication").isNotNull().cast("int") * 2
            + (F.coalesce("drug_name", F.lit("")) != fv.NO_DRUG_NAME).cast("int"))
    decision = F.col("simplified_stage") == "pdufa"
    best = [rank.desc(), F.col("drug_id"), F.coalesce("drug_name", F.lit(""))]
    trial = F.coalesce("nct_id", F.lit(""))
    one = (calendar.withColumn("_k", F.row_number().over(
        W.partitionBy("ticker", "catalyst_date_raw", trial).orderBy(*best))).where("_k = 1"))
    # Trials keep their own id in the second key, so only decision dates can meet there.
    slot = F.when(decision, "").otherwise(F.concat(F.lit("t"), trial))
    return (one.withColumn("_k", F.row_number().over(
        W.partitionBy("ticker", "catalyst_date_raw", slot).orderBy(*best)))
        .where("_k = 1").drop("_k"))


def build_calendar(trials: DataFrame, registry: DataFrame, docs: DataFrame | None, today,
                   horizon: int = 180, lookback: int = 45) -> DataFrame:
    """Union of trial readouts and decision dates in the stored table's columns."""
    rows = readout_rows(candidate_readouts(trials, registry, today, horizon, lookback))
    if docs is not None:
        rows = rows.unionByName(decision_rows(docs, today), allowMissingColumns=True)
    floor = F.date_sub(F.lit(today).cast("date"), lookback)
    rows = rows.where(F.col("catalyst_date_hi") >= floor).withColumns({
        "drug_id": stable_id(F.col("ticker"), F.col("nct_id"), F.col("catalyst_date_raw")),
        "designations": F.lit("")})
    schema = TABLES["catalysts"]
    return most_informative(reconcile(rows, schema).select(*schema.fieldNames()))
