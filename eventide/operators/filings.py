"""Filing cadence and financing posture as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.scoring import dilution_readiness
from eventide.functions.text import nearest
from eventide.operators.asof import Feature, in_order, running, with_features, with_leaving


def has_prefix(form: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | form.startswith(p)
    return out


def cadence_feature(filings: DataFrame, distinct_days: bool = True) -> Feature:
    """8-K counts of the trailing 30, 90 and 365 days, days since the last, and burst.

    Burst is the 90-day count against the trailing-year quarterly rate; it needs a rate of 0.75.
    Point-in-time studies count distinct days, the live view counts filings.
    """
    one = F.lit(1) if distinct_days else F.count("*")
    daily = (filings.where(F.col("form").startswith("8-K") & F.col("filed").isNotNull())
             .groupBy("ticker", F.col("filed").alias("day"))
             .agg((F.max(one) if distinct_days else one).alias("_eightk"))
             .withColumn("_eightk_day", F.col("day")))
    # Today and so many days before it.
    daily = with_leaving(daily, ["ticker"], {f"_in_{n}": ("_eightk", n + 1) for n in (30, 90, 365)})

    def state(stream):
        def count(days):
            return running(f"_in_{days}", "ticker").cast("int")
        last = F.last("_eightk_day", ignorenulls=True).over(in_order("ticker"))
        rate = F.col("eightk_365d") / 4.0
        return (stream.withColumns({
            "eightk_30d": count(30), "eightk_90d": count(90), "eightk_365d": count(365),
            "days_since_8k": F.datediff("day", last)})
            .withColumn("burst", F.when(rate >= 0.75, nearest(F.col("eightk_90d") / rate, 3))))
    return Feature(daily, state, ("eightk_30d", "eightk_90d", "eightk_365d", "days_since_8k", "burst"))


def cadence_asof(probes: DataFrame, filings: DataFrame, probe_day: str = "asof",
                 distinct_days: bool = True) -> DataFrame:
    """Probe rows with the filing cadence as of their day."""
    return with_features(probes, [cadence_feature(filings, distinct_days)], "ticker", probe_day)


def financing_feature(filings: DataFrame) -> Feature:
    """Shelf and offering posture on each day. Form families are prefix tests."""
    shelf = has_prefix(F.col("form"), fv.SHELF_FORMS)
    offering = has_prefix(F.col("form"), fv.OFFERING_FORMS)
    daily = (filings.where((shelf | offering) & F.col("filed").isNotNull())
             .groupBy("ticker", F.col("filed").alias("day"))
             .agg(F.count_if(shelf).alias("_shelves"), F.count_if(offering).alias("_offers")))
    daily = with_leaving(daily, ["ticker"], {"_in_730": ("_offers", 731)})

    def state(stream):
        upto = in_order("ticker")

        def last_day(n):
            return F.max(F.when(F.col(n) > 0, F.col("day"))).over(upto)

        def count(n):
            return running(n, "ticker").cast("int")
        age = F.datediff("day", "last_shelf_date")
        return (stream.withColumns({
            "last_shelf_date": last_day("_shelves"), "shelf_count": count("_shelves"),
            "last_offering_date": last_day("_offers"),
            "offerings_24m": count("_in_730"),
            "offerings_total": count("_offers")})
            .withColumns({
                "shelf_age_days": age,
                "shelf_live": F.coalesce(age <= fv.SHELF_LIFE_DAYS, F.lit(False)),
                "days_since_offering": F.datediff("day", "last_offering_date")}))
    return Feature(daily, state, (
        "last_shelf_date", "shelf_count", "last_offering_date", "offerings_24m", "offerings_total",
        "shelf_age_days", "shelf_live", "days_since_offering"))


def financing_asof(probes: DataFrame, filings: DataFrame, probe_day: str = "asof") -> DataFrame:
    """Probe rows with the financing posture on their day."""
    return with_features(probes, [financing_feature(filings)], "ticker", probe_day)


def with_readiness(posture: DataFrame, runway: str = "runway_months") -> DataFrame:
    """Add dilution readiness, label and notes to a posture with a runway column."""
    r = dilution_readiness(F.col("shelf_live"), F.col("offerings_24m"),
                           F.col("days_since_offering"), F.col(runway))
    return posture.withColumn("_r", r).select("*", "_r.*").drop("_r")
