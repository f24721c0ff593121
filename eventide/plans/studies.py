"""Point-in-time event studies.

Each study is the same pipeline: periodic filing dates become events, events get
benchmark-adjusted returns, what was knowable on the entry date is attached, and bucketed returns
are summarised. They differ in the attached features and the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions import buckets as bk
from eventide.functions.priors import approval_prior, design_bucket
from eventide.operators.asof import (Feature, latest_feature, product_feature, range_product,
                                     with_features)
from eventide.operators.facts import KINDS, financials_feature, periodic_filing_dates
from eventide.operators.filings import cadence_feature, financing_feature, with_readiness
from eventide.operators.inference import summarize
from eventide.operators.insiders import insiders_feature
from eventide.operators.panel import event_returns, missing_tickers, price_panel


@dataclass
class Market:
    """Landed tables the studies read."""

    bars: DataFrame
    filings: DataFrame
    facts: DataFrame
    splits: DataFrame | None = None
    short_interest: DataFrame | None = None
    insider_tx: DataFrame | None = None
    kinds: dict | None = None
    benchmark: str = "BENCH"


@dataclass
class Study:
    """Labelled events of a study and the cuts to summarise."""

    name: str
    events: DataFrame
    cuts: dict
    horizons: tuple
    categories: dict | None = None

    def summary(self, n_boot: int = fv.N_BOOT, seed: int = 0) -> DataFrame:
        out = summarize(self.events, self.cuts, self.horizons, n_boot, seed, self.categories)
        return out.select(F.lit(self.name).alias("study"), "*")

    def write_events(self, path: str) -> None:
        """The labelled events as CSV with a header, in order of date and ticker."""
        (self.events.orderBy("event_date", "ticker").write.mode("overwrite")
         .option("header", True).csv(path))

    def coverage(self, bars: DataFrame, asked: DataFrame, start, end) -> DataFrame:
        """Observations and tickers of the study, and asked tickers without a usable history."""
        rows = self.events.select(F.lit(1).alias("o"), F.col("ticker").alias("t"),
                                  F.lit(None).cast("int").alias("m"))
        gone = missing_tickers(bars, asked, start, end).select(
            F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(1))
        return rows.unionAll(gone).agg(F.count("o").alias("observations"),
                                       F.count_distinct("t").alias("tickers"),
                                       F.count("m").alias("missing_tickers"))


def filing_returns(m: Market, start, end, horizons=fv.FACTOR_HORIZONS) -> DataFrame:
    """Returns of periodic-filing events, entered on the first session on or after the filing."""
    events = periodic_filing_dates(m.filings, start, end)
    panel = price_panel(m.bars, start, end, events.select("ticker"), m.benchmark)
    return event_returns(events, panel, horizons, 0)


def known_at_entry(m: Market, start, end, horizons, *more: Feature) -> DataFrame:
    """Filing returns with runway, cash, shares and `more` as known on the entry date.

    A ticker has one event per filing date, so the events ride on its timeline: facts of all features
    meet them in one shuffle and nothing is joined back.
    """
    features = [financials_feature(m.facts, m.kinds or KINDS), *more]
    return with_features(filing_returns(m, start, end, horizons), features, "ticker", "entry_date",
                         carry=True)


def restated_cap(price: str = "entry_price") -> Column:
    """Shares restated by all later splits, times the back-adjusted price."""
    return F.col("shares_outstanding") * F.col("split_factor") * F.col(price)


def with_market_cap(events: DataFrame, splits: DataFrame | None,
                    price: str = "entry_price", day: str = "entry_date") -> DataFrame:
    """Events with shares and a price, and their market value on a day."""
    if splits is None:
        events = events.withColumn("split_factor", F.lit(1.0))
    else:
        events = range_product(events, splits, "ticker", day, "day", "ratio", "split_factor")
    return events.withColumn("market_cap", restated_cap(price)).drop("split_factor")


def _low() -> Column:
    return F.col("runway_months") < fv.RUNWAY_CRITICAL_MONTHS


def runway_study(m: Market, start, end, horizons=fv.FACTOR_HORIZONS) -> Study:
    splits = [] if m.splits is None else [
        product_feature(m.splits, "ticker", "day", "ratio", "split_factor")]
    e = known_at_entry(m, start, end, horizons, *splits).where("cash_usd is not null")
    if not splits:
        e = e.withColumn("split_factor", F.lit(1.0))
    e = e.withColumn("market_cap", restated_cap()).drop("split_factor")
    distressed = F.coalesce(_low() & (F.col("market_cap") < 300e6), F.lit(False))
    e = e.withColumns({
        "runway_bucket": bk.runway_bucket(F.col("runway_months")),
        "size_bucket": bk.size_bucket(F.col("market_cap")),
        "distressed_micro": F.when(distressed, "distressed micro").otherwise("everything else")})
    return Study("runway", e, {"by_runway": "runway_bucket", "by_size": "size_bucket",
                               "by_setup": "distressed_micro"}, horizons)


def cadence_study(m: Market, start, end, horizons=fv.FACTOR_HORIZONS) -> Study:
    e = known_at_entry(m, start, end, horizons, cadence_feature(m.filings))
    e = e.withColumns({
        "burst_bucket": bk.burst_bucket(F.col("burst")),
        "count_bucket": bk.count_bucket(F.col("eightk_90d")),
        "interaction": bk.interaction(_low(), F.col("burst") >= 1.5, "low runway + burst",
                                      "low runway only", "burst only")})
    return Study("cadence", e, {"by_burst": "burst_bucket", "by_count": "count_bucket",
                                "by_interaction": "interaction"}, horizons)


def short_interest_feature(short_interest: DataFrame) -> Feature:
    """The reading last published on or before each day; the earlier settlement wins a tie."""
    return latest_feature(short_interest, "ticker", "published_date",
                          ["days_to_cover", "shares_short"], name="_reading",
                          tie=-F.datediff("settlement_date", F.lit("1970-01-01").cast("date")))


def short_interest_asof(events: DataFrame, short_interest: DataFrame,
                        day: str = "entry_date") -> DataFrame:
    """Events with the short-interest reading known on a day."""
    return with_features(events, [short_interest_feature(short_interest)], "ticker", day)


def squeeze_study(m: Market, start, end, horizons=fv.FACTOR_HORIZONS) -> Study:
    e = known_at_entry(m, start, end, horizons, short_interest_feature(m.short_interest))
    e = e.withColumns({
        "dtc_bucket": bk.cover_bucket(F.col("days_to_cover")),
        "interaction": bk.interaction(_low(), F.col("days_to_cover") >= 5,
                                      "low runway + crowded short", "low runway, uncrowded",
                                      "crowded short only")})
    return Study("squeeze", e, {"by_dtc": "dtc_bucket", "by_interaction": "interaction"},
                 horizons)


def financing_study(m: Market, start, end, horizons=fv.FACTOR_HORIZONS) -> Study:
    e = with_readiness(known_at_entry(m, start, end, horizons, financing_feature(m.filings)))
    recent = F.coalesce(F.col("days_since_offering") <= 120, F.lit(False))
    e = e.withColumns({
        "recent_deal": F.when(recent, "priced <120d ago").otherwise("no recent deal"),
        "interaction": bk.interaction(_low(), F.col("offerings_24m") >= 2,
                                      "low runway + serial issuer", "low runway, rare issuer",
                                      "serial issuer only")})
    return Study("financing", e, {"by_readiness": "dilution_label",
                                  "by_recent_deal": "recent_deal",
                                  "by_interaction": "interaction"}, horizons)


def insider_study(m: Market, start, end, horizons=fv.FACTOR_HORIZONS) -> Study:
    tx = m.insider_tx.where(F.col("code").isin("P", "S"))
    filers = periodic_filing_dates(m.filings, start, end).select("ticker").distinct()
    tx = tx.join(filers, "ticker", "left_semi")
    e = known_at_entry(m, start, end, horizons, insiders_feature(tx))
    e = e.withColumns({
        "net_bucket": bk.net_flow_bucket(F.col("insider_net_usd")),
        "cluster": F.when(F.col("insider_buyers") >= 3, "cluster buy (3+ filings)")
        .otherwise("no cluster"),
        "interaction": bk.interaction(_low(), F.col("insider_net_usd") > 0,
                                      "low runway + insiders buying",
                                      "low runway, no insider buying",
                                      "insiders buying only")})
    return Study("insider", e, {"by_net": "net_bucket", "by_cluster": "cluster",
                                "by_interaction": "interaction"}, horizons)


def readout_study(readouts: DataFrame, bars: DataFrame, start, end,
                  horizons=fv.READOUT_HORIZONS, benchmark: str = "BENCH") -> Study:
    """Trial readouts entered five sessions ahead, cut by stage, prior, run-up and design.

    `readouts` has one row per nct_id with ticker, event_date and the trial's design columns.
    """
    panel = price_panel(bars, start, end, readouts.select("ticker"), benchmark)
    slim = readouts.select("ticker", "event_date", "anchor", "nct_id")
    e = event_returns(slim, panel, horizons, fv.READOUT_ENTRY_OFFSET)
    meta = readouts.select("nct_id", "indication", "simplified_stage", "allocation", "masking",
                           "enrollment")
    e = e.join(meta, "nct_id", "left").withColumn(
        "loa", approval_prior(F.col("simplified_stage"), F.col("indication")))
    e = e.withColumns({
        "prior_bucket": bk.cut(F.col("loa"), fv.PRIOR_CUTS),
        "design_bucket": design_bucket(F.col("allocation"), F.col("masking")),
        "enroll_bucket": bk.cut(F.col("enrollment").cast("double"), fv.ENROLLMENT_CUTS),
        "runup_bucket": bk.cut(F.col("ret_20d"), fv.RUNUP_CUTS)})
    cuts = {"by_stage": "simplified_stage", "by_prior": "prior_bucket",
            "by_runup": "runup_bucket", "by_design": "design_bucket",
            "by_enrollment": "enroll_bucket", "overall": None}
    grid = {"by_prior": [x[2] for x in fv.PRIOR_CUTS], "by_runup": [x[2] for x in fv.RUNUP_CUTS],
            "by_enrollment": [x[2] for x in fv.ENROLLMENT_CUTS]}
    return Study("readout", e, cuts, horizons, grid)
