"""Feature frame, scored board, board views and the published document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions import priors
from eventide.functions.dates import narrow
from eventide.functions.priors import lookup
from eventide.functions.scoring import headline_reason, scored, squeeze_metrics
from eventide.functions.text import therapeutic_area

# Columns each per-ticker table adds to the feature frame, as {output: input}, with the date that
# picks the newest row of the logs.
PROFILE = {
    "financials": (None, {x: x for x in ("cash_usd", "quarterly_burn_usd", "runway_months",
                                         "shares_outstanding", "cash_asof")}),
    "prices": (None, {x: x for x in ("last", "ret_20d", "ret_60d", "rvol_20d", "rvol_60d",
                                     "adv_usd", "pct_of_52w_high", "market_cap")}),
    "sentiment": ("snapshot_date", {
        "sentiment": "sentiment", "sentiment_thin": "thin", "news_articles": "articles",
        "scored_articles": "scored_articles", "top_positive": "top_positive",
        "top_negative": "top_negative", "eightk_30d": "eightk_30d", "eightk_90d": "eightk_90d",
        "days_since_8k": "days_since_8k"}),
    "short_interest": ("settlement_date", {
        "shares_short": "shares_short", "shares_short_prior": "shares_short_prior",
        "days_to_cover": "days_to_cover", "short_asof": "settlement_date"}),
    "financing": (None, {x: x for x in ("dilution_label", "dilution_readiness", "offerings_24m",
                                        "days_since_offering", "shelf_live",
                                        "last_offering_date")}),
    "guidance": (None, {"guide_lo": "period_lo", "guide_hi": "period_hi",
                        "guide_phrase": "phrase", "guide_filed": "filed"}),
    "insider": ("snapshot_date", {
        "insider_tilt": "insider_tilt", "insider_net_usd": "net_usd",
        "form4_filings": "form4_filings", "senior_net_usd": "senior_net_usd",
        "cluster_buy": "cluster_buy", "n_buyers": "n_buyers",
        "biggest_delta_own": "biggest_delta_own", "biggest_move_desc": "biggest_move_desc"}),
}
TRIAL = ("overall_status", "phases", "enrollment", "allocation", "masking",
         "primary_completion", "lead_sponsor")


@dataclass
class Tables:
    """The tables the board reads."""

    catalysts: DataFrame
    trials: DataFrame
    financials: DataFrame
    prices: DataFrame
    implied: DataFrame
    sentiment: DataFrame
    short_interest: DataFrame
    financing: DataFrame
    guidance: DataFrame
    insider: DataFrame


def ticker_profile(t: Tables, today=None) -> DataFrame:
    """One wide row per ticker from seven per-ticker tables, newest row of the logs by the run date
    (short interest: of those published by then).

    The tables are stacked and reduced by ticker in one aggregation, instead of one window or
    join each: a single shuffle, combined on the map side, so a long log of one ticker is cheap.
    """
    parts = []
    for name, (order, columns) in PROFILE.items():
        packed = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
        day = F.col(order).cast("date") if order else F.lit("1970-01-01").cast("date")
        rows = getattr(t, name)
        if order and today is not None:
            known = "published_date" if "published_date" in rows.columns else order
            rows = rows.where(F.col(known).cast("date") <= F.lit(today).cast("date"))
        parts.append(rows.select("ticker", packed.alias(name), day.alias("_day")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    wide = (stacked.where("ticker is not null").groupBy("ticker").agg(*[
        F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_day"))).alias(n) for n in PROFILE]))
    return wide.select("ticker", *[F.col(f"{n}.{out}").alias(out)
                                   for n, (_, cols) in PROFILE.items() for out in cols])


def joined(t: Tables, horizon: int | None = None, today=None) -> DataFrame:
    """Catalysts with trial design, ticker profile and the implied move of their date.

    With a run date, rows that can no longer be upcoming are dropped before any join: narrowing
    only moves the window inward, so an end before today stays before today.
    """
    c = t.catalysts
    if today is not None:
        c = c.where(F.col("catalyst_date_hi") >= F.lit(today).cast("date"))
        if horizon is not None:
            last = F.date_add(F.lit(today).cast("date"), horizon)
            c = c.where(F.col("catalyst_date_lo") <= last)
    implied = t.implied.select("ticker", F.col("catalyst_date").alias("catalyst_date_lo"),
                               "atm_iv", "implied_move", F.col("expiry").alias("implied_expiry"))
    designed = c.join(t.trials.select("nct_id", *TRIAL), "nct_id", "left")
    return (with_prior(designed).join(implied, ["ticker", "catalyst_date_lo"], "left")
            .join(ticker_profile(t, today), "ticker", "left"))


def with_prior(rows: DataFrame) -> DataFrame:
    """Area, approval prior and trial design: all that needs only the event and its trial.

    Computed before the ticker joins, in a stage of its own.
    """
    c = F.col
    return rows.withColumns({
        "ta": therapeutic_area(c("indication")),
        "design_bucket": priors.design_bucket(c("allocation"), c("masking")),
    }).withColumns({
        "loa": priors.approval_prior(c("simplified_stage"), c("indication"),
                                     c("designations"), c("ta")),
        "design_multiplier": priors.design_multiplier(c("design_bucket"), c("enrollment"),
                                                      c("simplified_stage")),
        "design_note": priors.design_note(c("design_bucket"), c("enrollment"))})


def features(t: Tables, today, horizon: int = 180) -> DataFrame:
    """One row per upcoming catalyst with every derived feature."""
    c = F.col
    run_day = F.lit(today).cast("date")
    d = joined(t, horizon, today)
    is_window = c("date_precision") == "readout_window"
    n = narrow(c("catalyst_date_lo"), c("catalyst_date_hi"), c("guide_lo"), c("guide_hi"))
    plain = F.struct(c("catalyst_date_lo").alias("lo"), c("catalyst_date_hi").alias("hi"),
                     F.lit("trial").alias("source"))
    d = (d.withColumn("_n", F.when(F.coalesce(is_window, F.lit(False)), n).otherwise(plain))
         .withColumns({
             "catalyst_date_lo": c("_n.lo"), "catalyst_date_hi": c("_n.hi"),
             "date_source": c("_n.source"),
             "date_precision": F.when(c("_n.source") == "guidance", "guidance")
             .otherwise(c("date_precision"))}).drop("_n"))
    d = d.withColumn("days_to_catalyst", F.datediff("catalyst_date_lo", run_day))
    d = d.where((c("catalyst_date_hi") >= run_day) & (c("days_to_catalyst") <= horizon))
    d = d.withColumns({
        "date_confidence": lookup(c("date_precision"), fv.PRECISION_WEIGHT, 0.0),
        "expected_move": priors.typical_move(c("simplified_stage"), c("market_cap")),
        "baseline_move": c("rvol_60d") * F.sqrt(
            F.greatest(c("days_to_catalyst"), F.lit(1)) / 252.0),
        "runway_at_catalyst": c("runway_months") - c("days_to_catalyst") / 30.44,
        "runway_stale": F.coalesce(c("last_offering_date") > c("cash_asof"), F.lit(False)),
        "is_binary": F.coalesce(c("simplified_stage").isin(*fv.BINARY_STAGES), F.lit(False)),
        "microcap": F.coalesce(c("market_cap"), F.lit(0.0)) < 300e6,
        "illiquid": F.coalesce(c("adv_usd"), F.lit(0.0)) < 1e6,
        "_squeeze": squeeze_metrics(c("shares_short"), c("days_to_cover"),
                                    c("shares_outstanding"), c("shares_short_prior")),
    })
    material = (F.when(c("baseline_move") == 0, F.lit(float("inf")))
                .otherwise(c("expected_move") / c("baseline_move")))
    return (d.withColumns({
        "move_ratio": c("implied_move") / c("expected_move"),
        "materiality": F.when(c("market_cap").isNotNull(), material),
    }).select("*", "_squeeze.*").drop("_squeeze"))


def board(t: Tables, today, horizon: int = 180) -> DataFrame:
    """Scored rows. Building them starts no job; who reads them often stores them first.

    The rows are counted as they pass (metric `scored_board`), so a filter on them stays above the scoring
    and is not rewritten through its whole expression.
    """
    return scored(features(t, today, horizon)).observe(
        "scored_board", F.count(F.lit(1)).alias("rows"))


# --- views ------------------------------------------------------------------------------------

ORDER = {"conviction": (F.desc, "conviction", F.asc, "days_to_catalyst"),
         "date": (F.asc, "days_to_catalyst", F.desc, "conviction")}


def ordered(rows: DataFrame, sort: str = "conviction") -> DataFrame:
    """Conviction order or date order; the id settles what both leave open."""
    first, a, second, b = ORDER[sort]
    return rows.orderBy(first(a), second(b), F.asc("drug_id"))


def matches(query: str) -> Column:
    """Case-insensitive search over ticker, drug and indication."""
    q = query.strip().lower()
    return (F.lower(F.col("ticker")).contains(q)
            | F.coalesce(F.lower(F.col("drug_name")).contains(q), F.lit(False))
            | F.coalesce(F.lower(F.col("indication")).contains(q), F.lit(False)))


def view(rows: DataFrame, show: str = "ALL", min_conviction: int = 0,
         horizon: int | None = None, search: str | None = None, sort: str = "date",
         limit: int | None = None) -> DataFrame:
    """Filter, search, order and cut the board. `show` is ALL, ACTIONABLE, supported or a setup."""
    if show == "ACTIONABLE":
        rows = rows.where(F.col("setup") != "NO_EDGE")
    elif show == "supported":
        rows = rows.where(F.col("evidence") == "supported")
    elif show != "ALL":
        rows = rows.where(F.col("setup") == show.upper())
    if min_conviction:
        rows = rows.where(F.col("conviction") >= min_conviction)
    if horizon is not None:
        rows = rows.where(F.col("days_to_catalyst") <= horizon)
    if search:
        rows = rows.where(matches(search))
    rows = ordered(rows, sort)
    return rows.limit(limit) if limit else rows


def verdict_tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


# --- published document -----------------------------------------------------------------------

def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _number(name: str) -> Column:
    c = F.col(name)
    return F.when(~F.isnan(c), c)


def published(rows: DataFrame) -> DataFrame:
    """Board rows in their published columns; dates as ISO text, NaN as NULL."""
    c = F.col
    return rows.select(
        "ticker", F.concat(F.lit(fv.QUOTE_PAGE), c("ticker")).alias("robinhood"),
        c("company_name").alias("company"), c("drug_name").alias("drug"), "indication", "stage",
        c("catalyst_date_raw").alias("date"), c("days_to_catalyst").alias("days"),
        c("date_precision").alias("precision"), _iso(c("catalyst_date_hi")).alias("date_hi"),
        "date_source", "guide_phrase", "verdict", "directional", "setup", "conviction",
        "evidence", "evidence_note", _number("loa").alias("loa"),
        _number("implied_move").alias("implied"), _number("expected_move").alias("expected"),
        _number("runway_months").alias("runway"), _number("ret_20d").alias("ret20"),
        _number("market_cap").alias("mcap"), _number("sentiment").alias("sentiment"),
        c("scored_articles").alias("sent_n"),
        F.coalesce(c("sentiment_thin"), F.lit(True)).alias("sent_thin"),
        c("eightk_90d").alias("eightk"), _number("days_to_cover").alias("dtc"),
        _number("short_pct_outstanding").alias("short_pct"), c("squeeze_label").alias("squeeze"),
        _iso(c("short_asof")).alias("short_asof"), "offerings_24m",
        c("dilution_label").alias("dilution"), "runway_stale",
        _iso(c("cash_asof")).alias("cash_asof"), c("design_bucket").alias("design"),
        "design_note", "enrollment", "days_since_offering",
        _number("insider_tilt").alias("insider_tilt"), "form4_filings",
        F.coalesce(c("cluster_buy"), F.lit(False)).alias("cluster_buy"),
        _number("senior_net_usd").alias("senior_net_usd"),
        c("biggest_move_desc").alias("insider_note"),
        F.coalesce(F.nullif(c("top_negative"), F.lit("")), c("top_positive")).alias("headline"),
        "reasons", F.coalesce(headline_reason(c("reason_list")), c("reasons"))
        .alias("headline_reason"),
        F.greatest(F.size("reason_list"), F.lit(1)).alias("n_reasons"),
        c("nct_id").alias("nct"), "drug_id")


def published_recent(recent: DataFrame) -> DataFrame:
    """Recent outcomes in their published columns."""
    c = F.col
    return recent.select(
        "ticker", F.concat(F.lit(fv.QUOTE_PAGE), c("ticker")).alias("robinhood"),
        c("drug_name").alias("drug"), "indication", "stage",
        _iso(c("catalyst_date")).alias("date"), "move_1d", "abn_1d", "move_todate", "abn_todate",
        F.coalesce(_iso(c("last_date")), F.lit("")).alias("last_date"), "prior_verdict",
        "prior_conviction")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
                       .alias("value"))


def publish(rows: DataFrame, recent: DataFrame, path: str, generated: str,
            horizon: int) -> None:
    """Write the document as JSON lines: `header`, `rows` in date order, and `recent`."""
    out = published(ordered(rows, "date")).drop("drug_id")
    as_json(out).write.mode("overwrite").text(f"{path}/rows")
    as_json(published_recent(recent)).write.mode("overwrite").text(f"{path}/recent")
    header = (rows.sparkSession.read.text(f"{path}/rows")
              .agg(F.count("*").alias("count"))
              .select(F.lit(generated).alias("generated"), F.lit(horizon).alias("horizon"),
                      "count"))
    as_json(header).write.mode("overwrite").text(f"{path}/header")
