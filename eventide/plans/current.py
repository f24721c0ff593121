"""The current tables: prices, financials, sentiment, insiders, short interest, financing,
guidance and implied moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.dates import guided_period
from eventide.functions.sentiment import Lexicon, lexicon_hits
from eventide.functions.text import (all_matches, company_tokens, headline_key, html_text,
                                     names_company, nearest, squeeze)
from eventide.operators.facts import KINDS, current_financials
from eventide.operators.filings import cadence_asof, financing_asof, with_readiness
from eventide.operators.insiders import current_insiders
from eventide.operators.panel import price_statistics
from eventide.plans.studies import with_market_cap
from eventide.sources.readers import filing_hits


def prices(bars: DataFrame, financials: DataFrame, splits: DataFrame | None, today) -> DataFrame:
    """Price statistics with market cap from filed shares restated by later splits."""
    p = (price_statistics(bars, today).withColumn("asof", F.lit(today).cast("date"))
         .join(financials.select("ticker", "shares_outstanding"), "ticker", "left"))
    return with_market_cap(p, splits, "last", "asof").drop("asof", "shares_outstanding")


def financials(facts: DataFrame, kinds: dict = KINDS, today=None) -> DataFrame:
    """Current facts of each ticker as filed by the run date."""
    return current_financials(facts, kinds, today)


def unique_headlines(headlines: DataFrame) -> DataFrame:
    """One headline per ticker and duplicate key: first source, then first position, then date,
    link and title, so the choice does not depend on the order of the input."""
    keyed = headlines.withColumn("key", headline_key(F.col("title"))).where("key != ''")
    rest = F.struct("title", "published", "link", "source", "pos")
    return (keyed.groupBy("ticker", "key")
            .agg(F.min_by(rest, F.struct(F.when(F.col("source") == "rss", 0).otherwise(1), "pos",
                                         "published", "link", "title"))
                 .alias("h")).select("ticker", "h.*"))


def relevant_headlines(headlines: DataFrame, companies: DataFrame) -> DataFrame:
    """Headlines that name their company: `companies` has (ticker, company_name)."""
    named = companies.select("ticker", company_tokens(
        F.col("ticker"), F.col("company_name")).alias("_tokens"))
    return (headlines.join(named, "ticker", "left")
            .withColumn("_tokens", F.coalesce("_tokens", F.array(F.lower("ticker"))))
            .where(names_company(F.col("title"), F.col("_tokens"))).drop("_tokens"))


def sentiment_scores(headlines: DataFrame, today, lex: Lexicon = Lexicon(),
                     days: int = 21) -> DataFrame:
    """Recency-weighted score per ticker with a one-week half-life, counts and extremes.

    The most positive and negative headline are the first with the extreme net count.
    """
    h = (headlines.select("ticker", "title", "published", "source", F.col("pos").alias("at"),
                          lexicon_hits(F.col("title"), lex).alias("_h"))
         .select("ticker", "title", "published", "source", "at", "_h.pos", "_h.neg"))
    day = F.lit(today).cast("date")
    age = F.greatest(F.lit(0), F.coalesce(F.datediff(day, "published"), F.lit(days)))
    weight = F.pow(F.lit(0.5), age / 7.0)
    net, hits = F.col("pos") - F.col("neg"), F.col("pos") + F.col("neg")
    early = F.struct(net, -F.when(F.col("source") == "rss", 0).otherwise(1), -F.col("at"),
                     F.col("title"))
    late = F.struct(net, F.when(F.col("source") == "rss", 0).otherwise(1), F.col("at"),
                    F.col("title"))
    num, den = F.sum(net * weight), F.sum(hits * weight)
    total = F.sum(hits)
    return h.groupBy("ticker").agg(
        F.count("*").cast("int").alias("articles"), total.cast("int").alias("scored_articles"),
        F.sum("pos").cast("int").alias("pos_hits"), F.sum("neg").cast("int").alias("neg_hits"),
        F.when(den != 0, nearest(num / den, 3)).otherwise(0.0).alias("sentiment"),
        (total < 4).alias("thin"),
        F.max_by("title", F.when(net > 0, early)).alias("top_positive"),
        F.min_by("title", F.when(net < 0, late)).alias("top_negative"))


def sentiment(headlines: DataFrame, companies: DataFrame, filings: DataFrame, today,
              days: int = 21, lex: Lexicon = Lexicon()) -> DataFrame:
    """One row per company: deduplicated, on-topic, scored headlines and filing cadence."""
    day = F.lit(today).cast("date")
    recent = headlines.where(F.col("published").between(F.date_sub(day, days), day))
    scores = sentiment_scores(relevant_headlines(unique_headlines(recent), companies), today,
                              lex, days)
    asked = companies.select("ticker").distinct().withColumn(
        "snapshot_date", F.lit(today).cast("date"))
    rows = asked.join(scores, "ticker", "left").fillna(
        {"articles": 0, "scored_articles": 0, "pos_hits": 0, "neg_hits": 0, "sentiment": 0.0,
         "thin": True})
    return cadence_asof(rows, filings, "snapshot_date", distinct_days=False).drop("burst")


def insiders(tickers: DataFrame, filings: DataFrame, tx: DataFrame, today,
             days: int = 90) -> DataFrame:
    """A row per asked ticker, so that a quiet one replaces its older row."""
    return current_insiders(tickers, filings, tx, today, days).withColumn(
        "snapshot_date", F.lit(today).cast("date"))


def latest_short_interest(readings: DataFrame, history: bool = False, today=None) -> DataFrame:
    """The reading with the newest settlement per ticker, or all of them; with a run date, of
    those published by then. Of several for one settlement the one published last, then the greater
    values."""
    if today is not None:
        readings = readings.where(F.col("published_date") <= F.lit(today).cast("date"))
    if history:
        return readings
    first = [c for c in ("settlement_date", "published_date") if c in readings.columns]
    rest = [c for c in readings.columns if c not in ("ticker", *first)]
    return (readings.where("settlement_date is not null").groupBy("ticker")
            .agg(F.max(F.struct(*first, *rest)).alias("r")).select("ticker", "r.*")
            .select(readings.columns))


def financing(tickers: DataFrame, filings: DataFrame, financial_rows: DataFrame,
              today) -> DataFrame:
    """Shelf and offering posture and dilution readiness of each ticker today."""
    asked = tickers.select("ticker").distinct().withColumn("asof", F.lit(today).cast("date"))
    posture = financing_asof(asked, filings).join(
        financial_rows.select("ticker", "runway_months"), "ticker", "left")
    return with_readiness(posture).drop("asof", "shelf_age_days", "runway_months")


def guidance_statements(hits: DataFrame, text: str = "text", first_only: bool = False) -> DataFrame:
    """Guided readout periods of each filing text, with phrase and place.

    With `first_only` just the first statement of a text, and none if it names no period.
    """
    pattern = "(?i)" + fv.GUIDANCE
    stated = F.arrays_zip(all_matches(F.col(text), pattern, 0).alias("whole"),
                          all_matches(F.col(text), pattern, 1).alias("period"))
    if first_only:
        stated = F.slice(stated, 1, 1)
    return (hits.withColumn("_m", F.explode(stated))
            .withColumn("_r", guided_period(F.col("_m.period.found"))).where("_r.lo is not null")
            .select(F.upper("ticker").alias("ticker"), "doc_id", "filed",
                    F.col("_r.lo").alias("period_lo"), F.col("_r.hi").alias("period_hi"),
                    squeeze(F.col("_m.whole.found")).alias("phrase"),
                    F.col("_m.whole.at").alias("place")))


def newest_statement(statements: DataFrame) -> DataFrame:
    """The most recent statement per company; the first one of a filing that makes several."""
    row = F.struct("filed", "period_lo", "period_hi", "phrase")
    order = F.struct("filed", "doc_id", *([-F.col("place")] if "place" in statements.columns else []))
    return statements.groupBy("ticker").agg(F.max_by(row, order).alias("r")).select("ticker", "r.*")


def guidance(docs: DataFrame, today, months_back: int = 9) -> DataFrame:
    """Stated readout timing per company from event filings."""
    hits = filing_hits(docs, fv.GUIDANCE_PHRASES, today, months_back)
    hits = hits.where("ticker is not null and cik is not null")
    # A document found by several phrases is read once; the search already tests them together.
    return newest_statement(guidance_statements(hits.withColumn("text", html_text(F.col("html")))))


def implied_pairs(catalysts: DataFrame, price_rows: DataFrame, today,
                  horizon: int = 45) -> DataFrame:
    """Distinct near-dated (ticker, date) pairs with a price history."""
    ahead = F.datediff("catalyst_date_lo", F.lit(today).cast("date"))
    return (catalysts.where(F.col("catalyst_date_lo").isNotNull() & ahead.between(0, horizon))
            .join(price_rows.select("ticker").distinct(), "ticker", "left_semi")
            .select("ticker", F.col("catalyst_date_lo").alias("catalyst_date")).distinct())


def implied_moves(pairs: DataFrame, quotes: DataFrame, today) -> DataFrame:
    """Straddle-implied move of the first expiry on or after each date.

    Of each expiry only the newest quote day up to today counts, so both legs are of one day. Call
    and put are each the strike nearest to spot, the first quoted on a tie. A chain is reduced to
    those two rows per expiry and quote day before it meets the dates, and dates find their expiry
    on one timeline per ticker.
    """
    mid = F.when((F.coalesce("bid", F.lit(0.0)) != 0) & (F.coalesce("ask", F.lit(0.0)) != 0),
                 (F.col("bid") + F.col("ask")) / 2).otherwise(F.coalesce("last", F.lit(0.0)))
    gap = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("pos"))

    def side(s):
        return F.min_by(F.struct(mid.alias("mid"), "iv", "spot"),
                        F.when(F.col("side") == s, gap)).alias(s)
    known = quotes.where(F.col("asof") <= F.lit(today).cast("date"))
    daily = known.groupBy("ticker", "expiry", "asof").agg(side("C"), side("P"))
    atm = daily.groupBy("ticker", "expiry").agg(
        F.max_by(F.struct("C", "P"), "asof").alias("q")).select("ticker", "expiry", "q.*")
    ahead = (Window.partitionBy("ticker").orderBy(F.col("day"), F.col("asked").desc())
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    line = (pairs.select("ticker", F.col("catalyst_date").alias("day"), F.lit(True).alias("asked"),
                         F.lit(None).cast("date").alias("expiry"))
            .unionByName(atm.select("ticker", F.col("expiry").alias("day"),
                                    F.lit(False).alias("asked"), "expiry")))
    first = (line.withColumn("expiry", F.first("expiry", ignorenulls=True).over(ahead))
             .where("asked and expiry is not null")
             .select("ticker", F.col("day").alias("catalyst_date"), "expiry").distinct())
    straddle = F.col("C.mid") + F.col("P.mid")
    iv = F.when(F.col("C.iv").isNotNull() & F.col("P.iv").isNotNull(),
                (F.col("C.iv") + F.col("P.iv")) / 2).otherwise(F.coalesce("C.iv", "P.iv"))
    return (first.join(atm, ["ticker", "expiry"]).where(straddle > 0)
            .select("ticker", "catalyst_date", "expiry", iv.alias("atm_iv"),
                    (straddle / F.col("C.spot")).alias("implied_move"),
                    (straddle / F.col("C.spot")).alias("straddle_pct")))
