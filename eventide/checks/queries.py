"""Registered queries. Each takes (spark, sf_dir), reads whole tables, and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from eventide import fixed_values as fv
from eventide import proxies as px
from eventide.functions import buckets as bk
from eventide.functions import dates, priors, scoring, sentiment, text
from eventide.operators import asof, changelog, facts, filings, inference, insiders, names
from eventide.operators import panel as pn
from eventide.operators import tables as tb
from eventide.plans import board as bd
from eventide.plans import calendar as cal
from eventide.plans import current, logs, outcomes, refresh, studies
from eventide.schemas import TABLES
from eventide.sources import readers as rd
from eventide.storage import shared_dir

QUERIES: dict = {}
KINDS = {k: ((k, f"{k}_b"), "shares" if k == "shares" else "USD")
         for k in ("cash", "investments", "burn", "shares")}
# Frequent words of the driver documents stand in for the default lexicon, which no driver
# document contains.
CORPUS_LEXICON = sentiment.Lexicon(
    negative_phrases=("the of", "and the", "on the"), positive_phrases=("in the", "er the", "of the"),
    negative_words=("the", "der"), positive_words=("of", "and", "que", "re"),
    negators=r"\b(?:not|no|to|la|un|in|nd)\b")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles on a grid, for comparison between engines that add in different orders."""
    unit = float(10 ** digits)
    return df.select(*[
        (F.floor(F.col(f.name) * unit + 0.5) / unit).alias(f.name)
        if isinstance(f.dataType, DoubleType)
        else F.col(f.name) for f in df.schema.fields])


def V(s: SparkSession, d: str, name: str) -> DataFrame:
    return px.view(s, d, name)


def B(s: SparkSession, d: str, name: str) -> DataFrame:
    return px.base(s, d, name)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of a few files over all cores; a table of many files stays as it is scanned.

    Told by the number of files alone, so nothing runs while the plan is built.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def market(s, d) -> studies.Market:
    return studies.Market(
        bars=V(s, d, "price_bar"), filings=V(s, d, "filing_index"), facts=V(s, d, "xbrl_fact"),
        splits=V(s, d, "split_event"), insider_tx=V(s, d, "insider_tx"), kinds=KINDS,
        short_interest=published(V(s, d, "short_interest")))


def published(si: DataFrame) -> DataFrame:
    return si.withColumn("published_date", dates.publication_date(F.col("settlement_date")))


def board_tables(s, d) -> bd.Tables:
    t = {n: V(s, d, n) for n in bd.Tables.__dataclass_fields__}
    return bd.Tables(**t | {"short_interest": published(t["short_interest"])})


# --- sources ------------------------------------------------------------------------------------

def _index_blocks(s, d) -> DataFrame:
    """A two-entry filing block per order, one of them with a date that may be malformed."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return B(s, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("ticker"),
        F.array("o_orderpriority", "o_orderstatus").alias("form"),
        F.array(day, F.when(F.col("o_orderstatus") == "P", F.lit("n.d.")).otherwise(day))
        .alias("filingDate"),
        F.array(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
        .alias("accessionNumber"))


@query
def filing_index_rows(s, d):
    return rd.filing_index(_index_blocks(s, d))


@query
def insider_quarter_rows(s, d):
    o = B(s, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("ACCESSION_NUMBER"),
        F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("FILING_DATE"),
        F.when(F.col("o_orderstatus") == "P", "4/A").otherwise("4").alias("DOCUMENT_TYPE"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NA")
        .otherwise(F.concat(F.lit("t"), F.col("o_custkey").cast("string")))
        .alias("ISSUERTRADINGSYMBOL"))
    li = B(s, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("ACCESSION_NUMBER"),
        F.when(F.col("l_returnflag") == "R", "P").when(F.col("l_returnflag") == "A", "S")
        .otherwise("F").alias("TRANS_CODE"),
        F.col("l_quantity").cast("string").alias("TRANS_SHARES"),
        F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "0")
        .otherwise(F.col("l_discount").cast("string")).alias("TRANS_PRICEPERSHARE"))
    return rounded(rd.insider_quarter(o, li))


@query
def short_interest_rows(s, d):
    li = B(s, d, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("symbolCode"),
        F.when(F.col("l_linenumber") == 7, "bad").otherwise(
            F.date_format("l_shipdate", "yyyy-MM-dd")).alias("settlementDate"),
        F.when(F.col("l_tax") == 0, "null").otherwise(F.col("l_quantity").cast("string"))
        .alias("currentShortPositionQuantity"),
        F.when(F.col("l_discount") == 0, "").otherwise(F.col("l_quantity").cast("string"))
        .alias("previousShortPositionQuantity"),
        F.col("l_extendedprice").cast("string").alias("averageDailyVolumeQuantity"),
        F.col("l_discount").cast("string").alias("daysToCoverQuantity"),
        F.col("l_tax").cast("string").alias("changePercent"))
    return rd.short_interest(li)


@query
def price_panel(s, d):
    return pn.price_panel(V(s, d, "price_bar"), px.STUDY_START, px.STUDY_END).rows.select(
        "ticker", "day", "pos", "close")


@query
def tickers_without_history(s, d):
    asked = V(s, d, "filing_index").select("ticker").distinct()
    return pn.missing_tickers(V(s, d, "price_bar"), asked, "2000-01-01", "2000-05-02")


@query
def study_coverage(s, d):
    """Observations, tickers, and tickers without history of the filing events."""
    events = facts.periodic_filing_dates(V(s, d, "filing_index"), "2000-01-01", "2000-05-02")
    missing = pn.missing_tickers(V(s, d, "price_bar"), events.select("ticker"), "2000-01-01",
                                 "2000-05-02")
    n = events.groupBy("ticker").agg(F.count("*").alias("n")).join(
        missing.withColumn("gone", F.lit(1)), "ticker", "left")
    return n.agg(F.sum("n").alias("observations"), F.count("*").alias("tickers"),
                 F.count("gone").alias("missing_tickers"))


@query
def split_events(s, d):
    return rd.splits(V(s, d, "split_event"))


def _docs(s, d) -> DataFrame:
    return B(s, d, "documents").select(
        "source", F.col("source").alias("cik"), "doc_id",
        F.when(F.col("lang") == "en", "8-K").otherwise("10-K").alias("form"),
        F.date_add(F.lit("1999-10-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
        .alias("filed"),
        F.concat(F.lit("Firm "), "source", F.lit("  ("), F.upper("source"), F.lit(", X)"))
        .alias("display_name"), F.col("text").alias("html"))


@query
def filing_phrase_hits(s, d):
    hits = rd.filing_hits(_docs(s, d), ("The Of", "and the"), px.RUN_DATE, 6)
    return rd.one_per_filing_day(hits).select("ticker", "company_name", "filed", "cik", "doc_id")


# --- tables -------------------------------------------------------------------------------------

def _log_halves(s, d):
    log = V(s, d, "verdict_log")
    newer = log.where(F.col("snapshot_date") > F.lit("2024-01-10").cast("date"))
    return log, newer.withColumn("conviction", F.col("conviction") + 1)


@query
def keyed_upsert(s, d):
    old, new = _log_halves(s, d)
    return tb.upsert(old, new, ["drug_id", "snapshot_date"])


@query
def calendar_slice_replace(s, d):
    c = V(s, d, "catalysts").select("drug_id", "ticker", "catalyst_date_raw", "catalyst_date_hi")
    old = c.withColumn("catalyst_date_hi", F.when(F.col("ticker") != "T1",
                                                  F.col("catalyst_date_hi")))
    new = c.where("catalyst_date_hi >= date'2000-05-16'").withColumn("ticker", F.lit("NEW"))
    return tb.replace_slice(old, new, px.RUN_DATE, 45, ["drug_id", "catalyst_date_raw"])


@query
def reconciled_log(s, d):
    from eventide.schemas import TABLES
    return tb.reconcile(V(s, d, "verdict_log"), TABLES["verdict_log"]).drop("pulled_at")


# --- text and number expressions ------------------------------------------------------------------

@query
def normalised_values(s, d):
    p = B(s, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 5 == 0, "  NaN ").when(F.col("p_size") % 5 == 1, "<NA>")
        .when(F.col("p_size") % 5 == 2, F.lit(None)).otherwise(
            F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("t"),
        F.when(F.col("p_size") % 4 == 0, "NaN").when(F.col("p_size") % 4 == 1, "x1")
        .otherwise(F.col("p_retailprice").cast("string")).alias("n"))
    return p.select("p_partkey", text.clean_text(F.col("t")).alias("clean"),
                    text.clean_number(F.col("n"), -1).alias("num"))


@query
def company_keys(s, d):
    c = B(s, d, "customer")
    raw = F.concat("c_name", F.lit(", Inc. & "), F.initcap("c_mktsegment"),
                   F.lit(" Therapeutics Holdings-CO (Group)"))
    return c.select("c_custkey", text.company_key(raw).alias("name_key"))


@query
def simple_stages(s, d):
    raw = F.concat_ws(",", F.when(F.col("o_orderkey") % 2 == 0, "PHASE1"),
                      F.when(F.col("o_orderkey") % 3 == 0, "Phase 2"),
                      F.when(F.col("o_orderkey") % 5 == 0, "phase3"),
                      F.when(F.col("o_orderkey") % 7 == 0, "PHASE4"))
    return B(s, d, "orders").select("o_orderkey", text.simple_stage(raw).alias("stage"))


@query
def owner_roles(s, d):
    k = F.col("c_custkey")
    title = (F.when(k % 7 == 0, "Chief Executive Officer").when(k % 7 == 1, "EVP & CFO")
             .when(k % 7 == 2, "Vice President").when(k % 7 == 3, "Cooperative lead")
             .when(k % 7 == 4, "coo"))
    return B(s, d, "customer").select("c_custkey", text.owner_role(
        k % 2 == 0, k % 3 == 0, F.when(k % 5 != 0, k % 5 == 1), title).alias("role"))


@query
def therapeutic_areas(s, d):
    """Areas of catalyst indications and of whole documents."""
    a = V(s, d, "catalysts").select(F.concat(F.lit("c"), F.col("drug_id").cast("string")).alias("id"),
                                    text.therapeutic_area(F.col("indication")).alias("area"))
    b = spread(B(s, d, "documents")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
                                    text.therapeutic_area(F.col("text")).alias("area"))
    return a.unionByName(b)


@query
def stable_ids(s, d):
    return V(s, d, "catalysts").select("drug_id", text.stable_id(
        F.col("ticker"), F.when(F.col("drug_id") % 3 != 0, F.col("nct_id")),
        F.col("catalyst_date_raw")).alias("stable_id"))


@query
def page_texts(s, d):
    t = text.html_text(F.col("html"))
    return spread(B(s, d, "pages")).select("page_id", t.alias("body"))


@query
def tidy_indications(s, d):
    c = V(s, d, "catalysts")
    k = F.col("drug_id") % 8
    phrase = (F.when(k == 0, F.concat(F.lit("adults with "), "indication", F.lit(" who failed")))
              .when(k == 1, F.concat("indication", F.lit(" in adults, and assigned a date of")))
              .when(k == 2, F.concat("indication", F.lit('," said the Chairman')))
              .when(k == 3, F.concat(F.lit(" - "), "indication", F.lit(" announced last quarter")))
              .when(k == 4, F.lit("symptomatic"))
              .when(k == 5, F.concat("indication", F.lit(" and set a date of October 17")))
              .when(k == 6, F.concat(F.lit("moderate to severe "), "indication",
                                     F.lit(" one two three four five six seven eight nine due to")))
              .otherwise("a b c"))
    return c.select("drug_id", text.tidy_indication(phrase).alias("tidy"))


def _headlines(s, d):
    return V(s, d, "headline").select(
        F.concat(F.lit("src"), (F.col("pos") % 20).cast("string")).alias("ticker"),
        "title", "published", "source", F.lit("").alias("link"), "pos")


@query
def headline_hits(s, d):
    """Lexicon hits of every document, with a lexicon of frequent corpus words."""
    return spread(B(s, d, "documents")).select(
        "doc_id", sentiment.lexicon_hits(F.col("text"), CORPUS_LEXICON).alias("h")).select(
        "doc_id", "h.pos", "h.neg")


@query
def headline_hits_default_lexicon(s, d):
    return spread(V(s, d, "worded_headline")).select(
        "doc_id", sentiment.lexicon_hits(F.col("title")).alias("h")).select(
        "doc_id", "h.pos", "h.neg")


def _companies(s, d):
    return B(s, d, "documents").groupBy(F.col("source").alias("ticker")).agg(F.concat(
        F.lit("The Global "), F.when(F.min("doc_id") % 2 == 0, "Ouen").otherwise("Nterti"),
        F.lit(" Whst Pharma Inc")).alias("company_name"))


@query
def distinct_headlines(s, d):
    return current.unique_headlines(_headlines(s, d)).select("ticker", "pos", "source")


@query
def on_topic_headlines(s, d):
    return current.relevant_headlines(_headlines(s, d), _companies(s, d)).select("ticker", "pos")


@query
def recent_headlines(s, d):
    return rd.since(_headlines(s, d), "published", "2024-01-26", 6).select("ticker", "pos")


@query
def headline_sentiment(s, d):
    """Recency-weighted sentiment per source over all distinct headlines."""
    return current.sentiment_scores(current.unique_headlines(_headlines(s, d)), "2024-01-25",
                                    CORPUS_LEXICON)


@query
def sentiment_table(s, d):
    """Current sentiment per company with its filing cadence."""
    filed = V(s, d, "filing_index").select(
        F.concat(F.lit("src"), F.substring("ticker", 2, 9)).alias("ticker"), "form",
        F.date_add("filed", 8500).alias("filed"))
    return current.sentiment(_headlines(s, d), _companies(s, d), filed, "2024-01-25", 21,
                             CORPUS_LEXICON)


# --- dates --------------------------------------------------------------------------------------

@query
def fuzzy_dates(s, d):
    return spread(V(s, d, "raw_date")).select("id", dates.fuzzy_date(F.col("raw")).alias("r")).select(
        "id", "r.lo", "r.hi", "r.precision")


@query
def narrowed_windows(s, d):
    c = V(s, d, "catalysts").select("drug_id", "ticker", "catalyst_date_lo", "catalyst_date_hi")
    g = V(s, d, "guidance").select("ticker", "period_lo", "period_hi")
    n = dates.narrow(F.col("catalyst_date_lo"), F.col("catalyst_date_hi"), F.col("period_lo"),
                     F.col("period_hi"))
    return c.join(g, "ticker", "left").select("drug_id", n.alias("n")).select(
        "drug_id", "n.lo", "n.hi", "n.source")


@query
def readout_windows(s, d):
    r = V(s, d, "raw_date").select(F.lit("T").alias("ticker"), F.lit("PHASE2").alias("stage"),
                                   F.col("raw").alias("primary_completion"), "id",
                                   F.lit("s").alias("lead_sponsor"))
    return cal.readout_rows(r).select("id", "catalyst_date_lo", "catalyst_date_hi",
                                      "catalyst_date_raw", "date_precision")


@query
def publication_dates(s, d):
    return B(s, d, "lineitem").select(F.to_date("l_shipdate").alias("settled")).distinct().select(
        "settled", dates.publication_date(F.col("settled")).alias("published"))


@query
def study_quarters(s, d):
    span = B(s, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"),
                                 F.to_date(F.max("o_orderdate")).alias("b"))
    return span.select(F.explode(dates.quarter_labels(F.col("a"), F.col("b"))).alias("quarter"))


# --- priors, scoring, buckets -----------------------------------------------------------------------

@query
def approval_priors(s, d):
    c = F.col
    return rounded(V(s, d, "catalysts").select("drug_id", priors.approval_prior(
        c("simplified_stage"), c("indication"), c("designations")).alias("loa")))


@query
def typical_moves(s, d):
    c = V(s, d, "catalysts").join(V(s, d, "prices").select("ticker", "market_cap"), "ticker", "left")
    return rounded(c.select("drug_id", priors.typical_move(
        F.col("simplified_stage"), F.col("market_cap")).alias("expected_move")))


@query
def trial_design(s, d):
    t = V(s, d, "trials")
    b = priors.design_bucket(F.col("allocation"), F.col("masking"))
    return t.select("nct_id", b.alias("design_bucket"),
                    priors.design_multiplier(b, F.col("enrollment"), F.lit("Phase 2"))
                    .alias("design_multiplier"),
                    priors.design_note(b, F.col("enrollment")).alias("design_note"))


@query
def short_squeeze(s, d):
    c = F.col
    m = V(s, d, "short_interest").join(
        V(s, d, "financials").select("ticker", "shares_outstanding"), "ticker", "left")
    return rounded(m.select("ticker", "settlement_date", scoring.squeeze_metrics(
        c("shares_short"), c("days_to_cover"), c("shares_outstanding"),
        c("shares_short_prior")).alias("q")).select("ticker", "settlement_date", "q.*"))


@query
def study_buckets(s, d):
    """Every bucket function over line items."""
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    known = F.col("l_linenumber") != 7
    return B(s, d, "lineitem").select(
        bk.runway_bucket(F.when(known, q)).alias("runway"),
        bk.size_bucket(F.when(known, x * 40000)).alias("size"),
        bk.burst_bucket(F.when(known, q / 12)).alias("burst"),
        bk.count_bucket(F.when(known, q - 1)).alias("n_filings"),
        bk.cover_bucket(F.when(known, q / 6)).alias("cover"),
        bk.net_flow_bucket(F.when(known, (q - 25) * 15000)).alias("net_flow"),
        bk.cut(q / 50, fv.PRIOR_CUTS).alias("prior"),
        bk.cut(q * 10 - 20, fv.ENROLLMENT_CUTS).alias("enrollment"),
        bk.cut(F.when(known, (q - 25) / 100), fv.RUNUP_CUTS).alias("runup"),
        bk.interaction(F.when(known, q < 20), F.col("l_discount") > 0.05, "both", "first",
                       "second").alias("mixed")
    ).groupBy("runway", "size", "burst", "n_filings", "cover", "net_flow", "prior",
              "enrollment", "runup", "mixed").agg(F.count("*").alias("n"))


# --- board --------------------------------------------------------------------------------------

@query
def feature_join(s, d):
    return rounded(bd.joined(board_tables(s, d), today=px.RUN_DATE).select(
        "drug_id", "enrollment", "allocation", "cash_usd", "runway_months", "cash_asof", "last",
        "market_cap", "implied_move", "implied_expiry", "sentiment", "sentiment_thin",
        "news_articles", "eightk_90d", "shares_short", "days_to_cover", "short_asof",
        "dilution_label", "offerings_24m", "guide_lo", "guide_hi", "insider_tilt", "n_buyers"), 4)


FEATURES = ("drug_id", "ticker", "catalyst_date_lo", "catalyst_date_hi", "date_precision",
            "date_source", "days_to_catalyst", "date_confidence", "ta", "design_bucket",
            "design_multiplier", "design_note", "loa", "expected_move", "move_ratio",
            "baseline_move", "materiality", "runway_at_catalyst", "runway_stale", "is_binary",
            "microcap", "illiquid", "short_pct_outstanding", "short_build", "squeeze_risk",
            "squeeze_label")


@query
def feature_frame(s, d):
    return rounded(bd.features(board_tables(s, d), px.RUN_DATE).select(*FEATURES))


@query
def scored_board(s, d):
    return rounded(bd.board(board_tables(s, d), px.RUN_DATE).select(
        "drug_id", "ticker", "days_to_catalyst", "verdict", "directional", "setup", "setup_desc",
        "evidence", "evidence_note", "lean", "conviction", "reasons", "runway_score",
        "runup_score", "loa_score"))


@query
def board_top(s, d):
    """The thirty most convinced rows."""
    b = bd.board(board_tables(s, d), px.RUN_DATE)
    return bd.view(b, sort="conviction", limit=30).select("drug_id", "setup", "conviction",
                                                          "days_to_catalyst")


@query
def board_actionable_by_date(s, d):
    b = bd.board(board_tables(s, d), px.RUN_DATE)
    return bd.view(b, show="ACTIONABLE", min_conviction=20, horizon=120, limit=250).select(
        "drug_id", "setup", "conviction", "days_to_catalyst")


@query
def board_search(s, d):
    b = bd.board(board_tables(s, d), px.RUN_DATE)
    return bd.view(b, show="supported", search="Nephri").select(
        "drug_id", "setup", "evidence", "conviction")


@query
def board_verdict_tally(s, d):
    return bd.verdict_tally(bd.board(board_tables(s, d), px.RUN_DATE))


@query
def published_board(s, d):
    """Published rows as JSON documents."""
    p = bd.published(bd.board(board_tables(s, d), px.RUN_DATE))
    slim = p.select("drug_id", "ticker", "robinhood", "company", "date", "days", "date_hi",
                    "verdict", "directional", "conviction", "sent_thin", "short_asof",
                    "cash_asof", "cluster_buy", "headline", "headline_reason", "n_reasons", "nct")
    return slim.select("drug_id", F.to_json(F.struct(*[c for c in slim.columns if c != "drug_id"]),
                                            {"ignoreNullFields": "false"}).alias("doc"))


@query
def verdict_snapshot(s, d):
    b = bd.board(board_tables(s, d), px.RUN_DATE)
    twice = b.unionByName(b.withColumn("conviction", F.col("conviction") - 1))
    return outcomes.snapshot(twice, px.RUN_DATE).drop("pulled_at")


@query
def implied_candidates(s, d):
    return current.implied_pairs(V(s, d, "catalysts"), V(s, d, "prices"), px.RUN_DATE)


@query
def implied_moves(s, d):
    pairs = current.implied_pairs(V(s, d, "catalysts"), V(s, d, "prices"), px.RUN_DATE)
    return rounded(current.implied_moves(pairs, V(s, d, "option_quote"), px.RUN_DATE))


# --- as-of joins --------------------------------------------------------------------------------

def _probes(s, d) -> DataFrame:
    """Periodic filings of the study window as probe days."""
    return facts.periodic_filing_dates(V(s, d, "filing_index"), px.STUDY_START,
                                       px.STUDY_END).select(
        "ticker", F.col("event_date").alias("asof"))


@query
def periodic_filings(s, d):
    return _probes(s, d)


@query
def short_interest_asof(s, d):
    return studies.short_interest_asof(_probes(s, d), published(V(s, d, "short_interest")), "asof")


@query
def financials_asof(s, d):
    return rounded(facts.financials_asof(_probes(s, d), V(s, d, "xbrl_fact"), "asof", KINDS)
                   .where("cash_usd is not null"))


@query
def cadence_asof(s, d):
    return filings.cadence_asof(_probes(s, d), V(s, d, "filing_index"))


@query
def financing_asof(s, d):
    return filings.financing_asof(_probes(s, d), V(s, d, "filing_index"))


@query
def insiders_asof(s, d):
    tx = V(s, d, "insider_tx").where("code in ('P', 'S')")
    return rounded(insiders.insiders_asof(_probes(s, d), tx), 2)


@query
def market_cap_asof(s, d):
    e = facts.financials_asof(_probes(s, d), V(s, d, "xbrl_fact"), "asof", KINDS).where(
        "cash_usd is not null").withColumn("price", F.lit(12.5))
    return rounded(studies.with_market_cap(e, V(s, d, "split_event"), "price", "asof").select(
        "ticker", "asof", "shares_outstanding", "market_cap"), 3)


@query
def sponsor_tickers(s, d):
    """Suppliers and customers of one naming scheme matched to a registry of part names."""
    reg = B(s, d, "part").select(
        F.concat("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_type")))
                 .otherwise(F.lit("")), F.lit(" Inc.")).alias("title"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("ticker"),
        F.col("p_partkey").alias("pos"))
    spon = B(s, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 4 == 0, F.split("p_name", " ")[0])
        .when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit(" "), "p_type", F.lit(" Labs X")))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("Unlisted "), "p_name"))
        .otherwise(F.upper("p_name")).alias("lead_sponsor"))
    return names.match_sponsors(spon, reg).select("id", "ticker")


# --- returns, prices, outcomes ------------------------------------------------------------------------

@query
def calendar_positions(s, d):
    """First position on or after, and last on or before the day before, every order date."""
    panel = pn.price_panel(V(s, d, "price_bar"), px.STUDY_START, px.STUDY_END)
    c = panel.calendar
    days = B(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    eve = days.select(F.date_sub("day", 1).alias("day"))
    a = pn.positions(days, c, "after").withColumnRenamed("pos", "on_or_after")
    b = (pn.positions(eve, c, "before").withColumn("day", F.date_add("day", 1))
         .withColumnRenamed("pos", "before"))
    return a.join(b, "day")


@query
def event_returns(s, d):
    """Returns of filing events entered five sessions ahead."""
    e = facts.periodic_filing_dates(V(s, d, "filing_index"), px.STUDY_START, px.STUDY_END)
    panel = pn.price_panel(V(s, d, "price_bar"), px.STUDY_START, px.STUDY_END, e)
    return rounded(pn.event_returns(e, panel, (1, 5, 21, 63), 5).drop("anchor"))


@query
def price_statistics(s, d):
    return rounded(pn.price_statistics(V(s, d, "price_bar")), 6)


@query
def price_table(s, d):
    fins = facts.current_financials(V(s, d, "xbrl_fact"), KINDS)
    return rounded(current.prices(V(s, d, "price_bar"), fins, V(s, d, "split_event"),
                                  px.RUN_DATE).select("ticker", "last", "market_cap"), 3)


@query
def realised_outcomes(s, d):
    return rounded(outcomes.outcomes(V(s, d, "catalysts"), V(s, d, "price_bar"), px.RUN_DATE, 400))


def _judged(s, d):
    """Event log rows as outcomes and as the verdict log that preceded them."""
    log = V(s, d, "verdict_log")
    o = log.select("drug_id", F.col("snapshot_date").alias("catalyst_date"),
                   F.concat(F.lit("T"), F.col("drug_id").cast("string")).alias("ticker"),
                   ((F.col("conviction") - 8) / 100.0).alias("move_todate")).where(
        "ticker is not null")
    c = V(s, d, "catalysts")
    return outcomes.recent(o, c, log.withColumn("snapshot_date", F.date_add(
        "snapshot_date", (F.col("drug_id") % 3).cast("int"))), "2024-01-31", 25)


@query
def recent_outcomes(s, d):
    return rounded(_judged(s, d).select(
        "drug_id", "catalyst_date", "prior_verdict", "prior_setup", "prior_conviction",
        "verdict_asof", "drug_name", "stage", "move_todate"))


@query
def recent_outcomes_largest(s, d):
    """The hundred largest moves."""
    return rounded(outcomes.order_recent(
        _judged(s, d).where("drug_id is not null"), "move").limit(100).select("move_todate"))


@query
def recent_up_down(s, d):
    return outcomes.up_down(_judged(s, d))


@query
def published_recent(s, d):
    j = _judged(s, d)
    for c in ("move_1d", "abn_1d", "abn_todate"):
        j = j.withColumn(c, F.lit(None).cast("double"))
    j = j.withColumn("last_date", F.lit(None).cast("date"))
    return bd.published_recent(j).select("ticker", "drug", "date", "last_date", "prior_verdict",
                                         "prior_conviction")


# --- logs -----------------------------------------------------------------------------------------

@query
def log_latest_signature(s, d):
    return changelog.latest_signatures(V(s, d, "verdict_log"), "drug_id",
                                       changelog.verdict_signature()).select(
        "drug_id", "last_signature.verdict", "last_signature.setup", "last_signature.decile",
        "last_signature.evidence")


@query
def log_changed_rows(s, d):
    log = V(s, d, "verdict_log")
    old = log.where("snapshot_date <= date'2024-01-15'")
    new = log.where("snapshot_date > date'2024-01-15'")
    return changelog.changed_rows(new, old, "drug_id", changelog.verdict_signature())


def _landed_json(s, rows: DataFrame, name: str) -> str:
    path = _folder(s, name)
    rows.write.json(path)
    return path


def _landed_trials(s, d) -> DataFrame:
    """Trial records as JSON lines, made from customers."""
    k = F.col("c_custkey")
    one = lambda n, v: F.struct(v.alias(n))
    rows = B(s, d, "customer").select(F.struct(
        F.struct(F.concat(F.when(k % 41 == 0, "ISRCTN").otherwise("NCT"), F.lpad(k.cast("string"), 8, "0")).alias("nctId"),
                 F.concat(F.lit("Drug "), k).alias("briefTitle")).alias("identificationModule"),
        F.struct(F.when(k % 2 == 0, "RECRUITING").otherwise("COMPLETED").alias("overallStatus"),
                 one("date", F.element_at(F.array(F.lit("2000-07-15"), F.lit("2000-09"), F.lit("1999-03"),
                                                  F.lit("soon")), (k % 4 + 1).cast("int")))
                 .alias("primaryCompletionDateStruct")).alias("statusModule"),
        F.struct(F.lit("INTERVENTIONAL").alias("studyType"),
                 F.when(k % 3 == 0, F.array(F.lit("PHASE1"))).when(k % 3 == 1, F.array(F.lit("PHASE2")))
                 .otherwise(F.array(F.lit("PHASE2"), F.lit("PHASE3"))).alias("phases"),
                 one("count", F.when(k % 7 == 0, "many").otherwise((k % 500).cast("string"))).alias("enrollmentInfo"),
                 F.struct(F.lit("RANDOMIZED").alias("allocation"), one("masking", F.lit("DOUBLE")).alias("maskingInfo"))
                 .alias("designInfo")).alias("designModule"),
        F.struct(F.array(F.concat(F.lit("condition "), k % 9), F.lit("pain")).alias("conditions"))
        .alias("conditionsModule"),
        one("leadSponsor", F.struct(
            F.concat(F.lit("Supplier#"), F.lpad((k % 15 + 1).cast("string"), 9, "0")).alias("name"),
            F.when(k % 5 == 0, "OTHER").otherwise("INDUSTRY").alias("class"))).alias("sponsorCollaboratorsModule"))
        .alias("protocolSection"))
    return rd.read_trials(s, _landed_json(s, rows, "trials"))


def _suppliers(s, d) -> DataFrame:
    return B(s, d, "supplier").select(
        F.col("s_name").alias("title"), F.concat(F.lit("T"), "s_suppkey").alias("ticker"),
        F.col("s_suppkey").cast("bigint").alias("cik"), F.col("s_suppkey").cast("bigint").alias("pos"))


@query
def trial_design_rows(s, d):
    return rd.trial_designs(_landed_trials(s, d)).select(
        "nct_id", "overall_status", "phases", "enrollment", "allocation", "masking", "primary_completion",
        "lead_sponsor")


@query
def candidate_readout_rows(s, d):
    return rd.candidate_readouts(_landed_trials(s, d), _suppliers(s, d), px.RUN_DATE).select(
        "nct_id", "drug_name", "stage", "primary_completion", "indication", "enrollment", "ticker")


@query
def historical_readout_rows(s, d):
    return rd.historical_readouts(_landed_trials(s, d), _suppliers(s, d), "1999-01-01", "1999-12-31").select(
        "nct_id", "ticker", "event_date", "date_precision", "simplified_stage", "anchor")


@query
def whole_calendar(s, d):
    """Trial readouts and filed decision dates as one calendar."""
    return cal.build_calendar(_landed_trials(s, d), _suppliers(s, d), V(s, d, "two_date_filing"), px.RUN_DATE).select(
        "ticker", "nct_id", "catalyst_date_raw", "catalyst_date_lo", "catalyst_date_hi", "date_precision",
        "simplified_stage", "drug_name", "indication")


@query
def company_fact_rows(s, d):
    """Facts JSON of suppliers: a tag of the second taxonomy counts where the first has no units for it."""
    k = F.col("s_suppkey")

    def fact(val, filed):
        return F.struct(F.lit("2000-01-01").alias("start"), F.lit("2000-03-31").alias("end"), val.alias("val"),
                        filed.alias("filed"), F.lit("10-Q").alias("form"))

    def tag(name, unit, *facts):
        return F.create_map(F.lit(name), F.struct(F.create_map(F.lit(unit), F.array(*facts)).alias("units")))
    day = F.concat(F.lit("2000-05-0"), k % 9 + 1)
    none = F.create_map(F.lit("Cash"), F.struct(F.create_map().cast(f"map<string,array<{rd.FACT}>>").alias("units")))
    own = tag("Cash", "USD", fact(F.col("s_acctbal"), day), fact(F.col("s_acctbal") + 1, F.lit("n/a")),
              fact(F.col("s_acctbal") + 2, F.lit("2000-08-01")))
    rows = B(s, d, "supplier").select(F.concat(F.lit("000"), k).alias("cik"), F.create_map(
        F.lit("us-gaap"), F.when(k % 3 == 0, none).otherwise(own),
        F.lit("dei"), F.map_concat(tag("Cash", "EUR", fact(F.lit(7.0), day)),
                                   tag("Shares", "shares", fact(k.cast("double") * 1000, day)))).alias("facts"))
    raw = rd.read_company_facts(s, _landed_json(s, rows, "facts"))
    return rd.company_facts(raw, _suppliers(s, d)).select("ticker", "tag", "unit", "filed", "val", "pos")


@query
def ownership_document_rows(s, d):
    """Transactions of ownership filings in XML, one filing per order."""
    value = lambda n, v: F.concat(F.lit(f"<{n}><value>"), v, F.lit(f"</value></{n}>"))
    tx = lambda t: F.concat(
        F.lit("<nonDerivativeTransaction>"), value("transactionDate", F.lit("2000-01-02")),
        F.lit("<transactionCoding><transactionCode>"),
        F.when(t["l_returnflag"] == "R", "P").when(t["l_returnflag"] == "A", "S").otherwise("F"),
        F.lit("</transactionCode></transactionCoding><transactionAmounts>"),
        value("transactionShares", F.when(t["l_linenumber"] == 6, "few").otherwise(t["l_quantity"].cast("string"))),
        value("transactionPricePerShare", F.when(t["l_linenumber"] == 5, "").otherwise(t["l_tax"].cast("string"))),
        F.lit("</transactionAmounts><postTransactionAmounts>"),
        value("sharesOwnedFollowingTransaction", (t["l_quantity"] * 3).cast("string")),
        F.lit("</postTransactionAmounts></nonDerivativeTransaction>"))
    # The lines are gathered; their XML, many times as long, is written where the document is.
    docs = (B(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(
                F.struct("l_linenumber", "l_returnflag", "l_quantity", "l_tax")).alias("t"))
            .withColumn("t", F.sort_array(F.transform("t", lambda t: F.struct(
                t["l_linenumber"].alias("l_linenumber"), tx(t).alias("x")))))
            .select(F.lit("T").alias("ticker"), F.col("l_orderkey").alias("accession"),
                    F.lit("2000-01-03").cast("date").alias("filed_date"), F.concat(
                        F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>OWNER  N"),
                        F.col("l_orderkey") % 10, F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>"),
                        F.when(F.col("l_orderkey") % 2 == 0, "<isDirector>1</isDirector>").otherwise(
                            "<isOfficer>true</isOfficer><officerTitle>Vice  President</officerTitle>"),
                        F.lit("</reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"),
                        F.array_join("t.x", ""), F.lit("</nonDerivativeTable></ownershipDocument>")).alias("xml")))
    return rd.insider_documents(docs).select("accession", "code", "shares", "price", "owner", "title", "held_after")


@query
def company_registry(s, d):
    """A registry of all customers as one JSON object in one file, read in splits."""
    path, c = _folder(s, "registry"), B(s, d, "customer")
    entry = F.to_json(F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("c"), "c_custkey").alias("ticker"),
                               F.when(F.col("c_custkey") % 50 == 0, F.concat("c_name", F.lit(" {x} }")))
                               .otherwise(F.col("c_name")).alias("title")))
    keyed = c.select(F.col("c_custkey").alias("k"), F.concat(F.lit('"'), "c_custkey", F.lit('":'), entry).alias("value"))
    ends = s.createDataFrame([(-1, '{"-1":{"title":null}'), (1 << 60, "}")], "k long, value string")
    lines = keyed.withColumn("value", F.concat(F.lit(","), "value")).unionByName(ends)
    lines.repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return rd.read_registry(s, path).select("title", "ticker", "cik", "pos")


@query
def news_feed_order(s, d):
    """Of news items with one title the first in its feed stays: items differ in place and link only."""
    path = _folder(s, "news")
    items = B(s, d, "documents").select(
        F.col("doc_id"), F.concat(F.lit("T"), F.col("doc_id") % 7).alias("ticker"),
        F.concat(F.lit("News number "), F.col("doc_id") % 31).alias("title"),
        F.when(F.col("doc_id") % 11 == 0, "2024-01-20T99:10:00Z").otherwise("2024-01-20T09:10:00Z").alias("pubDate"),
        F.struct(F.concat(F.lit("l"), "doc_id").alias("url")).alias("canonicalUrl"))
    items.repartition(1).sortWithinPartitions(F.col("doc_id").desc()).drop("doc_id").write.json(path)
    return current.unique_headlines(rd.news_headlines(rd.read_news(s, path))).select(
        "ticker", "title", "published", "link")


@query
def log_by_month(s, d):
    """The verdict log kept by month: its early days, the later ones, then the last day run again with
    other verdicts for even ids and a row of a day without a date."""
    log = tb.reconcile(V(s, d, "verdict_log"), TABLES["verdict_log"])
    store = refresh.Store(s, _folder(s, "store"))
    store.put("verdict_log", log.where("snapshot_date <= date'2024-01-15'"))
    store.put("verdict_log", log.where("snapshot_date > date'2024-01-15'"))
    last = log.join(log.agg(F.max("snapshot_date").alias("snapshot_date")), "snapshot_date", "left_semi")
    again = last.where("drug_id % 2 = 0").withColumn("verdict", F.lit("AGAIN"))
    store.put("verdict_log", again)
    return store.read("verdict_log").select("drug_id", "snapshot_date", "verdict", "conviction")


@query
def log_seed_counts(s, d):
    """Rows read, new and in the log after a committed log is seeded into one that holds a part."""
    name, schema = "verdict_log", TABLES["verdict_log"]
    path = _folder(s, "log")
    full = tb.reconcile(V(s, d, name), schema).select(*schema.fieldNames())
    logs.dump(full, name, path)
    part = full.where("snapshot_date <= date'2024-01-15'")
    seeded = logs.committed(s, name, path)
    return logs.row_counts(part, seeded, logs.seed(part, s, name, path), name)


@query
def log_append(s, d):
    log = V(s, d, "verdict_log")
    return logs.append(log.where("snapshot_date <= date'2024-01-15'"),
                       log.where("snapshot_date > date'2024-01-15'"), "verdict_log")


@query
def log_compacted(s, d):
    return changelog.compact(V(s, d, "verdict_log"), "drug_id", changelog.verdict_signature())


@query
def sentiment_log_compacted(s, d):
    return rounded(changelog.compact(V(s, d, "sentiment"), "ticker",
                                     changelog.sentiment_signature()))


@query
def log_evidence_repaired(s, d):
    return changelog.repair_evidence(V(s, d, "verdict_log")).select(
        "drug_id", "snapshot_date", "setup", "evidence")


# --- current tables ---------------------------------------------------------------------------------

@query
def freshest_tags(s, d):
    """Rows of the freshest of several competing tags per ticker."""
    return facts.freshest_tag(V(s, d, "xbrl_fact"), KINDS).groupBy("ticker", "kind", "tag").agg(
        F.count("*").alias("n"), F.max("end_date").alias("newest"))


@query
def current_financials(s, d):
    return rounded(facts.current_financials(V(s, d, "xbrl_fact"), KINDS))


def _form4(s, d):
    tx = B(s, d, "lineitem").select(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.col("l_orderkey").alias("accession"),
        F.when(F.col("l_returnflag") == "R", "P").otherwise("S").alias("code"),
        F.col("l_quantity").alias("shares"),
        F.when(F.col("l_linenumber") != 5, F.col("l_tax") + 1.0).alias("price"),
        F.when(F.col("l_linenumber") != 6, F.concat(
            F.lit("Owner "), (F.col("l_partkey") % 5).cast("string"))).otherwise("")
        .alias("owner"),
        F.when(F.col("l_linenumber") <= 2, "senior").otherwise("director").alias("role"),
        F.when(F.col("l_linenumber") <= 2, "CEO").otherwise("").alias("title"),
        (F.col("l_quantity") * F.col("l_linenumber") * 0.75).alias("held_after"),
        (F.col("l_partkey") * 100 + F.col("l_quantity")).cast("bigint").alias("tx_pos"))
    filed = V(s, d, "filing_index").select("ticker", F.lit("4").alias("form"), "filed", "accession",
                                           F.col("accession").alias("pos"))
    return filed, tx


@query
def newest_ownership_filings(s, d):
    filed, _ = _form4(s, d)
    return insiders.newest_filings(filed, px.RUN_DATE, max_filings=3).select("ticker", "accession")


@query
def insider_table(s, d):
    filed, tx = _form4(s, d)
    asked = B(s, d, "supplier").select(F.explode(F.array(
        *[F.concat(F.lit(c), F.col("s_suppkey").cast("string")) for c in "TQ"])).alias("ticker"))
    return rounded(insiders.current_insiders(asked, filed, tx, px.RUN_DATE), 4)


@query
def ownership_changes(s, d):
    _, tx = _form4(s, d)
    return rounded(tx.select("accession", "tx_pos", "code", insiders.ownership_change(
        F.col("code"), F.col("shares"), F.col("held_after")).alias("delta_own")))


@query
def latest_short_interest(s, d):
    return current.latest_short_interest(published(V(s, d, "short_interest")), today=px.RUN_DATE)


@query
def financing_table(s, d):
    f = V(s, d, "filing_index")
    return current.financing(f, f, V(s, d, "financials"), px.RUN_DATE)


@query
def newest_guidance(s, d):
    """The most recent statement per company."""
    st = B(s, d, "orders").select(
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("filed"),
        F.to_date("o_orderdate").alias("period_lo"), F.to_date("o_orderdate").alias("period_hi"),
        F.col("o_orderpriority").alias("phrase"))
    return current.newest_statement(st)


@query
def calendar_union_deduplicated(s, d):
    """Two calendars of different columns stacked, then the most informative row per event."""
    a = V(s, d, "catalysts").select(
        "drug_id", "ticker", "drug_name", "nct_id", "indication", "simplified_stage",
        F.date_format(F.trunc("catalyst_date_lo", "month"), "yyyy-MM-dd")
        .alias("catalyst_date_raw")).where("simplified_stage is not null")
    b = a.where("simplified_stage = 'pdufa'").select(
        (F.col("drug_id") + 100000000).alias("drug_id"), "ticker", "catalyst_date_raw",
        "simplified_stage", F.lit(fv.NO_DRUG_NAME).alias("drug_name"))
    return cal.most_informative(a.unionByName(b, allowMissingColumns=True)).select(
        "drug_id", "ticker", "catalyst_date_raw", "simplified_stage")


# --- studies ------------------------------------------------------------------------------------------

def _study(s, d, build) -> studies.Study:
    return build(market(s, d), px.STUDY_START, px.STUDY_END)


_ABN = ("abn_21d", "abn_63d", "abn_126d")


@query
def runway_study_events(s, d):
    return rounded(_study(s, d, studies.runway_study).events.select(
        "ticker", "event_date", "entry_date", "runway_months", "runway_bucket", "size_bucket",
        "distressed_micro", *_ABN))


@query
def cadence_study_events(s, d):
    return rounded(_study(s, d, studies.cadence_study).events.select(
        "ticker", "event_date", "burst_bucket", "count_bucket", "interaction", *_ABN))


@query
def squeeze_study_events(s, d):
    return rounded(_study(s, d, studies.squeeze_study).events.select(
        "ticker", "event_date", "dtc_bucket", "interaction", *_ABN))


@query
def financing_study_events(s, d):
    return rounded(_study(s, d, studies.financing_study).events.select(
        "ticker", "event_date", "dilution_label", "dilution_notes", "recent_deal", "interaction",
        *_ABN))


@query
def insider_study_events(s, d):
    return rounded(_study(s, d, studies.insider_study).events.select(
        "ticker", "event_date", "net_bucket", "cluster", "interaction", *_ABN))


def _readouts(s, d) -> DataFrame:
    """Catalysts with their trial's design as historical readouts."""
    c = V(s, d, "catalysts").select(
        F.concat(F.lit("R"), F.col("drug_id").cast("string")).alias("nct_id"), "ticker",
        F.col("catalyst_date_lo").alias("event_date"), "indication", "simplified_stage",
        F.col("nct_id").alias("design_id"), F.lit("ctgov").alias("anchor"))
    t = V(s, d, "trials").select(F.col("nct_id").alias("design_id"), "allocation", "masking",
                                 "enrollment")
    return c.join(t, "design_id", "left").drop("design_id")


def _readout_study(s, d) -> studies.Study:
    return studies.readout_study(_readouts(s, d), V(s, d, "price_bar"), px.STUDY_START,
                                 px.STUDY_END)


@query
def readout_study_events(s, d):
    return rounded(_readout_study(s, d).events.select(
        "nct_id", "ticker", "entry_date", "loa", "prior_bucket", "design_bucket",
        "enroll_bucket", "runup_bucket", "abn_1d", "abn_5d", "abn_21d", "abn_63d"))


def _summary(study: studies.Study) -> DataFrame:
    return rounded(study.summary(), 6)


@query
def runway_study(s, d):
    return _summary(_study(s, d, studies.runway_study))


@query
def cadence_study(s, d):
    return _summary(_study(s, d, studies.cadence_study))


@query
def squeeze_study(s, d):
    return _summary(_study(s, d, studies.squeeze_study))


@query
def financing_study(s, d):
    return _summary(_study(s, d, studies.financing_study))


@query
def insider_study(s, d):
    return _summary(_study(s, d, studies.insider_study))


@query
def readout_study(s, d):
    return _summary(_readout_study(s, d))


@query
def grouped_medians(s, d):
    """Exact medians of line prices per flag and of a heavily repeated value."""
    li = B(s, d, "lineitem")
    price = inference.exact_median(li.select("l_returnflag", (F.col("l_extendedprice") / 1e5)
                                             .alias("v")), ["l_returnflag"], "v")
    rate = inference.exact_median(li.select("l_returnflag", F.col("l_discount").alias("v")),
                                  ["l_returnflag"], "v")
    return rounded(price.withColumnRenamed("median", "price").join(
        rate.withColumnRenamed("median", "rate"), "l_returnflag"))


# --- filings read for dates, stored versions, logs and extracts ------------------------------------

@query
def guidance_table(s, d):
    return current.guidance(V(s, d, "event_filing"), px.RUN_DATE).select(
        "ticker", "filed", "period_lo", "period_hi", "phrase")


@query
def decision_dates(s, d):
    return cal.decision_rows(V(s, d, "event_filing"), px.RUN_DATE).select(
        "ticker", "catalyst_date_lo", "catalyst_date_raw", "filed", "doc_id")


@query
def filed_decisions(s, d):
    """All decision dates of filings that state two, with the drug and indication near each."""
    return cal.decision_rows(spread(V(s, d, "two_date_filing")), px.RUN_DATE).select(
        "ticker", "catalyst_date_lo", "filed", "doc_id", "drug_name", "indication")


@query
def financials_on_a_date(s, d):
    """Current financials on a run date before which only part of the facts was filed."""
    return rounded(current.financials(V(s, d, "xbrl_fact"), KINDS, today=px.STUDY_END))


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@query
def stored_versions(s, d):
    """The financials table after two replacements, the second made from the first."""
    path = _folder(s, "table")
    tb.overwrite(V(s, d, "financials"), path)
    tb.overwrite(tb.read_current(s, path).where("cash_asof > DATE '2000-04-05'"), path)
    return tb.read_current(s, path).select("ticker", "cash_usd", "cash_asof")


@query
def log_round_trip(s, d):
    """The verdict log dumped as CSV and seeded twice into an empty table."""
    path, schema = _folder(s, "log"), TABLES["verdict_log"]
    logs.dump(tb.reconcile(V(s, d, "verdict_log"), schema).select(*schema.fieldNames()),
              "verdict_log", path)
    once = logs.seed(s.createDataFrame([], schema), s, "verdict_log", path)
    return logs.seed(once, s, "verdict_log", path).select(
        "drug_id", "snapshot_date", "verdict", "setup", "conviction", "evidence", "catalyst_date")


@query
def study_events_csv(s, d):
    """Cadence study events written as CSV and read back."""
    path = _folder(s, "events")
    studies.cadence_study(market(s, d), px.STUDY_START, px.STUDY_END).write_events(path)
    return s.read.option("header", True).csv(path).groupBy("ticker").agg(
        F.count("*").alias("n"), F.min(F.col("event_date").cast("date")).alias("first_event"))
