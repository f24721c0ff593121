"""Readers of landed files.

Each source has a `read_*` function for its files and a function from the raw columns to typed
rows, so that raw rows may also come from a table. Readers always pass a schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide import schemas
from eventide.functions.dates import day_key, fuzzy_date, publication_date
from eventide.functions.text import (clean_number, company_key, owner_role, simple_stage,
                                     squeeze, strip, ticker_in_name)
from eventide.operators.names import match_sponsors

TRIAL_JSON = """protocolSection STRUCT<
    identificationModule: STRUCT<nctId: STRING, briefTitle: STRING>,
    statusModule: STRUCT<overallStatus: STRING,
        primaryCompletionDateStruct: STRUCT<date: STRING>>,
    designModule: STRUCT<studyType: STRING, phases: ARRAY<STRING>,
        enrollmentInfo: STRUCT<count: STRING>,
        designInfo: STRUCT<allocation: STRING, maskingInfo: STRUCT<masking: STRING>>>,
    conditionsModule: STRUCT<conditions: ARRAY<STRING>>,
    sponsorCollaboratorsModule: STRUCT<leadSponsor: STRUCT<name: STRING, class: STRING>>>"""
FACT = ("STRUCT<start: STRING, `end`: STRING, val: DOUBLE, filed: STRING, form: STRING>")
COMPANY_FACTS_JSON = ("cik STRING, facts MAP<STRING, MAP<STRING, STRUCT<units: "
                      f"MAP<STRING, ARRAY<{FACT}>>>>>")
INDEX_ARRAYS = ("STRUCT<form: ARRAY<STRING>, filingDate: ARRAY<STRING>, "
                "accessionNumber: ARRAY<STRING>, primaryDocument: ARRAY<STRING>>")
SUBMISSIONS_JSON = f"cik STRING, filings STRUCT<recent: {INDEX_ARRAYS}>"
VALUE = "STRUCT<value: STRING>"
TRANSACTION = (
    "ARRAY<STRUCT<transactionDate: {v}, transactionCoding: STRUCT<transactionCode: STRING>, "
    "transactionCode: STRING, transactionShares: {v}, transactionPricePerShare: {v}, "
    "sharesOwnedFollowingTransaction: {v}, "
    "transactionAmounts: STRUCT<transactionShares: {v}, transactionPricePerShare: {v}>, "
    "postTransactionAmounts: STRUCT<sharesOwnedFollowingTransaction: {v}>>>").format(v=VALUE)
OWNERSHIP_XML = (
    "reportingOwner ARRAY<STRUCT<reportingOwnerId: STRUCT<rptOwnerName: STRING>, "
    "reportingOwnerRelationship: STRUCT<isDirector: STRING, isOfficer: STRING, "
    "isTenPercentOwner: STRING, officerTitle: STRING>>>, "
    f"nonDerivativeTransaction {TRANSACTION}, "
    f"nonDerivativeTable STRUCT<nonDerivativeTransaction: {TRANSACTION}>")
RSS_XML = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, pubDate: STRING, link: STRING>>>"
NEWS_JSON = (
    "ticker STRING, content STRUCT<title: STRING, pubDate: STRING, providerPublishTime: STRING, "
    "canonicalUrl: STRUCT<url: STRING>>, title STRING, pubDate STRING, "
    "providerPublishTime STRING, canonicalUrl STRUCT<url: STRING>")
CALENDAR_JSON = ", ".join(
    f"{n} " + {"statuses": "ARRAY<STRUCT<abbreviation: STRING>>"}.get(n, "STRING")
    for n in fv.CALENDAR_FREE_FIELDS)


def iso_day(c: Column) -> Column:
    """A date from exact ISO text, NULL otherwise."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def _path(*steps: str) -> Column:
    return F.col("protocolSection." + ".".join(steps))


# --- trials -----------------------------------------------------------------------------------

def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial records, one JSON document per line."""
    return spark.read.schema(TRIAL_JSON).json(path)


def trial_designs(raw: DataFrame) -> DataFrame:
    """Design facts, one row per trial id."""
    d = ("designModule", "designInfo")
    rows = raw.select(
        strip(_path("identificationModule", "nctId")).alias("nct_id"),
        _path("statusModule", "overallStatus").alias("overall_status"),
        F.array_join(F.coalesce(_path("designModule", "phases"), F.array()), ",").alias("phases"),
        _path("designModule", "enrollmentInfo", "count").try_cast("int").alias("enrollment"),
        _path(*d, "allocation").alias("allocation"),
        _path(*d, "maskingInfo", "masking").alias("masking"),
        _path("statusModule", "primaryCompletionDateStruct", "date").alias("primary_completion"),
        _path("designModule", "studyType").alias("study_type"),
        _path("sponsorCollaboratorsModule", "leadSponsor", "name").alias("lead_sponsor"))
    return one_per(rows.where(F.upper("nct_id").startswith("NCT")), ["nct_id"])


def _industry_readouts(raw: DataFrame, start: Column, end: Column, phases) -> DataFrame:
    """Industry trials of the wanted phases whose completion can fall in [start, end]."""
    date = _path("statusModule", "primaryCompletionDateStruct", "date")
    ph = _path("designModule", "phases")
    when = F.coalesce(iso_day(date), F.concat(date, F.lit("-01")).try_cast("date"))
    return (raw.where((_path("sponsorCollaboratorsModule", "leadSponsor", "class") == "INDUSTRY")
                      & F.arrays_overlap(ph, F.array(*[F.lit(p) for p in phases]))
                      & when.between(start, end))
            .select(
                _path("identificationModule", "nctId").alias("nct_id"),
                _path("identificationModule", "briefTitle").alias("drug_name"),
                F.array_join(ph, ",").alias("stage"), date.alias("primary_completion"),
                _path("sponsorCollaboratorsModule", "leadSponsor", "name").alias("lead_sponsor"),
                F.array_join(F.coalesce(_path("conditionsModule", "conditions"), F.array()), "; ")
                .alias("indication"),
                _path("designModule", "enrollmentInfo", "count").try_cast("int")
                .alias("enrollment"),
                _path("designModule", "designInfo", "allocation").alias("allocation"),
                _path("designModule", "designInfo", "maskingInfo", "masking").alias("masking"),
                _path("statusModule", "overallStatus").alias("overall_status")))


def candidate_readouts(raw: DataFrame, registry: DataFrame, today, horizon: int = 180,
                       lookback: int = 0, phases=("PHASE2", "PHASE3")) -> DataFrame:
    """Recruiting or active industry trials that complete around now, with a ticker if known."""
    day = F.lit(today).cast("date")
    rows = _industry_readouts(raw, F.date_sub(day, lookback), F.date_add(day, horizon), phases)
    rows = rows.where(F.col("overall_status").isin("RECRUITING", "ACTIVE_NOT_RECRUITING"))
    return match_sponsors(rows, registry)


def historical_readouts(raw: DataFrame, registry: DataFrame, start, end,
                        phases=("PHASE2", "PHASE3")) -> DataFrame:
    """Past industry readouts with a listed sponsor: one row per trial, anchor `ctgov`."""
    rows = _industry_readouts(raw, F.lit(start).cast("date"), F.lit(end).cast("date"), phases)
    when = fuzzy_date(F.col("primary_completion"))
    rows = (rows.withColumn("_d", when).where("_d.lo is not null")
            .withColumns({"event_date": F.col("_d.lo"), "date_precision": F.col("_d.precision"),
                          "stage_raw": F.col("stage"),
                          "simplified_stage": simple_stage(F.col("stage")),
                          "anchor": F.lit("ctgov")})
            .drop("_d", "stage", "primary_completion"))
    return one_per(match_sponsors(rows, registry).where("ticker is not null"), ["nct_id"])


# --- registry, facts, filing index --------------------------------------------------------------

_ENTRY_START = r'^[\s,{]*"\d+"\s*:\s*\{'


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Company registry: a JSON object of numbered entries, as (title, ticker, cik, pos).

    The object is read in splits, cut at closing braces, so many tasks share one large file. A brace in
    a title cuts an entry into pieces that are no entry; these few are put together again in file order.
    """
    raw = (spark.read.option("lineSep", "}").text(path)
           .select("value", F.col("_metadata.file_path").alias("file"), scan_order().alias("at")))
    whole = raw.withColumn("e", _entry(F.col("value")))
    pieces = (whole.where("e.v.title is null and e.v.ticker is null and e.v.cik_str is null")
              .withColumn("n", F.sum(F.col("value").rlike(_ENTRY_START).cast("int")).over(
                  W.partitionBy("file").orderBy("at"))))
    mended = (pieces.groupBy("file", "n")
              .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
              # An entry ends with a value; braces after it close the object.
              .select(_entry(F.regexp_replace(F.array_join(F.col("p.value"), "}"), r"[\s}]+$", ""))
                      .alias("e")))
    return (whole.select("e").unionAll(mended)
            .where("e.v.title is not null or e.v.ticker is not null or e.v.cik_str is not null")
            .select("e.v.title", F.upper("e.v.ticker").alias("ticker"), F.col("e.v.cik_str").alias("cik"),
                    F.col("e.k").cast("bigint").alias("pos")))


def _entry(text: Column) -> Column:
    """struct(k, v) of an entry without its closing brace."""
    kind = "MAP<STRING, STRUCT<cik_str: BIGINT, ticker: STRING, title: STRING>>"
    bare = F.regexp_replace(text, r"^[\s,{]*", "")
    one = F.map_entries(F.from_json(F.concat(F.lit("{"), bare, F.lit("}}")), kind))
    entry = F.try_element_at(one, F.lit(1))
    return F.struct(entry["key"].alias("k"), entry["value"].alias("v"))


def scan_order() -> Column:
    """Place of a record in its file: where its split starts, plus its number in the task.

    A split has at least as many bytes as a task has records before its end, so places grow through
    the file, whatever is shuffled later.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + number


def ticker_cik(registry: DataFrame) -> DataFrame:
    """(ticker, cik); the last listing of a ticker wins."""
    return registry.groupBy("ticker").agg(F.max_by("cik", "pos").alias("cik"))


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPANY_FACTS_JSON).json(path)


def company_facts(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Long fact rows. A tag comes from the first taxonomy, the second only fills its gaps."""
    us, dei = F.col("facts")["us-gaap"], F.col("facts")["dei"]
    empty = F.create_map().cast(
        f"MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<{FACT}>>>>")
    tags = F.map_zip_with(
        F.coalesce(us, empty), F.coalesce(dei, empty),
        lambda k, a, b: F.when(F.size(F.coalesce(a["units"], F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast(f"array<array<{FACT}>>")))) > 0, a)
        .otherwise(b))
    rows = (raw.select(F.col("cik").cast("bigint").alias("cik"), F.explode(tags).alias("tag", "n"))
            .select("cik", "tag", F.explode("n.units").alias("unit", "facts"))
            .select("cik", "tag", "unit", F.posexplode("facts").alias("pos", "f")))
    names = ticker_cik(registry)
    return (rows.join(names, "cik").select(
        "ticker", "tag", "unit", iso_day(F.col("f.start")).alias("start_date"),
        iso_day(F.col("f.end")).alias("end_date"), iso_day(F.col("f.filed")).alias("filed"),
        F.col("f.val").alias("val"), F.col("f.form").alias("form"),
        F.col("pos").cast("bigint").alias("pos"))
        .where("filed is not null and val is not null"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(SUBMISSIONS_JSON).json(path)
            .select("cik", "filings.recent.*"))


def filing_rows(blocks: DataFrame, key: str = "ticker") -> DataFrame:
    """Parallel arrays of a filing index to rows; entries with a bad date are dropped."""
    zipped = F.arrays_zip("form", "filingDate", "accessionNumber")
    return (blocks.select(key, F.posexplode(zipped).alias("pos", "z"))
            .select(key, F.col("z.form").alias("form"), iso_day(F.col("z.filingDate"))
                    .alias("filed"), F.col("z.accessionNumber").alias("accession"),
                    F.col("pos").cast("bigint").alias("pos"))
            .where("filed is not null"))


def filing_index(recent: DataFrame, shards: DataFrame | None = None, since=None,
                 key: str = "ticker") -> DataFrame:
    """Filing rows; older shards join in only for keys whose recent block starts after `since`."""
    rows = filing_rows(recent, key)
    if shards is None or since is None:
        return rows
    short = recent.where(F.array_min(F.transform("filingDate", iso_day))
                         > F.lit(since).cast("date"))
    return rows.unionByName(filing_rows(shards.join(short.select(key).distinct(), key,
                                                    "left_semi"), key))


# --- insider filings ----------------------------------------------------------------------------

def read_tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).csv(path, sep="\t", header=True)


def insider_quarter(submissions: DataFrame, transactions: DataFrame) -> DataFrame:
    """Open-market rows of the quarterly data set, keyed by filing date.

    The last submission row of an accession wins; `SEQ` is the file order where the two differ.
    """
    order = F.col("SEQ") if "SEQ" in submissions.columns else F.lit(0)
    sub = (submissions.where(F.col("DOCUMENT_TYPE") == "4")
           .groupBy("ACCESSION_NUMBER").agg(F.max_by(
               F.struct("ISSUERTRADINGSYMBOL", "FILING_DATE"), order).alias("m"))
           .select("ACCESSION_NUMBER", "m.*")
           .where(~F.coalesce(F.col("ISSUERTRADINGSYMBOL"), F.lit("")).isin("", "NA")))
    shares_text = F.coalesce(F.nullif(F.col("TRANS_SHARES"), F.lit("")), F.lit("0"))
    price_text = F.coalesce(F.nullif(F.col("TRANS_PRICEPERSHARE"), F.lit("")), F.lit("0"))
    filed = F.try_to_date(F.initcap(F.lower(F.col("FILING_DATE"))), "dd-MMM-yyyy")
    rows = (transactions.where(F.col("TRANS_CODE").isin("P", "S"))
            .join(sub, "ACCESSION_NUMBER")
            .select(F.upper("ISSUERTRADINGSYMBOL").alias("ticker"), filed.alias("filed_date"),
                    F.col("ACCESSION_NUMBER").alias("accession"),
                    F.col("TRANS_CODE").alias("code"),
                    shares_text.try_cast("double").alias("shares"),
                    price_text.try_cast("double").alias("p"))
            .where("filed_date is not null and shares is not null and p is not null"))
    price = F.when(F.col("p") != 0, F.col("p"))
    return rows.select("ticker", "filed_date", "accession", "code", "shares",
                       price.alias("price"),
                       F.coalesce(F.col("shares") * price, F.lit(0.0)).alias("usd"))


def insider_documents(docs: DataFrame) -> DataFrame:
    """Open-market rows of ownership filings: `docs` has (ticker, accession, filed_date, xml)."""
    doc = F.from_xml("xml", OWNERSHIP_XML, {"rowTag": "ownershipDocument", "mode": "PERMISSIVE"})
    empty = F.array().cast(TRANSACTION)
    owner = F.try_element_at(F.col("d.reportingOwner"), F.lit(1))
    rel = owner["reportingOwnerRelationship"]
    title = F.coalesce(strip(squeeze(rel["officerTitle"])), F.lit(""))

    def yes(c):
        return F.lower(strip(c)).isin("1", "true")
    role = owner_role(yes(rel["isOfficer"]), yes(rel["isDirector"]), yes(rel["isTenPercentOwner"]),
                      title)
    # What holds for a document is taken before its transactions are listed: once, and not carried whole.
    # The outer form infers no filter on the list, for which each document would be parsed a second time;
    # its row of a document without transactions has no code and goes with the filter below.
    rows = (docs.withColumn("d", doc).select(
        "ticker", "accession", "filed_date", role.alias("role"), title.alias("_title"),
        F.coalesce(strip(squeeze(owner["reportingOwnerId"]["rptOwnerName"])), F.lit(""))
        .alias("owner"),
        F.concat(F.coalesce(F.col("d.nonDerivativeTable.nonDerivativeTransaction"), empty),
                 F.coalesce(F.col("d.nonDerivativeTransaction"), empty)).alias("_tx"))
        .select("*", F.posexplode_outer("_tx").alias("tx_pos", "t")).drop("_tx"))
    code = strip(F.coalesce(F.col("t.transactionCoding.transactionCode"),
                            F.col("t.transactionCode")))
    shares = F.coalesce(F.col("t.transactionAmounts.transactionShares.value"),
                        F.col("t.transactionShares.value"), F.lit("0"))
    price = F.coalesce(F.col("t.transactionAmounts.transactionPricePerShare.value"),
                       F.col("t.transactionPricePerShare.value"))
    after = F.coalesce(F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value"),
                       F.col("t.sharesOwnedFollowingTransaction.value"))
    shown = (F.when(F.col("_title") != "", F.col("_title")).when(F.col("role") == "director",
                                                                 "Director")
             .when(F.col("role") == "ten_percent", "10% owner").otherwise(F.col("_title")))
    return (rows.select("ticker", "accession", "filed_date", code.alias("code"),
                        strip(shares).try_cast("double").alias("shares"),
                        clean_number(strip(price)).alias("price"), "owner", "role",
                        shown.alias("title"), clean_number(strip(after)).alias("held_after"),
                        "tx_pos", strip(F.col("t.transactionDate.value")).alias("date"))
            .where("code in ('P', 'S') and shares is not null"))


# --- short interest, bars, splits, options -------------------------------------------------------

SHORT_INTEREST_CSV = ("symbolCode STRING, settlementDate STRING, "
                      "currentShortPositionQuantity STRING, "
                      "previousShortPositionQuantity STRING, averageDailyVolumeQuantity STRING, "
                      "daysToCoverQuantity STRING, changePercent STRING")


def read_short_interest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHORT_INTEREST_CSV).csv(path, header=True)


def short_interest(raw: DataFrame) -> DataFrame:
    """Typed readings; rows without a settlement date or a short quantity are dropped."""
    settled = iso_day(F.col("settlementDate"))
    return (raw.select(
        F.upper("symbolCode").alias("ticker"), settled.alias("settlement_date"),
        publication_date(settled).alias("published_date"),
        clean_number(F.col("currentShortPositionQuantity")).alias("shares_short"),
        clean_number(F.col("previousShortPositionQuantity")).alias("shares_short_prior"),
        clean_number(F.col("averageDailyVolumeQuantity")).alias("avg_daily_volume"),
        clean_number(F.col("daysToCoverQuantity")).alias("days_to_cover"),
        clean_number(F.col("changePercent")).alias("change_pct"))
        .where("settlement_date is not null and shares_short is not null"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily adjusted bars (ticker, day, close, volume) from Parquet."""
    return (spark.read.schema("ticker STRING, day DATE, close DOUBLE, volume DOUBLE")
            .parquet(path).where("close is not null and not isnan(close)"))


def splits(raw: DataFrame) -> DataFrame:
    return raw.where("ratio > 0").select(F.upper("ticker").alias("ticker"), "day", "ratio")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return splits(spark.read.schema("ticker STRING, day DATE, ratio DOUBLE")
                  .csv(path, header=True))


def read_option_quotes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "ticker STRING, asof DATE, spot DOUBLE, expiry DATE, side STRING, strike DOUBLE, "
        "bid DOUBLE, ask DOUBLE, last DOUBLE, iv DOUBLE, pos BIGINT").parquet(path)


# --- headlines ----------------------------------------------------------------------------------

def rss_headlines(docs: DataFrame) -> DataFrame:
    """Headlines of RSS documents (ticker, xml); a malformed document gives no rows."""
    doc = F.from_xml("xml", RSS_XML, {"rowTag": "rss", "mode": "PERMISSIVE"})
    stamp = strip(F.col("i.pubDate"))
    # Day names are not needed to place an instant, so they are cut before parsing.
    bare = F.regexp_replace(stamp, r"^[A-Za-z]{3},\s+", "")
    utc = F.regexp_replace(bare, r"\s(?:GMT|UTC)$", " +0000")
    when = F.try_to_timestamp(F.regexp_replace(utc, r"\s[+-]\d{4}$", ""),
                              F.lit("d MMM yyyy HH:mm:ss"))
    return (docs.withColumn("d", doc)
            .select("ticker", F.posexplode("d.channel.item").alias("pos", "i"))
            .select("ticker", strip(F.col("i.title")).alias("title"),
                    F.to_date(when).alias("published"), strip(F.col("i.link")).alias("link"),
                    F.lit("rss").alias("source"), F.col("pos").cast("bigint").alias("pos"))
            .where("title is not null and title != ''"))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """News items with their place in the feed's file."""
    return spark.read.schema(NEWS_JSON).json(path).withColumn("pos", scan_order())


def news_headlines(raw: DataFrame) -> DataFrame:
    """Headlines of news JSON, nested under `content` or flat, ISO or epoch stamped."""
    def pick(name):
        return F.when(F.col("content").isNotNull(), F.col(f"content.{name}")).otherwise(F.col(name))
    stamp = F.coalesce(pick("pubDate"), pick("providerPublishTime"))
    epoch = F.to_date(F.timestamp_seconds(stamp.try_cast("double")))
    when = F.coalesce(epoch, day_key(stamp))
    return (raw.select("ticker", pick("title").alias("title"), when.alias("published"),
                       F.coalesce(pick("canonicalUrl")["url"], F.lit("")).alias("link"),
                       F.lit("news").alias("source"), "pos")
            .where("title is not null and title != '' and published is not null"))


def since(rows: DataFrame, day: str, today, days: int) -> DataFrame:
    """Rows dated within the trailing days and not after today; undated rows are dropped."""
    end = F.lit(today).cast("date")
    return rows.where(F.col(day).between(F.date_sub(end, days), end))


# --- curated calendar ---------------------------------------------------------------------------

def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Curated calendar rows; the schema itself drops every column outside the allow-list."""
    return spark.read.schema(CALENDAR_JSON).json(path)


def designations(statuses: Column) -> Column:
    tags = F.filter(F.transform(statuses, lambda s: s["abbreviation"]),
                    lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(tags)), " "), F.lit(""))


def curated_calendar(raw: DataFrame, include_paid: bool = False) -> DataFrame:
    """Catalyst rows of the curated calendar, placeholders removed, one per drug and raw date."""
    allowed = fv.CALENDAR_FREE_FIELDS + (fv.CALENDAR_PAID_FIELDS if include_paid else ())
    rows = raw.select(*[x for x in allowed if x in raw.columns])
    rows = rows.withColumn("designations", designations(F.col("statuses")))
    rows = rows.withColumn("_d", fuzzy_date(F.col("catalyst_date")))
    rows = rows.withColumns({"catalyst_date_lo": F.col("_d.lo"),
                             "catalyst_date_hi": F.col("_d.hi"),
                             "date_precision": F.col("_d.precision")})
    rows = rows.drop("_d", "statuses", "drug_updated_at")
    rows = rows.withColumnsRenamed(fv.CALENDAR_RENAMES)
    rows = rows.withColumns({"price": clean_number(F.col("price")),
                             "optionable": F.col("optionable").try_cast("boolean"),
                             "drug_id": F.col("drug_id").try_cast("bigint")})
    placeholder = (F.col("stage").isNull() & F.col("next_catalyst").isNull()
                   & F.col("fda_status").isNull())
    return one_per(rows.where(~placeholder), ["drug_id", "catalyst_date_raw"])


# --- filing text --------------------------------------------------------------------------------

def filing_hits(docs: DataFrame, phrases, today, months_back: int, form: str = "8-K",
                text: str = "html") -> DataFrame:
    """Filings of a trailing window that contain any phrase, with ticker and company name.

    `docs` has (cik, doc_id, form, filed, display_name) and the text column.
    """
    day = F.lit(today).cast("date")
    body = F.lower(F.col(text))
    any_phrase = F.lit(False)
    for p in phrases:
        any_phrase = any_phrase | body.contains(p.lower())
    return (docs.where((F.col("form") == form)
                       & F.col("filed").between(F.date_sub(day, 30 * months_back), day)
                       & any_phrase)
            .select(ticker_in_name(F.col("display_name")).alias("ticker"),
                    F.element_at(F.split("display_name", r"  \("), 1).alias("company_name"),
                    "filed", "cik", "doc_id", text))


def one_per(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the least by its other columns in order: the same in every run."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min(rest).alias("r")).select(*keys, "r.*").select(rows.columns)


def one_per_filing_day(hits: DataFrame) -> DataFrame:
    """One hit per (ticker, filed), the smallest document id."""
    rest = F.struct(*[c for c in hits.columns if c not in ("ticker", "filed")])
    return (hits.groupBy("ticker", "filed").agg(F.min_by(rest, "doc_id").alias("r"))
            .select("ticker", "filed", "r.*"))


# --- logs ---------------------------------------------------------------------------------------

def read_log(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A committed log. Only an empty cell is missing; `n/a` is a label like any other."""
    schema = schemas.TABLES[name]
    text = ", ".join(f"{f.name} STRING" for f in schema.fields)
    raw = spark.read.schema(text).csv(path, header=True, nullValue="", emptyValue="")
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def company_names(registry: DataFrame) -> DataFrame:
    """Registry with its normalised name."""
    return registry.withColumn("name", company_key(F.col("title")))
