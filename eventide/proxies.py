"""Domain tables derived from the driver tables.

No market data ships with the driver tables, so the landed domain tables are derived from them by
SQL that Spark and DuckDB both run unchanged. Every view reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RUN_DATE = "2000-06-30"
STUDY_START, STUDY_END = "1996-01-01", "2001-08-01"

SUPPLIERS = "(SELECT count(*) FROM supplier)"
_INDICATION = """CASE o_orderkey % 12 WHEN 0 THEN 'Non-small cell lung cancer'
    WHEN 1 THEN 'Duchenne muscular dystrophy' WHEN 2 THEN 'acute myeloid leukemia'
    WHEN 3 THEN 'cUTI, including pyelonephritis' WHEN 4 THEN 'lupus nephritis'
    WHEN 5 THEN 'autism spectrum disorder' WHEN 6 THEN 'transthyretin amyloid cardiomyopathy'
    WHEN 7 THEN 'Type 2 diabetes' WHEN 8 THEN 'Wet AMD'
    WHEN 9 THEN 'cystic fibrosis' WHEN 10 THEN 'a ligand binding study'
    ELSE NULL END"""

VIEWS = {
    "price_bar": """
        SELECT concat('T', CAST(l_suppkey AS STRING)) AS ticker,
               CAST(date_trunc('week', l_shipdate) AS DATE) AS day,
               min(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume
        FROM lineitem GROUP BY 1, 2
        UNION ALL
        SELECT 'BENCH', CAST(date_trunc('week', l_shipdate) AS DATE),
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity),
               sum(l_quantity)
        FROM lineitem GROUP BY 1, 2""",
    "filing_index": f"""
        SELECT concat('T', CAST(o_custkey % {SUPPLIERS} AS STRING)) AS ticker,
               CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '424B5'
                    WHEN '3-MEDIUM' THEN 'S-3' WHEN '4-NOT SPECIFIED' THEN '10-Q'
                    ELSE '10-K' END AS form,
               CAST(o_orderdate AS DATE) AS filed, o_orderkey AS accession
        FROM orders""",
    "xbrl_fact": """
        SELECT concat('T', CAST(l_suppkey AS STRING)) AS ticker,
               concat(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'shares'
                    WHEN l_returnflag = 'R' THEN 'cash'
                    WHEN l_returnflag = 'A' THEN 'burn' ELSE 'investments' END,
                    CASE WHEN l_orderkey % 3 = 0 THEN '_b' ELSE '' END) AS tag,
               CASE WHEN l_linenumber = 5 THEN 'EUR'
                    WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'shares' ELSE 'USD' END AS unit,
               date_add(CAST(l_shipdate AS DATE), CAST(-(60 + l_quantity) AS INT)) AS start_date,
               CAST(l_shipdate AS DATE) AS end_date,
               date_add(CAST(l_shipdate AS DATE), CAST(35 + 5 * l_linenumber AS INT)) AS filed,
               CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_quantity * 10000
                    WHEN l_returnflag = 'R' THEN 5 * l_extendedprice
                    WHEN l_returnflag = 'A' THEN -l_extendedprice ELSE l_extendedprice END AS val,
               CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber
                    ELSE l_orderkey * 8 + l_linenumber END AS pos
        FROM lineitem""",
    "insider_tx": """
        SELECT concat('T', CAST(l_suppkey AS STRING)) AS ticker,
               CAST(l_shipdate AS DATE) AS filed_date, l_orderkey AS accession,
               CASE l_returnflag WHEN 'R' THEN 'P' WHEN 'A' THEN 'S' ELSE 'F' END AS code,
               l_quantity AS shares, l_extendedprice AS usd
        FROM lineitem""",
    "short_interest": """
        SELECT concat('T', CAST(l_suppkey AS STRING)) AS ticker,
               last_day(CAST(l_shipdate AS DATE)) AS settlement_date,
               sum(l_quantity) * 1000 AS shares_short,
               sum(l_quantity * (1 + l_linenumber % 2)) * 600 AS shares_short_prior,
               min(l_quantity) / 1.5 AS days_to_cover
        FROM lineitem GROUP BY 1, 2""",
    "split_event": f"""
        SELECT concat('T', CAST(p_partkey % {SUPPLIERS} AS STRING)) AS ticker,
               date_add(DATE '1996-01-01', CAST(p_partkey % 2000 AS INT)) AS day,
               CASE p_size % 3 WHEN 0 THEN 0.5E0 WHEN 1 THEN 2.0E0 ELSE 0.1E0 END AS ratio
        FROM part""",
    "verdict_log": """
        SELECT user_id AS drug_id, CAST(ts AS DATE) AS snapshot_date,
               min(event_type) AS verdict,
               CASE min(event_type) WHEN 'click' THEN 'DILUTION_SHORT'
                    WHEN 'error' THEN 'NO_EDGE' ELSE 'RUNUP_FADE' END AS setup,
               CAST(least(floor(min(value)), 100) AS INT) AS conviction,
               CASE WHEN count(*) % 3 = 0 THEN '' ELSE 'n/a' END AS evidence,
               DATE '2024-03-01' AS catalyst_date
        FROM events GROUP BY 1, 2""",
    "catalysts": f"""
        SELECT o_orderkey AS drug_id,
               concat('T', CAST(o_custkey % {SUPPLIERS} AS STRING)) AS ticker,
               concat('Company ', CAST(o_custkey AS STRING)) AS company_name,
               concat('Drug-', CAST(o_orderkey AS STRING)) AS drug_name,
               concat('NCT', lpad(CAST(o_custkey AS STRING), 8, '0')) AS nct_id,
               {_INDICATION} AS indication,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Phase 1' WHEN '2-HIGH' THEN 'Phase 2'
                    WHEN '3-MEDIUM' THEN 'Phase 3' WHEN '4-NOT SPECIFIED' THEN 'PDUFA'
                    ELSE 'Phase 2/3' END AS stage,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'phase1' WHEN '2-HIGH' THEN 'phase2'
                    WHEN '3-MEDIUM' THEN 'phase3' WHEN '4-NOT SPECIFIED' THEN 'pdufa'
                    ELSE 'phase2/3' END AS simplified_stage,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS catalyst_date_raw,
               CAST(o_orderdate AS DATE) AS catalyst_date_lo,
               date_add(CAST(o_orderdate AS DATE),
                        CAST(CASE WHEN o_orderkey % 2 = 0 THEN 180 ELSE 0 END AS INT))
                   AS catalyst_date_hi,
               CASE WHEN o_orderkey % 2 = 0 THEN 'readout_window' WHEN o_orderstatus = 'F'
                    THEN 'day' WHEN o_orderstatus = 'O' THEN 'month_part'
                    ELSE 'quarter' END AS date_precision,
               CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'BTD' WHEN 2 THEN 'ODD FTD'
                    WHEN 3 THEN 'PRIME RMAT' ELSE NULL END AS designations
        FROM orders""",
    "trials": """
        SELECT concat('NCT', lpad(CAST(c_custkey AS STRING), 8, '0')) AS nct_id,
               CASE c_custkey % 2 WHEN 0 THEN 'RECRUITING' ELSE 'COMPLETED' END AS overall_status,
               'PHASE2' AS phases,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal / 20) AS INT) END
                   AS enrollment,
               CASE c_custkey % 4 WHEN 0 THEN 'RANDOMIZED' WHEN 1 THEN 'NON_RANDOMIZED'
                    WHEN 2 THEN 'NA' ELSE NULL END AS allocation,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'DOUBLE' WHEN 'MACHINERY' THEN 'QUADRUPLE'
                    WHEN 'HOUSEHOLD' THEN NULL ELSE 'NONE' END AS masking,
               '2000-06' AS primary_completion, 'INTERVENTIONAL' AS study_type,
               c_name AS lead_sponsor
        FROM customer""",
    "financials": """
        SELECT concat('T', CAST(s_suppkey AS STRING)) AS ticker,
               (s_acctbal + 1000) * 10000 AS cash_usd,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL
                    ELSE (s_nationkey + 1) * 1500000.0E0 END AS quarterly_burn_usd,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL
                    ELSE (s_acctbal + 1000) * 10000 / ((s_nationkey + 1) * 500000.0E0) END
                   AS runway_months,
               CASE WHEN s_suppkey % 11 = 0 THEN NULL
                    ELSE (s_suppkey % 50 + 1) * 2000000.0E0 END AS shares_outstanding,
               date_add(DATE '2000-03-31', CAST(s_nationkey AS INT)) AS cash_asof
        FROM supplier""",
    "prices": """
        SELECT concat('T', CAST(s_suppkey AS STRING)) AS ticker,
               (s_acctbal + 1000) / 400 AS last,
               CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE (s_acctbal - 4000) / 10000 END
                   AS ret_20d,
               (s_acctbal - 3000) / 8000 AS ret_60d,
               0.2E0 + (s_nationkey + 1) / 20.0E0 AS rvol_20d,
               0.1E0 + (s_nationkey + 1) / 25.0E0 AS rvol_60d,
               CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE (s_acctbal + 1000) * 700 END AS adv_usd,
               0.5E0 + s_nationkey / 50.0E0 AS pct_of_52w_high,
               CASE WHEN s_suppkey % 11 = 0 THEN NULL
                    ELSE (s_suppkey % 50 + 1) * 2000000.0E0 * ((s_acctbal + 1000) / 400) END
                   AS market_cap
        FROM supplier""",
    "implied": f"""
        SELECT concat('T', CAST(o_custkey % {SUPPLIERS} AS STRING)) AS ticker,
               CAST(o_orderdate AS DATE) AS catalyst_date,
               max(date_add(CAST(o_orderdate AS DATE), CAST(o_custkey % 20 AS INT))) AS expiry,
               max(o_totalprice) / 500000 AS atm_iv, min(o_totalprice) / 600000 AS implied_move
        FROM orders GROUP BY 1, 2""",
    "sentiment": f"""
        SELECT concat('T', CAST(c_custkey % {SUPPLIERS} AS STRING)) AS ticker,
               date_add(DATE '2000-05-01', CAST(c_custkey % 60 AS INT)) AS snapshot_date,
               max(c_acctbal) / 10000 AS sentiment, count(*) % 2 = 0 AS thin,
               CAST(count(*) AS INT) AS articles, CAST(max(c_custkey % 9) AS INT)
                   AS scored_articles,
               max(c_name) AS top_positive, CASE WHEN min(c_custkey % 3) = 0 THEN ''
                   ELSE min(c_name) END AS top_negative,
               CAST(max(c_custkey % 4) AS INT) AS eightk_30d,
               CAST(max(c_custkey % 11) AS INT) AS eightk_90d,
               CAST(max(c_custkey % 30) AS INT) AS days_since_8k
        FROM customer GROUP BY 1, 2""",
    "financing": """
        SELECT concat('T', CAST(s_suppkey AS STRING)) AS ticker,
               CASE s_suppkey % 4 WHEN 0 THEN 'cold' WHEN 1 THEN 'possible' WHEN 2 THEN 'likely'
                    ELSE 'loaded' END AS dilution_label,
               CAST(s_suppkey % 4 AS INT) AS dilution_readiness,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 5 AS INT) - 1 END
                   AS offerings_24m,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_nationkey * 9 AS INT) END
                   AS days_since_offering,
               s_suppkey % 2 = 0 AS shelf_live,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL
                    ELSE date_add(DATE '2000-06-30', CAST(-(s_nationkey * 9) AS INT)) END
                   AS last_offering_date
        FROM supplier""",
    "guidance": """
        SELECT concat('T', CAST(s_suppkey AS STRING)) AS ticker, DATE '2000-05-15' AS filed,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL
                    ELSE date_add(DATE '2000-06-01', CAST(s_nationkey * 8 AS INT)) END
                   AS period_lo,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL
                    ELSE date_add(DATE '2000-08-01', CAST(s_nationkey * 8 AS INT)) END
                   AS period_hi,
               concat('data expected ', s_name) AS phrase
        FROM supplier""",
    "insider": """
        SELECT concat('T', CAST(s_suppkey AS STRING)) AS ticker,
               DATE '2000-06-29' AS snapshot_date, (s_acctbal - 3000) / 10000 AS insider_tilt,
               s_acctbal * 50 AS net_usd, CAST(s_suppkey % 9 AS INT) AS form4_filings,
               s_acctbal * 40 AS senior_net_usd, s_suppkey % 3 = 0 AS cluster_buy,
               CAST(s_suppkey % 5 AS INT) AS n_buyers,
               (s_acctbal - 2000) / 9000 AS biggest_delta_own, s_name AS biggest_move_desc
        FROM supplier""",
    "raw_date": """
        SELECT o_orderkey AS id,
               CASE o_orderkey % 14
                 WHEN 0 THEN concat(CAST(m AS STRING), '/', CAST(d AS STRING), '/', y)
                 WHEN 1 THEN concat(y, '-', lpad(CAST(m AS STRING), 2, '0'), '-',
                                    lpad(CAST(d AS STRING), 2, '0'))
                 WHEN 2 THEN concat(y, '-', lpad(CAST(m AS STRING), 2, '0'))
                 WHEN 3 THEN concat(mon, ' ', CAST(d AS STRING), ', ', y)
                 WHEN 4 THEN concat('Mid ', abbr, ' ', y)
                 WHEN 5 THEN concat('Q', CAST(1 + m % 4 AS STRING), ' ', y)
                 WHEN 6 THEN concat(CAST(1 + m % 2 AS STRING), 'H ', y)
                 WHEN 7 THEN concat('Early ', y)
                 WHEN 8 THEN y
                 WHEN 9 THEN 'TBD'
                 WHEN 10 THEN concat(CAST(d AS STRING), ' ', mon, ' ', y)
                 WHEN 11 THEN concat('late-', abbr, '--', y)
                 WHEN 12 THEN concat(CAST(m AS STRING), '/', CAST(d + 20 AS STRING), '/', y)
                 ELSE concat('second half of ', y) END AS raw
        FROM (SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS m,
                     CAST(day(o_orderdate) AS INT) AS d,
                     CAST(year(o_orderdate) AS STRING) AS y,
                     CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February'
                       WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May'
                       WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August'
                       WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November'
                       ELSE 'December' END AS mon,
                     CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb'
                       WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May'
                       WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug'
                       WHEN 9 THEN 'Sept' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov'
                       ELSE 'Dec' END AS abbr
              FROM orders) x""",
    "headline": """
        SELECT source AS ticker, text AS title,
               date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT)) AS published,
               CASE doc_id % 2 WHEN 0 THEN 'rss' ELSE 'news' END AS source, doc_id AS pos
        FROM documents""",
    "event_filing": f"""
        SELECT concat('C', CAST(o_custkey AS STRING)) AS cik, o_orderkey AS doc_id,
               CASE WHEN o_orderkey % 7 = 0 THEN '10-Q' ELSE '8-K' END AS form,
               CAST(o_orderdate AS DATE) AS filed,
               concat('Company ', CAST(o_custkey AS STRING), CASE WHEN o_custkey % 5 = 0 THEN ''
                      ELSE concat('  (T', CAST(o_custkey % {SUPPLIERS} AS STRING), ')  (CIK 1)') END)
                   AS display_name,
               concat('<p>News &amp; updates.</p> <p>', CASE o_orderkey % 4
                 WHEN 0 THEN concat('Topline data expected in the ', CASE o_custkey % 4
                     WHEN 0 THEN 'first quarter' WHEN 1 THEN 'second half'
                     WHEN 2 THEN 'third quarter' ELSE 'fourth quarter' END, ' of ',
                     CAST(year(o_orderdate) + 1 AS STRING), '.')
                 WHEN 1 THEN concat('The PDUFA date is March ', CAST(1 + o_custkey % 28 AS STRING), ', ',
                     CAST(year(o_orderdate) + 1 AS STRING), ' for this.')
                 WHEN 2 THEN 'Data expected in due course.' ELSE 'Nothing new.' END, '</p>') AS html
        FROM orders""",
    "two_date_filing": f"""
        SELECT cik, doc_id, form, filed, display_name, concat(
            '<p>The agency accepted the NDA for Zelo', CAST(k % 50 AS STRING), ' for the treatment of ',
            CASE k % 3 WHEN 0 THEN 'plaque psoriasis' WHEN 1 THEN 'heart failure' ELSE 'celiac disease' END,
            '. The PDUFA date is March ', CASE WHEN k % 4 = 0 THEN '45' ELSE CAST(1 + k % 28 AS STRING) END, ', ',
            CAST(year(filed) + 1 AS STRING), '.</p><p>', repeat('Business went on as before &amp; well. ', 50),
            '</p><p>Work goes on. We filed the BLA for Bervo', CAST(k % 40 AS STRING), ' for patients with ',
            CASE k % 2 WHEN 0 THEN 'severe asthma' ELSE 'sickle cell disease' END,
            '. Its target action date is June ', CAST(1 + k % 29 AS STRING), ', ',
            CAST(year(filed) + 2 AS STRING), '.</p>') AS html
        FROM (SELECT concat('C', CAST(o_custkey AS STRING)) AS cik, o_orderkey AS doc_id, '8-K' AS form,
                     CAST(o_orderdate AS DATE) AS filed, o_custkey AS k,
                     concat('Company ', CAST(o_custkey AS STRING), '  (T',
                            CAST(o_custkey % {SUPPLIERS} AS STRING), ')  (CIK 1)') AS display_name
              FROM orders)""",
    "worded_headline": """
        SELECT doc_id, concat(CASE doc_id % 8
            WHEN 0 THEN 'Trial met the primary endpoint and shares surge. '
            WHEN 1 THEN 'Drug did not win approval; a complete response letter raises concern. '
            WHEN 2 THEN 'Study failed to show positive results, without success; shares plunge. '
            WHEN 3 THEN 'Fast track granted: strong and promising data, approval never certain. '
            WHEN 4 THEN 'No approval, no approval, approved elsewhere. '
            WHEN 5 THEN 'Unable to beat a weak market, the rally stops. '
            ELSE '' END, text) AS title
        FROM documents""",
    "option_quote": """
        SELECT concat('T', CAST(l_suppkey AS STRING)) AS ticker,
               (l_partkey % 40) + 20.0E0 AS strike, 40.0E0 AS spot,
               date_add(CAST(date_trunc('week', l_shipdate) AS DATE), 4) AS expiry,
               date_add(DATE '2000-06-30', CAST(l_orderkey % 9 AS INT) - 6) AS asof,
               CASE l_returnflag WHEN 'R' THEN 'C' ELSE 'P' END AS side,
               CASE WHEN l_linenumber = 3 THEN 0.0E0 ELSE l_quantity / 10 END AS bid,
               l_quantity / 8 AS ask, l_quantity / 9 AS last,
               CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount + 0.3E0 END AS iv,
               l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS pos
        FROM lineitem""",
}


_registered: dict = {}


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Register the driver tables as views, once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if _registered.get("key") == key and spark.catalog.tableExists(BASE[-1]):
        return
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    _registered["key"] = key


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived domain table."""
    tables(spark, sf_dir)
    return spark.sql(VIEWS[name])


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.table(name)
