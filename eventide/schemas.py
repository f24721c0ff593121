"""Schemas and keys of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, DateType, DoubleType, IntegerType, LongType,
                               StringType, StructType, TimestampType)

_TYPES = {"BIGINT": LongType(), "INT": IntegerType(), "STRING": StringType(),
          "DOUBLE": DoubleType(), "BOOLEAN": BooleanType(), "DATE": DateType(),
          "TIMESTAMP": TimestampType()}

_DDL = {
    "catalysts": """drug_id BIGINT, ticker STRING, company_name STRING, drug_name STRING,
        nct_id STRING, indication STRING, stage STRING, simplified_stage STRING,
        fda_status STRING, next_catalyst STRING, catalyst_date_raw STRING,
        catalyst_date_lo DATE, catalyst_date_hi DATE, date_precision STRING,
        designations STRING, note STRING, optionable BOOLEAN, price DOUBLE,
        pulled_at TIMESTAMP""",
    "trials": """nct_id STRING, overall_status STRING, phases STRING, enrollment INT,
        allocation STRING, masking STRING, primary_completion STRING, study_type STRING,
        lead_sponsor STRING, pulled_at TIMESTAMP""",
    "financials": """ticker STRING, cik STRING, cash_usd DOUBLE, cash_asof DATE,
        quarterly_burn_usd DOUBLE, runway_months DOUBLE, shares_outstanding DOUBLE,
        pulled_at TIMESTAMP""",
    "prices": """ticker STRING, last DOUBLE, ret_20d DOUBLE, ret_60d DOUBLE, rvol_20d DOUBLE,
        rvol_60d DOUBLE, adv_usd DOUBLE, pct_of_52w_high DOUBLE, market_cap DOUBLE,
        pulled_at TIMESTAMP""",
    "verdict_log": """drug_id BIGINT, snapshot_date DATE, ticker STRING, catalyst_date DATE,
        verdict STRING, setup STRING, conviction INT, evidence STRING, pulled_at TIMESTAMP""",
    "outcomes": """drug_id BIGINT, catalyst_date DATE, ticker STRING, entry_date DATE,
        entry_price DOUBLE, last_price DOUBLE, last_date DATE, move_1d DOUBLE, move_5d DOUBLE,
        move_todate DOUBLE, abn_1d DOUBLE, abn_5d DOUBLE, abn_todate DOUBLE,
        computed_at TIMESTAMP""",
    "guidance": """ticker STRING, filed DATE, period_lo DATE, period_hi DATE, phrase STRING,
        pulled_at TIMESTAMP""",
    "financing": """ticker STRING, last_shelf_date DATE, shelf_live BOOLEAN, shelf_count INT,
        last_offering_date DATE, days_since_offering INT, offerings_24m INT,
        offerings_total INT, dilution_readiness INT, dilution_label STRING,
        dilution_notes STRING, pulled_at TIMESTAMP""",
    "insider": """ticker STRING, snapshot_date DATE, window_days INT, form4_filings INT,
        shares_bought DOUBLE, shares_sold DOUBLE, buy_usd DOUBLE, sell_usd DOUBLE,
        net_usd DOUBLE, insider_tilt DOUBLE, senior_net_usd DOUBLE, n_buyers INT,
        n_sellers INT, cluster_buy BOOLEAN, biggest_delta_own DOUBLE, biggest_move_desc STRING,
        pulled_at TIMESTAMP""",
    "short_interest": """ticker STRING, settlement_date DATE, published_date DATE,
        shares_short DOUBLE, shares_short_prior DOUBLE, avg_daily_volume DOUBLE,
        days_to_cover DOUBLE, change_pct DOUBLE, pulled_at TIMESTAMP""",
    "sentiment": """ticker STRING, snapshot_date DATE, articles INT, scored_articles INT,
        pos_hits INT, neg_hits INT, sentiment DOUBLE, thin BOOLEAN, top_positive STRING,
        top_negative STRING, eightk_30d INT, eightk_90d INT, eightk_365d INT,
        days_since_8k INT, pulled_at TIMESTAMP""",
    "implied": """ticker STRING, catalyst_date DATE, expiry DATE, atm_iv DOUBLE,
        implied_move DOUBLE, straddle_pct DOUBLE, pulled_at TIMESTAMP""",
}
KEYS = {
    "catalysts": ["drug_id", "catalyst_date_raw"], "trials": ["nct_id"],
    "financials": ["ticker"], "prices": ["ticker"], "verdict_log": ["drug_id", "snapshot_date"],
    "outcomes": ["drug_id", "catalyst_date"], "guidance": ["ticker"], "financing": ["ticker"],
    "insider": ["ticker", "snapshot_date"], "short_interest": ["ticker", "settlement_date"],
    "sentiment": ["ticker", "snapshot_date"], "implied": ["ticker", "catalyst_date"],
}
# Logs, and the day by whose month they are stored.
LOGS = {"verdict_log": "snapshot_date", "sentiment": "snapshot_date"}


def _struct(ddl: str) -> StructType:
    out = StructType()
    for column in ddl.split(","):
        name, kind = column.split()
        out.add(name, _TYPES[kind])
    return out


TABLES = {name: _struct(ddl) for name, ddl in _DDL.items()}
