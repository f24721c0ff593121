import datetime as dt
import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from eventide import schemas
from eventide.functions.scoring import headline_reason, scored
from eventide.plans import board as bd
from eventide.plans import calendar as cal
from eventide.plans import current, logs, outcomes, refresh
from eventide.sources import readers as rd

D = dt.date
TODAY = "2026-09-22"

FORM4 = """<ownershipDocument>
  <reportingOwner><reportingOwnerId><rptOwnerName>DOE  JANE</rptOwnerName></reportingOwnerId>
  <reportingOwnerRelationship><isOfficer>1</isOfficer><officerTitle>Chief Financial
  Officer (CFO)</officerTitle></reportingOwnerRelationship></reportingOwner>
  <nonDerivativeTransaction><transactionCode>F</transactionCode>
    <transactionShares><value>13272</value></transactionShares></nonDerivativeTransaction>
  <nonDerivativeTransaction><transactionCode>P</transactionCode>
    <transactionShares><value>5000</value></transactionShares>
    <transactionPricePerShare><value>3.20</value></transactionPricePerShare>
    <sharesOwnedFollowingTransaction><value>15000</value></sharesOwnedFollowingTransaction>
  </nonDerivativeTransaction>
  <nonDerivativeTransaction><transactionCode>A</transactionCode>
    <transactionShares><value>9999</value></transactionShares></nonDerivativeTransaction>
</ownershipDocument>"""
RSS = """<?xml version="1.0"?><rss><channel>
  <item><title>Drug X approved</title><pubDate>Mon, 21 Sep 2026 09:22:40 GMT</pubDate>
    <link>http://e.com/1</link></item>
  <item><title>No date here</title><link>http://e.com/2</link></item></channel></rss>"""


def trial(nct, phases, date, sponsor="Acme Bio Inc", status="RECRUITING", cls="INDUSTRY"):
    return {"protocolSection": {
        "identificationModule": {"nctId": nct, "briefTitle": f"Title {nct}"},
        "statusModule": {"overallStatus": status, "primaryCompletionDateStruct": {"date": date}},
        "designModule": {"studyType": "INTERVENTIONAL", "phases": phases,
                         "enrollmentInfo": {"count": 120},
                         "designInfo": {"allocation": "RANDOMIZED",
                                        "maskingInfo": {"masking": "DOUBLE"}}},
        "conditionsModule": {"conditions": ["NSCLC", "b", "c", "d"]},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": sponsor, "class": cls}}}}


def land(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(p)


def registry(spark, tmp_path):
    entries = {"0": {"cik_str": 7, "ticker": "acme", "title": "Acme Bio, Inc."},
               "1": {"cik_str": 8, "ticker": "BETA", "title": "Beta Gene Corp"}}
    return rd.read_registry(spark, land(tmp_path, "reg.json", [entries]))


def filing(doc, ticker, filed, body, form="8-K"):
    return ("7", doc, form, filed, f"Acme Bio  ({ticker}, CIK 7)", f"<html><p>{body}</p></html>")


DOC = "cik string, doc_id string, form string, filed date, display_name string, html string"
DECISION = ("The company announced that the FDA accepted its NDA for INO-3107 for the treatment of "
            "adults with Recurrent Respiratory Papillomatosis, and assigned a PDUFA target action "
            "date of October 30, 2026. The PDUFA date stands.")


def docs(spark):
    return spark.createDataFrame([
        filing("d1", "ACME", D(2026, 8, 1), DECISION),
        filing("d2", "ACME", D(2026, 7, 1), "topline data expected in the first half of 2027."),
        filing("d3", "ACME", D(2026, 8, 9), "Results are expected in Q4 2026, data expected in it."),
        filing("d4", "BETA", D(2020, 8, 9), "data expected in Q4 2026"),
        filing("d5", "BETA", D(2026, 8, 9), DECISION, "10-K")], DOC)


def test_trial_readers(spark, tmp_path):
    rows = [trial("NCT1", ["PHASE2"], "2026-11"), trial("NCT1", ["PHASE2"], "2026-11"),
            trial("X9", ["PHASE2"], "2026-11"), trial("NCT2", ["PHASE1"], "2026-11-03"),
            trial("NCT3", ["PHASE3"], "2024-02-03", "Unlisted SA", "COMPLETED"),
            trial("NCT4", ["PHASE2", "PHASE3"], "2024-02-03", "Beta Gene", "COMPLETED"),
            {"protocolSection": {"identificationModule": {"nctId": "NCT5"}}}]
    raw = rd.read_trials(spark, land(tmp_path, "t.json", rows))
    got = {r.nct_id: r for r in rd.trial_designs(raw).collect()}
    assert set(got) == {"NCT1", "NCT2", "NCT3", "NCT4", "NCT5"}
    assert got["NCT4"].phases == "PHASE2,PHASE3" and got["NCT4"].enrollment == 120
    assert got["NCT5"].phases == "" and got["NCT5"].masking is None
    reg = registry(spark, tmp_path)
    c = rd.candidate_readouts(raw.dropDuplicates(), reg, TODAY, 180).collect()
    assert sorted((r.nct_id, r.ticker, r.indication) for r in c) == [
        ("NCT1", "ACME", "NSCLC; b; c; d"), ("X9", "ACME", "NSCLC; b; c; d")]
    h = rd.historical_readouts(raw, reg, "2024-01-01", "2024-12-31").collect()
    assert [(r.nct_id, r.ticker, r.event_date, r.simplified_stage, r.anchor) for r in h] == [
        ("NCT4", "BETA", D(2024, 2, 3), "phase2/3", "ctgov")]


def test_company_facts(spark, tmp_path):
    f = {"cik": "7", "facts": {
        "us-gaap": {"Cash": {"units": {"USD": [
            {"end": "2023-03-31", "val": 1, "filed": "2023-05-05", "form": "10-Q"},
            {"end": "2023-03-31", "filed": "2023-05-05"}, {"end": "2023-03-31", "val": 3}]}},
            "Shares": {}},
        "dei": {"Cash": {"units": {"USD": [{"end": "2023-03-31", "val": 9, "filed": "2023-05-05"}]}},
                "Shares": {"units": {"shares": [
                    {"end": "2023-03-31", "val": 5, "filed": "2023-05-05"}]}}}}}
    raw = rd.read_company_facts(spark, land(tmp_path, "f.json", [f]))
    got = rd.company_facts(raw, registry(spark, tmp_path)).collect()
    assert sorted((r.ticker, r.tag, r.unit, r.val) for r in got) == [
        ("ACME", "Cash", "USD", 1.0), ("ACME", "Shares", "shares", 5.0)]


def test_filing_index_shards(spark):
    s = "ticker string, form array<string>, filingDate array<string>, accessionNumber array<string>"
    recent = spark.createDataFrame([("A", ["8-K", "4"], ["2024-01-05", "bad"], ["a1", "a2"]),
                                    ("B", ["8-K"], ["2020-01-05"], ["b1"])], s)
    old = spark.createDataFrame([("A", ["8-K"], ["2019-01-05"], ["a0"]),
                                 ("B", ["8-K"], ["2010-01-05"], ["b0"])], s)
    got = rd.filing_index(recent, old, "2022-01-01").collect()
    assert sorted(r.accession for r in got) == ["a0", "a1", "b1"]


def test_insider_documents_and_table(spark):
    d = spark.createDataFrame([("ACME", "acc1", D(2026, 9, 1), FORM4),
                               ("ACME", "acc2", D(2026, 9, 1), "<broken")],
                              "ticker string, accession string, filed_date date, xml string")
    tx = rd.insider_documents(d)
    r = tx.collect()
    assert len(r) == 1
    assert (r[0].code, r[0].shares, r[0].price, r[0].role, r[0].owner, r[0].held_after) == (
        "P", 5000.0, 3.2, "senior", "DOE JANE", 15000.0)
    idx = spark.createDataFrame([("ACME", "4", D(2026, 9, 1), "acc1", 0),
                                 ("ACME", "4", D(2026, 1, 1), "old", 1),
                                 ("BETA", "4", D(2026, 9, 2), "none", 0)],
                                "ticker string, form string, filed date, accession string, pos bigint")
    late = spark.createDataFrame([("ACME", "4", D(2026, 9, 23), "acc1", 2)], idx.schema)
    asked = spark.createDataFrame([("ACME",), ("BETA",), ("QUIET",), (None,)], "ticker string")
    got = {x.ticker: x for x in current.insiders(asked, idx.unionByName(late), tx, TODAY).collect()}
    assert set(got) == {"ACME", "BETA", "QUIET"} and got["QUIET"].form4_filings == 0
    a = got["ACME"]
    assert (a.form4_filings, a.buy_usd, a.senior_net_usd, a.n_buyers, a.insider_tilt) == (
        1, 16000.0, 16000.0, 1, 1.0)
    assert a.biggest_move_desc == "DOE JANE (Chief Financial Officer (CFO)) +50% of holding"
    assert got["BETA"].net_usd == 0.0 and got["BETA"].biggest_move_desc is None


def test_headline_readers(spark, tmp_path):
    d = spark.createDataFrame([("X", RSS), ("Y", "<rss><channel><item>broken")],
                              "ticker string, xml string")
    got = {r.title: r for r in rd.rss_headlines(d).collect()}
    assert set(got) == {"Drug X approved", "No date here"}
    assert got["Drug X approved"].published == D(2026, 9, 21)
    assert got["No date here"].published is None
    assert rd.since(rd.rss_headlines(d), "published", TODAY, 21).count() == 1
    items = [{"ticker": "X", "content": {"title": "nested", "pubDate": "2026-09-20T10:00:00Z",
                                         "canonicalUrl": {"url": "u"}}},
             {"ticker": "X", "title": "flat", "providerPublishTime": 1789000000},
             {"ticker": "X", "title": "undated"}]
    n = rd.news_headlines(rd.read_news(spark, land(tmp_path, "n.json", items))).collect()
    assert sorted((r.title, str(r.published), r.link) for r in n) == [
        ("flat", "2026-09-10", ""), ("nested", "2026-09-20", "u")]


def test_curated_calendar(spark, tmp_path):
    rows = [{"drug_id": 1, "company_ticker": "AA", "catalyst_date": "Q4 2026", "stage_label": "P2",
             "statuses": [{"abbreviation": "ODD"}, {"abbreviation": "BTD"}, {"abbreviation": "ODD"}],
             "company_price": "3.5", "company_optionable": "true", "enterprise_value": 9},
            {"drug_id": 1, "company_ticker": "AA", "catalyst_date": "Q4 2026", "stage_label": "P2"},
            {"drug_id": 2, "catalyst_date": "2026"}]
    got = rd.curated_calendar(rd.read_calendar(spark, land(tmp_path, "c.json", rows[:1] + rows[2:])))
    assert "enterprise_value" not in got.columns
    r = got.collect()
    assert len(r) == 1 and r[0].designations == "BTD ODD" and r[0].price == 3.5 and r[0].optionable
    assert r[0].catalyst_date_lo == D(2026, 10, 1) and r[0].date_precision == "quarter"
    both = rd.curated_calendar(rd.read_calendar(spark, land(tmp_path, "c2.json", rows[:2])))
    assert both.count() == 1


def test_decision_details(spark):
    t = spark.createDataFrame([("x " * 700 + DECISION + " y" * 700,)], "text string")
    r = cal.decision_details(t).first()
    assert (r.catalyst_date_lo, r.drug_name, r.indication) == (
        D(2026, 10, 30), "INO-3107", "Recurrent Respiratory Papillomatosis")
    two = ("for the treatment of lupus nephritis. " + "z " * 200
           + "The FDA set a PDUFA date of October 1, 2026 for ABC-12, indicated for gout attacks. "
           + "z " * 200 + "for patients with asthma.")
    r = cal.decision_details(spark.createDataFrame([(two,)], "text string")).first()
    assert r.indication == "gout attacks" and r.drug_name == "ABC-12"


def test_every_stated_date_counts(spark):
    first = "The PDUFA date is March 45, 2026 for the NDA for Alphex for the treatment of gout attacks. "
    rest = ("q " * 900).join([
        first, "Its action date is June 7, 2026 for the NDA for Bervo for the treatment of severe asthma. ",
        "The PDUFA goal date is July 9, 2026; not more. "])
    t = spark.createDataFrame([(1, rest), (2, "no date here"), (3, None), (4, "")], "id int, text string")
    got = sorted((r.catalyst_date_lo, r.drug_name, r.indication, rest[r._at:r._at + 5])
                 for r in cal.decision_details(t).collect())
    assert got == [(D(2026, 6, 7), "Bervo", "severe asthma", "actio"), (D(2026, 7, 9), None, None, "PDUFA")]
    assert cal.decision_details(t, first_only=True).count() == 0
    said = ("Topline data expected in the third quarter of 2026. " + "Data expected in mid-2027.")
    g = spark.createDataFrame([("t", "d", D(2026, 1, 5), said)], "ticker string, doc_id string, filed date, text string")
    rows = current.guidance_statements(g).collect()
    assert [r.period_lo.year for r in sorted(rows, key=lambda r: r.place)] == [2026, 2027]
    assert current.newest_statement(current.guidance_statements(g)).first().period_lo == D(2026, 7, 1)
    assert current.guidance_statements(g, first_only=True).count() == 1


def test_facts_filed_later_are_not_current(spark):
    rows = [("T", "cash", "USD", None, D(2025, 3, 31), D(2025, 5, 1), 10.0, "10-Q", 1),
            ("T", "cash", "USD", None, D(2025, 6, 30), D(2025, 8, 1), 70.0, "10-Q", 2),
            ("T", "cash_b", "USD", None, D(2025, 9, 30), None, 90.0, "10-Q", 3)]
    f = spark.createDataFrame(rows, "ticker string, tag string, unit string, start_date date, end_date date, "
                                    "filed date, val double, form string, pos int")
    kinds = {k: ((k, f"{k}_b"), "USD") for k in ("cash", "investments", "burn", "shares")}
    cash = lambda day: [r.cash_usd for r in current.financials(f, kinds, day).collect()]
    assert cash("2025-07-31") == [10.0] and cash("2025-08-01") == [70.0] and cash("2025-04-30") == []
    assert cash(None) == [90.0]


def test_calendar_and_guidance(spark, tmp_path):
    raw = rd.read_trials(spark, land(tmp_path, "t.json", [trial("NCT1", ["PHASE2"], "2026-11")]))
    got = cal.build_calendar(raw, registry(spark, tmp_path), docs(spark), TODAY).collect()
    by = {r.simplified_stage: r for r in got}
    assert set(by) == {"phase2", "pdufa"} and len(got) == 2
    t, p = by["phase2"], by["pdufa"]
    assert t.catalyst_date_raw == "2026-11 + window" and t.date_precision == "readout_window"
    assert t.catalyst_date_hi == D(2026, 11, 1) + dt.timedelta(days=180)
    assert (p.ticker, p.catalyst_date_lo, p.drug_name) == ("ACME", D(2026, 10, 30), "INO-3107")
    import hashlib
    want = int(hashlib.sha1(b"ACME|None|2026-10-30").hexdigest()[:15], 16)
    assert p.drug_id == want
    g = current.guidance(docs(spark), TODAY).collect()
    assert [(r.ticker, r.filed, r.period_lo, r.period_hi) for r in g] == [
        ("ACME", D(2026, 8, 9), D(2026, 10, 1), D(2026, 12, 31))]


def base_row(**change):
    r = dict(drug_id=1, ticker="T", runway_at_catalyst=20.0, ret_20d=0.0, move_ratio=None,
             implied_move=None, expected_move=0.35, baseline_move=0.2, loa=0.2, stage="Phase 2",
             ta="oncology", designations="", materiality=1.75, market_cap=2e8,
             date_confidence=1.0, is_binary=True, squeeze_risk=0, squeeze_label="low",
             days_to_cover=1.0, short_build=0.0, cluster_buy=False, n_buyers=0,
             senior_net_usd=0.0, biggest_delta_own=None, biggest_move_desc=None,
             offerings_24m=3, runway_stale=False, dilution_label="possible",
             days_since_offering=400, eightk_90d=0, microcap=False, illiquid=False)
    return {**r, **change}


TYPES = ("drug_id bigint, ticker string, runway_at_catalyst double, ret_20d double, move_ratio double,"
         "implied_move double, expected_move double, baseline_move double, loa double, stage string,"
         "ta string, designations string, materiality double, market_cap double,"
         "date_confidence double, is_binary boolean, squeeze_risk int, squeeze_label string,"
         "days_to_cover double, short_build double, cluster_buy boolean, n_buyers int,"
         "senior_net_usd double, biggest_delta_own double, biggest_move_desc string,"
         "offerings_24m int, runway_stale boolean, dilution_label string,"
         "days_since_offering int, eightk_90d int, microcap boolean, illiquid boolean")


def test_scoring_rules(spark):
    cases = {
        "funded": base_row(), "broke": base_row(runway_at_catalyst=3.0),
        "rare": base_row(runway_at_catalyst=3.0, offerings_24m=0),
        "unknown": base_row(runway_at_catalyst=3.0, offerings_24m=None),
        "stale": base_row(runway_at_catalyst=3.0, runway_stale=True),
        "crowded": base_row(runway_at_catalyst=3.0, squeeze_risk=2, squeeze_label="elevated"),
        "micro": base_row(runway_at_catalyst=3.0, microcap=True, eightk_90d=7),
        "vague": base_row(runway_at_catalyst=3.0, date_confidence=0.15),
        "rich": base_row(move_ratio=1.5, implied_move=0.525), "cheap": base_row(move_ratio=0.5,
                                                                             implied_move=0.175),
        "immaterial": base_row(move_ratio=1.5, implied_move=0.5, materiality=0.5),
        "runup": base_row(ret_20d=0.4), "long": base_row(loa=0.8),
        "empty": {k: None for k in base_row()} | {"drug_id": 1},
        "insider": base_row(runway_at_catalyst=3.0, cluster_buy=True, n_buyers=4,
                            senior_net_usd=1234567.0, biggest_delta_own=0.9,
                            biggest_move_desc="X (CEO) +90% of holding")}
    names = [x.strip().split()[0] for x in TYPES.split(",")]
    rows = [tuple({**c, "drug_id": i}[n] for n in names) for i, c in enumerate(cases.values())]
    got = scored(spark.createDataFrame(rows, TYPES)).withColumn(
        "head", headline_reason(F.col("reason_list"))).collect()
    r = dict(zip(cases, sorted(got, key=lambda x: x.drug_id)))
    setup = {k: v.setup for k, v in r.items()}
    assert setup["funded"] == "NO_EDGE" and setup["broke"] == "DILUTION_SHORT"
    assert setup["rich"] == "VOL_SELL_RICH" and setup["cheap"] == "VOL_BUY_CHEAP"
    assert setup["immaterial"] == "NO_EDGE" and setup["runup"] == "RUNUP_FADE"
    assert setup["long"] == "BASE_RATE_LONG"
    conv = {k: v.conviction for k, v in r.items()}
    assert conv["rare"] < conv["unknown"] < conv["broke"] <= conv["micro"]
    assert conv["stale"] < conv["broke"] and conv["crowded"] < conv["broke"] > conv["vague"]
    strength = (0.7 * 0.4 + abs((0.2 - 0.4) * 1.2) * 0.35) * 1.35
    assert conv["broke"] == round(100 * strength)
    assert setup["empty"] == "NO_EDGE" and r["empty"].conviction == 0
    assert r["empty"].reasons == "size unknown: no share count filed, materiality untested"
    assert "$1,234,567" in r["insider"].reasons and "4 insiders bought" in r["insider"].reasons
    assert conv["insider"] == conv["broke"]
    assert "low runway + busy" in r["micro"].reasons and "serial issuer" in r["broke"].head
    assert r["rich"].head.startswith("20mo cash, financing not forced")
    assert r["broke"].verdict == "SHORT" and r["broke"].directional and not r["rich"].directional
    assert r["funded"].evidence == "n/a" and r["broke"].evidence == "supported"


def test_verdict_before_the_event(spark):
    v = spark.createDataFrame([(1, D(2026, 9, 1), "SHORT", "S", 50), (1, D(2026, 9, 4), "LONG", "L", 60)],
                              "drug_id bigint, snapshot_date date, verdict string, setup string, conviction int")
    o = spark.createDataFrame([(1, D(2026, 9, 4), 0.1), (2, D(2026, 9, 4), None)],
                              "drug_id bigint, catalyst_date date, move_todate double")
    c = spark.createDataFrame([(1, "d", "i", "s", "c", "raw")],
                              "drug_id bigint, drug_name string, indication string, stage string, "
                              "company_name string, catalyst_date_raw string")
    got = {r.drug_id: r for r in outcomes.recent(o, c, v, "2026-09-22").collect()}
    assert got[1].prior_verdict == "SHORT" and got[1].verdict_asof == D(2026, 9, 1)
    assert got[2].prior_verdict is None and len(got) == 2


def test_vague_dates_have_no_outcome(spark):
    rows = [(i, "T", D(2026, 9, 1), D(2026, 9, 1), p) for i, p in
            enumerate(("day", "month_part", "quarter", "readout_window", "unknown"))]
    c = spark.createDataFrame(rows, "drug_id bigint, ticker string, catalyst_date_lo date, "
                                    "catalyst_date_hi date, date_precision string")
    assert sorted(r.drug_id for r in outcomes.passed_catalysts(c, TODAY).collect()) == [0, 1]


def test_log_round_trip_keeps_labels(spark, tmp_path):
    schema = schemas.TABLES["verdict_log"]
    rows = [Row(1, D(2024, 1, 2), "T", D(2024, 5, 1), "NO TRADE", "NO_EDGE", 3, "n/a", None),
            Row(2, D(2024, 1, 1), None, None, "SHORT", "DILUTION_SHORT", 50, None, None)]
    log = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "log")
    logs.dump(log, "verdict_log", path)
    back = {r.drug_id: r for r in rd.read_log(spark, "verdict_log", path).collect()}
    assert back[1].evidence == "n/a" and back[2].evidence is None and back[2].ticker is None
    empty = spark.createDataFrame([], schema)
    once = logs.seed(empty, spark, "verdict_log", path)
    assert once.count() == 2 and logs.seed(once, spark, "verdict_log", path).count() == 2
    from eventide.operators.changelog import repair_evidence
    fixed = {r.drug_id: r.evidence for r in repair_evidence(once).collect()}
    assert fixed == {1: "n/a", 2: "supported"}
    assert logs.append(once, once.withColumn("snapshot_date", F.date_add("snapshot_date", 1)),
                       "verdict_log").count() == 2


def test_implied_move(spark):
    now, old, later = D(2026, 9, 20), D(2026, 9, 18), D(2026, 9, 30)
    q = [("A", D(2026, 12, 18), "C", 10.0, 1.0, 2.0, 9.0, 0.5, 0, now), ("A", D(2026, 12, 18), "C", 12.0, 1.0, 2.0, 9.0, 0.9, 1, now),
         ("A", D(2026, 12, 18), "P", 12.0, 0.0, 2.0, 3.0, None, 2, now), ("A", D(2026, 10, 16), "C", 11.0, 9.0, 9.0, 9.0, 0.1, 3, now),
         ("A", D(2026, 12, 18), "P", 11.0, 8.0, 8.0, 8.0, .8, 4, old), ("A", D(2026, 12, 18), "C", 11.0, 8.0, 8.0, 8.0, .8, 5, later)]
    quotes = spark.createDataFrame([(d, t, 11.0, e, s, k, b, a, last, iv, p) for t, e, s, k, b, a, last, iv, p, d in q],
                                   "asof date, ticker string, spot double, expiry date, side string, strike double, "
                                   "bid double, ask double, last double, iv double, pos bigint")
    pairs = spark.createDataFrame([("A", D(2026, 11, 1)), ("A", D(2027, 1, 1))], "ticker string, catalyst_date date")
    r = current.implied_moves(pairs, quotes, D(2026, 9, 22)).collect()
    assert len(r) == 1 and r[0].expiry == D(2026, 12, 18) and r[0].atm_iv == 0.5
    assert abs(r[0].implied_move - 4.5 / 11) < 1e-12


def test_refresh_end_to_end(spark, tmp_path):
    """All tables land, and a second, unchanged night logs nothing."""
    raw = rd.read_trials(spark, land(tmp_path, "t.json", [trial("NCT1", ["PHASE2"], "2026-11")]))
    calendar = cal.build_calendar(raw, registry(spark, tmp_path), docs(spark), TODAY)
    days = [D(2026, 3, 2) + dt.timedelta(days=i + 2 * (i // 5)) for i in range(140)]
    bars = spark.createDataFrame([(t, d, 10.0 + (i % 7), 1e6) for t in ("ACME", "BENCH")
                                  for i, d in enumerate(days)],
                                 "ticker string, day date, close double, volume double")
    facts = spark.createDataFrame(
        [("ACME", "CashAndCashEquivalentsAtCarryingValue", "USD", None, D(2026, 6, 30), D(2026, 8, 5), 3e7, "10-Q", 0),
         ("ACME", "NetCashProvidedByUsedInOperatingActivities", "USD", D(2026, 4, 1), D(2026, 6, 30), D(2026, 8, 5), -2e7, "10-Q", 1),
         ("ACME", "CommonStockSharesOutstanding", "shares", None, D(2026, 6, 30), D(2026, 8, 5), 1e7, "10-Q", 2)],
        "ticker string, tag string, unit string, start_date date, end_date date, filed date, val double, form string, pos bigint")
    filings = spark.createDataFrame(
        [("ACME", f, d, a, 0) for f, d, a in (("8-K", D(2026, 9, 1), "x"), ("S-3", D(2026, 1, 1), "s"),
                                              ("424B5", D(2026, 7, 1), "o"), ("4", D(2026, 9, 2), "acc1"))],
        "ticker string, form string, filed date, accession string, pos bigint")
    form4 = rd.insider_documents(spark.createDataFrame(
        [("ACME", "acc1", D(2026, 9, 2), FORM4)], "ticker string, accession string, filed_date date, xml string"))
    heads = rd.rss_headlines(spark.createDataFrame(
        [("ACME", RSS.replace("Drug X approved", "Acme wins approval"))], "ticker string, xml string"))
    si = rd.short_interest(spark.createDataFrame([("acme", "2026-08-31", "1000", "800", "10", "6.0", "")], rd.SHORT_INTEREST_CSV))
    quotes = spark.createDataFrame([], "asof date, ticker string, spot double, expiry date, side string, strike double, bid double, ask double, last double, iv double, pos bigint")
    landed = refresh.Landed(
        calendar=calendar, trials=rd.trial_designs(raw), facts=facts, bars=bars,
        splits=spark.createDataFrame([], "ticker string, day date, ratio double"), headlines=heads,
        filings=filings, insider_tx=form4, short_interest=si, quotes=quotes, docs=docs(spark))
    store = refresh.Store(spark, str(tmp_path / "store"))
    refresh.refresh(store, landed, TODAY)
    n = {t: store.read(t).count() for t in schemas.TABLES}
    assert n["catalysts"] == 2 and n["verdict_log"] == 2 and n["sentiment"] == 1
    assert n["financials"] == n["financing"] == n["insider"] == n["guidance"] == n["prices"] == 1
    f = store.read("financials").first()
    assert f.runway_months == 4.5 and store.read("short_interest").first().days_to_cover == 6.0
    board = bd.board(store.tables(), TODAY)
    got = {r.simplified_stage: r for r in board.collect()}
    assert got["pdufa"].setup == "DILUTION_SHORT" and got["phase2"].date_source == "guidance"
    assert got["phase2"].date_precision == "guidance" and got["phase2"].catalyst_date_hi == D(2026, 12, 31)
    night = outcomes.snapshot(board, "2026-09-23")
    assert logs.append(store.read("verdict_log"), night, "verdict_log").count() == 2
    recent = outcomes.recent(store.read("outcomes"), store.read("catalysts"), store.read("verdict_log"), TODAY)
    for c in ("move_1d", "abn_1d"):
        assert c in recent.columns
    out = str(tmp_path / "doc")
    bd.publish(board, recent, out, "2026-09-22T00:00:00", 180)
    rows = [json.loads(r.value) for r in spark.read.text(out + "/rows").collect()]
    assert len(rows) == 2 and {"ticker", "headline_reason", "insider_note"} <= set(rows[0])
    assert json.loads(spark.read.text(out + "/header").first().value)["count"] == 2


def test_registry_is_read_in_splits(spark, tmp_path):
    rows = {str(i): {"cik_str": 1000 + i, "ticker": f"t{i}", "title": f"Company {i} Inc"} for i in range(400)}
    rows["7"]["title"], rows["8"]["title"] = "Odd } one", 'A "}, \\"9\\":{" B}'
    rows["399"]["title"] = "}}"
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(rows, indent=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = spark.read.option("lineSep", "}").text(str(path))
        assert scan.rdd.getNumPartitions() > 4
        got = sorted((r.pos, r.ticker, r.cik, r.title) for r in rd.read_registry(spark, str(path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, f"T{i}", 1000 + i, rows[str(i)]["title"]) for i in range(400)]
    (tmp_path / "none.json").write_text("{}")
    assert rd.read_registry(spark, str(tmp_path / "none.json")).count() == 0


def test_news_keep_the_order_of_the_feed(spark, tmp_path):
    items = [{"ticker": "T", "title": t, "pubDate": "2026-09-20T10:00:00Z", "link": f"l{i}"}
             for i, t in enumerate(["Same thing", "same THING!", "Other", "Other.", "same thing"])]
    items += [{"ticker": "T", "title": "bad stamp", "pubDate": "2026-09-20T99:00:00Z"},
              {"ticker": "T", "title": "bad tail", "pubDate": "2026-09-20 never"}]
    raw = rd.news_headlines(rd.read_news(spark, land(tmp_path, "feed.json", items)))
    assert {r.title for r in raw.collect()} == {"Same thing", "same THING!", "Other", "Other.", "same thing"}
    for df in (raw, raw.repartition(3), raw.orderBy(F.col("title").desc())):
        assert sorted(r.title for r in current.unique_headlines(df).collect()) == ["Other", "Same thing"]


def test_board_starts_no_job_and_refresh_leaves_no_folder(spark, tmp_path):
    from pathlib import Path

    from eventide.storage import scope, shared_dir, stash
    tables = refresh.Store(spark, str(tmp_path / "store")).tables()
    spark.sparkContext.setJobGroup("board", "board")
    rows = bd.board(tables, TODAY)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("board")
    assert rows.count() == 0
    spark.sparkContext.setJobGroup("other", "other")
    before = set(Path(shared_dir(spark).removeprefix("file:")).iterdir())
    try:
        with scope(spark) as outer:
            assert stash(spark.range(3)).count() == 3
            with scope(spark) as inner:
                assert inner.startswith(outer)
                stash(spark.range(2))
            assert not Path(inner.removeprefix("file:")).exists() and Path(outer.removeprefix("file:")).exists()
            raise ValueError
    except ValueError:
        pass
    assert set(Path(shared_dir(spark).removeprefix("file:")).iterdir()) == before


def test_two_dates_of_a_text_and_one_search_for_mentions(spark):
    html = ("<p>We filed the NDA for Zelo for the treatment of heart failure. The PDUFA date is March 3, 2027."
            "</p><p>" + "Nothing new. " * 120 + "</p><p>We filed the BLA for Bervo, IN PATIENTS WITH heart "
            "failure. The PDUFA date is March 3, 2027; its target action date is June 9, 2027.</p>")
    docs = spark.createDataFrame(
        [("C1", 1, "8-K", D(2026, 9, 1), "Acme  (AAA)  (CIK 1)", html)],
        "cik string, doc_id int, form string, filed date, display_name string, html string")
    df = cal.decision_rows(docs, TODAY)
    got = {(r.catalyst_date_lo, r.drug_name, r.indication) for r in df.collect()}
    assert got == {(D(2027, 3, 3), "Zelo", "heart failure"), (D(2027, 6, 9), "Bervo", "heart failure")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text#") == 2  # one search for dates, one for mentions


def test_a_document_is_read_once_and_not_carried_by_its_transactions(spark):
    docs = spark.createDataFrame([("A", 1, D(2026, 9, 1), FORM4), ("A", 2, D(2026, 9, 1), "<ownershipDocument/>")],
                                 "ticker string, accession int, filed_date date, xml string")
    df = rd.insider_documents(docs)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    carried = [x for x in plan.split("\n") if "Generate" in x]
    assert len(carried) == 1 and "reportingOwner" not in plan[:plan.index("Generate")]
    assert plan.count("from_xml") <= 1
    assert {r.accession for r in df.collect()} == {1}
