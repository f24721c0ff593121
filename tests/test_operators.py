import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from eventide.operators import asof, changelog, facts, filings, inference, insiders, names, panel
from eventide.operators import tables as tb
from eventide.schemas import TABLES

D = dt.date
KINDS = {k: ((k,), "USD") for k in ("cash", "investments", "burn", "shares")}


def day(n):
    return D(2020, 1, 1) + dt.timedelta(days=n)


def fact(t, tag, start, end, filed, val, pos):
    return (t, tag, "USD", start, end, filed, float(val), "10-Q", pos)


FACT = ("ticker string, tag string, unit string, start_date date, end_date date, filed date, "
        "val double, form string, pos bigint")


def test_point_in_time_fixture(spark):
    rows = [fact("AAA", "cash", None, D(2023, 3, 31), D(2023, 5, 5), 100, 0),
            fact("AAA", "cash", None, D(2023, 6, 30), D(2023, 8, 5), 80, 1),
            fact("AAA", "cash", None, D(2023, 9, 30), D(2023, 11, 5), 60, 2),
            fact("AAA", "cash", None, D(2023, 3, 31), D(2024, 2, 1), 999, 3),
            fact("AAA", "burn", D(2023, 1, 1), D(2023, 3, 31), D(2023, 5, 5), -20, 4),
            fact("AAA", "burn", D(2023, 4, 1), D(2023, 6, 30), D(2023, 8, 5), -20, 5)]
    f = spark.createDataFrame(rows, FACT)
    asks = [("AAA", D(2023, 9, 1)), ("AAA", D(2023, 6, 1)), ("AAA", D(2023, 1, 1)),
            ("AAA", D(2024, 3, 1))]
    p = spark.createDataFrame(asks, "ticker string, asof date")
    got = {r.asof: r for r in facts.financials_asof(p, f, "asof", KINDS).collect()}
    a = got[D(2023, 9, 1)]
    assert (a.cash_usd, a.quarterly_burn_usd, a.runway_months) == (80.0, 20.0, 12.0)
    assert got[D(2023, 6, 1)].cash_usd == 100.0 and got[D(2023, 1, 1)].cash_usd is None
    assert got[D(2024, 3, 1)].cash_usd == 60.0
    ev = facts.periodic_filing_dates(f.where("tag = 'cash'"), "2023-06-01", "2023-12-31").collect()
    assert sorted(r.event_date for r in ev) == [D(2023, 8, 5), D(2023, 11, 5)]


def test_facts_of_another_unit_and_tag_order(spark):
    kinds = KINDS | {"cash": (("A", "B"), "USD")}
    end, filed = D(2023, 6, 30), D(2023, 8, 1)
    rows = [("X", "A", "USD", None, end, filed, 100.0, "10-Q", 5), ("X", "B", "USD", None, end, filed, 55.0, "10-Q", 0),
            ("X", "A", "EUR", None, D(2023, 9, 30), D(2023, 11, 1), 9.0, "10-Q", 0)]
    f = spark.createDataFrame(rows, FACT)
    p = spark.createDataFrame([("X", D(2024, 1, 1))], "ticker string, asof date")
    assert facts.financials_asof(p, f, "asof", kinds).first().cash_usd == 100.0
    assert facts.current_financials(f, kinds).first().cash_usd == 100.0


def test_financials_against_brute_force_with_a_hot_ticker(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        t = "HOT" if i % 3 else f"T{rnd.randrange(4)}"
        end = rnd.randrange(60)
        rows.append(fact(t, rnd.choice(list(KINDS)), day(end - rnd.choice([30, 70, 90, 120])),
                         day(end), day(end + rnd.randrange(30)), rnd.randrange(-50, 50), i))
    asks = [(t, day(n)) for t in ("HOT", "T0", "T1", "T2") for n in range(0, 100, 7)]
    got = facts.financials_asof(spark.createDataFrame(asks, "ticker string, asof date"),
                                spark.createDataFrame(rows, FACT), "asof", KINDS).collect()
    for r in got:
        seen = [x for x in rows if x[0] == r.ticker and x[5] <= r.asof]

        def latest(kind):
            c = [x for x in seen if x[1] == kind]
            return max(c, key=lambda x: (x[4], x[5]))[6] if c else None
        cash = latest("cash")
        if cash is None:
            assert r.cash_usd is None
            continue
        assert r.cash_usd == cash + (latest("investments") or 0)
        q = sorted([x for x in seen if x[1] == "burn" and 60 <= (x[4] - x[3]).days <= 100],
                   key=lambda x: x[4], reverse=True)[:4]
        avg = sum(x[6] for x in q) / len(q) if q else None
        want = None if avg is None else -avg if avg < 0 else 0.0
        assert r.quarterly_burn_usd == want
        assert r.shares_outstanding == (latest("shares") or None)


def test_asof_join_against_brute_force(spark):
    rnd = random.Random(1)
    f = [("HOT" if i % 3 else f"K{i % 5}", day(rnd.randrange(50)), i) for i in range(300)]
    p = [(rnd.choice(["HOT", "K0", "K1", "none"]), day(rnd.randrange(60)), i) for i in range(200)]
    facts_df = spark.createDataFrame(f, "k string, d date, v int")
    probes = spark.createDataFrame(p, "k string, at date, id int")
    for strict in (False, True):
        got = asof.asof_join(probes, facts_df, "k", "at", "d", ["v"], strict).collect()
        assert len(got) == len(p)
        for r in got:
            c = [x for x in f if x[0] == r.k and (x[1] < r.at if strict else x[1] <= r.at)]
            assert r.v == (max(c, key=lambda x: (x[1], x[2]))[2] if c else None)


def test_range_product(spark):
    s = spark.createDataFrame([("A", D(2025, 1, 1), 0.1), ("A", D(2025, 6, 1), 2.0)],
                              "ticker string, day date, ratio double")
    p = spark.createDataFrame([("A", D(2024, 1, 1)), ("A", D(2025, 1, 1)), ("A", D(2026, 1, 1)),
                               ("B", D(2024, 1, 1))], "ticker string, asof date")
    got = {(r.ticker, r.asof.year): r.f for r in
           asof.range_product(p, s, "ticker", "asof", "day", "ratio", "f").collect()}
    assert got == {("A", 2024): 0.2, ("A", 2025): 2.0, ("A", 2026): 1.0, ("B", 2024): 1.0}


def test_cadence_fixture(spark):
    f = spark.createDataFrame(
        [("A", "8-K", D(2023, m, 1)) for m in (1, 3, 6, 9)] + [("A", "8-K/A", D(2023, 3, 1))]
        + [("B", "8-K", D(2023, 1, 1))], "ticker string, form string, filed date")
    p = spark.createDataFrame([("A", D(2023, 3, 31)), ("B", D(2023, 3, 31)), ("C", D(2023, 3, 31))],
                              "ticker string, asof date")
    got = {r.ticker: r for r in filings.cadence_asof(p, f).collect()}
    assert (got["A"].eightk_90d, got["A"].eightk_365d, got["A"].days_since_8k) == (2, 2, 30)
    assert got["B"].burst is None and got["C"].eightk_365d == 0 and got["C"].days_since_8k is None
    live = {r.ticker: r for r in filings.cadence_asof(p, f, distinct_days=False).collect()}
    assert live["A"].eightk_90d == 3


def test_financing_fixture(spark):
    today = D(2026, 9, 22)
    f = spark.createDataFrame(
        [("new", "S-3", D(2025, 1, 2)), ("old", "S-3", D(2020, 1, 2)),
         ("auto", "S-3ASR", D(2026, 1, 5)), ("future", "424B5", D(2026, 12, 1)),
         ("serial", "424B5", D(2026, 8, 1)), ("serial", "424B5", D(2025, 6, 1)),
         ("serial", "424B5", D(2019, 1, 1))], "ticker string, form string, filed date")
    p = f.select("ticker").distinct().withColumn("asof", F.lit(today))
    got = {r.ticker: r for r in filings.financing_asof(p, f).collect()}
    assert got["new"].shelf_live and not got["old"].shelf_live
    assert got["auto"].shelf_live and got["auto"].shelf_count == 1
    assert got["future"].offerings_total == 0 and got["future"].last_offering_date is None
    s = got["serial"]
    assert (s.offerings_24m, s.offerings_total) == (2, 3)
    assert s.days_since_offering == (today - D(2026, 8, 1)).days


def test_insider_window_against_brute_force(spark):
    rnd = random.Random(2)
    tx = [("HOT" if i % 3 else "B", day(rnd.randrange(300)), rnd.randrange(40),
           rnd.choice("PS"), float(rnd.randrange(100))) for i in range(400)]
    p = [(t, day(n)) for t in ("HOT", "B", "C") for n in range(0, 420, 5)]
    got = insiders.insiders_asof(
        spark.createDataFrame(p, "ticker string, asof date"),
        spark.createDataFrame(tx, "ticker string, filed_date date, accession int, code string, "
                                  "usd double")).collect()
    assert len(got) == len(p)
    for r in got:
        w = [x for x in tx if x[0] == r.ticker
             and r.asof - dt.timedelta(days=90) < x[1] <= r.asof]
        assert r.insider_buy_usd == sum(x[4] for x in w if x[3] == "P")
        assert r.insider_sell_usd == sum(x[4] for x in w if x[3] == "S")
        assert r.insider_filings == len({x[2] for x in w})
        assert r.insider_buyers == len({x[2] for x in w if x[3] == "P"})
        assert r.any_insider_activity == bool(w)


def test_event_returns_fixture(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i + 2 * (i // 5)) for i in range(60)]
    px = [10 + 10 * i / 59 for i in range(60)]
    bars = ([("AAA", d, p, 1.0) for d, p in zip(days, px)]
            + [("BENCH", d, 100.0, 1.0) for d in days]
            + [("GAP", d, 5.0, 1.0) for i, d in enumerate(days) if i != 15]
            + [("FEW", d, 5.0, 1.0) for d in days[:20]])
    bars = spark.createDataFrame(bars, "ticker string, day date, close double, volume double")
    ev = spark.createDataFrame([("AAA", days[20]), ("GAP", days[20]), ("FEW", days[10])],
                               "ticker string, event_date date")
    p = panel.price_panel(bars, days[0], days[-1])
    got = {r.ticker: r for r in panel.event_returns(ev, p, (1, 5), 5).collect()}
    assert set(got) == {"AAA"}  # no fill for a missing entry row, too few closes dropped
    assert abs(got["AAA"].abn_5d - (px[25] / px[15] - 1)) < 1e-12
    assert got["AAA"].rvol_60d is None and got["AAA"].entry_date == days[15]
    miss = panel.missing_tickers(bars, ev, days[0], days[-1]).collect()
    assert [r.ticker for r in miss] == ["FEW"]


def test_realised_moves_fixture(spark):
    days = [D(2026, 6, 1) + dt.timedelta(days=i + 2 * (i // 5)) for i in range(40)]
    bars = [(t, d, 10.0 + (i if t == "AAA" else 0), 1.0) for t in ("AAA", "BENCH")
            for i, d in enumerate(days)]
    bars = spark.createDataFrame(bars, "ticker string, day date, close double, volume double")
    ev = spark.createDataFrame([(1, "AAA", days[10])], "drug_id bigint, ticker string, catalyst_date date")
    r = panel.realised_moves(ev, panel.price_panel(bars, days[0], days[-1])).first()
    assert r.entry_date == days[9] and r.entry_date.weekday() == 4  # Monday event, Friday entry
    assert abs(r.move_1d - (20 / 19 - 1)) < 1e-12 and abs(r.abn_1d - r.move_1d) < 1e-12
    assert r.last_date == days[-1] and abs(r.move_todate - (49 / 19 - 1)) < 1e-12


def test_sponsor_matching_against_brute_force(spark):
    from eventide import fixed_values as fv  # noqa: F401
    reg = [("Alpha Bio Inc", "ab", 0), ("Alpha Bio", "late", 1), ("Alpha Bio Gene", "abg", 2),
           ("American One", "one", 3), ("American Two", "two", 4), ("Zeta", "zz", 5)]
    want = {"ALPHA BIO, INC.": "AB", "Alpha Bio Gene Works": "ABG", "Alpha": "ABG",
            "American": "ONE", "Zeta Therapeutics": "ZZ", "Zetas": None, None: None, "Inc": None}
    df = names.match_sponsors(
        spark.createDataFrame([(k,) for k in want], "lead_sponsor string"),
        spark.createDataFrame(reg, "title string, ticker string, pos bigint"))
    assert {r.lead_sponsor: r.ticker for r in df.collect()} == want


def test_freshest_tag_never_merges(spark):
    kinds = {k: (t, "USD") for k, t in {"cash": ("A", "B"), "investments": ("I",), "burn": ("N",),
                                        "shares": ("S",)}.items()}
    rows = [("X", "A", "USD", None, D(2023, 9, 30), D(2023, 11, 1), 1.0, "10-Q", 0),
            ("X", "B", "USD", None, D(2026, 6, 30), D(2026, 8, 1), 2.0, "10-Q", 0),
            ("Y", "A", "USD", None, D(2026, 6, 30), D(2026, 8, 1), 10.0, "10-Q", 0),
            ("Y", "B", "USD", None, D(2026, 6, 30), D(2026, 8, 1), 99.0, "10-Q", 0)]
    got = facts.freshest_tag(spark.createDataFrame(rows, FACT), kinds).collect()
    assert sorted((r.ticker, r.val) for r in got) == [("X", 2.0), ("Y", 10.0)]


def test_bootstrap_widens_with_clusters_and_flags_thin(spark):
    rnd = random.Random(0)
    rows = [(f"T{i:02d}", f"T{i:02d}", v) for i in range(20) for v in [rnd.gauss(0, 1)] * 10]
    rows = [(t, f"{t}-{j}", v) for j, (t, _, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "c string, one string, abn_1d double")

    def width(cluster):
        s = inference.summarize(df.withColumn("ticker", F.col(cluster)), {"all": None}, (1,),
                                400).first()
        return s.ci_hi - s.ci_lo
    assert width("c") > 2 * width("one")
    few = df.where("c < 'T04'").withColumn("ticker", F.col("c")).withColumn("abn_1d", F.lit(1.0))
    r = inference.summarize(few, {"all": None}, (1,), 100).first()
    assert not r.reliable and not r.significant and r.n_clusters == 4


def test_multiple_testing(spark):
    rows = [("a", 20, 0.1, 0.2, 0.0001), ("b", 20, 0.1, 0.2, 0.04), ("c", 4, 0.1, 0.2, 0.0)]
    df = spark.createDataFrame(rows, "bucket string, n_clusters int, ci_lo double, ci_hi double, "
                                     "p_two_sided double")
    got = {r.bucket: r for r in inference.flag_tests(df).collect()}
    assert got["a"].survives_bonferroni and not got["b"].survives_bonferroni
    assert got["b"].significant and not got["c"].significant


def test_exact_median_matches_statistics(spark):
    rnd = random.Random(4)
    rows = [("a", rnd.gauss(0, 1e-5)) for _ in range(301)] + [("b", 0.0)] * 200 \
        + [("b", rnd.uniform(-9, 9)) for _ in range(100)] + [("c", float(i)) for i in (1, 5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r["median"] for r in inference.exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median([v for q, v in rows if q == k]) for k in "abc"}


def test_upsert_slice_reconcile(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B", 1), (3, "c", 1)], "k int, v string, extra int")
    got = tb.upsert(old.withColumn("extra", F.lit(None).cast("int")), new, ["k"]).collect()
    assert sorted((r.k, r.v) for r in got) == [(1, "a"), (2, "B"), (3, "c")]
    slim = spark.createDataFrame([("T", D(2024, 1, 1))], "ticker string, snapshot_date date")
    once = tb.reconcile(slim, TABLES["insider"])
    assert {"senior_net_usd", "cluster_buy", "n_buyers"} <= set(once.columns)
    assert tb.reconcile(once, TABLES["insider"]).schema == once.schema
    path = str(tmp_path / "t")
    assert tb.read_current(spark, path) is None
    tb.overwrite(old, path)
    tb.overwrite(tb.read_current(spark, path).where("k = 1"), path)
    assert [r.k for r in tb.read_current(spark, path).collect()] == [1]
    tb.append(old.where("k = 2"), path)
    assert sorted(r.k for r in tb.read_current(spark, path).collect()) == [1, 2]
    tb.overwrite(tb.read_current(spark, path).where("k = 1"), path)
    # A run that breaks off after its data is written leaves the table as it was.
    old.write.parquet(f"{path}/data-unfinished")
    assert [r.k for r in tb.read_current(spark, path).collect()] == [1]


def test_change_only_log(spark):
    cols = ("drug_id bigint, snapshot_date date, verdict string, setup string, conviction int, "
            "evidence string, catalyst_date date")

    def row(day_, conv=41, verdict="SHORT"):
        return (1, day_, verdict, "S", conv, "n/a", D(2024, 5, 1))
    log = spark.createDataFrame([row(D(2024, 1, 1))], cols)
    sig = changelog.verdict_signature()

    def changed(r):
        return changelog.changed_rows(spark.createDataFrame([r], cols), log, "drug_id", sig).count()
    assert changed(row(D(2024, 1, 2), 44)) == 0
    assert changed(row(D(2024, 1, 2), 52)) == 1
    assert changed(row(D(2024, 1, 2), 44, "LONG")) == 1
    dense = spark.createDataFrame([row(D(2024, 1, 1)), row(D(2024, 1, 2)), row(D(2024, 1, 3), 80)],
                                  cols)
    kept = changelog.compact(dense, "drug_id", sig).collect()
    assert sorted(r.snapshot_date for r in kept) == [D(2024, 1, 1), D(2024, 1, 3)]


def test_log_by_month_rewrites_only_a_rerun_month(spark, tmp_path):
    from pathlib import Path

    path, schema = str(tmp_path / "log"), "k int, day date, v string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    files = lambda: {p.parent.name: {x.name for x in p.parent.glob("*.parquet")}
                     for p in Path(path).glob("month=*/*.parquet")}
    kept = lambda: sorted((r.k, str(r.day), r.v) for r in tb.read_months(
        spark, path, frame().schema).collect())
    day = dt.date
    tb.upsert_months(frame(), path, ["k", "day"], "day")
    assert kept() == []
    tb.upsert_months(frame((1, day(2026, 1, 5), "a"), (2, day(2026, 2, 5), "b"), (3, None, "n")), path,
                     ["k", "day"], "day")
    one = files()
    assert set(one) == {"month=2026-01", "month=2026-02", "month=none"}
    tb.upsert_months(frame((4, day(2026, 2, 6), "c")), path, ["k", "day"], "day")
    two = files()
    assert two["month=2026-01"] == one["month=2026-01"] and two["month=2026-02"] > one["month=2026-02"]
    tb.upsert_months(frame((2, day(2026, 2, 5), "B"), (5, day(2026, 3, 1), "d"), (1, day(2026, 1, 6), "e")),
                     path, ["k", "day"], "day")
    three = files()
    assert three["month=2026-01"] > one["month=2026-01"]
    assert not three["month=2026-02"] & two["month=2026-02"]
    assert kept() == [(1, "2026-01-05", "a"), (1, "2026-01-06", "e"), (2, "2026-02-05", "B"), (3, "None", "n"),
                      (4, "2026-02-06", "c"), (5, "2026-03-01", "d")]
    plan = tb.read_months(spark, path, frame().schema).where("month = '2026-01'")
    assert "PartitionFilters: [isnotnull(month" in plan._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trailing_windows_are_told_by_steps(spark):
    """No state walks the frame of a trailing window: its work per day must not grow with the window."""
    rng = random.Random(3)
    tx = [("A", day(n), n % 7, rng.choice("PS"), float(rng.randint(1, 9) * 10 ** rng.randint(0, 12)))
          for n in range(0, 400, 3)]
    tx = spark.createDataFrame(tx, "ticker string, filed_date date, accession int, code string, usd double")
    p = spark.createDataFrame([("A", day(n)) for n in range(0, 600, 5)], "ticker string, asof date")
    f = spark.createDataFrame([("A", "8-K", day(n)) for n in range(0, 400, 11)]
                              + [("A", "424B5", day(n)) for n in range(0, 400, 50)],
                              "ticker string, form string, filed date")
    got = insiders.insiders_asof(p, tx)
    for df in (got, filings.cadence_asof(p, f), filings.financing_asof(p, f)):
        assert "RangeFrame" not in plan_of(df)
    rows = [(r.filed_date, r.accession, r.code, r.usd) for r in tx.collect()]
    for r in got.collect():
        live = [x for x in rows if dt.timedelta(0) <= r.asof - x[0] < dt.timedelta(90)]
        for side, have in (("P", r.insider_buy_usd), ("S", r.insider_sell_usd)):
            want = sum(x[3] for x in live if x[2] == side)
            assert have == want if want == 0 else abs(have / want - 1) < 1e-12
        assert r.insider_filings == len({x[1] for x in live})
        assert r.insider_buyers == len({x[1] for x in live if x[2] == "P"})
        assert r.any_insider_activity == bool(live)
    for r in filings.cadence_asof(p, f).collect():
        ages = [(r.asof - day(n)).days for n in range(0, 400, 11)]
        assert [r.eightk_30d, r.eightk_90d, r.eightk_365d] == [
            sum(0 <= a <= w for a in ages) for w in (30, 90, 365)]


def test_features_have_timelines_of_their_own(spark):
    """A feature's passes go over its own facts and the probes, not over the facts of another."""
    p = spark.createDataFrame([("A", day(9)), ("A", day(9)), ("B", day(1)), (None, day(1))],
                              "ticker string, asof date")
    a = spark.createDataFrame([("A", day(3), 1), ("A", day(9), 2)], "ticker string, day date, x int")
    b = spark.createDataFrame([("A", day(8), 7), ("B", day(2), 8)], "ticker string, day date, y int")
    seen = []

    def watched(f, other):
        def state(stream):
            seen.append(other in stream.columns)
            return f.state(stream)
        return asof.Feature(f.daily, state, f.columns, f.otherwise)
    x = watched(asof.latest_feature(a, "ticker", "day", ["x"], name="_x"), "_y")
    y = watched(asof.latest_feature(b, "ticker", "day", ["y"], name="_y"), "_x")
    got = asof.with_features(p, [x, y], "ticker", "asof").collect()
    assert sorted((r.ticker or "", r.x, r.y) for r in got if r.ticker) == [
        ("A", 2, 7), ("A", 2, 7), ("B", None, None)]
    assert len(got) == 4 and seen == [False, False]
