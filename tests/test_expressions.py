import datetime as dt

from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions import dates, priors, scoring, text
from eventide.functions.sentiment import lexicon_hits

D = dt.date


def test_fuzzy_dates(apply):
    cases = {
        "09/21/2026": (D(2026, 9, 21), D(2026, 9, 21), "day"),
        "2025-03-17": (D(2025, 3, 17), D(2025, 3, 17), "day"),
        "2026-11": (D(2026, 11, 1), D(2026, 11, 30), "month"),
        "Mid Sep 2026": (D(2026, 9, 11), D(2026, 9, 20), "month_part"),
        "2H 2026": (D(2026, 7, 1), D(2026, 12, 31), "half"),
        "H1 2026": (D(2026, 1, 1), D(2026, 6, 30), "half"),
        "Q4 2026": (D(2026, 10, 1), D(2026, 12, 31), "quarter"),
        "2026": (D(2026, 1, 1), D(2026, 12, 31), "year"),
        "TBD": (None, None, "unknown"), "": (None, None, "unknown"),
        None: (None, None, "unknown"), "02/31/2026": (None, None, "unknown"),
        "February 30 2026": (None, None, "unknown"),
        "Late Feb 2026": (D(2026, 2, 21), D(2026, 2, 28), "month_part"),
        "November 15, 2026": (D(2026, 11, 15), D(2026, 11, 15), "day"),
        "15 April 2027": (D(2027, 4, 15), D(2027, 4, 15), "day"),
        "March 3rd, 2027": (D(2027, 3, 3), D(2027, 3, 3), "day"),
        "September 2026": (D(2026, 9, 1), D(2026, 9, 30), "month"),
        "2026-13": (D(2026, 1, 1), D(2026, 12, 31), "year"),
        "Sept 2026": (D(2026, 1, 1), D(2026, 12, 31), "year"),
        "Early 2026": (D(2026, 1, 1), D(2026, 4, 30), "year_part"),
        "late-2026": (D(2026, 9, 1), D(2026, 12, 31), "year_part"),
    }
    assert [tuple(r) for r in apply(dates.fuzzy_date, list(cases))] == list(cases.values())


def test_guided_periods(apply):
    cases = {"first half of 2027": (D(2027, 1, 1), D(2027, 6, 30)),
             "Q4 2026": (D(2026, 10, 1), D(2026, 12, 31)),
             "second quarter of 2026": (D(2026, 4, 1), D(2026, 6, 30)),
             "March 2027": (D(2027, 3, 1), D(2027, 3, 31)),
             "mid-2027": (D(2027, 5, 1), D(2027, 8, 31)),
             "soon": (None, None), "": (None, None)}
    assert [tuple(r) for r in apply(dates.guided_period, list(cases))] == list(cases.values())


def test_guidance_only_narrows(spark):
    lo, hi = D(2026, 11, 1), D(2027, 4, 30)
    rows = [(lo, hi, D(2027, 1, 1), D(2027, 3, 31)), (lo, hi, D(2028, 1, 1), D(2028, 12, 31)),
            (lo, hi, D(2020, 1, 1), D(2030, 12, 31)), (lo, hi, None, None),
            (lo, hi, D(2027, 2, 1), None), (None, None, D(2027, 1, 1), D(2027, 3, 31))]
    df = spark.createDataFrame(rows, "a date, b date, c date, d date").coalesce(1)
    got = [tuple(r.n) for r in df.select(dates.narrow(*map(F.col, "abcd")).alias("n")).collect()]
    assert got == [(D(2027, 1, 1), D(2027, 3, 31), "guidance"), (lo, hi, "trial"),
                   (lo, hi, "guidance"), (lo, hi, "trial"), (D(2027, 2, 1), hi, "guidance"),
                   (None, None, "trial")]
    w = fv.PRECISION_WEIGHT
    assert w["readout_window"] < w["quarter"] < w["guidance"] < w["day"]


def test_publication_lag_and_quarters(apply, spark):
    days = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"]
    got = apply(lambda c: dates.publication_date(c.cast("date")), days)
    assert got == [D(2024, 1, 19), D(2024, 1, 19), D(2024, 1, 19), D(2024, 1, 22)]
    q = spark.sql("select date'2021-02-03' a, date'2021-08-01' b").select(
        dates.quarter_labels(F.col("a"), F.col("b")).alias("q")).first().q
    assert q == ["2020q4", "2021q1", "2021q2", "2021q3"]
    assert apply(dates.day_key, ["2024-01-05 00:00:00", "x", None]) == [D(2024, 1, 5), None, None]


def test_text_normalisers(apply):
    assert apply(text.clean_text, [None, " nan ", "<NA>", " a b "]) == ["", "", "", "a b"]
    assert apply(lambda c: text.clean_number(c, 0), ["1.5", "NaN", "x", None]) == [1.5, 0, 0, 0]
    assert apply(text.simple_stage, ["PHASE1,PHASE2", "PHASE2, PHASE3", "PHASE4", "x", None]) == [
        "phase1/2", "phase2/3", "phase4", "other", "other"]
    assert apply(text.company_key, ["Merck & Co., Inc.", "Acme Bio-Labs Ltd", None]) == [
        "merck", "acme bio", ""]
    assert apply(text.ticker_in_name, ["Acme Corp  (ACME, CIK 1)", "B (X.Y)", "none"]) == [
        "ACME", "X.Y", None]


def test_therapeutic_areas(apply):
    cases = {"cUTI, including pyelonephritis": "infectious", "lupus nephritis": "autoimmune",
             "autism spectrum disorder": "psychiatry",
             "transthyretin amyloid cardiomyopathy": "cardiovascular",
             "Severe Leukocyte Adhesion Deficiency-I": "rare", "a ligand study": "other",
             "Wet AMD": "ophthalmology", None: "other", "": "other"}
    assert apply(text.therapeutic_area, list(cases)) == list(cases.values())


def test_html_and_indications(apply):
    out = apply(text.html_text, ["<p>WAKIX&#174; for <b>x</b>&#8226;</p><script>a</script>"])[0]
    assert "®" in out and "<" not in out and "script" not in out
    cases = {
        "IgAN in adults, and assigned a PDUFA target action date of": "IgAN",
        "high-risk Stage 1 NSCLC announced last quarter": "high-risk Stage 1 NSCLC",
        "adults with Recurrent Respiratory Papillomatosis": "Recurrent Respiratory Papillomatosis",
        "the": None, "a b c": None, "symptomatic": None,
        "epidermal growth factor receptor": None,
        "multiple myeloma,\" said Daniel O’Day, Chairman": "multiple myeloma",
        "presbyopia and set a PDUFA action date of October 17": "presbyopia",
        " ".join(["word"] * 25): " ".join(["word"] * 10)}
    assert apply(text.tidy_indication, list(cases)) == list(cases.values())


def test_drug_rejection(apply):
    junk = ["EX-99", "EX-99.1", "EXHIBIT", "FORM", "NDA", "PDUFA", "Q3", "the"]
    real = ["INO-3107", "BP-205", "SRP-9001", "BBP-418", "CTx-1301"]
    got = apply(text._acceptable_drug, junk + real)
    assert got == [False] * len(junk) + [True] * len(real)


def test_lexicon(apply):
    texts = ["FDA approval granted", "Shares plunge after clinical hold",
             "Drug not approved by the FDA", "Trial did not meet primary endpoint",
             "Phase 3 trial met primary endpoint", "Announces reverse stock split",
             "Company to present at investor conference", "", None, "cannot beat it",
             "no " + "x" * 40 + " beat"]
    got = [tuple(r) for r in apply(lexicon_hits, texts)]
    assert got[0][0] > 0 and got[1][1] > 0
    assert got[2][0] == 0 and got[2][1] > 0
    assert got[3][0] == 0 and got[3][1] > 0
    assert got[4][0] > 0 and got[4][1] == 0
    assert got[5][1] > 0
    assert got[6] == got[7] == got[8] == (0, 0)
    assert got[9] == (1, 0) and got[10] == (1, 0)


def test_lexicon_matches_plain_counting(apply):
    """Against a direct count in Python on texts full of overlapping hits and negators."""
    import random
    import re
    rnd = random.Random(3)
    words = ["not", "granted", "grant", "approval", "no", "without", "fails to", "beat", "beats",
             "positive", "data", "win", "loss", "cannot", "é", "-", "fda approval", "meet"]
    texts = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(40)]

    def plain(t):
        pos = neg = 0
        neg += sum(t.count(p) for p in fv.NEGATIVE_PHRASES)
        neg += sum(len(re.findall(rf"\b{re.escape(w)}", t)) for w in fv.NEGATIVE_WORDS)
        pats = [re.escape(p) for p in fv.POSITIVE_PHRASES]
        for p in pats + [rf"\b{w}" for w in fv.POSITIVE_WORDS]:
            for m in re.finditer(p, t):
                negated = re.search(fv.NEGATORS, t[max(0, m.start() - 32):m.start()])
                pos, neg = (pos, neg + 1) if negated else (pos + 1, neg)
        return pos, neg
    assert [tuple(r) for r in apply(lexicon_hits, texts)] == [plain(t) for t in texts]


def test_headline_relevance(spark):
    rows = [("MRK", "Merck & Company Inc.", "Novo Nordisk shares plunge over 7%"),
            ("MRK", "Merck & Company Inc.", "Merck raises full-year guidance"),
            ("INO", "Inovio Pharmaceuticals", "Casino stocks rally"),
            ("INO", "Inovio Pharmaceuticals", "Inovio doses first patient"),
            ("XY", None, "XY wins")]
    df = spark.createDataFrame(rows, "t string, c string, h string").coalesce(1)
    tok = text.company_tokens(F.col("t"), F.col("c"))
    got = df.select(tok.alias("tok"), text.names_company(F.col("h"), tok).alias("ok")).collect()
    assert [r.ok for r in got] == [False, True, False, True, True]
    assert set(got[0].tok) == {"mrk", "merck"}


def test_priors(spark):
    def loa(stage, ind=None, tags=None):
        df = spark.createDataFrame([(stage, ind, tags)], "s string, i string, d string")
        return df.select(priors.approval_prior(*map(F.col, "sid")).alias("x")).first().x
    assert abs(loa("phase3") - 0.496) < 1e-12
    assert loa("Phase 3", "breast cancer") < loa("phase3") < loa("phase3", None, "BTD ODD")
    assert loa("pdufa", "sickle cell") < 0.98
    assert loa("nonsense") == 0.10

    def mv(stage, cap):
        df = spark.createDataFrame([(stage, cap)], "s string, c double")
        return df.select(priors.typical_move(F.col("s"), F.col("c")).alias("x")).first().x
    assert mv("phase3", None) == mv("phase3", 0.0) == 0.45
    assert mv("phase3", 2e8) == 0.45 and mv("phase3", 5e9) == 0.3 and mv("phase3", 4e11) == 0.01


def test_design_multiplier_rounds_like_python(spark):
    rows = [(b, n, s) for b in fv.DESIGN_MULTIPLIER for n in (None, 20.0, 100.0, 400.0)
            for s in list(fv.LOA_BY_PHASE) + ["?"]]
    df = spark.createDataFrame(rows, "b string, n double, s string")
    got = df.select("b", "n", "s", priors.design_multiplier(*map(F.col, "bns")).alias("m"),
                    priors.design_note(F.col("b"), F.col("n")).alias("note")).collect()
    for r in got:
        size = 1.0 if r.n is None else 0.85 if r.n < 60 else 1.05 if r.n >= 300 else 1.0
        base = fv.LOA_BY_PHASE.get(r.s, 0.10)
        assert r.m == round(1.0 + (fv.DESIGN_MULTIPLIER[r.b] * size - 1.0) * (1.0 - base), 3), r
    note = {(r.b, r.n): r.note for r in got}
    assert note[("randomized_open", 20.0)] == "randomized open, n=20, underpowered"
    assert note[("unknown", None)] is None


def test_printed_numbers(apply):
    xs = [0.15, 0.25, 0.35, 2.45, 5.05, 1.25, 0.05, 3.0, 12.349999, 2.675]
    assert apply(scoring.tenths, xs, "double") == [f"{x:.1f}" for x in xs]
    ys = [0.5, 1.5, 2.5, 3.49, 1e6]
    assert apply(scoring.whole, ys, "double") == [f"{y:.0f}" for y in ys]


def test_squeeze_and_readiness(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), (1e6, 2.0, 1e8, 5e5), (1e6, 5.0, 1e8, None),
         (1e6, 10.0, 1e8, None), (2.5e7, 1.0, 1e8, None), (3.5e7, 1.0, 1e8, None)],
        "a double, b double, c double, d double").coalesce(1)
    got = df.select(scoring.squeeze_metrics(*map(F.col, "abcd")).alias("q")).select("q.*").collect()
    assert [r.squeeze_risk for r in got] == [0, 1, 2, 3, 2, 3]
    assert got[1].short_build == 1.0 and got[0].squeeze_label == "low"
    rows = [(True, 6, 30, None), (True, 6, 30, 60.0), (True, 2, 80, 3.0), (False, 0, None, 3.0),
            (True, 0, None, 3.0), (True, 2, 200, 20.0)]
    df = spark.createDataFrame(rows, "a boolean, b int, c int, d double").coalesce(1)
    got = df.select(scoring.dilution_readiness(*map(F.col, "abcd")).alias("q")).select("q.*").collect()
    assert [r.dilution_label for r in got] == ["possible", "possible", "loaded", "possible",
                                               "likely", "likely"]
    assert got[0].dilution_notes == "live shelf, but funded"
    assert got[2].dilution_notes == "live shelf; 2 offerings in 24mo; priced a deal 80d ago"
