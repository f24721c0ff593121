"""SQL that recomputes the registered queries independently, for DuckDB."""

from __future__ import annotations

import re

from eventide import fixed_values as fv
from eventide import proxies as px

ORACLE: dict[str, str] = {}
DAY = f"DATE '{px.RUN_DATE}'"
A, Z = f"DATE '{px.STUDY_START}'", f"DATE '{px.STUDY_END}'"
WORD = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d(x: float) -> str:
    return f"{float(x)!r}" + ("" if "e" in repr(float(x)) else "E0")


def pick(expr: str, table: dict, default: str = "NULL", number: bool = False) -> str:
    body = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN "
                    f"{d(v) if number else q(v)}" for k, v in table.items())
    return f"(CASE {expr} {body} ELSE {default} END)"


def check(name: str, final: str, *parts: str) -> None:
    """Compose views and fragments (by name, in order) in front of the final select."""
    text = "\n".join([*(FRAGMENTS[p] for p in parts if p in FRAGMENTS), final])
    views = [v for v in px.VIEWS if re.search(rf"\b{v}\b", text)]
    ctes = [f"{v} AS ({px.VIEWS[v]})" for v in views if v not in parts]
    ctes += [f"{p} AS ({FRAGMENTS[p]})" for p in parts]
    ORACLE[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + final


def on_grid(sql: str) -> str:
    """Replace round(x, n) by the floor form the queries use, the same in both engines, and
    round_even(x, n) by printing, which rounds the exact binary value."""
    out, at = "", 0
    for m in re.finditer(r"(?<![\w])round(?:_even)?\(", sql):
        if m.start() < at:
            continue
        depth, i, comma = 1, m.end(), None
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        x, n = on_grid(sql[m.end():comma]), int(sql[comma + 1:i - 1])
        grid = f"(floor(({x}) * 1e{n} + 0.5E0) / 1e{n})"
        exact = f"CAST(printf('%.{n}f', CAST({x} AS DOUBLE)) AS DOUBLE)"
        out += sql[at:m.start()] + (exact if "even" in m.group() else grid)
        at = i
    return out + sql[at:]


def ntrim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR lower({ntrim(x)}) IN ('nan','nat','none','<na>') "
            f"THEN '' ELSE {ntrim(x)} END)")


def area(x: str) -> str:
    t = f"lower({clean(x)})"
    out = f"CASE WHEN {t} = '' THEN 'other' WHEN "
    out += " OR ".join(f"contains({t}, {q(m)})" for m in fv.RARE_MARKERS)
    out += (rf" OR regexp_matches({t}, '\bdeficiency\b')"
            rf" OR regexp_matches({t}, '\b(?:type|deficiency)[- ][ivx]+\b') THEN 'rare'")
    for name, words in fv.TA_KEYWORDS:
        alt = "|".join(w + (f"($|{WORD})" if len(w) <= 4 and not w.endswith(" ") else
                            (r"[\p{L}\p{N}_]" if len(w) <= 4 else "")) for w in words)
        out += f" WHEN regexp_matches({t}, '(^|{WORD})(?:{alt})') THEN {q(name)}"
    return out + " ELSE 'other' END"


STAGE_KEY = "lower(replace(simplified_stage, ' ', ''))"


def prior(stage: str, ta: str, tags: str | None) -> str:
    base = pick(stage, fv.LOA_BY_PHASE, d(fv.LOA_DEFAULT), True)
    mult = pick(ta, fv.TA_MULTIPLIER, d(1), True)
    if tags:
        for tag, bonus in fv.DESIGNATION_BONUS.items():
            mult = (f"({mult} * CASE WHEN contains(upper({clean(tags)}), {q(tag)}) "
                    f"THEN {d(bonus)} ELSE 1.0E0 END)")
    return (f"greatest(0.01E0, least(0.98E0, {base} * "
            f"(1.0E0 + ({mult} - 1.0E0) * (1.0E0 - {base}))))")


def move(stage: str, cap: str) -> str:
    top = pick(stage, fv.MOVE_CEILING, d(fv.MOVE_CEILING_DEFAULT), True)
    risk = pick(stage, fv.DOLLARS_AT_RISK, d(fv.DOLLARS_AT_RISK_DEFAULT), True)
    return (f"CASE WHEN coalesce({cap}, 0) <= 0 THEN {top} "
            f"ELSE greatest(0.01E0, least({top}, {risk} / {cap})) END")


DESIGN = f"""CASE WHEN upper({clean('allocation')}) = 'RANDOMIZED' AND
      upper({clean('masking')}) NOT IN ('', 'NONE', 'NA', 'OPEN') THEN 'randomized_blinded'
    WHEN upper({clean('allocation')}) = 'RANDOMIZED' THEN 'randomized_open'
    WHEN upper({clean('allocation')}) IN ('', 'NA') THEN 'unknown'
    WHEN upper({clean('masking')}) NOT IN ('', 'NONE', 'NA', 'OPEN') THEN 'single_arm_blinded'
    ELSE 'single_arm_open' END"""


def design_mult(stage: str) -> str:
    base = pick(stage, fv.LOA_BY_PHASE, d(fv.LOA_DEFAULT), True)
    size = "(CASE WHEN enrollment < 60 THEN 0.85E0 WHEN enrollment >= 300 THEN 1.05E0 ELSE 1.0E0 END)"
    mult = f"({pick('design_bucket', fv.DESIGN_MULTIPLIER, d(1), True)} * {size})"
    return f"round_even(1.0E0 + ({mult} - 1.0E0) * (1.0E0 - {base}), 3)"


DESIGN_NOTE = """nullif(concat_ws(', ',
    CASE WHEN design_bucket <> 'unknown' THEN replace(design_bucket, '_', ' ') END,
    CASE WHEN enrollment < 60 THEN concat('n=', enrollment, ', underpowered')
         WHEN enrollment >= 300 THEN concat('n=', enrollment) END), '')"""


def squeeze(short, cover, out, prior_):
    pct = f"(CASE WHEN {short} <> 0 AND {out} <> 0 THEN {short} / {out} END)"
    tier = f"(CASE WHEN {cover} >= 10 THEN 3 WHEN {cover} >= 5 THEN 2 WHEN {cover} >= 2 THEN 1 ELSE 0 END)"
    risk = (f"(CASE WHEN {pct} >= 0.30E0 THEN 3 WHEN {pct} >= 0.20E0 THEN greatest({tier}, 2) "
            f"ELSE {tier} END)")
    build = f"(CASE WHEN {short} <> 0 AND {prior_} <> 0 THEN {short} / {prior_} - 1 END)"
    label = f"(CASE {risk} WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'elevated' ELSE 'high' END)"
    return pct, build, risk, label


SI_PUB = """
        SELECT *, settlement_date + CASE isodow(settlement_date) WHEN 6 THEN 13 WHEN 7 THEN 12
               ELSE 14 END AS published_date FROM short_interest"""
FRAGMENTS = {
    "joined_rows": f"""
        SELECT c.drug_id, c.ticker, c.company_name, c.drug_name, c.nct_id, c.indication, c.stage,
               c.simplified_stage, c.catalyst_date_raw, c.catalyst_date_lo AS lo0,
               c.catalyst_date_hi AS hi0, c.date_precision AS prec0, c.designations,
               t.enrollment, t.allocation, t.masking, f.cash_usd, f.runway_months,
               f.shares_outstanding, f.cash_asof, p.last, p.ret_20d, p.rvol_60d, p.adv_usd,
               p.market_cap, i.implied_move, i.expiry AS implied_expiry, s.sentiment,
               s.thin AS sentiment_thin, s.articles AS news_articles, s.top_positive,
               s.top_negative, s.eightk_90d, si.shares_short, si.shares_short_prior,
               si.days_to_cover, si.settlement_date AS short_asof, fz.dilution_label,
               fz.offerings_24m, fz.days_since_offering, fz.last_offering_date,
               g.period_lo AS guide_lo, g.period_hi AS guide_hi, ins.insider_tilt,
               ins.senior_net_usd, ins.cluster_buy, ins.n_buyers, ins.biggest_delta_own,
               ins.biggest_move_desc
        FROM catalysts c LEFT JOIN trials t USING (nct_id)
        LEFT JOIN financials f ON c.ticker = f.ticker LEFT JOIN prices p ON c.ticker = p.ticker
        LEFT JOIN implied i ON c.ticker = i.ticker AND c.catalyst_date_lo = i.catalyst_date
        LEFT JOIN (SELECT * FROM sentiment WHERE snapshot_date <= {DAY} QUALIFY row_number() OVER
             (PARTITION BY ticker ORDER BY snapshot_date DESC) = 1) s ON c.ticker = s.ticker
        LEFT JOIN (SELECT * FROM ({SI_PUB}) WHERE published_date <= {DAY} QUALIFY row_number() OVER
             (PARTITION BY ticker ORDER BY settlement_date DESC) = 1) si ON c.ticker = si.ticker
        LEFT JOIN financing fz ON c.ticker = fz.ticker
        LEFT JOIN guidance g ON c.ticker = g.ticker
        LEFT JOIN insider ins ON c.ticker = ins.ticker AND ins.snapshot_date <= {DAY}
        WHERE c.catalyst_date_hi >= {DAY}""",
    "windowed": f"""
        SELECT * FROM (SELECT *,
          CASE WHEN narrowed THEN glo ELSE lo0 END AS catalyst_date_lo,
          CASE WHEN narrowed THEN ghi ELSE hi0 END AS catalyst_date_hi,
          CASE WHEN narrowed THEN 'guidance' ELSE prec0 END AS date_precision,
          CASE WHEN narrowed THEN 'guidance' ELSE 'trial' END AS date_source
          FROM (SELECT *, coalesce(prec0 = 'readout_window' AND guide_lo IS NOT NULL
                          AND lo0 IS NOT NULL AND ghi IS NOT NULL AND glo <= ghi, false) AS narrowed
                FROM (SELECT *, greatest(lo0, guide_lo) AS glo,
                        CASE WHEN guide_hi IS NULL THEN hi0 ELSE least(hi0, guide_hi) END AS ghi
                      FROM joined_rows)))
        WHERE catalyst_date_hi >= {DAY}
          AND date_diff('day', {DAY}, catalyst_date_lo) <= 180""",
    "feat": f"""
        SELECT *, {design_mult(STAGE_KEY)} AS design_multiplier, {DESIGN_NOTE} AS design_note,
               {prior(STAGE_KEY, 'ta', 'designations')} AS loa,
               implied_move / expected_move AS move_ratio,
               CASE WHEN market_cap IS NOT NULL THEN expected_move / baseline_move END
                   AS materiality
        FROM (SELECT *, date_diff('day', {DAY}, catalyst_date_lo) AS days_to_catalyst,
                {pick('date_precision', fv.PRECISION_WEIGHT, '0.0E0', True)} AS date_confidence,
                {area('indication')} AS ta, {DESIGN} AS design_bucket,
                {move(STAGE_KEY, 'market_cap')} AS expected_move,
                rvol_60d * sqrt(greatest(date_diff('day', {DAY}, catalyst_date_lo), 1) / 252.0E0)
                    AS baseline_move,
                runway_months - date_diff('day', {DAY}, catalyst_date_lo) / 30.44E0
                    AS runway_at_catalyst,
                coalesce(last_offering_date > cash_asof, false) AS runway_stale,
                simplified_stage IN ('phase2','phase2/3','phase3','pdufa','nda','bla') AS is_binary,
                coalesce(market_cap, 0) < 3e8 AS microcap, coalesce(adv_usd, 0) < 1e6 AS illiquid,
                {squeeze('shares_short', 'days_to_cover', 'shares_outstanding', 'shares_short_prior')[0]}
                    AS short_pct_outstanding,
                {squeeze('shares_short', 'days_to_cover', 'shares_outstanding', 'shares_short_prior')[1]}
                    AS short_build,
                {squeeze('shares_short', 'days_to_cover', 'shares_outstanding', 'shares_short_prior')[2]}
                    AS squeeze_risk,
                {squeeze('shares_short', 'days_to_cover', 'shares_outstanding', 'shares_short_prior')[3]}
                    AS squeeze_label
              FROM windowed)""",
    "cascade": f"""
        SELECT *, {pick('setup', fv.LEAN)} AS lean,
          abs(rs) * 0.4E0 + abs(us) * 0.25E0 + abs(ls) * 0.35E0 AS s0
        FROM (SELECT *, CASE WHEN rs <= -0.7E0 THEN 'DILUTION_SHORT'
             WHEN materiality >= 1 AND move_ratio > 1.25E0 THEN 'VOL_SELL_RICH'
             WHEN materiality >= 1 AND move_ratio < 0.8E0 THEN 'VOL_BUY_CHEAP'
             WHEN us <= -0.6E0 AND ls < 0 AND is_binary THEN 'RUNUP_FADE'
             WHEN ls > 0.25E0 AND rs >= 0.2E0 AND coalesce(ret_20d, 0) < 0.25E0
               THEN 'BASE_RATE_LONG' ELSE 'NO_EDGE' END AS setup
          FROM (SELECT *, CASE WHEN runway_at_catalyst IS NULL THEN 0.0E0
                    WHEN runway_at_catalyst < 0 THEN -1.0E0 WHEN runway_at_catalyst < 6 THEN -0.7E0
                    WHEN runway_at_catalyst < 12 THEN -0.3E0 ELSE 0.2E0 END AS rs,
                  CASE WHEN ret_20d > 0.25E0 THEN -0.6E0 WHEN ret_20d < -0.25E0 THEN 0.3E0
                    ELSE 0.0E0 END AS us,
                  greatest(-1.0E0, least(1.0E0, (loa - 0.4E0) * 1.2E0)) AS ls FROM feat))""",
    "amplified": """
        SELECT *, CASE WHEN setup = 'DILUTION_SHORT' THEN s4
             WHEN setup IN ('VOL_SELL_RICH', 'VOL_BUY_CHEAP')
               THEN greatest(s0, least(1.0E0, abs(move_ratio - 1.0E0)))
             WHEN setup = 'NO_EDGE' THEN s0 * 0.3E0 ELSE s0 END AS strength,
          CASE WHEN lean = 'short' THEN CASE squeeze_risk WHEN 1 THEN 0.85E0 WHEN 2 THEN 0.4E0
               WHEN 3 THEN 0.25E0 ELSE 1.0E0 END ELSE 1.0E0 END AS penalty
        FROM (SELECT *, CASE WHEN eightk_90d >= 6 THEN least(1.0E0, s3 * 1.3E0) ELSE s3 END AS s4
         FROM (SELECT *, CASE WHEN microcap THEN least(1.0E0, s2 * 1.25E0) ELSE s2 END AS s3
          FROM (SELECT *, CASE WHEN runway_stale THEN s1 * 0.6E0 ELSE s1 END AS s2
           FROM (SELECT *, CASE WHEN offerings_24m >= 2 THEN least(1.0E0, s0 * 1.35E0)
                    WHEN offerings_24m < 2 THEN s0 * 0.5E0 ELSE s0 END AS s1 FROM cascade))))""",
    "scored": f"""
        SELECT *, CAST(greatest(0, least(100, CASE WHEN illiquid THEN round_even(c0 * 0.6E0, 0)
                 ELSE c0 END)) AS INT) AS conviction,
          {pick('setup', fv.VERDICT)} AS verdict,
          setup IN ('DILUTION_SHORT', 'RUNUP_FADE', 'BASE_RATE_LONG') AS directional,
          {pick('setup', fv.SETUP_TEXT)} AS setup_desc, {pick('setup', fv.EVIDENCE)} AS evidence,
          {pick('setup', fv.EVIDENCE_NOTE)} AS evidence_note
        FROM (SELECT *, CAST(round_even(100 * strength * (0.35E0 + 0.65E0 * date_confidence)
              * penalty, 0) AS DOUBLE) AS c0 FROM amplified)""",
    "reasoned": """
        SELECT *, list_filter([
          CASE WHEN runway_at_catalyst < 0 THEN printf('cash runs out ~%.0fmo before the catalyst',
                 abs(runway_at_catalyst))
               WHEN runway_at_catalyst < 6 THEN
                 printf('only %.0fmo cash left at the catalyst', runway_at_catalyst)
               WHEN runway_at_catalyst < 12 THEN printf('%.0fmo cash at the catalyst',
                 runway_at_catalyst)
               WHEN runway_at_catalyst IS NOT NULL THEN
                 printf('%.0fmo cash, financing not forced', runway_at_catalyst) END,
          CASE WHEN ret_20d > 0.25E0 THEN printf('+%.0f%% in 20 sessions into the date',
                 ret_20d * 100)
               WHEN ret_20d < -0.25E0 THEN printf('%.0f%% in 20 sessions, expectations reset',
                 ret_20d * 100) END,
          CASE WHEN move_ratio > 1.25E0 THEN printf(
                 'straddle prices %.0f%% vs %.0f%% typical (%.1fx)', implied_move * 100,
                 expected_move * 100, move_ratio)
               WHEN move_ratio < 0.8E0 THEN printf(
                 'straddle prices only %.0f%% vs %.0f%% typical (%.1fx)', implied_move * 100,
                 expected_move * 100, move_ratio) END,
          concat(printf('base-rate LOA %.0f%% for ', loa * 100), coalesce(stage, 'None'), ' ', ta,
                 CASE WHEN coalesce(designations, '') <> '' THEN concat(' (', designations, ')')
                 ELSE '' END),
          CASE WHEN materiality IS NULL AND market_cap IS NULL THEN
                 'size unknown: no share count filed, materiality untested'
               WHEN materiality < 1 THEN printf(
                 'immaterial: asset is ~%.0f%% of cap vs %.0f%% baseline noise',
                 expected_move * 100, baseline_move * 100) END,
          CASE WHEN lean = 'short' AND squeeze_risk <> 0 THEN concat('squeeze risk ',
                 squeeze_label, CASE WHEN days_to_cover IS NOT NULL THEN
                 printf(': %.1f days to cover', days_to_cover) ELSE '' END,
                 ' -- crowded low-runway shorts tested -1.1% @21d (p=0.63) vs -7.2% uncrowded') END,
          CASE WHEN lean = 'short' AND short_build > 0.5E0 THEN
                 printf('short interest +%.0f%% since last reading', short_build * 100) END,
          CASE WHEN lean = 'short' AND cluster_buy THEN concat('CAUTION: ', coalesce(n_buyers, 0),
                 ' insiders bought (cluster) -- tested, not supported, not scored') END,
          CASE WHEN lean = 'short' AND senior_net_usd > 100000 THEN concat(
                 'CAUTION: C-suite net bought $',
                 format('{:,}', CAST(round_even(senior_net_usd, 0) AS BIGINT)),
                 ' -- tested, not supported, not scored') END,
          CASE WHEN lean = 'short' AND biggest_delta_own > 0.5E0 AND biggest_move_desc <> ''
               THEN concat('CAUTION: ', biggest_move_desc) END,
          CASE WHEN setup = 'DILUTION_SHORT' AND offerings_24m IS NULL THEN
                 'issuance history unavailable: not adjusted'
               WHEN setup = 'DILUTION_SHORT' AND offerings_24m >= 2 THEN concat(offerings_24m,
                 ' offerings in 24mo: serial issuer (-27.7% @126d vs +2.2% for rare issuers)')
               WHEN setup = 'DILUTION_SHORT' THEN
                 'rare issuer: low runway alone tested flat (p=0.87)' END,
          CASE WHEN setup = 'DILUTION_SHORT' AND runway_stale THEN
                 'runway predates a later offering: cash figure understated' END,
          CASE WHEN setup = 'DILUTION_SHORT' AND dilution_label = 'loaded' THEN
                 'dilution readiness loaded (-17.0% @126d)' END,
          CASE WHEN setup = 'DILUTION_SHORT' AND days_since_offering <= 120 THEN concat(
                 'priced a deal ', days_since_offering, 'd ago (-9.0% @126d)') END,
          CASE WHEN setup = 'DILUTION_SHORT' AND microcap THEN
                 'microcap: -10.5% abn @126d for the size bucket' END,
          CASE WHEN setup = 'DILUTION_SHORT' AND eightk_90d >= 6 THEN concat(eightk_90d,
                 ' 8-Ks in 90d: heavy filing activity') END,
          CASE WHEN setup = 'DILUTION_SHORT' AND eightk_90d >= 6 AND microcap THEN
                 'low runway + busy + microcap tested -39.8% @126d' END,
          CASE WHEN illiquid THEN 'thin: under $1M/day traded' END
        ], lambda x: x IS NOT NULL) AS reason_list FROM scored""",
    "ev": f"""
        SELECT DISTINCT ticker, filed AS event_date FROM filing_index
        WHERE form IN ('10-Q', '10-K') AND filed BETWEEN {A} AND {Z}""",
    "usable": f"""
        SELECT * FROM price_bar WHERE day >= {A} - 10 AND day < {Z} + 120
        QUALIFY count(close) OVER (PARTITION BY ticker) >= 30""",
    "cal": """
        SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INT) AS pos
        FROM (SELECT DISTINCT day FROM usable)""",
    "panel": "SELECT u.ticker, u.day, c.pos, u.close FROM usable u JOIN cal c USING (day)",
    "si_pub": SI_PUB,
    "ret": """
        SELECT e.ticker, e.event_date, p.day AS entry_date, p.close AS entry_price,
          CASE WHEN b1.close > 0 THEN (p1.close / p.close - 1) - (b1.close / b.close - 1) END AS abn_21d,
          CASE WHEN b2.close > 0 THEN (p2.close / p.close - 1) - (b2.close / b.close - 1) END AS abn_63d,
          CASE WHEN b3.close > 0 THEN (p3.close / p.close - 1) - (b3.close / b.close - 1) END AS abn_126d
        FROM (SELECT ev.*, (SELECT min(pos) FROM cal WHERE cal.day >= ev.event_date) AS pos FROM ev) e
        JOIN panel p ON p.ticker = e.ticker AND p.pos = e.pos
        JOIN panel b ON b.ticker = 'BENCH' AND b.pos = e.pos
        LEFT JOIN panel p1 ON p1.ticker = e.ticker AND p1.pos = e.pos + 21
        LEFT JOIN panel p2 ON p2.ticker = e.ticker AND p2.pos = e.pos + 63
        LEFT JOIN panel p3 ON p3.ticker = e.ticker AND p3.pos = e.pos + 126
        LEFT JOIN panel b1 ON b1.ticker = 'BENCH' AND b1.pos = e.pos + 21
        LEFT JOIN panel b2 ON b2.ticker = 'BENCH' AND b2.pos = e.pos + 63
        LEFT JOIN panel b3 ON b3.ticker = 'BENCH' AND b3.pos = e.pos + 126
        WHERE p.close > 0 AND b.close > 0""",
    "ask_ev": "SELECT ticker, event_date AS asof FROM ev",
    "ask_ret": "SELECT DISTINCT ticker, entry_date AS asof FROM ret",
}


def _pit(ask: str) -> dict:
    """Point-in-time financials by inequality join, for a probe fragment."""
    return {
        f"vis_{ask}": f"""
            SELECT a.asof, f.*, string_split(tag, '_')[1] AS kind, contains(tag, '_') AS tagno
            FROM {ask} a JOIN xbrl_fact f ON f.ticker = a.ticker AND f.filed <= a.asof
            WHERE unit = CASE WHEN starts_with(tag, 'shares') THEN 'shares' ELSE 'USD' END""",
        f"lat_{ask}": f"""
            SELECT * FROM vis_{ask} WHERE kind <> 'burn' QUALIFY row_number() OVER (
              PARTITION BY ticker, asof, kind
              ORDER BY end_date DESC, filed DESC, tagno, pos, val DESC) = 1""",
        f"brn_{ask}": f"""
            SELECT ticker, asof, count(*) AS k4, coalesce(max(CASE WHEN k = 1 THEN val END), 0)
              + coalesce(max(CASE WHEN k = 2 THEN val END), 0)
              + coalesce(max(CASE WHEN k = 3 THEN val END), 0)
              + coalesce(max(CASE WHEN k = 4 THEN val END), 0) AS total
            FROM (SELECT *, row_number() OVER (PARTITION BY ticker, asof
                    ORDER BY end_date DESC, tagno, pos, val DESC) AS k
                  FROM vis_{ask} WHERE kind = 'burn' AND end_date - start_date BETWEEN 60 AND 100)
            WHERE k <= 4 GROUP BY ALL""",
        f"fin_{ask}": f"""
            SELECT c.ticker, c.asof, c.val + coalesce(i.val, 0) AS cash_usd,
              c.end_date AS cash_period_end, c.filed AS cash_filed,
              CASE WHEN b.total / k4 < 0 THEN -(b.total / k4) WHEN k4 > 0 THEN 0.0E0 END
                AS quarterly_burn_usd,
              CASE WHEN b.total / k4 < 0 THEN round_even((c.val + coalesce(i.val, 0))
                / (-(b.total / k4) / 3.0E0), 2) END AS runway_months,
              nullif(s.val, 0) AS shares_outstanding
            FROM (SELECT * FROM lat_{ask} WHERE kind = 'cash') c
            LEFT JOIN (SELECT * FROM lat_{ask} WHERE kind = 'investments') i USING (ticker, asof)
            LEFT JOIN (SELECT * FROM lat_{ask} WHERE kind = 'shares') s USING (ticker, asof)
            LEFT JOIN brn_{ask} b USING (ticker, asof)""",
    }


FRAGMENTS.update(_pit("ask_ev"))
FRAGMENTS.update(_pit("ask_ret"))
FRAGMENTS.update({
    f"{k}_{ask}": v.format(ask=ask) for ask in ("ask_ev", "ask_ret") for k, v in {
        "cad": """
            SELECT ticker, asof, CAST(count(*) FILTER (asof - f <= 30) AS INT) AS eightk_30d,
              CAST(count(*) FILTER (asof - f <= 90) AS INT) AS eightk_90d,
              CAST(count(*) FILTER (asof - f <= 365) AS INT) AS eightk_365d,
              CAST(asof - max(f) AS INT) AS days_since_8k,
              CASE WHEN count(*) FILTER (asof - f <= 365) >= 3 THEN
                round_even(count(*) FILTER (asof - f <= 90)
                           / (count(*) FILTER (asof - f <= 365) / 4.0E0), 3) END AS burst
            FROM {ask} a LEFT JOIN (SELECT DISTINCT ticker, filed AS f FROM filing_index
                 WHERE starts_with(form, '8-K')) x USING (ticker)
            WHERE f <= asof OR f IS NULL GROUP BY ticker, asof""",
        "post": """
            SELECT a.ticker, a.asof, max(filed) FILTER (form = 'S-3') AS last_shelf_date,
              CAST(count(*) FILTER (form = 'S-3') AS INT) AS shelf_count,
              max(filed) FILTER (form = '424B5') AS last_offering_date,
              CAST(count(*) FILTER (form = '424B5' AND a.asof - filed <= 730) AS INT) AS offerings_24m,
              CAST(count(*) FILTER (form = '424B5') AS INT) AS offerings_total,
              CAST(a.asof - max(filed) FILTER (form = 'S-3') AS INT) AS shelf_age_days,
              coalesce(a.asof - max(filed) FILTER (form = 'S-3') <= 1095, false) AS shelf_live,
              CAST(a.asof - max(filed) FILTER (form = '424B5') AS INT) AS days_since_offering
            FROM {ask} a LEFT JOIN filing_index f ON f.ticker = a.ticker AND f.filed <= a.asof
            GROUP BY a.ticker, a.asof""",
        "inw": """
            SELECT a.ticker, a.asof,
              coalesce(round(sum(usd) FILTER (code = 'P'), 2), 0) AS insider_buy_usd,
              coalesce(round(sum(usd) FILTER (code = 'S'), 2), 0) AS insider_sell_usd,
              CAST(count(DISTINCT accession) AS INT) AS insider_filings,
              CAST(count(DISTINCT accession) FILTER (code = 'P') AS INT) AS insider_buyers,
              count(accession) > 0 AS any_insider_activity,
              round(coalesce(sum(usd) FILTER (code = 'P'), 0)
                    - coalesce(sum(usd) FILTER (code = 'S'), 0), 2) AS insider_net_usd
            FROM {ask} a LEFT JOIN (SELECT * FROM insider_tx WHERE code IN ('P', 'S')) t
              ON t.ticker = a.ticker AND t.filed_date > a.asof - 90 AND t.filed_date <= a.asof
            GROUP BY a.ticker, a.asof""",
        "sia": """
            SELECT a.ticker, a.asof, s.days_to_cover, s.shares_short
            FROM {ask} a LEFT JOIN si_pub s ON s.ticker = a.ticker AND s.published_date <= a.asof
            QUALIFY row_number() OVER (PARTITION BY a.ticker, a.asof
              ORDER BY s.published_date DESC NULLS LAST, s.settlement_date) = 1""",
    }.items()})


def ready(runway: str) -> tuple[str, str, str]:
    """Readiness score, label and notes from posture columns and a runway expression."""
    needs = f"coalesce({runway} < 24, false)"
    able = "(CAST(shelf_live AS INT) + CAST(offerings_24m >= 2 AS INT))"
    score = (f"(CASE WHEN {needs} THEN {able} + CAST(coalesce({runway} < 12, false) AS INT) "
             f"ELSE least({able}, 1) END)")
    label = f"(CASE {score} WHEN 0 THEN 'cold' WHEN 1 THEN 'possible' WHEN 2 THEN 'likely' ELSE 'loaded' END)"
    notes = f"""concat_ws('; ', CASE WHEN shelf_live AND NOT {needs} THEN 'live shelf, but funded'
          WHEN shelf_live THEN 'live shelf' END,
        CASE WHEN offerings_24m >= 2 AND NOT (shelf_live AND NOT {needs})
          THEN concat(offerings_24m, ' offerings in 24mo') END,
        CASE WHEN {needs} AND days_since_offering <= 120
          THEN concat('priced a deal ', days_since_offering, 'd ago') END)"""
    return score, label, notes


def bucket(x: str, edges, last: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'unknown' "
            + " ".join(f"WHEN {x} < {e} THEN {q(n)}" for e, n in edges) + f" ELSE {q(last)} END)")


def inter(a: str, b: str, both: str, first: str, second: str) -> str:
    return (f"(CASE WHEN coalesce({a}, false) AND coalesce({b}, false) THEN {q(both)} "
            f"WHEN coalesce({a}, false) THEN {q(first)} WHEN coalesce({b}, false) THEN {q(second)} "
            f"ELSE 'neither' END)")


RUNWAY = lambda x: bucket(x, ((6, "a. <6mo"), (12, "b. 6-12mo"), (24, "c. 12-24mo")), "d. >24mo")
SIZE = lambda x: bucket(x, (("3e8", "micro <$300M"), ("2e9", "small $0.3-2B")), "mid+ >$2B")
BURST = lambda x: bucket(x, ((0.75, "a. quiet <0.75x"), (1.5, "b. normal 0.75-1.5x"), (3, "c. elevated 1.5-3x")), "d. burst >3x")
COUNT = lambda x: bucket(x, ((1, "a. none"), (3, "b. 1-2"), (6, "c. 3-5")), "d. 6+")
COVER = lambda x: bucket(x, ((1.5, "a. <1.5 days"), (3, "b. 1.5-3 days"), (6, "c. 3-6 days")), "d. 6+ days")


def net(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} > 250000 THEN 'a. net buying >$250k' "
            f"WHEN {x} > 0 THEN 'b. net buying' WHEN {x} = 0 THEN 'c. none' "
            f"WHEN {x} > -250000 THEN 'd. net selling' ELSE 'e. net selling >$250k' END)")


def cut(x: str, cuts) -> str:
    out = "(CASE"
    for lo, hi, label in cuts:
        cond = [f"{x} IS NOT NULL"]
        if lo is not None:
            cond.append(f"{x} > {d(lo)}")
        if hi is not None:
            cond.append(f"{x} <= {d(hi)}")
        out += f" WHEN {' AND '.join(cond)} THEN {q(label)}"
    return out + " END)"


LOW = "runway_months < 6"
_TALL = "fin_ask_ret"
PIT_RET = ("ask_ret", "vis_ask_ret", "lat_ask_ret", "brn_ask_ret", "fin_ask_ret")
PIT_EV = ("ask_ev", "vis_ask_ev", "lat_ask_ev", "brn_ask_ev", "fin_ask_ev")
RET = ("ev", "usable", "cal", "panel", "ret")

FRAGMENTS.update({
    "sf": """
        SELECT a.ticker, a.asof, coalesce(product(e.ratio), 1) AS factor FROM ask_ret a
        LEFT JOIN split_event e ON e.ticker = a.ticker AND e.day > a.asof GROUP BY ALL""",
    "runway_ev": f"""
        SELECT *, {RUNWAY('runway_months')} AS runway_bucket, {SIZE('market_cap')} AS size_bucket,
          CASE WHEN runway_months < 6 AND market_cap < 3e8 THEN 'distressed micro'
               ELSE 'everything else' END AS distressed_micro
        FROM (SELECT r.*, f.runway_months, f.shares_outstanding * s.factor * r.entry_price AS market_cap
              FROM ret r JOIN fin_ask_ret f ON f.ticker = r.ticker AND f.asof = r.entry_date
              JOIN sf s ON s.ticker = r.ticker AND s.asof = r.entry_date)""",
    "cadence_ev": f"""
        SELECT *, {BURST('burst')} AS burst_bucket, {COUNT('eightk_90d')} AS count_bucket,
          {inter(LOW, 'burst >= 1.5', 'low runway + burst', 'low runway only', 'burst only')}
            AS interaction
        FROM (SELECT r.*, f.runway_months, c.burst, coalesce(c.eightk_90d, 0) AS eightk_90d FROM ret r
              LEFT JOIN fin_ask_ret f ON f.ticker = r.ticker AND f.asof = r.entry_date
              LEFT JOIN cad_ask_ret c ON c.ticker = r.ticker AND c.asof = r.entry_date)""",
    "squeeze_ev": f"""
        SELECT *, {COVER('days_to_cover')} AS dtc_bucket,
          {inter(LOW, 'days_to_cover >= 5', 'low runway + crowded short', 'low runway, uncrowded',
                 'crowded short only')} AS interaction
        FROM (SELECT r.*, f.runway_months, c.days_to_cover FROM ret r
              LEFT JOIN fin_ask_ret f ON f.ticker = r.ticker AND f.asof = r.entry_date
              LEFT JOIN sia_ask_ret c ON c.ticker = r.ticker AND c.asof = r.entry_date)""",
    "financing_ev": f"""
        SELECT *, {ready('runway_months')[1]} AS dilution_label,
          {ready('runway_months')[2]} AS dilution_notes,
          CASE WHEN days_since_offering <= 120 THEN 'priced <120d ago' ELSE 'no recent deal' END
            AS recent_deal,
          {inter(LOW, 'offerings_24m >= 2', 'low runway + serial issuer',
                 'low runway, rare issuer', 'serial issuer only')} AS interaction
        FROM (SELECT r.*, f.runway_months, c.* EXCLUDE (ticker, asof) FROM ret r
              LEFT JOIN fin_ask_ret f ON f.ticker = r.ticker AND f.asof = r.entry_date
              LEFT JOIN post_ask_ret c ON c.ticker = r.ticker AND c.asof = r.entry_date)""",
    "insider_ev": f"""
        SELECT *, {net('insider_net_usd')} AS net_bucket,
          CASE WHEN insider_buyers >= 3 THEN 'cluster buy (3+ filings)' ELSE 'no cluster' END
            AS cluster,
          {inter(LOW, 'insider_net_usd > 0', 'low runway + insiders buying',
                 'low runway, no insider buying', 'insiders buying only')} AS interaction
        FROM (SELECT r.*, f.runway_months, c.insider_net_usd, c.insider_buyers FROM ret r
              LEFT JOIN fin_ask_ret f ON f.ticker = r.ticker AND f.asof = r.entry_date
              LEFT JOIN inw_ask_ret c ON c.ticker = r.ticker AND c.asof = r.entry_date)""",
    "readouts": """
        SELECT concat('R', c.drug_id) AS nct_id, c.ticker, c.catalyst_date_lo AS event_date,
               c.indication, c.simplified_stage, t.allocation, t.masking, t.enrollment
        FROM catalysts c LEFT JOIN trials t USING (nct_id)""",
    "lr": """
        SELECT a.ticker, a.pos, ln(a.close / b.close) AS r FROM panel a
        JOIN panel b ON b.ticker = a.ticker AND b.pos = a.pos - 1""",
    "readout_ev": f"""
        SELECT *, {prior(STAGE_KEY, area('indication'), None)} AS loa, {DESIGN} AS design_bucket
        FROM (SELECT e.*, p.day AS entry_date,
          CASE WHEN e.pos >= 21 THEN p.close / h.close - 1 END AS ret_20d,
          CASE WHEN b1.close > 0 THEN (p1.close / p.close - 1) - (b1.close / b.close - 1) END AS abn_1d,
          CASE WHEN b2.close > 0 THEN (p2.close / p.close - 1) - (b2.close / b.close - 1) END AS abn_5d,
          CASE WHEN b3.close > 0 THEN (p3.close / p.close - 1) - (b3.close / b.close - 1) END AS abn_21d,
          CASE WHEN b4.close > 0 THEN (p4.close / p.close - 1) - (b4.close / b.close - 1) END AS abn_63d
        FROM (SELECT r.*, (SELECT min(pos) FROM cal WHERE cal.day >= r.event_date) - 5 AS pos
              FROM readouts r) e
        JOIN panel p ON p.ticker = e.ticker AND p.pos = e.pos
        JOIN panel b ON b.ticker = 'BENCH' AND b.pos = e.pos
        LEFT JOIN panel h ON h.ticker = e.ticker AND h.pos = e.pos - 20
        LEFT JOIN panel p1 ON p1.ticker = e.ticker AND p1.pos = e.pos + 6
        LEFT JOIN panel p2 ON p2.ticker = e.ticker AND p2.pos = e.pos + 10
        LEFT JOIN panel p3 ON p3.ticker = e.ticker AND p3.pos = e.pos + 26
        LEFT JOIN panel p4 ON p4.ticker = e.ticker AND p4.pos = e.pos + 68
        LEFT JOIN panel b1 ON b1.ticker = 'BENCH' AND b1.pos = e.pos + 6
        LEFT JOIN panel b2 ON b2.ticker = 'BENCH' AND b2.pos = e.pos + 10
        LEFT JOIN panel b3 ON b3.ticker = 'BENCH' AND b3.pos = e.pos + 26
        LEFT JOIN panel b4 ON b4.ticker = 'BENCH' AND b4.pos = e.pos + 68
        WHERE p.close > 0 AND b.close > 0)""",
})


def summary_sql(source: str, study: str, cuts: dict, horizons, grid: dict | None = None) -> str:
    """Bootstrap summary of an event fragment."""
    rows = " UNION ALL ".join(
        f"SELECT {q(c)} AS cut, {q('ALL') if col is None else col} AS bucket, '{h}d' AS horizon, "
        f"ticker, abn_{h}d AS value FROM {source}" for c, col in cuts.items() for h in horizons)
    one = "(xor({0} >> 16, {0}) * 73244475) & 4294967295"
    zero = ""
    if grid:
        cells = ", ".join(f"({q(c)}, {q(b)}, '{h}d')" for c, bs in grid.items() for b in bs
                          for h in horizons)
        zero = (f" UNION ALL SELECT g.cut, g.bucket, g.horizon, 0, 0, NULL, NULL, NULL FROM "
                f"(VALUES {cells}) g(cut, bucket, horizon) WHERE NOT EXISTS (SELECT 1 FROM cells0 c "
                f"WHERE c.cut = g.cut AND c.bucket = g.bucket AND c.horizon = g.horizon)")
    return f""",
      rows AS (SELECT * FROM ({rows}) WHERE bucket IS NOT NULL),
      clusters AS (SELECT cut, bucket, horizon, ticker, sum(value) AS total, count(value) AS n
                   FROM rows GROUP BY ALL),
      cells0 AS (SELECT cut, bucket, horizon, count(value) AS n,
            count(DISTINCT ticker) FILTER (value IS NOT NULL) AS n_clusters,
            avg(value) AS mean, median(value) AS median,
            avg(CASE WHEN value > 0 THEN 1.0E0 WHEN value IS NOT NULL THEN 0.0E0 END) AS hit_rate
            FROM rows GROUP BY ALL),
      cells AS (SELECT * FROM cells0{zero}),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY cut, bucket, horizon
            ORDER BY substr(md5(ticker), 1, 2), ticker) - 1 AS idx FROM clusters WHERE n > 0),
      r0 AS (SELECT cut, bucket, horizon, n_clusters AS c, b,
             CAST(('0x' || substr(md5(concat_ws('|', '0', cut, bucket, horizon)), 1, 8)) AS BIGINT) AS h
             FROM cells, (SELECT unnest(range(1, {fv.N_BOOT + 1})) AS b) WHERE n_clusters > 0),
      r1 AS (SELECT *, {one.format('b')} AS m FROM r0), r2 AS (SELECT *, {one.format('m')} AS m2 FROM r1),
      r3 AS (SELECT * EXCLUDE (h), xor(h, xor(m2 >> 16, m2)) AS h FROM r2),
      r4 AS (SELECT *, {one.format('h')} AS g FROM r3), r5 AS (SELECT *, {one.format('g')} AS g2 FROM r4),
      reps AS (SELECT cut, bucket, horizon, c, b, xor(g2 >> 16, g2) AS h FROM r5),
      d0 AS (SELECT cut, bucket, horizon, b, c, (h + k * 2654435761) & 4294967295 AS x
             FROM (SELECT *, unnest(range(1, c + 1)) AS k FROM reps)),
      d1 AS (SELECT * EXCLUDE (x), {one.format('x')} AS x FROM d0),
      d2 AS (SELECT * EXCLUDE (x), {one.format('x')} AS x FROM d1),
      draws AS (SELECT cut, bucket, horizon, b, xor(x >> 16, x) % c AS idx FROM d2),
      means AS (SELECT cut, bucket, horizon, b, sum(total) / sum(n) AS m
                FROM draws JOIN numbered USING (cut, bucket, horizon, idx) GROUP BY ALL),
      boot AS (SELECT cut, bucket, horizon, quantile_cont(m, 0.025) AS ci_lo,
                quantile_cont(m, 0.975) AS ci_hi,
                avg(CASE WHEN abs(m - am) >= abs(mean) THEN 1.0E0 ELSE 0.0E0 END) AS p_two_sided
               FROM (SELECT *, avg(m) OVER (PARTITION BY cut, bucket, horizon) AS am FROM means)
               JOIN cells USING (cut, bucket, horizon) GROUP BY ALL)
    SELECT {q(study)} AS study, cut, bucket, horizon, n, n_clusters, round(mean, 6) AS mean,
      round(median, 6) AS median, round(hit_rate, 6) AS hit_rate, round(ci_lo, 6) AS ci_lo,
      round(ci_hi, 6) AS ci_hi, round(p_two_sided, 6) AS p_two_sided, n_clusters >= 12 AS reliable,
      coalesce(n_clusters >= 12 AND (ci_lo > 0 OR ci_hi < 0) AND p_two_sided < 0.05, false)
        AS significant,
      coalesce(n_clusters >= 12 AND p_two_sided < 0.05E0 / count(*) OVER (), false)
        AS survives_bonferroni
    FROM cells LEFT JOIN boot USING (cut, bucket, horizon)"""
