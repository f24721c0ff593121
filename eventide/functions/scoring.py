"""Setup cascade, conviction and stated reasons of one event row.

Every function takes the needed columns from the feature frame by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.priors import lookup
from eventide.functions.text import clean_number, clean_text, flag, nearest

c = F.col


# --- printed numbers --------------------------------------------------------------------------

def whole(x: Column) -> Column:
    """Nearest integer as text, halves to even."""
    return F.bround(x, 0).cast("bigint").cast("string")


def percent(x: Column) -> Column:
    return F.concat(whole(x * 100), F.lit("%"))


def tenths(x: Column) -> Column:
    """One decimal as text."""
    return nearest(x, 1).cast("decimal(18,1)").cast("string")


# --- crowding and dilution --------------------------------------------------------------------

def squeeze_metrics(short: Column, cover: Column, outstanding: Column, prior: Column) -> Column:
    """struct(short_pct_outstanding, short_build, squeeze_risk, squeeze_label)."""
    pct = F.when((short != 0) & (outstanding != 0), short / outstanding)
    build = F.when((short != 0) & (prior != 0), short / prior - 1)
    tier = F.when(cover >= 10, 3).when(cover >= 5, 2).when(cover >= 2, 1).otherwise(0)
    risk = (F.when(pct >= 0.30, 3).when(pct >= 0.20, F.greatest(tier, F.lit(2)))
            .otherwise(tier))
    label = F.element_at(F.array(*[F.lit(x) for x in fv.SQUEEZE_LABEL]), risk + 1)
    return F.struct(pct.alias("short_pct_outstanding"), build.alias("short_build"),
                    risk.alias("squeeze_risk"), label.alias("squeeze_label"))


def dilution_readiness(shelf_live: Column, offerings_24m: Column, days_since: Column,
                       runway: Column) -> Column:
    """struct(dilution_readiness, dilution_label, dilution_notes): ability times need."""
    live = flag(shelf_live)
    n = F.coalesce(offerings_24m, F.lit(0))
    needs = F.coalesce(runway < 24, F.lit(False))
    able = live.cast("int") + (n >= 2).cast("int")
    score = F.when(needs, able + F.coalesce(runway < 12, F.lit(False)).cast("int")) \
        .otherwise(F.least(able, F.lit(1)))
    label = F.element_at(F.array(*[F.lit(x) for x in fv.READINESS_LABEL]), score + 1)
    serial = F.when(n >= 2, F.concat(n.cast("string"), F.lit(" offerings in 24mo")))
    deal = F.when(needs & (days_since <= 120),
                  F.concat(F.lit("priced a deal "), days_since.cast("string"), F.lit("d ago")))
    funded = live & ~needs
    notes = F.filter(F.array(
        F.when(funded, "live shelf, but funded").when(live, "live shelf"),
        F.when(~funded, serial), deal), lambda x: x.isNotNull())
    return F.struct(score.alias("dilution_readiness"), label.alias("dilution_label"),
                    F.array_join(notes, "; ").alias("dilution_notes"))


# --- component scores -------------------------------------------------------------------------

def runway_score() -> Column:
    r = c("runway_at_catalyst")
    return (F.when(r.isNull(), 0.0).when(r < 0, -1.0)
            .when(r < fv.RUNWAY_CRITICAL_MONTHS, -0.7)
            .when(r < fv.RUNWAY_WARN_MONTHS, -0.3).otherwise(0.2))


def runway_reason() -> Column:
    r = c("runway_at_catalyst")
    return (F.when(r < 0, F.concat(F.lit("cash runs out ~"), whole(F.abs(r)),
                                   F.lit("mo before the catalyst")))
            .when(r < fv.RUNWAY_CRITICAL_MONTHS,
                  F.concat(F.lit("only "), whole(r), F.lit("mo cash left at the catalyst")))
            .when(r < fv.RUNWAY_WARN_MONTHS, F.concat(whole(r), F.lit("mo cash at the catalyst")))
            .when(r.isNotNull(), F.concat(whole(r), F.lit("mo cash, financing not forced"))))


def runup_score() -> Column:
    r = c("ret_20d")
    return F.when(r > fv.RUNUP_HOT_20D, -0.6).when(r < -0.25, 0.3).otherwise(0.0)


def runup_reason() -> Column:
    r = c("ret_20d")
    return (F.when(r > fv.RUNUP_HOT_20D, F.concat(
        F.lit("+"), percent(r), F.lit(" in 20 sessions into the date")))
        .when(r < -0.25, F.concat(percent(r), F.lit(" in 20 sessions, expectations reset"))))


def vol_reason() -> Column:
    ratio = c("move_ratio")
    tail = F.concat(percent(c("implied_move")), F.lit(" vs "), percent(c("expected_move")),
                    F.lit(" typical ("), tenths(ratio), F.lit("x)"))
    rich = ratio > fv.IMPLIED_RICH_RATIO
    return F.when(rich | (ratio < 0.8), F.concat(
        F.when(rich, "straddle prices ").otherwise("straddle prices only "), tail))


def loa_score() -> Column:
    raw = (c("loa") - 0.4) * 1.2
    return F.when(c("loa").isNull(), 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def loa_reason() -> Column:
    tags = clean_text(c("designations"))
    return F.when(c("loa").isNotNull(), F.concat(
        F.lit("base-rate LOA "), percent(c("loa")), F.lit(" for "),
        F.coalesce(c("stage"), F.lit("None")), F.lit(" "), c("ta"),
        F.when(tags != "", F.concat(F.lit(" ("), tags, F.lit(")"))).otherwise("")))


def size_reason() -> Column:
    m = c("materiality")
    return (F.when(m.isNull() & c("market_cap").isNull(),
                   "size unknown: no share count filed, materiality untested")
            .when(m < 1.0, F.concat(
                F.lit("immaterial: asset is ~"), percent(c("expected_move")),
                F.lit(" of cap vs "), percent(c("baseline_move")), F.lit(" baseline noise"))))


# --- cascade ----------------------------------------------------------------------------------

def setup() -> Column:
    """The most actionable setup that applies, in fixed order."""
    material = c("materiality") >= 1.0
    ratio = c("move_ratio")
    hot = c("runup_raw") <= -0.6
    return (F.when(c("runway_raw") <= -0.7, "DILUTION_SHORT")
            .when(material & (ratio > fv.IMPLIED_RICH_RATIO), "VOL_SELL_RICH")
            .when(material & (ratio < 0.8), "VOL_BUY_CHEAP")
            .when(hot & (c("loa_raw") < 0) & flag(c("is_binary")), "RUNUP_FADE")
            .when((c("loa_raw") > 0.25) & (c("runway_raw") >= 0.2)
                  & (F.coalesce(c("ret_20d"), F.lit(0.0)) < fv.RUNUP_HOT_20D), "BASE_RATE_LONG")
            .otherwise("NO_EDGE"))


def _is_dilution() -> Column:
    return c("setup") == "DILUTION_SHORT"


def _is_short() -> Column:
    return c("lean") == "short"


def _busy() -> Column:
    return F.coalesce(c("eightk_90d") >= 6, F.lit(False))


def squeeze_penalty() -> Column:
    risk = F.coalesce(c("squeeze_risk"), F.lit(0))
    return F.when(_is_short(), lookup(risk, fv.SQUEEZE_PENALTY, 1.0)).otherwise(1.0)


def strength() -> Column:
    """Signal strength after the amplifiers, which cap at one after each step."""
    one = F.lit(1.0)
    base = F.abs(c("runway_raw")) * 0.4 + F.abs(c("runup_raw")) * 0.25 + F.abs(c("loa_raw")) * 0.35
    offerings = clean_number(c("offerings_24m"))
    s = (F.when(offerings >= 2, F.least(one, base * 1.35)).when(offerings < 2, base * 0.5)
         .otherwise(base))
    s = F.when(flag(c("runway_stale")), s * 0.6).otherwise(s)
    s = F.when(flag(c("microcap")), F.least(one, s * 1.25)).otherwise(s)
    s = F.when(_busy(), F.least(one, s * 1.3)).otherwise(s)
    vol = c("setup").isin("VOL_SELL_RICH", "VOL_BUY_CHEAP")
    ratio = c("move_ratio")
    return (F.when(_is_dilution(), s)
            .when(vol & ratio.isNotNull(),
                  F.greatest(base, F.least(one, F.abs(ratio - 1.0))))
            .when(c("setup") == "NO_EDGE", base * 0.3).otherwise(base))


def conviction() -> Column:
    conf = F.coalesce(c("date_confidence"), F.lit(0.0))
    raw = F.bround(100 * c("strength") * (0.35 + 0.65 * conf) * squeeze_penalty(), 0)
    thin = F.when(flag(c("illiquid")), F.bround(raw * 0.6, 0)).otherwise(raw)
    return F.greatest(F.lit(0), F.least(F.lit(100), thin.cast("int")))


def reason_list() -> Column:
    """Stated reasons in fixed order, as an array."""
    short, dilution = _is_short(), _is_dilution()
    risk = F.coalesce(c("squeeze_risk"), F.lit(0))
    cover = c("days_to_cover")
    offerings = clean_number(c("offerings_24m"))
    senior = c("senior_net_usd")
    since = c("days_since_offering")
    micro = flag(c("microcap"))
    return F.filter(F.array(
        runway_reason(), runup_reason(), vol_reason(), loa_reason(), size_reason(),
        F.when(short & (risk != 0), F.concat(
            F.lit("squeeze risk "), F.coalesce(c("squeeze_label"), F.lit("None")),
            F.when(cover.isNotNull(), F.concat(F.lit(": "), tenths(cover),
                                               F.lit(" days to cover"))).otherwise(""),
            F.lit(" -- crowded low-runway shorts tested -1.1% @21d (p=0.63) vs "
                  "-7.2% uncrowded"))),
        F.when(short & (c("short_build") > 0.5), F.concat(
            F.lit("short interest +"), percent(c("short_build")), F.lit(" since last reading"))),
        F.when(short & flag(c("cluster_buy")), F.concat(
            F.lit("CAUTION: "), F.coalesce(c("n_buyers"), F.lit(0)).cast("string"),
            F.lit(" insiders bought (cluster) -- tested, not supported, not scored"))),
        F.when(short & (senior > 100_000), F.concat(
            F.lit("CAUTION: C-suite net bought $"), F.format_number(senior, 0),
            F.lit(" -- tested, not supported, not scored"))),
        F.when(short & (c("biggest_delta_own") > 0.5) & (c("biggest_move_desc") != ""),
               F.concat(F.lit("CAUTION: "), c("biggest_move_desc"))),
        F.when(dilution & offerings.isNull(), "issuance history unavailable: not adjusted")
        .when(dilution & (offerings >= 2), F.concat(
            offerings.cast("bigint").cast("string"),
            F.lit(" offerings in 24mo: serial issuer "
                  "(-27.7% @126d vs +2.2% for rare issuers)")))
        .when(dilution, "rare issuer: low runway alone tested flat (p=0.87)"),
        F.when(dilution & flag(c("runway_stale")),
               "runway predates a later offering: cash figure understated"),
        F.when(dilution & (c("dilution_label") == "loaded"),
               "dilution readiness loaded (-17.0% @126d)"),
        F.when(dilution & (since <= 120), F.concat(
            F.lit("priced a deal "), since.cast("bigint").cast("string"),
            F.lit("d ago (-9.0% @126d)"))),
        F.when(dilution & micro, "microcap: -10.5% abn @126d for the size bucket"),
        F.when(dilution & _busy(), F.concat(
            c("eightk_90d").cast("bigint").cast("string"),
            F.lit(" 8-Ks in 90d: heavy filing activity"))),
        F.when(dilution & _busy() & micro,
               "low runway + busy + microcap tested -39.8% @126d"),
        F.when(flag(c("illiquid")), "thin: under $1M/day traded"),
    ), lambda r: r.isNotNull())


def headline_reason(reasons: Column) -> Column:
    """The first reason that holds the highest-ranked key, else the first reason."""
    def holding(key):
        return F.filter(reasons, lambda r: F.lower(r).contains(key))
    ranked = [F.try_element_at(holding(key), F.lit(1)) for key in fv.REASON_RANK]
    return F.coalesce(*ranked, F.try_element_at(reasons, F.lit(1)))


def scored(features: DataFrame) -> DataFrame:
    """Feature rows plus verdict, setup, evidence, lean, conviction, reasons and scores."""
    return (features
            .withColumns({"runway_raw": runway_score(), "runup_raw": runup_score(),
                          "loa_raw": loa_score()})
            .withColumn("setup", setup())
            .withColumn("lean", lookup(c("setup"), fv.LEAN, "flat"))
            .withColumn("strength", strength())
            .withColumns({
                "conviction": conviction(),
                "verdict": lookup(c("setup"), fv.VERDICT, "NO TRADE"),
                "directional": c("setup").isin(*fv.DIRECTIONAL_SETUPS),
                "setup_desc": lookup(c("setup"), fv.SETUP_TEXT, ""),
                "evidence": lookup(c("setup"), fv.EVIDENCE, "untested"),
                "evidence_note": lookup(c("setup"), fv.EVIDENCE_NOTE, ""),
                "reason_list": reason_list(),
                "runway_score": nearest(c("runway_raw"), 2),
                "runup_score": nearest(c("runup_raw"), 2),
                "loa_score": nearest(c("loa_raw"), 2),
            })
            .withColumn("reasons", F.when(F.size("reason_list") > 0,
                                          F.array_join("reason_list", " | "))
                        .otherwise("insufficient data"))
            .drop("runway_raw", "runup_raw", "loa_raw", "strength"))
