"""Fuzzy dates, guided periods and other date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.text import let, squeeze, strip

_MONTH = "|".join(fv.MONTH_NAMES + fv.MONTH_ABBR)
_MONTH_DAY_YEAR = rf"\b({_MONTH})\b\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+((?:19|20)\d{{2}})"
_DAY_MONTH_YEAR = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\b,?\s+((?:19|20)\d{{2}})"
_HALF = r"\bh[12]\b|\b[12]h\b|\bfirst half\b|\bsecond half\b"


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """A date from textual parts, NULL when there is no such day."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                       F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.cast("int") > 0, text.try_cast("date"))


def _month_no(name: Column) -> Column:
    """Month number of a month name or abbreviation, from its first three letters."""
    letters = "".join(fv.MONTH_ABBR)
    at = F.instr(F.lit(letters), F.substring(name, 1, 3))
    return ((at + 2) / 3).cast("int")


def _span(y: Column, first_month, last_month) -> tuple[Column, Column]:
    lo = _ymd(y, F.lit(first_month) if isinstance(first_month, int) else first_month, F.lit(1))
    hi = F.last_day(_ymd(
        y, F.lit(last_month) if isinstance(last_month, int) else last_month, F.lit(1)))
    return lo, hi


def _result(lo: Column, hi: Column, precision: str) -> Column:
    """A parsed range; an impossible day is reported as unknown, it never falls through."""
    ok = lo.isNotNull()
    return F.struct(lo.alias("lo"), F.when(ok, hi).alias("hi"),
                    F.when(ok, precision).otherwise("unknown").alias("precision"))


def _part(text: Column) -> Column:
    """0, 1, 2 for an early, mid or late word; NULL without one."""
    def word(words):
        return text.rlike(rf"\b(?:{'|'.join(words)})\b")
    return (F.when(word(fv.EARLY_WORDS), 0).when(word(fv.MID_WORDS), 1)
            .when(word(fv.LATE_WORDS), 2))


def fuzzy_date(raw: Column) -> Column:
    """Parse a loosely written date into struct(lo, hi, precision), most specific form first."""
    literal = strip(F.coalesce(raw.cast("string"), F.lit("")))
    text = F.replace(F.replace(F.lower(literal), F.lit("--"), F.lit(" ")),
                     F.lit("-"), F.lit(" "))
    return let(F.struct(literal.alias("literal"), text.alias("text")),
               lambda x: _fuzzy(x["literal"], x["text"]))


def _fuzzy(literal: Column, text: Column) -> Column:
    def day(source, pattern, y, m, d, month_name=False):
        part = [F.regexp_extract(source, pattern, g) for g in (y, m, d)]
        month = _month_no(part[1]) if month_name else part[1]
        date = _ymd(part[0], month, part[2])
        return source.rlike(pattern), _result(date, date, "day")

    us = day(literal, r"(\d{1,2})/(\d{1,2})/(\d{4})", 3, 1, 2)
    iso = day(literal, r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", 1, 2, 3)
    named = day(text, _MONTH_DAY_YEAR, 3, 1, 2, month_name=True)
    named_rev = day(text, _DAY_MONTH_YEAR, 3, 2, 1, month_name=True)

    ym_pattern = r"^((?:19|20)\d{2})-(\d{1,2})$"
    ym = [F.regexp_extract(literal, ym_pattern, g) for g in (1, 2)]
    is_ym = literal.rlike(ym_pattern) & ym[1].try_cast("int").between(1, 12)
    ym_lo, ym_hi = _span(ym[0], ym[1], ym[1])

    year = F.regexp_extract(text, r"(19|20)\d{2}", 0)

    q = F.regexp_extract(text, r"\bq([1-4])\b", 1).try_cast("int")
    q_lo, q_hi = _span(year, 3 * q - 2, 3 * q)

    half_text = F.regexp_extract(text, _HALF, 0)
    half = F.when(half_text.isin("h1", "1h", "first half"), 1).otherwise(2)
    h_lo, h_hi = _span(year, 6 * half - 5, 6 * half)

    def earliest(names):
        hits = F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(names)})\b"), F.lit(1))
        return F.array_min(F.transform(hits, _month_no))
    month = F.coalesce(earliest(fv.MONTH_ABBR), earliest(fv.MONTH_NAMES))
    m_lo, m_hi = _span(year, month, month)
    part = _part(text)
    p_lo = F.date_add(m_lo, 10 * part)
    p_hi = F.when(part == 2, m_hi).otherwise(F.date_add(m_lo, 10 * part + 9))

    yp_lo, yp_hi = _span(year, 4 * part + 1, 4 * part + 4)
    y_lo, y_hi = _span(year, 1, 12)

    nothing = F.struct(F.lit(None).cast("date").alias("lo"), F.lit(None).cast("date").alias("hi"),
                       F.lit("unknown").alias("precision"))
    return (F.when(literal == "", nothing)
            .when(*us).when(*iso)
            .when(is_ym, _result(ym_lo, ym_hi, "month"))
            .when(*named).when(*named_rev)
            .when(year == "", nothing)
            .when(q.isNotNull(), _result(q_lo, q_hi, "quarter"))
            .when(half_text != "", _result(h_lo, h_hi, "half"))
            .when(month.isNotNull() & part.isNotNull(), _result(p_lo, p_hi, "month_part"))
            .when(month.isNotNull(), _result(m_lo, m_hi, "month"))
            .when(part.isNotNull(), _result(yp_lo, yp_hi, "year_part"))
            .otherwise(_result(y_lo, y_hi, "year")))


def guided_period(phrase: Column) -> Column:
    """Range of a guided period: ordinal halves and quarters first, then any fuzzy date."""
    return let(F.lower(strip(squeeze(F.coalesce(phrase, F.lit(""))))), _guided)


def _guided(t: Column) -> Column:
    year = F.regexp_extract(t, r"(19|20)\d{2}", 0)
    ordinal = r"(first|second|third|fourth)\s+(half|quarter)"
    n = (F.when(F.regexp_extract(t, ordinal, 1) == "first", 1)
         .when(F.regexp_extract(t, ordinal, 1) == "second", 2)
         .when(F.regexp_extract(t, ordinal, 1) == "third", 3)
         .when(F.regexp_extract(t, ordinal, 1) == "fourth", 4))
    unit = F.regexp_extract(t, ordinal, 2)
    half = F.least(n, F.lit(2))
    h_lo, h_hi = _span(year, 6 * half - 5, 6 * half)
    q_lo, q_hi = _span(year, 3 * n - 2, 3 * n)
    fuzzy = fuzzy_date(t)
    part = (F.when(t.rlike(r"\bmid[-\s]"), 1).when(t.rlike(r"\bearly\b"), 0)
            .when(t.rlike(r"\blate\b"), 2))
    p_lo, p_hi = _span(year, 4 * part + 1, 4 * part + 4)

    def rng(lo, hi):
        return F.struct(lo.alias("lo"), hi.alias("hi"))
    none = F.lit(None).cast("date")
    return (F.when(year == "", rng(none, none))
            .when(unit == "half", rng(h_lo, h_hi))
            .when(unit == "quarter", rng(q_lo, q_hi))
            .when(fuzzy["lo"].isNotNull(), rng(fuzzy["lo"], fuzzy["hi"]))
            .otherwise(rng(p_lo, p_hi)))


def narrow(window_lo: Column, window_hi: Column, guide_lo: Column, guide_hi: Column) -> Column:
    """Intersect a window with guidance; guidance only ever narrows."""
    lo = F.greatest(window_lo, guide_lo)
    hi = F.when(guide_hi.isNotNull() & window_hi.isNotNull(),
                F.least(window_hi, guide_hi)).otherwise(window_hi)
    use = (guide_lo.isNotNull() & window_lo.isNotNull() & hi.isNotNull() & (lo <= hi))
    use = F.coalesce(use, F.lit(False))
    return F.struct(F.when(use, lo).otherwise(window_lo).alias("lo"),
                    F.when(use, hi).otherwise(window_hi).alias("hi"),
                    F.when(use, "guidance").otherwise("trial").alias("source"))


def publication_date(settlement: Column) -> Column:
    """Ten business days after settlement (Monday to Friday, no holidays)."""
    dow = F.weekday(settlement)
    return F.date_add(settlement, F.when(dow == 5, 13).when(dow == 6, 12).otherwise(14))


def day_key(value: Column) -> Column:
    """The date a date or time stamp is written with, NULL when the value as a whole is neither."""
    text = value.cast("string")
    return F.when(text.try_cast("timestamp").isNotNull(), F.substring(text, 1, 10).try_cast("date"))


def quarter_labels(start: Column, end: Column) -> Column:
    """`YYYYqN` labels from the quarter before `start` through the quarter of `end`."""
    first = F.add_months(F.trunc(start, "quarter"), -3)
    quarters = F.sequence(first, F.trunc(end, "quarter"), F.expr("interval 3 months"))
    return F.transform(quarters, lambda d: F.concat(F.year(d), F.lit("q"), F.quarter(d)))
