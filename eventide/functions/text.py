"""Text and number normalisers, name/stage/role expressions, and filing-text extraction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventide import fixed_values as fv


def _any_of(words) -> str:
    return "|".join(re.escape(w) for w in words)


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it many times in `body`.

    Inside conditionals a repeated expression is otherwise evaluated at each mention.
    """
    return F.transform(F.array(value), lambda x: body(x))[0]


def nearest(x: Column, digits: int = 0) -> Column:
    """Round to `digits` decimals, halves to even, judged on the exact binary value.

    x * 10^digits is taken as product plus rounding error: with x split into two halves of 26
    bits, both partial products are exact. The error decides what only looks like a tie.
    """
    scale = float(10 ** digits)

    def rounded(v):
        x, p, hi = v["x"], v["p"], v["hi"]
        err = (hi * scale - p) + (x - hi) * scale
        low = F.floor(p)
        frac = p - low
        up = ((frac > 0.5) | ((frac == 0.5) & (err > 0))
              | ((frac == 0.5) & (err == 0) & (low % 2 != 0)))
        return (low + up.cast("int")) / scale
    parts = let(x, lambda v: F.struct(v.alias("x"), (v * scale).alias("p"), (
        v * 134217729.0 - (v * 134217729.0 - v)).alias("hi")))
    return let(parts, rounded)


def strip(c: Column, chars: str = r"\s") -> Column:
    """Trim the given character class from both ends."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


# --- missing values ---------------------------------------------------------------------------

def clean_text(c: Column) -> Column:
    """Trimmed text; NULL and the printed forms of a missing value become the empty string."""
    t = strip(c)
    return F.when(c.isNull() | F.lower(t).isin("nan", "nat", "none", "<na>"), "").otherwise(t)


def clean_number(c: Column, default=None) -> Column:
    """A double; NULL, NaN and unparsable values become `default`."""
    d = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(d), d), F.lit(default).cast("double"))


def flag(c: Column) -> Column:
    """A boolean where missing means false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


# --- names, stages, roles ---------------------------------------------------------------------

def company_key(name: Column) -> Column:
    """Normalised company name: lower case, alphanumeric, corporate suffix words removed."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]", " ")
    s = F.regexp_replace(s, rf"\b(?:{_any_of(fv.COMPANY_SUFFIXES)})\b", " ")
    return F.trim(squeeze(s))


def simple_stage(raw: Column) -> Column:
    """Collapse a phase list into one prior bucket; combined phases take the earlier one."""
    s = F.replace(F.lower(clean_text(raw)), F.lit(" "), F.lit(""))
    has = {n: s.contains(f"phase{n}") for n in "1234"}
    out = F.when(has["2"] & has["3"], "phase2/3").when(has["1"] & has["2"], "phase1/2")
    for n in "4321":
        out = out.when(has[n], f"phase{n}")
    return out.otherwise("other")


def owner_role(is_officer: Column, is_director: Column, is_ten_percent: Column,
               title: Column) -> Column:
    senior = F.coalesce(title, F.lit("")).rlike("(?i)" + fv.SENIOR_TITLE)
    return (F.when(flag(is_officer) & senior, "senior")
            .when(flag(is_officer), "officer")
            .when(flag(is_director), "director")
            .when(flag(is_ten_percent), "ten_percent")
            .otherwise("other"))


def ticker_in_name(display_name: Column) -> Column:
    """Ticker printed in a filer's display name, NULL when there is none."""
    t = F.regexp_extract(display_name, fv.TICKER_IN_NAME, 1)
    return F.when(t != "", t)


def stable_id(*parts: Column) -> Column:
    """60-bit content id: first 15 hex digits of SHA-1 over the parts, NULL printed as `None`."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


# --- therapeutic area -------------------------------------------------------------------------

def area_pattern(words) -> str:
    """Keywords anchored at a word start; those of four characters or fewer also at a word end."""
    return r"(?U)\b(?:" + "|".join(
        re.escape(w) + (r"\b" if len(w) <= 4 else "") for w in words) + ")"


def therapeutic_area(indication: Column) -> Column:
    def area(t):
        rare = F.lit(False)
        for m in fv.RARE_MARKERS:
            rare = rare | t.contains(m)
        for p in fv.RARE_PATTERNS:
            rare = rare | t.rlike(p)
        out = F.when(t == "", "other").when(rare, "rare")
        for name, words in fv.TA_KEYWORDS:
            out = out.when(t.rlike(area_pattern(words)), name)
        return out.otherwise("other")
    return let(F.lower(clean_text(indication)), area)


# --- headline relevance -----------------------------------------------------------------------

def company_tokens(ticker: Column, company: Column) -> Column:
    """Distinct words that identify a company in a headline: its ticker and distinctive names."""
    bare = F.regexp_replace(F.lower(F.coalesce(company, F.lit(""))), fv.HEADLINE_GENERIC, " ")
    words = F.regexp_extract_all(bare, F.lit(f"({fv.COMPANY_TOKEN})"), F.lit(1))
    keep = F.array_except(words, F.array(*[F.lit(w) for w in fv.HEADLINE_COMMON_WORDS]))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lower(ticker)), keep)))


def token_pattern(tokens: Column) -> Column:
    """One whole-word alternation per company, so a headline is scanned once."""
    quoted = F.transform(tokens, lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E")))
    return F.concat(F.lit(r"(?U)\b(?:"), F.array_join(quoted, "|"), F.lit(r")\b"))


def names_company(title: Column, tokens: Column) -> Column:
    return F.rlike(F.lower(clean_text(title)), token_pattern(tokens))


def headline_key(title: Column, length: int | None = None) -> Column:
    """Duplicate key of a headline: its word characters, lower case, or the first of them."""
    key = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\W+", "")
    return key if length is None else F.substring(key, 1, length)


# --- filing text ------------------------------------------------------------------------------

@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    import html
    return s.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def html_text(raw: Column) -> Column:
    """Readable text of an HTML document: no script/style blocks, no tags, entities decoded."""
    t = F.regexp_replace(raw, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    # Only texts with an entity cross to Python.
    return squeeze(F.coalesce(_unescape(F.when(t.contains("&"), t)), t))


def first_match(text: Column, pattern: str, group: int) -> Column:
    m = F.regexp_extract(text, pattern, group)
    return F.when(m != "", m)


def _edge(c: Column, chars: str) -> Column:
    return strip(c, re.escape(chars))


def tidy_indication(c: Column) -> Column:
    """Reduce a captured phrase to a disease name, NULL when nothing usable is left."""
    def before(text, pattern):
        return F.element_at(F.split(text, pattern, 2), 1)

    s = _edge(c, fv.INDICATION_EDGE)
    s = F.regexp_replace(s, "(?i)" + fv.INDICATION_LEAD, "")
    s = before(s, fv.INDICATION_CLAUSE)
    s = before(s, fv.INDICATION_COMMA_CLAUSE)
    s = F.regexp_replace(s, "(?i)" + fv.INDICATION_TRAILING_COHORT, "")
    s = _edge(before(s, fv.INDICATION_CUT), fv.INDICATION_EDGE)
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    s = let(F.struct(s.alias("text"), words.alias("words")), lambda x: F.when(
        F.size(x["words"]) > fv.INDICATION_WORDS,
        F.array_join(F.slice(x["words"], 1, fv.INDICATION_WORDS), " ")).otherwise(x["text"]))
    s = _edge(F.regexp_replace(_edge(s, " ,;-"), "(?i)" + fv.INDICATION_DANGLING, ""), " ,;-")
    return let(s, lambda x: F.when(
        (F.length(x) >= 4) & x.rlike("[A-Za-z]{4}")
        & ~x.rlike("(?i)" + fv.INDICATION_REJECT), x))


def _acceptable_drug(c: Column) -> Column:
    low = F.lower(c)
    return (~low.isin(*fv.DRUG_STOPWORDS)
            & ~F.element_at(F.split(low, r"\s+"), 1).isin(*fv.DRUG_STOPWORDS)
            & ~c.rlike("(?i)" + fv.NOT_A_DRUG))


def drug_near(text: Column, anchor: Column) -> Column:
    """First acceptable drug name around a zero-based anchor, patterns tried in order."""
    start = F.greatest(F.lit(0), anchor - fv.DRUG_BEFORE)
    window = F.substring(text, start + 1, anchor + fv.DRUG_AFTER - start)
    found = []
    for p in fv.DRUG_PATTERNS:
        hits = F.transform(F.regexp_extract_all(window, F.lit(p), F.lit(1)), lambda h: strip(h))
        found.append(F.try_element_at(F.filter(hits, _acceptable_drug), F.lit(1)))
    return F.coalesce(*found)


def all_matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<at, found>>: zero-based offset and a group of every match, in order.

    The text is searched once. `pattern` must not look at what is around its match (no lookaround, no
    word edge), so a match stands where its words first occur after the match before, and its groups
    follow from its words alone.
    """
    empty = F.array().cast("array<struct<at:int,found:string>>")

    def step(acc, whole):
        at = F.position(whole, text, acc["end"] + 1) - 1
        hit = F.struct(at.alias("at"), F.regexp_extract(whole, pattern, group).alias("found"))
        return F.struct((at + F.length(whole)).alias("end"),
                        F.array_append(acc["out"], hit).alias("out"))
    walked = F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                         F.struct(F.lit(0).alias("end"), empty.alias("out")), step)
    return walked["out"]


def indication_mentions(text: Column) -> Column:
    """Where a text may name an indication: what `indication_near` chooses from."""
    # Every mention begins with one of three letters; a look at the first spares the nine wordings.
    return all_matches(text, "(?i)(?=[afi])" + fv.INDICATION_PATTERN, 1)


def indication_near(mentions: Column, anchor: Column) -> Column:
    """The usable indication whose mention starts closest to the anchor."""
    tidy = F.transform(
        F.filter(mentions, lambda m: F.abs(m["at"] - anchor) <= fv.INDICATION_REACH),
        lambda m: F.struct(F.abs(m["at"] - anchor).alias("dist"), m["at"].alias("at"),
                           tidy_indication(m["found"]).alias("phrase")))
    return F.array_min(F.filter(tidy, lambda m: m["phrase"].isNotNull()))["phrase"]
