"""Approval priors, typical moves and trial-design expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.text import clean_number, clean_text, nearest, therapeutic_area


def lookup(key: Column, table: dict, default) -> Column:
    """A constant table as a map literal, with a default for unknown keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def _stage_key(stage: Column) -> Column:
    return F.replace(F.lower(clean_text(stage)), F.lit(" "), F.lit(""))


def base_rate(stage: Column) -> Column:
    return lookup(_stage_key(stage), fv.LOA_BY_PHASE, fv.LOA_DEFAULT)


def _damp(multiplier: Column, base: Column) -> Column:
    """Shrink a multiplier toward one as the base rate rises."""
    return 1.0 + (multiplier - 1.0) * (1.0 - base)


def approval_prior(stage: Column, indication: Column, designations: Column | None = None,
                   area: Column | None = None) -> Column:
    base = base_rate(stage)
    area = therapeutic_area(indication) if area is None else area
    mult = lookup(area, fv.TA_MULTIPLIER, 1.0)
    if designations is not None:
        tags = F.upper(clean_text(designations))
        for tag, bonus in fv.DESIGNATION_BONUS.items():
            mult = mult * F.when(tags.contains(tag), bonus).otherwise(1.0)
    return F.greatest(F.lit(0.01), F.least(F.lit(0.98), base * _damp(mult, base)))


def typical_move(stage: Column, market_cap: Column) -> Column:
    """Dollars at stake over market cap, capped by stage; the cap alone when size is unknown."""
    key = _stage_key(stage)
    ceiling = lookup(key, fv.MOVE_CEILING, fv.MOVE_CEILING_DEFAULT)
    at_risk = lookup(key, fv.DOLLARS_AT_RISK, fv.DOLLARS_AT_RISK_DEFAULT)
    sized = F.greatest(F.lit(0.01), F.least(ceiling, at_risk / market_cap))
    return F.when(F.coalesce(market_cap, F.lit(0.0)) <= 0, ceiling).otherwise(sized)


def design_bucket(allocation: Column, masking: Column) -> Column:
    alloc, mask = F.upper(clean_text(allocation)), F.upper(clean_text(masking))
    blinded = ~mask.isin("", "NONE", "NA", "OPEN")
    return (F.when((alloc == "RANDOMIZED") & blinded, "randomized_blinded")
            .when(alloc == "RANDOMIZED", "randomized_open")
            .when(alloc.isin("", "NA"), "unknown")
            .when(blinded, "single_arm_blinded")
            .otherwise("single_arm_open"))


def design_multiplier(bucket: Column, enrollment: Column, stage: Column) -> Column:
    n = clean_number(enrollment)
    size = F.when(n < fv.SMALL_ENROLLMENT, 0.85).when(n >= 300, 1.05).otherwise(1.0)
    mult = lookup(bucket, fv.DESIGN_MULTIPLIER, 1.0) * size
    return nearest(_damp(mult, base_rate(stage)), 3)


def design_note(bucket: Column, enrollment: Column) -> Column:
    n = clean_number(enrollment)
    whole = n.cast("bigint").cast("string")
    parts = F.filter(F.array(
        F.when(bucket != "unknown", F.replace(bucket, F.lit("_"), F.lit(" "))),
        F.when(n < fv.SMALL_ENROLLMENT, F.concat(F.lit("n="), whole, F.lit(", underpowered")))
        .when(n >= 300, F.concat(F.lit("n="), whole))), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))
