"""As-of joins.

All of these share one shape that stays safe under skew. Facts are first reduced to one row per
key and day with partial aggregation, and probes to their distinct key-days, so a key never
brings more rows to one window task than there are days in the calendar, however many rows it
holds. What is known on a day is a `Feature`: its daily facts and the running states over them.
`with_features` puts the facts of a feature and the probe days on one timeline per key, shuffles it
once, and takes all states in passes over that one partition; the probes, by far fewer than the facts,
then ride on the timeline of the next feature, so no pass of one feature goes over the facts of another.
An equi-join on (key, day), which adaptive execution can split, carries the states back to all probe
rows; probes that are few per key and day ride themselves and need no way back. What a trailing window
holds is told by steps, on the days on which facts enter and leave it, and never by walking its frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    """Facts by day and what they amount to.

    `daily` has the key, `day` and value columns (null in the probe rows); `state` adds the `columns` to
    a stream that holds both, by windows over the key. `otherwise` stands in for columns of
    probes without a key or day.
    """

    daily: DataFrame
    state: Callable[[DataFrame], DataFrame]
    columns: tuple[str, ...]
    otherwise: dict | None = None


def with_features(probes: DataFrame, features: list[Feature], key: str, probe_day: str,
                  carry: bool = False) -> DataFrame:
    """Probe rows with the columns of all features as of their day.

    With `carry` the rows themselves are on the timelines. They must then be few per key and day (such
    as one per event date), with key and day never null.
    """
    if carry:
        return reduce(lambda rows, f: _with_feature(rows, f, key, probe_day), features, probes)
    asked = (probes.select(key, probe_day)
             .where(F.col(key).isNotNull() & F.col(probe_day).isNotNull()).distinct())
    state = reduce(lambda rows, f: _with_feature(rows, f, key, probe_day), features, asked)
    out = probes.join(state, [key, probe_day], "left")
    fill = {c: v for f in features for c, v in (f.otherwise or {}).items()}
    return out.fillna(fill) if fill else out


def _with_feature(rows: DataFrame, f: Feature, key: str, probe_day: str) -> DataFrame:
    """Rows that ride on the timeline of one feature, with its columns."""
    asked = rows.select(F.col(key), F.col(probe_day).alias("day"), F.lit(1).alias("kind"),
                        F.struct(*[F.col(c) for c in rows.columns]).alias("_event"))
    facts = (f.daily.where(F.col(key).isNotNull() & F.col("day").isNotNull())
             .withColumn("kind", F.lit(0)))
    state = f.state(asked.unionByName(facts, allowMissingColumns=True)).where("kind = 1")
    return state.select("_event.*", *f.columns)


def day_number(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def in_order(key: str, strict: bool = False) -> W:
    """Running frame; inclusive puts a day's facts before its probe, strict after it."""
    kind = F.col("kind").desc() if strict else F.col("kind").asc()
    return (W.partitionBy(key).orderBy(F.col("day"), kind)
            .rowsBetween(W.unboundedPreceding, W.currentRow))


def latest_feature(facts: DataFrame, key: str, fact_day: str, values: list[str],
                   strict: bool = False, tie: Column | None = None, name: str = "_latest") -> Feature:
    """Values of the latest fact on or before (strictly before when `strict`) each day.

    `tie` picks among facts of one key and day: the greatest value wins.
    """
    packed = F.struct(*[F.col(v) for v in values])
    rank = tie if tie is not None else packed
    daily = facts.groupBy(key, F.col(fact_day).alias("day")).agg(F.max_by(packed, rank).alias(name))

    def state(stream):
        known = F.last(name, ignorenulls=True).over(in_order(key, strict))
        return stream.withColumn(name, known).withColumns({v: F.col(f"{name}.{v}") for v in values})
    return Feature(daily, state, tuple(values))


def asof_join(probes: DataFrame, facts: DataFrame, key: str, probe_day: str, fact_day: str,
              values: list[str], strict: bool = False,
              tie: Column | None = None) -> DataFrame:
    """Latest fact on or before (strictly before when `strict`) each probe day."""
    return with_features(probes, [latest_feature(facts, key, fact_day, values, strict, tie)],
                         key, probe_day)


def with_leaving(daily: DataFrame, keys: list[str], counts: dict[str, tuple[str, int]]) -> DataFrame:
    """Daily facts, and the days on which their counts leave trailing windows.

    `counts` names, per new column, an integer column and the days of its window: the new column rises by
    the value on its day and falls by it when the window has passed, so its running sum is the total of
    (day-window, day] and no frame is walked. A leaving day holds nothing but the fall.
    """
    own = [F.col(c).alias(c) for c in daily.columns]
    rise = [F.col(c).alias(n) for n, (c, _) in counts.items()]

    def leaving(name):
        c, window = counts[name]
        kept = [F.date_add("day", window).alias("day") if x == "day" else F.col(x).alias(x) if x in keys
                else F.lit(None).cast(daily.schema[x].dataType).alias(x) for x in daily.columns]
        fall = [(-F.col(c) if n == name else F.lit(None)).cast(daily.schema[k].dataType).alias(n)
                for n, (k, _) in counts.items()]
        return F.struct(*kept, *fall)
    return daily.select(F.inline(F.array(F.struct(*own, *rise), *[leaving(n) for n in counts])))


def running(column: str, key: str) -> Column:
    """Sum of an integer column up to each day, 0 before any."""
    return F.coalesce(F.sum(column).over(in_order(key)), F.lit(0))


def with_trailing(daily: DataFrame, key: str, columns: list[str], window: int) -> DataFrame:
    """Daily facts with the steps from which `trailing_sums` takes the sums of (day-window, day].

    Doubles are only ever added, so nothing is left over of what has passed. Days are cut into blocks as
    long as the window: the sum of a day is that of its block up to it, `_head`, and that of the end of
    the block before which the window still holds, `_tail`. `daily` has one row per key and day; rows where
    the first of `columns` is null are no facts of these sums.
    """
    block = F.floor(day_number(F.col("day")) / window)
    by = W.partitionBy(key, "_block")
    back = by.orderBy(F.col("day").desc())
    fact = F.col(columns[0]).isNotNull()
    opens = day_number(F.col("day")) == F.col("_block") * window

    def sums(frame):
        return F.struct(*[F.coalesce(F.sum(c).over(frame), F.lit(0.0)).alias(c) for c in columns])
    rows = daily.withColumn("_block", block).withColumns({
        "_after": sums(back.rowsBetween(W.unboundedPreceding, -1)),
        "_whole": sums(back.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "_upto": sums(by.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)),
        "_first": F.row_number().over(by.orderBy("day")) == 1})
    kept = [c for c in daily.columns if c not in (key, "day", *columns)]
    step = f"struct<block: bigint, sums: {rows.schema['_upto'].dataType.simpleString()}>"

    def at(block, value):
        return F.struct(block.alias("block"), F.col(value).alias("sums")).cast(step)

    def row(day, head, tail, own):
        return F.struct(F.col(key).alias(key), day.alias("day"), *[
            (F.col(c) if own else F.lit(None).cast(daily.schema[c].dataType)).alias(c) for c in kept],
            head.cast(step).alias("_head"), tail.cast(step).alias("_tail"))
    none, later = F.lit(None).cast(step), F.col("_block") + 1
    starts = F.date_add(F.lit("1970-01-01").cast("date"), (later * window).cast("int"))
    steps = F.array(
        row(F.col("day"), F.when(fact, at(F.col("_block"), "_upto")), none, True),
        F.when(fact, row(F.date_add("day", window), none, at(later, "_after"), False)),
        F.when(F.col("_first") & ~(fact & opens), row(starts, none, at(later, "_whole"), False)))
    return rows.select(F.inline(steps)).where("day is not null")


def trailing_sums(stream: DataFrame, key: str, columns: list[str], window: int) -> DataFrame:
    """The stream with the sums of (day-window, day] in `columns`, 0 where there is nothing."""
    block = F.floor(day_number(F.col("day")) / window)

    def part(side, c):
        return F.when(F.col(f"{side}.block") == block, F.col(f"{side}.sums.{c}")).otherwise(F.lit(0.0))
    known = stream.withColumns({s: F.last(s, ignorenulls=True).over(in_order(key))
                                for s in ("_head", "_tail")})
    return known.withColumns({c: part("_tail", c) + part("_head", c) for c in columns})


def product_feature(factors: DataFrame, key: str, factor_day: str, factor: str,
                    out: str) -> Feature:
    """Product of all factors dated strictly after each day, 1 when there are none."""
    daily = (factors.groupBy(key, F.col(factor_day).alias("day"))
             .agg(F.product(factor).alias("_factor")))
    later = (W.partitionBy(key).orderBy(F.col("day").desc(), F.col("kind").desc())
             .rowsBetween(W.unboundedPreceding, W.currentRow))

    def state(stream):
        return stream.withColumn(out, F.coalesce(F.product("_factor").over(later), F.lit(1.0)))
    return Feature(daily, state, (out,), {out: 1.0})


def range_product(probes: DataFrame, factors: DataFrame, key: str, probe_day: str,
                  factor_day: str, factor: str, out: str) -> DataFrame:
    """Product of all factors dated strictly after each probe day, 1 when there are none."""
    return with_features(probes, [product_feature(factors, key, factor_day, factor, out)],
                         key, probe_day)
