"""Financial facts: point-in-time state per filing date, and the current view.

A fact row is (ticker, tag, unit, start_date, end_date, filed, val, form, pos).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.text import nearest
from eventide.operators.asof import Feature, in_order, with_features

# A kind is (tags in order of preference, unit).
KINDS = {"cash": (fv.CASH_TAGS, "USD"), "investments": (fv.INVESTMENT_TAGS, "USD"),
         "burn": (fv.BURN_TAGS, "USD"), "shares": (fv.SHARE_TAGS, "shares")}


def periodic_filing_dates(filings: DataFrame, start=None, end=None) -> DataFrame:
    """Distinct (ticker, event_date) of periodic reports in a window, anchor `filing`."""
    f = filings.where(F.col("form").isin(*fv.PERIODIC_FORMS) & F.col("filed").isNotNull())
    if start is not None:
        f = f.where(F.col("filed") >= F.lit(start).cast("date"))
    if end is not None:
        f = f.where(F.col("filed") <= F.lit(end).cast("date"))
    return (f.select("ticker", F.col("filed").alias("event_date")).distinct()
            .withColumn("anchor", F.lit("filing")))


def is_quarter_span() -> Column:
    return F.datediff("end_date", "start_date").between(60, 100)


def _is(kind: str, kinds: dict) -> Column:
    tags, unit = kinds[kind]
    return F.col("tag").isin(*tags) & (F.col("unit") == unit)


def _tag_order(kinds: dict) -> Column:
    """Place of the fact's tag in its kind; of two facts alike else, the earlier tag wins."""
    order = [x for tags, _ in kinds.values() for i, t in enumerate(tags)
             for x in (F.lit(t), F.lit(i))]
    return F.element_at(F.create_map(*order), F.col("tag"))


def _daily_facts(facts: DataFrame, kinds: dict) -> DataFrame:
    """Per ticker and filing day: the latest-period fact of each kind and the four latest burns.

    Both reductions combine before the shuffle (aggregation and window group limit), so a
    ticker-day with very many facts stays small. A row holds one kind.
    """
    known = facts.where(F.col("filed").isNotNull() & F.col("val").isNotNull() & reduce(
        or_, (_is(k, kinds) for k in kinds)))
    rank = F.struct(-_tag_order(kinds), -F.col("pos"))
    kind = F.coalesce(*[F.when(_is(k, kinds), F.lit(k)) for k in ("cash", "investments", "shares")])
    top = (known.withColumn("kind", kind).where("kind is not null")
           .groupBy("ticker", "filed", "kind")
           .agg(F.max(F.struct("end_date", rank.alias("rank"), "val")).alias("top")))
    balances = top.select("ticker", "filed", *[F.when(F.col("kind") == k, F.struct(
        F.col("top.end_date").alias("end"), F.col("filed"), F.col("top.rank").alias("rank"),
        F.col("top.val").alias("val"))).alias(k) for k in ("cash", "investments", "shares")])
    order = (W.partitionBy("ticker", "filed")
             .orderBy(F.col("end_date").desc(), rank.desc(), F.col("val").desc()))
    burns = (known.where(_is("burn", kinds) & is_quarter_span())
             .withColumn("k", F.row_number().over(order)).where("k <= 4")
             .select("ticker", "filed", F.struct(
                 F.col("end_date").alias("end"), rank.alias("rank"),
                 F.col("val")).alias("burn")))
    return balances.unionByName(burns, allowMissingColumns=True)


def _running_top(frame: DataFrame, col: str, n: int, key: str) -> DataFrame:
    """Columns top1..topN: the n greatest values of `col` seen so far.

    A chain of running maxima. Each level passes on what it does not keep: the smaller of the
    arriving value and the maximum before it. Every level reuses the same sort.
    """
    upto = in_order(key)
    order = W.partitionBy(key).orderBy("day", "kind")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    frame = frame.withColumn("_arriving", F.col(col))
    for k in range(1, n + 1):
        frame = (frame.withColumn("_before", F.max("_arriving").over(before))
                 .withColumn(f"top{k}", F.max("_arriving").over(upto))
                 .withColumn("_arriving", F.when(
                     F.col("_arriving").isNotNull() & F.col("_before").isNotNull(),
                     F.least("_arriving", "_before"))))
    return frame.drop("_arriving", "_before")


def _burn_rate(tops: list[Column]) -> Column:
    """Average of the quarterly values, as a positive consumption; zero when cash came in."""
    n = sum((t.isNotNull().cast("int") for t in tops), F.lit(0))
    total = sum((F.coalesce(t["val"], F.lit(0.0)) for t in tops), F.lit(0.0))
    avg = F.when(n > 0, total / n)
    return F.when(avg < 0, -avg).when(avg.isNotNull(), 0.0)


def financials_feature(facts: DataFrame, kinds: dict = KINDS) -> Feature:
    """Cash, burn, runway and shares exactly as filed by each day.

    Among facts filed by then the greatest (period end, filing date) wins, so a restatement
    counts only from its own filing on. NULLs where no cash fact was visible.
    """
    def newest(kind):
        return F.max(kind).over(in_order("ticker"))

    def state(stream):
        stream = stream.withColumns({k: newest(k) for k in ("cash", "investments", "shares")})
        stream = _running_top(stream, "burn", 4, "ticker")
        total = F.col("cash.val") + F.coalesce(F.col("investments.val"), F.lit(0.0))
        burn = F.when(F.col("cash").isNotNull(),
                      _burn_rate([F.col(f"top{k}") for k in range(1, 5)]))
        shares = F.when(F.col("cash").isNotNull() & (F.col("shares.val") != 0), F.col("shares.val"))
        return stream.withColumns({
            "cash_usd": total, "cash_period_end": F.col("cash.end"),
            "cash_filed": F.col("cash.filed"), "quarterly_burn_usd": burn,
            "runway_months": F.when(burn > 0, nearest(total / (burn / 3.0), 2)),
            "shares_outstanding": shares})
    return Feature(_daily_facts(facts, kinds).withColumnRenamed("filed", "day"), state, (
        "cash_usd", "cash_period_end", "cash_filed", "quarterly_burn_usd", "runway_months",
        "shares_outstanding"))


def financials_asof(probes: DataFrame, facts: DataFrame, probe_day: str = "asof",
                    kinds: dict = KINDS) -> DataFrame:
    """Probe rows with the financials filed by their day."""
    return with_features(probes, [financials_feature(facts, kinds)], "ticker", probe_day)


def freshest_tag(facts: DataFrame, kinds: dict = KINDS) -> DataFrame:
    """Keep, per ticker and kind, the rows of the tag with the newest period in the kind's unit;
    never merge tags or units.

    The first tag of a kind wins a tie. The choice is one small row per ticker and kind.
    """
    kind = F.coalesce(*[F.when(_is(k, kinds), k) for k in kinds])
    tagged = facts.withColumn("kind", kind).where("kind is not null")
    dated = tagged.where("end_date is not null and val is not null")
    per_tag = dated.groupBy("ticker", "kind", "tag").agg(F.max("end_date").alias("newest"))
    chosen = per_tag.groupBy("ticker", "kind").agg(F.max_by(
        "tag", F.struct("newest", -_tag_order(kinds))).alias("tag"))
    return dated.join(chosen, ["ticker", "kind", "tag"])


def current_financials(facts: DataFrame, kinds: dict = KINDS, today=None) -> DataFrame:
    """Latest cash, burn, runway and share count per ticker from the freshest tag of each kind.

    With a run date, facts filed later, or without a filing date, are not seen: neither the values nor
    the choice of tags knows them. Missing cash counts as zero here. Runway needs a positive burn and
    cash.
    """
    if today is not None:
        facts = facts.where(F.col("filed") <= F.lit(today).cast("date"))
    fresh = freshest_tag(facts, kinds)

    def latest(kind):
        return F.max_by(F.struct("val", "end_date"), F.when(
            F.col("kind") == kind, F.struct("end_date", -F.col("pos"), "val"))).alias(kind)
    balances = fresh.groupBy("ticker").agg(latest("cash"), latest("investments"),
                                           latest("shares"))
    order = (W.partitionBy("ticker")
             .orderBy(F.col("end_date").desc(), F.col("pos"), F.col("val").desc()))
    burn = (fresh.where((F.col("kind") == "burn") & is_quarter_span())
            .withColumn("k", F.row_number().over(order)).where("k <= 4")
            .groupBy("ticker").agg(*[F.max(F.when(F.col("k") == k, F.struct("val")))
                                     .alias(f"top{k}") for k in range(1, 5)])
            .select("ticker", _burn_rate([F.col(f"top{k}") for k in range(1, 5)]).alias("burn")))
    total = (F.coalesce(F.col("cash.val"), F.lit(0.0))
             + F.coalesce(F.col("investments.val"), F.lit(0.0)))
    return (balances.join(burn, "ticker", "left").select(
        "ticker", F.when(total != 0, total).alias("cash_usd"),
        F.col("cash.end_date").alias("cash_asof"),
        F.col("burn").alias("quarterly_burn_usd"),
        F.when((F.col("burn") > 0) & (total != 0),
               nearest(total / (F.col("burn") / 3.0), 1)).alias("runway_months"),
        F.when(F.col("shares.val") != 0, F.col("shares.val")).alias("shares_outstanding")))
