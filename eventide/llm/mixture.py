"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has emitted up to its end
in a shuffled order, divided by the target of the source. All copies are then ordered by that time
and the order is cut at the total budget, in words. A source whose target exceeds its size goes
round again in a new shuffle, at most `max_repeats` times.

The copy at which a source reaches its target is taken in part: its finish time is the time of the
target, and only its first words count. So each source takes its target, to a word.

Running sums are kept in two levels: (source, round) is cut into hash ranges of about `group_rows`
copies, sums of ranges are added up, and a window runs inside a range; the global order is cut into
slices of virtual time in the same way. A source of a third of all rows is spread over many groups.

Defined cases: a null text has 0 words; null is a source of its own, last in order; rows that share
an id are one document (sizes added, least source); documents of 0 words have an offset and take
nothing; an empty table gives no rows; a source without words has target 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.storage import stash

WORD = r"[^\x20\x09-\x0D]+"
GROUP_ROWS = 10_000
_KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... along the ranks of the sources."""
    return (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")


def targets(sized: DataFrame, weight=cyclic_weight, budget_share: float = 1.0,
            max_repeats: float = 3.0) -> DataFrame:
    """One row per source: __source, __rank, n_docs, source_size, weight, target.

    Sources are ranked by code point, null last. They share `budget_share` of all words by weight;
    none gets more than `max_repeats` times its size, and what is over goes to the others by weight.
    In the order of cap / weight the capped sources come first, so one pass finds them all.
    """
    by_source = sized.groupBy("__source").agg(F.count(F.lit(1)).alias("n_docs"),
                                              F.sum("__size").alias("source_size"))
    # One row per source from here on.
    ranked = by_source.withColumn(
        "__rank", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
    ranked = (ranked.withColumn("weight", weight(F.col("__rank")))
              .withColumn("__cap", F.col("source_size") * F.lit(float(max_repeats))))
    up = Window.orderBy(F.col("__cap") / F.col("weight"), "__rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(budget_share))
    level = (total - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = ranked.withColumn("__capped", F.col("__cap") < level * F.col("weight"))
    found = found.withColumn("__total", total)
    free = found.withColumn(
        "__level", F.try_divide(
            F.col("__total") - F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0.0)).over(every),
            F.sum(F.when(~F.col("__capped"), F.col("weight")).otherwise(0.0)).over(every)))
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(
        F.least(F.col("__cap"), F.col("weight") * F.col("__level")))
    return free.withColumn("target", F.coalesce(target, F.lit(0.0))).select(
        "__source", "__rank", "n_docs", "source_size", "weight", "target")


def _running(rows: DataFrame, groups: list[str], order: list[str], value: str, within: list[str],
             out: str) -> DataFrame:
    """Sum of `value` over all earlier rows: of the same `within`, by range and then inside it."""
    sums = rows.groupBy(*groups).agg(F.sum(value).alias("__of_range"))
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    ahead = w.orderBy(*[g for g in groups if g not in within]).rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__of_range").over(ahead), F.lit(0))).drop(
        "__of_range")
    inside = (Window.partitionBy(*groups).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.join(sums, groups)
            .withColumn(out, F.col("__ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("__ahead"))


def shuffle_key(round_no: Column, doc: Column, seed: str) -> Column:
    """A fixed 60-bit number for a document in a round."""
    text = F.concat_ws("|", F.lit(seed), round_no.cast("string"),
                       F.coalesce(doc.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _KEY_BITS // 4), 16, 10).cast("long")


def sized_documents(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """__id, __source, __size: one row per document id."""
    return (docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
                        word_count(F.col(text_col)).alias("__size"))
            .groupBy("__id").agg(F.min("__source").alias("__source"), F.sum("__size").alias("__size")))


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
             text_col: str = "text", weight=cyclic_weight, budget_share: float = 1.0,
             max_repeats: int = 3, seed: str = "mix", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every copy the mix takes, and every document at least once.

    Columns: __id, __source, __size, source_size, target, round, finish (virtual time, 1 at the
    target), offset (words of the mix before it), taken (its words in the mix). Ordering by offset
    gives the mix.
    """
    sized = stash(sized_documents(docs, id_col, source_col, text_col))
    sources = stash(targets(sized, weight, budget_share, max_repeats))
    rows = sized.join(sources, sized["__source"].eqNullSafe(sources["__source"])).drop(
        sources["__source"])
    rounds = F.greatest(F.lit(1), F.least(F.lit(max_repeats), F.ceil(F.try_divide(
        F.col("target"), F.col("source_size"))))).cast("int")
    copies = rows.withColumn("round", F.explode(
        F.sequence(F.lit(0), F.coalesce(rounds, F.lit(1)) - 1)))
    copies = copies.withColumn("__key", shuffle_key(F.col("round"), F.col("__id"), seed))
    ranges = F.ceil(F.col("n_docs") / F.lit(group_rows))
    copies = copies.withColumn("__range", F.floor(
        F.col("__key") / F.lit(float(1 << _KEY_BITS)) * ranges).cast("long"))
    copies = _running(copies, ["__rank", "round", "__range"], ["__key", "__id"], "__size",
                      ["__rank", "round"], "__before")
    start = F.col("__before") + F.col("round") * F.col("source_size")
    limit = F.floor("target")
    copies = (copies.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("__size"), limit - start)))
              .withColumn("finish", F.coalesce(F.try_divide(
                  F.least(start + F.col("__size"), limit).cast("double"), limit), F.lit(1.0))))
    copies = copies.where("taken > 0 or round = 0")
    # Words come evenly along virtual time, so slices of equal length hold about as many copies.
    budget, n = sources.agg(F.sum(F.floor("target")).alias("b"), F.sum("n_docs").alias("n")).first()
    slices = max(1, -(-(n or 0) // group_rows))
    copies = copies.withColumn("__slice", F.least(
        F.floor(F.col("finish") * slices), F.lit(slices - 1)).cast("long"))
    copies = _running(copies, ["__slice"], ["finish", "__rank", "round", "__key", "__id"], "taken",
                      [], "offset")
    return copies.withColumn("taken", F.greatest(F.lit(0), F.least(
        F.col("taken"), F.lit(budget or 0) - F.col("offset")))).select(
            "__id", "__source", "__size", "source_size", "target", "round", "finish", "offset",
            "taken")


def taken_words(docs: DataFrame) -> DataFrame:
    """Per document: its words, those of its source, the target of the source, words taken."""
    return (schedule(docs).groupBy("__id").agg(
        F.first("__size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("taken").alias("taken"))
        .withColumnRenamed("__id", "doc_id"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
          text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: each as often as it is taken, with its columns unchanged, except that
    the copy at which its source reaches the target holds only the words taken. With several rows
    for an id, all of them come in every whole copy and none in the part copy."""
    plan = (schedule(docs, id_col, source_col, text_col, **options).where("taken > 0")
            .select("__id", F.col("__size").alias("__words"), F.col("taken").alias("__taken")))
    names = docs.columns
    cut = F.udf(words_up_to, T.StringType(), useArrow=True)
    out = (docs.withColumn("__own", F.col(id_col)).join(plan, F.expr("__own <=> __id"))
           .withColumn("__whole", F.col("__taken") == F.col("__words")))
    out = out.where(F.col("__whole") | (word_count(F.col(text_col)) == F.col("__words")))
    return out.select(*[
        F.when(F.col("__whole"), F.col(c)).otherwise(cut(F.col(c), F.col("__taken"))).alias(c)
        if c == text_col else F.col(f"`{c}`") for c in names])


def words_up_to(text, n):
    """The text up to the end of its n-th word; words as in WORD."""
    for k, m in enumerate(re.finditer(WORD, text or ""), 1):
        if k == n:
            return text[:m.end()]
    return text
