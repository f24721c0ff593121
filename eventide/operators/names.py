"""Sponsor name to ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.text import company_key


def name_index(registry: DataFrame) -> DataFrame:
    """(name, ticker, pos): normalised registry names, first listing wins."""
    return (registry.select(company_key(F.col("title")).alias("name"), "ticker", "pos")
            .where("name != ''").groupBy("name")
            .agg(F.upper(F.min_by("ticker", "pos")).alias("ticker"), F.min("pos").alias("pos")))


def proper_prefixes(name: Column) -> Column:
    """Whole-token prefixes of a name, shorter than the name itself."""
    tokens = F.split(name, " ")
    return F.when(F.size(tokens) > 1, F.transform(
        F.sequence(F.lit(1), F.size(tokens) - 1),
        lambda n: F.array_join(F.slice(tokens, 1, n), " "))).otherwise(F.array())


def match_sponsors(sponsors: DataFrame, registry: DataFrame, column: str = "lead_sponsor",
                   out: str = "ticker") -> DataFrame:
    """Attach a ticker to every sponsor row: the exact name, else the longest registry name that
    is a whole-token prefix of the sponsor or of which the sponsor is a whole-token prefix.

    Both prefix cases are equi-joins on expanded prefixes. The registry side keeps only the best
    name per prefix, so a common first word never multiplies rows.
    """
    index = name_index(registry)
    asked = (sponsors.select(F.col(column).alias("_raw")).where("_raw is not null").distinct()
             .withColumn("key", company_key(F.col("_raw"))).where("key != ''"))
    keys = asked.select("key").distinct()
    best = F.struct(F.length("name").alias("len"), (-F.col("pos")).alias("rank"), "ticker")

    exact = keys.join(index.withColumnRenamed("name", "key"), "key").select(
        "key", F.struct(F.lit(2147483647).alias("len"), F.lit(0).cast("bigint").alias("rank"),
                        F.col("ticker")).alias("hit"))
    shorter = (keys.select("key", F.explode(proper_prefixes(F.col("key"))).alias("name"))
               .join(index, "name")
               .select("key", F.struct(F.length("name").alias("len"),
                                       (-F.col("pos")).cast("bigint").alias("rank"),
                                       F.col("ticker")).alias("hit")))
    by_prefix = (index.select("name", "ticker", "pos",
                              F.explode(proper_prefixes(F.col("name"))).alias("key"))
                 .groupBy("key").agg(F.max(best).alias("hit")))
    longer = keys.join(by_prefix, "key").select(
        "key", F.struct(F.col("hit.len").alias("len"), F.col("hit.rank").cast("bigint")
                        .alias("rank"), F.col("hit.ticker").alias("ticker")).alias("hit"))
    chosen = (exact.unionByName(shorter).unionByName(longer)
              .groupBy("key").agg(F.max("hit").alias("hit")).select("key", F.col("hit.ticker").alias(out)))
    resolved = asked.join(chosen, "key").select(F.col("_raw").alias(column), out)
    return sponsors.join(resolved, column, "left")
