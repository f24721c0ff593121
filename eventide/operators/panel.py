"""Price panel: usable tickers, calendar positions, event returns and price statistics.

A panel is long: one row per ticker and trading day. A ticker has at most one row per day, so
windows partitioned by ticker are bounded by the calendar; the calendar itself, one row per
trading day, is small by construction and is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.storage import stash


def windowed_bars(bars: DataFrame, start, end, tickers: DataFrame | None,
                  benchmark: str) -> DataFrame:
    """Bars of the wanted tickers and the benchmark from ten days before start to 120 after end."""
    lo = F.date_sub(F.lit(start).cast("date"), fv.PANEL_LEAD_DAYS)
    hi = F.date_add(F.lit(end).cast("date"), fv.PANEL_TAIL_DAYS)
    b = bars.where(F.col("close").isNotNull() & (F.col("day") >= lo) & (F.col("day") < hi))
    if tickers is None:
        return b
    wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    return (b.where(F.col("ticker") != benchmark).join(wanted, "ticker", "left_semi")
            .unionByName(b.where(F.col("ticker") == benchmark)))


@dataclass(frozen=True)
class Panel:
    """Usable prices with trading-day positions.

    `rows` is (ticker, day, close, volume, pos), `calendar` is (day, pos) and `benchmark` is
    (pos, day, close) of the benchmark alone.
    """

    rows: DataFrame
    calendar: DataFrame
    benchmark: DataFrame


def price_panel(bars: DataFrame, start, end, tickers: DataFrame | None = None,
                benchmark: str = "BENCH") -> Panel:
    """Panel of tickers with enough closes, plus `pos`, the trading-day position.

    The position counts the distinct days of all usable tickers; a missing cell is an absent
    row and is never filled. The usable bars are written to shared storage once: rows, calendar and
    benchmark all come from there, so the bars and what they derive from are not read again.
    """
    usable = stash(windowed_bars(bars, start, end, tickers, benchmark)
                   .withColumn("n_closes", F.count("close").over(W.partitionBy("ticker")))
                   .where(F.col("n_closes") >= fv.MIN_CLOSES).drop("n_closes"))
    cal = usable.select("day").distinct().withColumn(
        "pos", F.row_number().over(W.orderBy("day")) - 1)
    rows = usable.join(F.broadcast(cal), "day")
    return Panel(rows, cal, rows.where(F.col("ticker") == benchmark).select("pos", "day", "close"))


def missing_tickers(bars: DataFrame, tickers: DataFrame, start, end,
                    benchmark: str = "BENCH") -> DataFrame:
    """Requested tickers without a usable history."""
    usable = (windowed_bars(bars, start, end, tickers, benchmark).groupBy("ticker").count()
              .where(F.col("count") >= fv.MIN_CLOSES))
    wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    return wanted.join(usable, "ticker", "left_anti")


def positions(days: DataFrame, cal: DataFrame, side: str) -> DataFrame:
    """Position of the first trading day on or after, or last on or before, each distinct day."""
    both = (days.select(F.col("day")).distinct().withColumn("pos", F.lit(None).cast("int"))
            .withColumn("asked", F.lit(True))
            .unionByName(cal.select("day", "pos").withColumn("asked", F.lit(False))))
    order = (W.orderBy(F.col("day").desc(), F.col("asked")) if side == "after"
             else W.orderBy(F.col("day"), F.col("asked")))
    frame = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (both.withColumn("pos", F.last("pos", ignorenulls=True).over(frame))
            .where("asked").select("day", "pos"))


def _at(offset: int, key: str | None = "ticker"):
    """Frame of exactly the row `offset` positions away; empty when that cell is missing."""
    base = W.partitionBy(key) if key else W
    return base.orderBy("pos").rangeBetween(offset, offset)


def with_exits(panel: Panel, exits: dict[str, int], realised: bool = False,
               keep: list[str] | None = None) -> DataFrame:
    """Per panel row: own and benchmark price now and at each exit offset.

    With `realised`, also the volatility of the up to 63 returns ending at the row and the
    20-session run-up, both only where 21 positions precede it. Every look forward or back is a
    frame over the same ticker ordering, so the panel is shuffled once.
    """
    p0 = F.col("close")
    cells = [F.max("close").over(_at(k)).alias(f"p_{name}") for name, k in exits.items()]
    if realised:
        cells += [F.log(p0 / F.max("close").over(_at(-1))).alias("r"),
                  (p0 / F.max("close").over(_at(-20)) - 1).alias("ret_20d")]
    p = panel.rows.select("ticker", "day", "pos", p0.alias("p0"), *cells, *(keep or []))
    if realised:
        trail = W.partitionBy("ticker").orderBy("pos").rangeBetween(-62, 0)
        enough = F.col("pos") >= 21
        p = (p.withColumn("rvol_60d", F.when(
                enough, F.stddev_samp("r").over(trail) * F.sqrt(F.lit(float(fv.TRADING_DAYS)))))
             .withColumn("ret_20d", F.when(enough, F.col("ret_20d"))).drop("r"))
    b = panel.benchmark.select("pos", p0.alias("b0"), *[
        F.max("close").over(_at(k, None)).alias(f"b_{name}") for name, k in exits.items()])
    return p.join(F.broadcast(b), "pos").where("p0 > 0 and b0 > 0")


def event_returns(events: DataFrame, panel: Panel, horizons=fv.READOUT_HORIZONS,
                  entry_offset: int = fv.READOUT_ENTRY_OFFSET) -> DataFrame:
    """Benchmark-adjusted returns of each event from entry to every horizon.

    Entry is `entry_offset` positions before the first trading day on or after the event and
    needs a positive price of ticker and benchmark on that very row. An exit lies `h` positions
    after the event day, so `entry_offset + h` after entry.
    """
    keep = [x for x in events.columns if x not in ("rvol_60d", "ret_20d", "entry_price")]
    exits = {f"{h}d": entry_offset + h for h in horizons}
    p0, b0 = F.col("p0"), F.col("b0")
    priced = with_exits(panel, exits, realised=True)
    at = positions(events.select(F.col("event_date").alias("day")), panel.calendar, "after")
    placed = (events.select(*keep).join(F.broadcast(at.withColumnRenamed("day", "event_date")),
                                        "event_date")
              .withColumn("pos", F.col("pos") - entry_offset))
    abn = {f"abn_{n}": F.when(F.col(f"b_{n}") > 0, (F.col(f"p_{n}") / p0 - 1)
                              - (F.col(f"b_{n}") / b0 - 1)) for n in exits}
    return (placed.join(priced, ["ticker", "pos"])
            .withColumns(abn)
            .select(*keep, F.col("day").alias("entry_date"), p0.alias("entry_price"),
                    "rvol_60d", "ret_20d", *abn))


def realised_moves(events: DataFrame, panel: Panel) -> DataFrame:
    """Moves of passed events from the last close before them: 1 and 5 sessions, and to date."""
    exits = {"1d": 1, "5d": 5}
    p0, b0 = F.col("p0"), F.col("b0")
    last = F.max_by(F.struct("pos", "day", "close"), "pos").over(W.partitionBy("ticker"))
    tail = Panel(panel.rows.withColumn("last", last), panel.calendar, panel.benchmark)
    b_last = F.broadcast(panel.benchmark.select(F.col("pos").alias("last_pos"),
                                                F.col("close").alias("b_last")))
    priced = (with_exits(tail, exits, keep=["last"]).withColumn("last_pos", F.col("last.pos"))
              .join(b_last, "last_pos", "left"))
    eve = events.withColumn("eve", F.date_sub("catalyst_date", 1))
    at = positions(eve.select(F.col("eve").alias("day")), panel.calendar, "before")
    placed = eve.join(F.broadcast(at.withColumnRenamed("day", "eve")), "eve")
    later = F.col("last_pos") > F.col("pos")

    def move(p):
        return F.col(p) / p0 - 1

    def bench(b):
        return F.col(b) / b0 - 1
    p_last = F.col("last.close")
    return (placed.join(priced, ["ticker", "pos"])
            .select("drug_id", "catalyst_date", "ticker", F.col("day").alias("entry_date"),
                    p0.alias("entry_price"),
                    F.when(later, p_last).alias("last_price"),
                    F.when(later, F.col("last.day")).alias("last_date"),
                    move("p_1d").alias("move_1d"), move("p_5d").alias("move_5d"),
                    F.when(later, p_last / p0 - 1).alias("move_todate"),
                    (move("p_1d") - bench("b_1d")).alias("abn_1d"),
                    (move("p_5d") - bench("b_5d")).alias("abn_5d"),
                    F.when(later, (p_last / p0 - 1) - bench("b_last")).alias("abn_todate")))


def price_statistics(bars: DataFrame, today=None) -> DataFrame:
    """Latest price statistics per ticker; needs 25 closes.

    With a run date only the year that ends with it is read, so a ticker that no longer trades has
    no current prices and later closes are not seen.
    """
    if today is not None:
        day = F.lit(today).cast("date")
        bars = bars.where((F.col("day") <= day) & (F.col("day") > F.add_months(day, -12)))
    by = W.partitionBy("ticker")
    newest = by.orderBy(F.col("day").desc())
    ranked = (bars.where(F.col("close").isNotNull())
              .select("ticker", "close", (F.col("close") * F.col("volume")).alias("usd"),
                      F.log(F.col("close") / F.lead("close").over(newest)).alias("r"),
                      F.row_number().over(newest).alias("k"),
                      F.count(F.col("close") * F.col("volume")).over(
                          newest.rowsBetween(W.unboundedPreceding, 0)).alias("v"))
              .where(F.col("k") <= fv.TRADING_DAYS + 1))
    k, close = F.col("k"), F.col("close")

    def nth(n):
        return F.max(F.when(k == n, close))

    def vol(n):
        return F.stddev_samp(F.when(k <= n, F.col("r"))) * F.sqrt(F.lit(252.0))
    return (ranked.groupBy("ticker").agg(
        F.count("*").alias("n"), nth(1).alias("last"),
        (nth(1) / nth(21) - 1).alias("ret_20d"), (nth(1) / nth(61) - 1).alias("ret_60d"),
        vol(20).alias("rvol_20d"), vol(60).alias("rvol_60d"),
        F.avg(F.when(F.col("v") <= 20, F.col("usd"))).alias("adv_usd"),
        (nth(1) / F.max(F.when(k <= fv.TRADING_DAYS, close))).alias("pct_of_52w_high"))
        .where("n >= 25").drop("n"))
