"""Trades from signals as table operations: levels, first touch, non-overlapping chains, equity factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.core import JOIN_PRODUCT, carry, cut, running

#: Blocks of a level that make one block of the next.
FAN = 64
#: Equity that counts as none: nothing trades on less.
LEAST_EQUITY = 1e-9


def slippage_sanity(df: DataFrame, slippage: float, most: float = 0.1) -> DataFrame:
    """``sym, mean_close, share, excessive`` : the slippage as a share of the mean close, and whether that is over
    ``most``; a mean of 0 or less is never excessive."""
    mean = df.groupBy("sym").agg(F.avg("close").alias("mean_close"))
    share = F.when(F.col("mean_close") > 0, slippage / F.col("mean_close"))
    return mean.withColumn("share", share).withColumn("excessive", F.coalesce(F.col("share") > most, F.lit(False)))


def check_costs(risk: float, commission: float, equity: float = 0.0) -> None:
    """Raises on a risked share outside of (0, 1], or a commission or an equity below 0."""
    if not (0 < risk <= 1 and commission >= 0 and equity >= 0):
        raise ValueError("risk must be in (0, 1], commission and equity 0 or more")


def check_multipliers(sl: float | Column, tp: float | Column) -> None:
    """Raises on a stop or target at no distance; columns of a parameter table are their owner's business."""
    if any(not isinstance(x, Column) and x <= 0 for x in (sl, tp)):
        raise ValueError("sl and tp must be positive")


def entry_levels(df: DataFrame, sl: float | Column, tp: float | Column, slippage: float, *keep: str) -> DataFrame:
    """Long and Short rows with ``atr`` > 0 and the columns ``keep``: ``side`` (1 or -1), ``entry`` (close worsened by the slippage), ``stop`` and
    ``target`` at ``sl`` and ``tp`` times atr. Rows with an entry of 0 or less don't trade."""
    check_multipliers(sl, tp)
    side = F.when(F.col("signal") == "Long", 1).when(F.col("signal") == "Short", -1)
    e = df.withColumn("side", side).where("side is not null and atr > 0").withColumn("entry", F.col("close") + F.col("side") * slippage)
    e = e.where("entry > 0").withColumn("stop", F.col("entry") - F.col("side") * sl * F.col("atr")).withColumn(
        "target", F.col("entry") + F.col("side") * tp * F.col("atr"),
    )
    return e.select("sym", "ts", "rn", "side", "entry", "stop", "target", *keep)


def first_touch(entries: DataFrame, bars: DataFrame) -> DataFrame:
    """``sym, rn, up, down, hit``: for each entry (``up``, ``down``) the first later bar with high >= up or low <= down, if any.

    Bars are summed up in a tree of blocks, ``FAN`` to a block. An entry looks at later blocks of its own parent, level
    by level, until one touches, and then goes down in it: a few joins on equal keys with ``FAN`` candidates each,
    however far the touch lies."""
    level = bars.select("sym", F.col("rn").alias("i"), "high", "low")
    top = bars.agg(F.max("rn")).first()[0] or 0
    levels = [level]
    while top >= FAN:
        level, top = level.groupBy("sym", F.floor(F.col("i") / FAN).alias("i")).agg(F.max("high").alias("high"), F.min("low").alias("low")), top // FAN
        levels.append(level)
    touches = (F.col("high") >= F.col("up")) | (F.col("low") <= F.col("down"))
    keys = ["sym", "rn", "up", "down"]
    look, found = entries.select(*keys, F.col("rn").alias("p")), []
    for blocks in levels:
        near = look.withColumn("parent", F.floor(F.col("p") / FAN)).join(blocks.withColumn("parent", F.floor(F.col("i") / FAN)), ["sym", "parent"])
        first = near.groupBy(*keys, "parent").agg(F.min(F.when((F.col("i") > F.col("p")) & touches, F.col("i"))).alias("hit"))
        found.append(first.where("hit is not null").select(*keys, "hit"))
        look = first.where("hit is null").select(*keys, F.col("parent").alias("p"))
    at = found.pop()
    for blocks, here in zip(levels[-2::-1], found[::-1], strict=True):
        inside = at.join(blocks.withColumn("hit", F.floor(F.col("i") / FAN)), ["sym", "hit"]).where(touches)
        at = inside.groupBy(*keys).agg(F.min("i").alias("hit")).unionByName(here)
    return at.select(*keys, "hit")


def barrier_outcome(df: DataFrame, sl: float | Column, tp: float | Column, slippage: float) -> DataFrame:
    """Each entry with its exit: the first later bar with a valid atr that touches the target (``TP``, which wins on a
    bar that touches both) or the stop (``SL``), else the symbol's last close (``EndOfData``), worsened by the slippage."""
    return _outcomes(entry_levels(df, sl, tp, slippage), df, slippage)


def _outcomes(entries: DataFrame, df: DataFrame, slippage: float) -> DataFrame:
    """The exits of entries with levels on the bars of ``df``. The tree of blocks is built once, and asked once for the entries of a bar
    that have equal levels, whatever else (as ``run_id``) they differ in."""
    e = entries.withColumn("up", F.greatest("stop", "target")).withColumn("down", F.least("stop", "target"))
    valid = F.col("atr") > 0
    live = df.select("sym", "rn", F.when(valid, F.col("high")).alias("high"), F.when(valid, F.col("low")).alias("low"))
    last = df.groupBy("sym").agg(F.max_by("close", "rn").alias("end"), F.max("rn").alias("end_rn"))
    keys = ["sym", "rn", "up", "down"]
    asked = e.select(*keys).distinct() if "run_id" in e.columns else e
    hit = first_touch(asked, live).join(live.withColumnRenamed("rn", "hit"), ["sym", "hit"])
    o = e.join(hit, keys, "left").join(last, "sym")
    won = F.when(F.col("side") == 1, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    reason = F.when(F.col("hit").isNull(), "EndOfData").when(won, "TP").otherwise("SL")
    level = F.when(reason == "TP", F.col("target")).when(reason == "SL", F.col("stop")).otherwise(F.col("end")) - F.col("side") * slippage
    return o.select(*entries.columns, reason.alias("reason"), level.alias("exit"), F.coalesce("hit", "end_rn").alias("exit_rn"))


def nonoverlap_trades(outcomes: DataFrame) -> DataFrame:
    """The outcomes that trade when only one position is open: the first, and after each exit the first entry at or after
    the exit bar. Pointers to the next trade are doubled: as many rounds as the logarithm of the longest chain."""
    none = F.lit(None).cast("long").alias("e")
    marks = outcomes.select("sym", "rn", F.col("rn").alias("e")).unionByName(outcomes.select("sym", F.col("exit_rn").alias("rn"), none))
    marks = marks.groupBy("sym", "rn").agg(F.max("e").alias("e"))
    ahead = carry(marks, ["e"], "_next", ahead=True).select("sym", F.col("rn").alias("exit_rn"), F.col("e_next").alias("to"))
    over = F.col("reason") != "EndOfData"
    jump = cut(outcomes.where(over).select("sym", "rn", "exit_rn").join(ahead, ["sym", "exit_rn"]).where("to is not null").select("sym", "rn", "to"))
    reached = outcomes.groupBy("sym").agg(F.min("rn").alias("rn"))
    while True:
        more = reached.join(jump, ["sym", "rn"]).select("sym", F.col("to").alias("rn"))
        reached = cut(reached.union(more).distinct())
        jump = cut(jump.alias("a").join(jump.select("sym", F.col("rn").alias("to"), F.col("to").alias("then")), ["sym", "to"]).select("sym", "rn", F.col("then").alias("to")))
        if jump.isEmpty():
            break
    return outcomes.join(reached, ["sym", "rn"], "left_semi")


def trade_log(trades: DataFrame, equity: float, risk: float, commission: float, least: float = LEAST_EQUITY) -> DataFrame:
    """The trades with number, size, PnL and equity before and after: each multiplies the equity by a factor that doesn't
    depend on it, so the equity is a running product. Trades on an equity of ``least`` or less don't take place."""
    check_costs(risk, commission, equity)
    u = F.least(F.try_divide(F.lit(risk), F.abs(F.col("entry") - F.col("stop"))), 1 / F.col("entry"))
    t = trades.withColumn("__u", u).withColumn("__e", F.greatest(F.lit(0.0), 1 - commission * F.col("entry") * F.col("__u")))
    move = F.col("__u") * F.col("side") * (F.col("exit") - F.col("entry"))
    t = t.withColumn("__m", move - commission * F.abs(move)).withColumn("__one", F.lit(1))
    t = t.withColumn(
        "__f",
        F.when((F.col("reason") == "EndOfData") & (F.col("__e") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("__e") + F.col("__m"))),
    )
    t = running(running(t, "__f", "__before", F.product, JOIN_PRODUCT, upto=-1), "__one", "trade_no", upto=-1)
    before = F.lit(float(equity)) * F.col("__before")
    t = t.where(before > least)
    size = before * F.col("__u")
    return t.select(
        "sym", F.col("trade_no").cast("long").alias("trade_no"),
        F.when(F.col("side") == 1, "Long").otherwise("Short").alias("type"), "ts", "rn", "entry", "stop", "target",
        size.alias("size"), (size * F.col("entry")).alias("entry_cost"),
        (size * F.col("entry") * commission).alias("entry_commission"), "exit", "exit_rn", (before * F.col("__m")).alias("pnl"),
        "reason", (before * F.col("__e")).alias("entry_equity"), (before * F.col("__f")).alias("equity"),
    )


def equity_curve(log: DataFrame, bars: DataFrame, equity: float) -> DataFrame:
    """``sym, bar_no, ts, equity``: point 0 is the equity at the start, point k that after bar k - 1; n + 1 points for n
    bars. An entry's commission counts from its bar on and a trade's result from its exit's; on a bar with both the
    entry comes after the exit, unless the trade ends there with the data."""
    check_costs(1.0, 0.0, equity)
    event = lambda rn, value, order: F.struct(F.col(rn).alias("rn"), F.col(value).alias("equity"), (2 * F.col("trade_no") + order).alias("order"))
    events = log.select("sym", F.inline(F.array(event("rn", "entry_equity", 0), event("exit_rn", "equity", 1))))
    after = events.groupBy("sym", "rn").agg(F.max_by("equity", "order").alias("after"))
    marked = bars.select("sym", "rn", "ts").join(after, ["sym", "rn"], "left")
    points = carry(marked, ["after"], "_known").select(
        "sym", (F.col("rn") + 1).alias("bar_no"), "ts", F.coalesce("after_known", F.lit(float(equity))).alias("equity"),
    )
    none = F.lit(None).cast(dict(bars.dtypes)["ts"]).alias("ts")
    start = bars.select("sym").distinct().select("sym", F.lit(0).cast("long").alias("bar_no"), none, F.lit(float(equity)).alias("equity"))
    return start.unionByName(points)


def strategy_search(df: DataFrame, grid: DataFrame, slippage: float, equity: float, risk: float, commission: float, least: float = LEAST_EQUITY) -> DataFrame:
    """``run_id, sym, trades, final_equity, total_return`` of each run of ``grid`` (``run_id, sl, tp, least``: Long where
    ``prob`` is over ``least``) on each symbol of ``df`` (bars with ``atr`` and ``prob``), all runs in one set of joins.

    The grid is a parameter, so it is broadcast. Only entries are a row for each run; the bars' tree is one for all of them, and
    runs that put equal levels on a bar ask it once."""
    bars = cut(df)
    # Bars that no run enters don't meet the grid.
    lowest = grid.agg(F.min("least").alias("__lowest"))
    some = bars.where("atr > 0").crossJoin(F.broadcast(lowest)).where("prob > __lowest").drop("__lowest")
    runs = some.crossJoin(F.broadcast(grid)).where("prob > least").withColumn("signal", F.lit("Long"))
    levels = entry_levels(runs, F.col("sl"), F.col("tp"), slippage, "run_id")
    outcomes = cut(_outcomes(levels, bars, slippage).withColumnRenamed("sym", "of").withColumn("sym", F.concat_ws("\x1f", F.col("run_id").cast("string"), "of")))
    log = trade_log(nonoverlap_trades(outcomes), equity, risk, commission, least)
    ends = log.groupBy("sym").agg(F.count(F.lit(1)).alias("trades"), F.max_by("equity", "trade_no").alias("final_equity"))
    every = bars.select(F.col("sym").alias("of")).distinct().crossJoin(F.broadcast(grid.select("run_id")))
    found = every.withColumn("sym", F.concat_ws("\x1f", F.col("run_id").cast("string"), "of")).join(ends, "sym", "left")
    final = F.coalesce("final_equity", F.lit(float(equity)))
    return found.select(
        "run_id", F.col("of").alias("sym"), F.coalesce("trades", F.lit(0)).alias("trades"), final.alias("final_equity"),
        (final / equity - 1).alias("total_return"),
    )


def best_run(results: DataFrame, metric: str = "total_return", largest: bool = True) -> DataFrame:
    """``run_id`` and mean ``metric`` of the best run of a search; the smaller run of equal ones."""
    means = results.groupBy("run_id").agg(F.avg(metric).alias(metric))
    return means.orderBy(F.desc(metric) if largest else F.asc(metric), "run_id").limit(1)


def slippage_cost(log: DataFrame, slippage: float) -> DataFrame:
    """``sym, cost``: the slippage of entry and exit on all sizes of a trade log."""
    return log.groupBy("sym").agg((F.sum("size") * 2 * slippage).alias("cost"))


def trade_summary(log: DataFrame, n: int) -> DataFrame:
    """The first and last ``n`` trades of each symbol."""
    last = log.groupBy("sym").agg(F.max("trade_no").alias("last"))
    return log.join(last, "sym").where((F.col("trade_no") < n) | (F.col("trade_no") > F.col("last") - n)).drop("last")


def trade_stats(log: DataFrame) -> DataFrame:
    """Number of trades, share won and profit factor (infinite without losses) by symbol."""
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.abs(F.sum(F.when(F.col("pnl") <= 0, F.col("pnl"))))
    return log.groupBy("sym").agg(
        F.count(F.lit(1)).alias("trades"), (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("win_ratio"),
        F.coalesce(F.try_divide(F.coalesce(won, F.lit(0.0)), lost), F.lit(float("inf"))).alias("profit_factor"),
    )
