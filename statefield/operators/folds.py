"""Cross-validation over blocks of market regimes, and the parts of a fold's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import deviation
from .strategy import chosen, marked, non_overlapping

ALL = Window.unboundedPreceding, Window.unboundedFollowing


def market_regimes(rows: DataFrame, labels: DataFrame, shock: float = 0.5) -> DataFrame:
    """date, market: SHOCK where at least that share of the date's rows is in SHOCK states, else BEAR in a macro BEAR, else BULL.

    rows: date, regime of the states. Dates without a macro regime are BULL unless they are SHOCK. One row a date.
    """
    share = rows.groupBy("date").agg(F.avg(F.coalesce(F.col("regime") == "SHOCK", F.lit(False)).cast("double")).alias("_share"))
    days = share.join(F.broadcast(labels.select("date", F.col("regime").alias("_macro"))), "date", "left")
    return days.select("date", F.when(F.col("_share") >= shock, "SHOCK").when(F.col("_macro") == "BEAR", "BEAR").otherwise("BULL").alias("market"))


def regime_blocks(days: DataFrame, k: int = 4, length: int = 120) -> DataFrame:
    """date, market, block, main, fold: blocks of `length` consecutive dates, dealt to k folds by their most frequent regime.

    main is that regime, of equally frequent ones the first by name. Each regime's blocks are dealt from the purest on, to and fro over
    the folds, so that no two folds differ by more than one block in any regime; a regime begins where the one before ended.
    Blocks should be longer than trades are held, or purging leaves nothing. days: date, market, one row a date; null is a regime.
    """
    number = F.floor((F.row_number().over(Window.orderBy("date")) - 1) / length)
    rows = days.select("date", "market", number.alias("block"))
    w = Window.partitionBy("block").orderBy(F.desc("n"), "market")
    blocks = rows.groupBy("block", "market").agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    dealt = F.row_number().over(Window.partitionBy("market").orderBy(F.desc("n"), "block")) - 1
    before = F.rank().over(Window.orderBy("market")) - 1
    place = F.when(F.floor(dealt / k) % 2 == 0, dealt % k).otherwise(k - 1 - dealt % k)
    blocks = blocks.select("block", F.col("market").alias("main"), ((place + before) % k).cast("int").alias("fold"))
    return rows.join(F.broadcast(blocks), "block").select("date", "market", "block", "main", "fold")


def purge_limits(blocks: DataFrame, rows: DataFrame, k: int, embargo: int = 0) -> DataFrame:
    """date, next_0.., until_0..: for each fold the first of its dates from this one on, and the last exit of its earlier dates.

    A training row that is entered on the date and left before `next` doesn't overlap the fold's later rows; one whose date is after
    `until`, by more than the embargo's days, doesn't overlap the earlier ones. rows: date, exit_date. One row a date.
    """
    w = Window.orderBy("date")
    exits = rows.groupBy("date").agg(F.max("exit_date").alias("_exit"))
    days = blocks.select("date", "fold").join(exits, "date", "left")
    own = lambda f, c: F.when(F.col("fold") == f, c)
    nexts = (F.min(own(f, F.col("date"))).over(w.rowsBetween(0, ALL[1])).alias(f"next_{f}") for f in range(k))
    untils = (F.max(own(f, F.date_add("_exit", embargo))).over(w.rowsBetween(ALL[0], -1)).alias(f"until_{f}") for f in range(k))
    return days.select("date", *nexts, *untils)


def identify_purged(rows: DataFrame, ret: str, limits: DataFrame, k: int, p: Params = DEFAULT) -> DataFrame:
    """fold and what identify gives for all rows that don't overlap the fold's; each row adds to all folds' moments in one pass."""

    def trains(f: int) -> Column:
        return F.coalesce(F.col(f"next_{f}") > F.col("exit_date"), F.lit(True)) & F.coalesce(F.col(f"until_{f}") < F.col("date"), F.lit(True))

    known = rows.where(f"state_id is not null and {ret} is not null").join(F.broadcast(limits), "date")
    x, regime = (lambda f: F.when(trains(f), F.col(ret))), (lambda f: F.when(trains(f), F.col("regime")))
    stats = known.groupBy("state_id").agg(
        *(F.struct(F.lit(f).alias("fold"), F.count(x(f)).alias("visits"), F.avg(x(f)).alias("mu_r"), deviation(x(f)).alias("sigma_r"), F.mode(regime(f), True).alias("regime")).alias(f"_{f}") for f in range(k))
    )
    cells = stats.select("state_id", F.explode(F.array(*(f"_{f}" for f in range(k)))).alias("c")).select("c.fold", "state_id", "c.visits", "c.mu_r", "c.sigma_r", "c.regime")
    return marked(cells.where("visits > 0"), p)


def regime_trades(rows: DataFrame, blocks: DataFrame, k: int, p: Params = DEFAULT, embargo: int = 0) -> DataFrame:
    """Greedy trades of each fold on its own dates, in states chosen from the other folds' rows that don't overlap it.

    rows: code, date, exit_date, state_id, regime, ret_h.
    """
    known = rows.where("ret_h is not null")
    picked = chosen(identify_purged(known, "ret_h", purge_limits(blocks, known, k, embargo), k, p), "fold")
    test = known.join(F.broadcast(blocks.select("date", "fold")), "date").join(F.broadcast(picked), ["fold", "state_id"], "left_semi")
    return non_overlapping(test, p.cost, "fold")


def regime_cv(trades: DataFrame, blocks: DataFrame, p: Params = DEFAULT, *by: str) -> DataFrame:
    """fold, by.., n_days, n_markets, n_trades, mean, std, sum, hit_rate, sharpe_ann of the trades; by: "market" for each regime of a fold.

    Folds and regimes without a trade have n_trades 0 and nulls. A trade belongs to the regime of its entry.
    """
    keys = ["fold", *by]
    days = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.countDistinct("market").alias("n_markets"))
    t = trades.join(F.broadcast(blocks.select(F.col("date").alias("entry_date"), "market")), "entry_date")
    out = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg("ret_net").alias("mean"), F.stddev_samp("ret_net").alias("std"), F.sum("ret_net").alias("sum"), F.avg((F.col("ret_net") > 0).cast("double")).alias("hit_rate")
    )
    sharpe = F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(F.lit(p.ann / p.horizon)))
    return days.join(out, keys, "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0))).withColumn("sharpe_ann", sharpe)


def fold_cells(trades: DataFrame) -> DataFrame:
    """fold, state_id, market, n, net, cost, and what of the gross sum is `expected`, by `regime`, by `state` and its `own`.

    trades: fold, state_id, market, ret_gross, ret_net. The other folds' trades say what was to be expected: a mean trade (expected),
    a mean trade of the regime instead (regime), a mean trade of the state in the regime instead (state); what is left is the
    cell's own. Where the others have no such trades the coarser mean stands for the finer one, and zero for all, so that always
    expected + regime + state + own - cost = net. One row for each fold, state and regime.
    """
    cells = trades.groupBy("fold", "state_id", "market").agg(F.count(F.lit(1)).alias("n"), F.sum("ret_gross").alias("gross"), F.sum("ret_net").alias("net"))

    def others(*keys: str) -> Column:
        """Mean gross return of the other folds' trades with these keys."""
        whole, own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)), Window.partitionBy("fold", *keys)
        n = F.sum("n").over(whole) - F.sum("n").over(own)
        return F.when(n > 0, (F.sum("gross").over(whole) - F.sum("gross").over(own)) / n)

    cells = cells.withColumn("_all", F.coalesce(others(), F.lit(0.0))).withColumn("_market", others("market")).withColumn("_state", others("state_id", "market"))
    cells = cells.withColumn("_market", F.coalesce("_market", "_all")).withColumn("_state", F.coalesce("_state", "_market"))
    n = F.col("n")
    return cells.select(
        "fold", "state_id", "market", "n", "net", (F.col("gross") - F.col("net")).alias("cost"), (n * F.col("_all")).alias("expected"), (n * (F.col("_market") - F.col("_all"))).alias("regime"),
        (n * (F.col("_state") - F.col("_market"))).alias("state"), (F.col("gross") - n * F.col("_state")).alias("own"),
    )


def fold_parts(cells: DataFrame, metrics: DataFrame) -> DataFrame:
    """fold, sharpe, worst, n, net and its parts for each fold with trades; worst is the one of the lowest Sharpe, of those the first."""
    sums = cells.groupBy("fold").agg(*(F.sum(c).alias(c) for c in ("n", "net", "cost", "expected", "regime", "state", "own")))
    first = F.row_number().over(Window.orderBy(F.asc_nulls_last("sharpe"), "fold")) == 1
    return metrics.select("fold", "sharpe").withColumn("worst", first & F.col("sharpe").isNotNull()).join(sums, "fold")


def losses(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Cells of the worst fold with their rank by net result from the largest loss on, and the share of all losses they have."""
    rows = cells.join(F.broadcast(parts.where("worst").select("fold")), "fold", "left_semi")
    loss = F.least("net", F.lit(0.0))
    total = F.sum(loss).over(Window.partitionBy("fold"))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.round("net", 9), "state_id", "market"))
    return rows.withColumn("share", F.when(total < 0, loss / total).otherwise(0.0)).withColumn("place", place)
