"""Metastable sets of a sparse transition matrix: spectrum by power iteration, basins, absorption by Jacobi sweeps.

Matrices are rows (i, j, p) and vectors rows (i, x); a product is a join and a sum, so work grows with the cells that are not
zero. Each step's vector is written, which cuts its lineage; steps end at a tolerance or after a fixed number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.sinks import written

#: Most steps of an iteration, and the change of its result that ends it.
STEPS, TOLERANCE = 200, 1e-10
CLASSES = ("core", "stable", "bridge", "escape")


def within(matrix: DataFrame, kept: DataFrame) -> DataFrame:
    """i, j, p of a matrix's cells (s, s_next, p) whose two states are in kept (s)."""
    rows = matrix.join(kept.select("s"), "s", "left_semi")
    return rows.join(kept.select(F.col("s").alias("s_next")), "s_next", "left_semi").select(F.col("s").alias("i"), F.col("s_next").alias("j"), "p")


def _scaled(v: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """v (keys.., i, x) with x over the sum of its sizes, and that sum as norm; a zero vector stays."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    v = v.withColumn("norm", F.sum(F.abs("x")).over(w))
    return v.withColumn("x", F.coalesce(ratio(F.col("x"), F.col("norm")), F.lit(0.0)))


def _start(i: Column) -> Column:
    """A vector that no eigenvector is at right angles to, as a rule."""
    return F.pmod(i * 7919 + 13, F.lit(1000)) / F.lit(1000.0) - F.lit(0.5)


def power_vectors(cells: DataFrame, steps: int = STEPS, tol: float = TOLERANCE) -> tuple[DataFrame, int]:
    """side ('left' or 'right'), i, x, norm: both first eigenvectors after some steps, and the number of steps; norm tends to λ1."""
    both = cells.select(F.lit("right").alias("side"), F.col("i").alias("to"), F.col("j").alias("of"), "p").unionByName(cells.select(F.lit("left").alias("side"), F.col("j").alias("to"), F.col("i").alias("of"), "p"))
    both = written(both, "power-cells")
    nodes = written(cells.select("i").unionByName(cells.select(F.col("j").alias("i"))).distinct(), "power-nodes")
    sides = nodes.select(F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"), "i")
    v, before = written(_scaled(sides.withColumn("x", F.lit(1.0)), ("side",)), "power"), None
    for step in range(1, steps + 1):
        moved = both.join(v.select("side", F.col("i").alias("of"), "x"), ["side", "of"]).groupBy("side", F.col("to").alias("i")).agg(F.sum(F.col("p") * F.col("x")).alias("x"))
        v = written(_scaled(sides.join(moved, ["side", "i"], "left").withColumn("x", F.coalesce("x", F.lit(0.0))), ("side",)), "power")
        norm = v.agg(F.max("norm")).first()[0]
        if norm is None or before is not None and abs(norm - before) < tol:
            return v, step
        before = norm
    return v, steps


def deflated(cells: DataFrame, first: DataFrame, steps: int = STEPS, tol: float = TOLERANCE) -> DataFrame:
    """i, x, norm: the second eigenvector by power iteration, of which each step takes the first one's part away; norm tends to |λ2|."""
    first = written(first, "power-first")
    pair = first.groupBy("i").pivot("side", ["left", "right"]).agg(F.first("x"))
    size = first.where("side = 'right'").agg(F.max("norm").alias("l1"))
    pair = pair.crossJoin(F.broadcast(pair.agg(F.sum(F.col("left") * F.col("right")).alias("lr")))).crossJoin(F.broadcast(size))
    pair = written(pair, "power-pair")
    cells = written(cells, "power-cells")
    v, before = written(_scaled(pair.select("i", _start(F.col("i")).alias("x"))), "deflated"), None
    for _ in range(steps):
        moved = cells.join(v.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("p") * F.col("x")).alias("y"))
        along = v.join(pair, "i").agg(F.sum(F.col("left") * F.col("x")).alias("lx"))
        rest = F.coalesce("y", F.lit(0.0)) - F.coalesce(F.col("l1") * F.col("right") * ratio(F.col("lx"), F.col("lr")), F.lit(0.0))
        v = written(_scaled(pair.join(moved, "i", "left").crossJoin(F.broadcast(along)).select("i", rest.alias("x"))), "deflated")
        norm = v.agg(F.max("norm")).first()[0]
        if norm is None or before is not None and abs(norm - before) < tol:
            break
        before = norm
    return v


def spectrum(cells: DataFrame, steps: int = STEPS, tol: float = TOLERANCE) -> DataFrame:
    """first, second, gap, mixing, leakage of a nonnegative matrix whose rows add up to 1 or less (D6); one row.

    Where the second eigenvalues are a complex pair, their size comes out only roughly.
    """
    vectors, _ = power_vectors(cells, steps, tol)
    vectors = written(vectors, "spectrum-first")
    one = vectors.where("side = 'right'").agg(F.max("norm").alias("first"))
    two = deflated(cells, vectors, steps, tol).agg(F.max("norm").alias("second"))
    second = F.col("second")
    mixing = F.when((second > 0) & (second < 1), -1 / F.ln(second)).otherwise(0.0)
    return one.crossJoin(F.broadcast(two)).select("first", "second", (F.col("first") - second).alias("gap"), mixing.alias("mixing"), (1 - F.col("first")).alias("leakage"))


def mean_stability(cells: DataFrame, visits: DataFrame) -> DataFrame:
    """unweighted, weighted: means of the states' stability within the set, by state and by visits (s, n) (D4); one row."""
    s = visits.join(cells.groupBy(F.col("i").alias("s")).agg(F.sum("p").alias("stay")), "s", "left").withColumn("stay", F.coalesce("stay", F.lit(0.0)))
    return s.agg(F.avg("stay").alias("unweighted"), ratio(F.sum(F.col("stay") * F.col("n")), F.sum("n")).alias("weighted"))


def basins(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """s, stay, attractor, basin of each state in kept (D5): stability s / (1 - s), cut where neighbours in its order differ most.

    The three largest ratios of neighbours, of equal ones those of the larger attractors, divide core, stable, bridge and escape;
    a set of fewer states has the first classes only. States that never leave come first, those that never stay last.
    """
    s = kept.select("s").join(cells.groupBy(F.col("i").alias("s")).agg(F.sum("p").alias("stay")), "s", "left").withColumn("stay", F.coalesce("stay", F.lit(0.0)))
    # sums of a row that are 1 but for the last digits
    s = s.withColumn("attractor", F.when(F.col("stay") < 1 - 1e-12, F.col("stay") / (1 - F.col("stay"))))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("attractor").desc_nulls_first(), "s")
    above = F.lag(F.coalesce("attractor", F.lit(float("inf")))).over(order)
    gap = F.when(above.isNull(), F.lit(None)).when(F.col("attractor") > 0, above / F.col("attractor")).when(F.col("attractor").isNull(), F.lit(1.0)).otherwise(F.when(above > 0, F.lit(float("inf"))).otherwise(1.0))
    s = s.withColumn("at", F.row_number().over(order)).withColumn("gap", gap)
    widest = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("gap").desc_nulls_last(), "at"))
    s = s.withColumn("cut", (F.col("gap").isNotNull() & (widest <= len(CLASSES) - 1)).cast("int"))
    upto = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    names = F.array(*(F.lit(c) for c in CLASSES))
    return s.withColumn("basin", F.get(names, F.sum("cut").over(upto).cast("int"))).select("s", "stay", "attractor", "basin")


def absorption(cells: DataFrame, targets: DataFrame, kept: DataFrame, steps: int = STEPS, tol: float = TOLERANCE) -> DataFrame:
    """s, reached: the chance to come to one of targets (s) from each state of kept (s) before leaving it, by Jacobi sweeps.

    A state's own cell is divided out, h = sum of p h over the others, over 1 - p of its own; states that never leave
    themselves never come. After some sweeps, values are those within as many changes of state.
    """
    cells = written(cells, "absorb-cells")
    goal = written(targets.select(F.col("s").alias("i")).distinct(), "absorb-goal")
    own = cells.where("i = j").select("i", F.col("p").alias("own"))
    other = cells.where("i <> j").join(own, "i", "left").join(goal, "i", "left_anti")
    other = written(other.select("i", "j", F.coalesce(ratio(F.col("p"), 1 - F.coalesce("own", F.lit(0.0))), F.lit(0.0)).alias("p")), "absorb-moves")
    states = written(kept.select(F.col("s").alias("i")).distinct().join(goal.withColumn("goal", F.lit(1.0)), "i", "left").withColumn("goal", F.coalesce("goal", F.lit(0.0))), "absorb-states")
    h = states.select("i", F.col("goal").alias("x"))
    for _ in range(steps):
        moved = other.join(h.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("p") * F.col("x")).alias("y"))
        h = written(states.join(moved, "i", "left").join(h.withColumnRenamed("x", "before"), "i").select("i", F.greatest("goal", F.coalesce("y", F.lit(0.0))).alias("x"), "before"), "absorb")
        change = h.agg(F.max(F.abs(F.col("x") - F.col("before")))).first()[0]
        h = h.select("i", "x")
        if change is None or change < tol:
            break
    return h.select(F.col("i").alias("s"), F.col("x").alias("reached"))
