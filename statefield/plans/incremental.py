"""Queries of what is computed piece by piece: streams with keyed state, long sequences in blocks, iterated solvers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TABLES as P
from ..operators import basins, chains, drift, latent, mixture, seeds, split, states, surfaces
from ..operators.features import Z, state_vector, valid_mask
from ..operators.live import LIVE
from ..sources import commits, sinks
from ..streaming import live as streamed
from .catalog import hidden, panel, register, rs, shared, state_rows, valid_pairs
from .oracles import CTES, cte, r

# The daily path as a stream

#: Days at the end of a slice whose rows partly come with the next one, or come wrong at first.
LATE_DAYS = 10


def streamed_states(s: SparkSession, d: str) -> DataFrame:
    """States of the panel, landed in three slices of dates with a restart between them.

    Of the last days of a slice a third of the rows is late, and some have a wrong close that the next slice corrects.
    """
    rows = sinks.written(panel(s, d).select("code", "date", "close", "volume"), "landing-panel")
    ends = rows.select(F.percentile_approx(F.datediff("date", F.lit("1970-01-01").cast("date")), [0.3, 0.6]).alias("e"))
    day, chance = F.datediff("date", F.lit("1970-01-01").cast("date")), F.pmod(F.xxhash64("code", "date"), F.lit(12))
    part = F.when(day <= F.col("e")[0], 0).when(day <= F.col("e")[1], 1).otherwise(2)
    last = (part < 2) & (day > F.col("e")[F.least(part, F.lit(1))] - LATE_DAYS)
    rows = rows.crossJoin(F.broadcast(ends)).select("code", "date", "close", "volume", part.alias("part"), (last & (chance < 4)).alias("late"), (last & (chance == 5)).alias("wrong"))
    landed = rows.select("code", "date", "close", "volume", (F.col("part") + F.col("late").cast("int")).alias("slice"))
    landed = landed.unionByName(rows.where("wrong").select("code", "date", F.col("close"), "volume", (F.col("part") + 1).alias("slice")))
    first_wrong = rows.where("wrong").select("code", "date", F.col("part").alias("slice"), F.lit(True).alias("wrong"))
    landed = landed.join(first_wrong, ["code", "date", "slice"], "left").withColumn("close", F.when(F.col("wrong"), F.col("close") * 3).otherwise(F.col("close"))).drop("wrong")
    path, target, checkpoint = (sinks.scratch(s, x) for x in ("landed", "live-states", "live-checkpoint"))
    landed = sinks.written(landed.withColumn("ingest_id", F.col("slice").cast("long")), "slices")
    for i in range(3):
        landed.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(path)
        streamed.run_states(s, path, landed.drop("slice").schema, target, checkpoint, P, late_rows=2 * LATE_DAYS)
    return streamed.current_states(s.read.parquet(target)).select("code", "date", *(f"z_{c}_bin" for c in LIVE), "state_id")


register("w7_streamed_states", "lives", "SELECT code, date, z_r_bin, z_sigma_bin, z_v_bin, z_l_bin, z_p_bin, state_id FROM lives")(streamed_states)

# Hidden chains by blocks, under fixed parameters: three states, four categories; blocks of 64 rows, so that most codes have several

START, TRANS = [0.5, 0.25, 0.25], [[0.75, 0.125, 0.125], [0.25, 0.5, 0.25], [0.125, 0.25, 0.625]]
EMIT = [[0.5, 0.25, 0.125, 0.125], [0.125, 0.5, 0.25, 0.125], [0.125, 0.125, 0.25, 0.5]]
#: Logarithms to multiples of 2^-10, so that sums of them and ties are exact in whatever order.
LOGS = [np.round(np.log(np.array(x)) * 1024) / 1024 for x in (START, TRANS, EMIT)]
MODEL = latent.CategoricalHMM(*(np.array(x) for x in (START, TRANS, EMIT)))
K3 = range(3)


@shared
def chain_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = state_rows(s, d).select(F.col("code").cast("string").alias("seq_id"), "date", (F.col("state_id") % 4).alias("C_t"))
    return chains.blocks_of(rows, 64)


def _emitted(i: int, values=EMIT) -> str:
    return f"CAST([{', '.join(map(str, map(float, values[i])))}][c + 1] AS DOUBLE)"


def _scaled(xs: list[str], source: str, names: str, more: str = "code, k") -> str:
    cells = ", ".join(f"{x} AS x{i}" for i, x in enumerate(xs))
    return f"SELECT {more}, {', '.join(f'x{i} / s AS {names}{i}' for i in K3)}, s FROM (SELECT *, x0 + x1 + x2 AS s FROM (SELECT {more}, {cells} FROM {source}))"


def chain_ctes() -> None:
    cte("ob", "states", "SELECT code, date, state_id % 4 AS c, row_number() OVER (PARTITION BY code ORDER BY date) AS k, count(*) OVER (PARTITION BY code) AS n FROM states")
    first = _scaled([f"{START[i]} * {_emitted(i)}" for i in K3], "ob WHERE k = 1", "a")
    ahead = [f"({' + '.join(f'a{i} * {TRANS[i][j]}' for i in K3)}) * {_emitted(j)}" for j in K3]
    then = _scaled(ahead, "(SELECT o.code, o.k, o.c, a0, a1, a2 FROM fw JOIN ob o ON o.code = fw.code AND o.k = fw.k + 1)", "a")
    cte("fw", "ob", f"{first} UNION ALL {then}")
    back = [" + ".join(f"{TRANS[i][j]} * {_emitted(j)} * b{j}" for j in K3) for i in K3]
    before = _scaled(back, "(SELECT bw.code, bw.k - 1 AS k, o.c, b0, b1, b2 FROM bw JOIN ob o ON o.code = bw.code AND o.k = bw.k WHERE bw.k > 1)", "b")
    cte("bw", "ob", f"SELECT code, k, {', '.join(f'CAST(1 AS DOUBLE) / 3 AS b{i}' for i in K3)}, CAST(1 AS DOUBLE) AS s FROM ob WHERE k = n UNION ALL {before}")
    cte("gam", "fw bw", f"SELECT code, k, c, {', '.join(f'a{i} * b{i} / (a0 * b0 + a1 * b1 + a2 * b2) AS g{i}' for i in K3)} FROM fw JOIN bw USING (code, k) JOIN ob USING (code, k)")
    moved = {(i, j): f"a{i} * {TRANS[i][j]} * {_emitted(j)} * b{j}" for i in K3 for j in K3}
    cells = ", ".join(f"{x} AS m{i}{j}" for (i, j), x in moved.items())
    total = " + ".join(f"m{i}{j}" for i, j in moved)
    cte("mov", "fw bw", f"SELECT *, {total} AS s FROM (SELECT {cells} FROM fw JOIN bw ON bw.code = fw.code AND bw.k = fw.k + 1 JOIN ob ON ob.code = bw.code AND ob.k = bw.k)")
    start, trans, emit = LOGS
    score = lambda i: f"{float(start[i])} + {_emitted(i, emit)}"
    best = lambda j: f"greatest({', '.join(f'v{i} + {float(trans[i][j])}' for i in K3)})"
    came = lambda j: f"CASE WHEN v0 + {float(trans[0][j])} = {best(j)} THEN 0 WHEN v1 + {float(trans[1][j])} = {best(j)} THEN 1 ELSE 2 END"
    step = ", ".join(f"{best(j)} + {_emitted(j, emit)} AS v{j}, {came(j)} AS f{j}" for j in K3)
    cte("vit", "ob", f"SELECT code, k, {', '.join(f'{score(i)} AS v{i}, {i} AS f{i}' for i in K3)} FROM ob WHERE k = 1 UNION ALL SELECT o.code, o.k, {step} FROM vit JOIN ob o ON o.code = vit.code AND o.k = vit.k + 1")
    cte("way", "vit", "SELECT code, k, CASE WHEN v0 = greatest(v0, v1, v2) THEN 0 WHEN v1 = greatest(v0, v1, v2) THEN 1 ELSE 2 END AS z FROM vit JOIN ob USING (code, k) WHERE k = n UNION ALL SELECT way.code, way.k - 1, [f0, f1, f2][way.z + 1] FROM way JOIN vit ON vit.code = way.code AND vit.k = way.k WHERE way.k > 1")


chain_ctes()
register("m2_log_likelihoods", "fw", f"SELECT CAST(code AS VARCHAR) AS seq_id, count(*) AS n, {r('sum(ln(s))', 'log_likelihood')} FROM fw GROUP BY 1")(lambda s, d: chains.log_likelihoods(chain_blocks(s, d), MODEL))
_parts = " UNION ALL ".join(
    [f"SELECT 'start' AS part, 0 AS i, {i} AS j, sum(g{i}) AS x FROM gam WHERE k = 1" for i in K3]
    + [f"SELECT 'trans' AS part, {i} AS i, {j} AS j, sum(m{i}{j} / s) AS x FROM mov" for i in K3 for j in K3]
    + [f"SELECT 'emit' AS part, {i} AS i, CAST(c AS INT) AS j, sum(g{i}) AS x FROM gam GROUP BY c" for i in K3]
)
register("m2_em_step", "gam mov", f"SELECT part, i, j, {r('x / sum(x) OVER (PARTITION BY part, i)', 'p')} FROM ({_parts})")(lambda s, d: chains.next_parameters(chain_blocks(s, d), MODEL))
register("m3_viterbi_paths", "way", "SELECT CAST(code AS VARCHAR) AS seq_id, date, CAST(z AS INT) AS z FROM way JOIN ob USING (code, k)")(lambda s, d: chains.best_paths(chain_blocks(s, d), *LOGS).withColumnRenamed("Z_t", "z"))

# One step of the clusters' iteration from fixed centres

CENTRES = [[((3 * i + j * (i + 1)) % 8 - 3.5) / 4 for j in range(4)] for i in range(8)]
_gaps = [" + ".join(f"power(z_{f} - {c}, 2)" for f, c in zip(Z, centre)) for centre in CENTRES]
_near = " ".join(f"WHEN d{i} = least({', '.join(f'd{j}' for j in range(8))}) THEN {i}" for i in range(8))
register("m1_lloyd_step", "zs", f"SELECT CAST(c AS INT) AS C_t, count(*) AS n, {', '.join(r(f'avg(z_{f})', f'z_{f}') for f in Z)} FROM (SELECT *, CASE {_near} END AS c FROM (SELECT *, {', '.join(f'{g} AS d{i}' for i, g in enumerate(_gaps))} FROM zs WHERE {' AND '.join(f'z_{f} IS NOT NULL' for f in Z)})) GROUP BY 1")(
    lambda s, d: latent.assigned(valid_z(s, d), [f"z_{f}" for f in Z], np.array(CENTRES)).where("valid").groupBy("C_t").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"z_{f}").alias(f"z_{f}") for f in Z))
)


def valid_z(s: SparkSession, d: str) -> DataFrame:
    return valid_mask(state_vector(panel(s, d), P), [f"z_{f}" for f in Z])


# One code with all rows, its windows in blocks

#: Longer than the windows reach back, and short enough for many blocks.
BLOCK = 1000


def one_code(s: SparkSession, d: str) -> DataFrame:
    """The panel as one code's history, in order of day and code; date is a number."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")
    return panel(s, d).select(F.lit(1).alias("code"), (day * 10_000_000 + F.col("code")).alias("date"), "close", "volume", "trade_value")


def one_code_ctes() -> None:
    """The expressions of the feature chain once more, over the panel as one code."""
    chain = ("panel", "raw0", "raw1", "feats", "zs", "bins", "states")
    cte("one_panel", "panel", "SELECT 1 AS code, CAST(date - DATE '1970-01-01' AS BIGINT) * 10000000 + code AS date, close, volume, trade_value FROM panel")
    for n in chain[1:]:
        sql = re.sub(rf"\bFROM ({'|'.join(chain)})\b", r"FROM one_\1", CTES[n][1])
        cte(f"one_{n}", " ".join(f"one_{x}" for x in CTES[n][0]), sql)


one_code_ctes()
register("w4_split_states", "one_bins", f"SELECT place, {rs('r sigma l flow z_r z_sigma z_v z_flow')}, bin_r, bin_sigma, bin_v, bin_flow, CAST(bin_r + 6 * bin_sigma + 36 * bin_v + 216 * bin_flow AS BIGINT) AS state_id FROM (SELECT *, date AS place FROM one_bins)")(
    lambda s, d: split.state_vector(one_code(s, d), P, BLOCK).select(F.col("date").alias("place"), "r", "sigma", "l", "flow", *(f"z_{f}" for f in Z), *(f"bin_{f}" for f in Z), "state_id")
)
_ok = " AND ".join(f"z_{f} IS NOT NULL" for f in Z)
register("w16_split_sequences", "one_zs", f"SELECT place, '1|' || gap AS seq_id FROM (SELECT date AS place, ok, count(CASE WHEN NOT ok THEN 1 END) OVER (ORDER BY date) AS gap FROM (SELECT date, coalesce(z_v > -0.5, false) AND {_ok} AS ok FROM one_zs)) WHERE ok")(
    lambda s, d: split.sequences(sinks.written(split.z_scores(one_code(s, d), P, BLOCK), "split-z").withColumn("valid", F.coalesce(F.col("z_v") > -0.5, F.lit(False)) & F.expr(_ok.lower()))).select(F.col("date").alias("place"), "seq_id")
)

# Metastable sets of the states' transitions: a fixed number of steps, so that SQL takes the same

POWER, SWEEPS = 8, 6


@shared
def set_cells(s: SparkSession, d: str) -> DataFrame:
    return basins.within(states.transitions(valid_pairs(s, d)), positive_states(s, d))


@shared
def positive_states(s: SparkSession, d: str) -> DataFrame:
    """s, n of the states with a positive mean return."""
    return states.state_table(valid_pairs(s, d), P).where("visits > 0 and mu_r_raw > 0").select(F.col("state_id").alias("s"), F.col("visits").alias("n"))


def basin_ctes() -> None:
    cte("kept", "stats", "SELECT state_id AS s, visits AS n FROM stats WHERE visits > 0 AND mu_r_raw > 0")
    cte("cells", "trans kept", "SELECT s AS i, s_next AS j, p FROM trans WHERE s IN (SELECT s FROM kept) AND s_next IN (SELECT s FROM kept)")
    cte("nodes", "cells", "SELECT i FROM cells UNION SELECT j FROM cells")
    for side, to, of in (("r", "i", "j"), ("l", "j", "i")):
        cte(f"{side}0", "nodes", "SELECT i, 1.0 / count(*) OVER () AS x, CAST(0 AS DOUBLE) AS norm FROM nodes")
        for k in range(1, POWER + 1):
            cte(f"{side}{k}", f"{side}{k - 1} nodes cells", f"SELECT i, y / sum(abs(y)) OVER () AS x, sum(abs(y)) OVER () AS norm FROM (SELECT nodes.i, coalesce(y, 0) AS y FROM nodes LEFT JOIN (SELECT c.{to} AS i, sum(p * x) AS y FROM cells c JOIN {side}{k - 1} v ON v.i = c.{of} GROUP BY 1) m ON m.i = nodes.i)")
    cte("pair", f"l{POWER} r{POWER}", f"SELECT i, l.x AS le, r.x AS ri, sum(l.x * r.x) OVER () AS lr, r.norm AS l1 FROM l{POWER} l JOIN r{POWER} r USING (i)")
    cte("y0", "pair", "SELECT i, x / sum(abs(x)) OVER () AS x, CAST(0 AS DOUBLE) AS norm FROM (SELECT i, ((i * 7919 + 13) % 1000) / 1000.0 - 0.5 AS x FROM pair)")
    for k in range(1, POWER + 1):
        cte(f"y{k}", f"y{k - 1} pair cells", f"SELECT i, z / sum(abs(z)) OVER () AS x, sum(abs(z)) OVER () AS norm FROM (SELECT pair.i, coalesce(y, 0) - l1 * ri * (SELECT sum(le * x) FROM y{k - 1} JOIN pair USING (i)) / lr AS z FROM pair LEFT JOIN (SELECT c.i, sum(p * x) AS y FROM cells c JOIN y{k - 1} v ON v.i = c.j GROUP BY 1) m ON m.i = pair.i)")
    cte("stay", "kept cells", "SELECT s, n, coalesce(x, 0) AS stay, CASE WHEN coalesce(x, 0) < 1 - 1e-12 THEN coalesce(x, 0) / (1 - coalesce(x, 0)) END AS a FROM kept LEFT JOIN (SELECT i AS s, sum(p) AS x FROM cells GROUP BY 1) USING (s)")
    cte("gaps", "stay", "SELECT *, row_number() OVER (ORDER BY a DESC NULLS FIRST, s) AS pos, lag(coalesce(a, 'inf'::DOUBLE)) OVER (ORDER BY a DESC NULLS FIRST, s) AS above FROM stay")
    cte("cuts3", "gaps", "SELECT pos FROM (SELECT pos, CASE WHEN above IS NULL THEN NULL WHEN a > 0 THEN above / a WHEN a IS NULL THEN 1 WHEN above > 0 THEN 'inf'::DOUBLE ELSE 1 END AS gap FROM gaps) WHERE gap IS NOT NULL ORDER BY gap DESC, pos LIMIT 3")
    cte("basin", "gaps cuts3", "SELECT s, stay, a, ['core', 'stable', 'bridge', 'escape'][1 + (SELECT count(*) FROM cuts3 WHERE cuts3.pos <= gaps.pos)] AS basin FROM gaps")
    cte("h0", "kept basin", "SELECT s, CASE WHEN basin IN ('core', 'stable') THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM basin")
    for k in range(1, SWEEPS + 1):
        cte(f"h{k}", f"h{k - 1} h0 cells", f"SELECT h0.s, greatest(h0.x, coalesce(y, 0)) AS x FROM h0 LEFT JOIN (SELECT c.i AS s, sum(c.p * v.x / nullif(1 - coalesce(o.p, 0), 0)) AS y FROM cells c JOIN h{k - 1} v ON v.s = c.j LEFT JOIN cells o ON o.i = c.i AND o.j = c.i WHERE c.i <> c.j AND c.i NOT IN (SELECT s FROM h0 WHERE x > 0) GROUP BY 1) m ON m.s = h0.s")


basin_ctes()
_second = f"(SELECT max(norm) FROM y{POWER})"
register("d6_spectrum", f"r{POWER} y{POWER}", f"SELECT {r('l1', 'first')}, {r('l2', 'second')}, {r('l1 - l2', 'gap')}, {r('CASE WHEN l2 > 0 AND l2 < 1 THEN -1 / ln(l2) ELSE 0.0 END', 'mixing')}, {r('1 - l1', 'leakage')} FROM (SELECT max(norm) AS l1, {_second} AS l2 FROM r{POWER})")(
    lambda s, d: basins.spectrum(set_cells(s, d), POWER, 0.0)
)
register("d5_basins", "basin", f"SELECT s, {r('stay')}, {r('a', 'attractor')}, basin FROM basin")(lambda s, d: basins.basins(set_cells(s, d), positive_states(s, d)))
register("d5_absorption", f"h{SWEEPS}", f"SELECT s, {r('x', 'reached')} FROM h{SWEEPS}")(lambda s, d: basins.absorption(set_cells(s, d), basins.basins(set_cells(s, d), positive_states(s, d)).where("basin in ('core', 'stable')"), positive_states(s, d), SWEEPS, 0.0))
register("d4_mean_stability", "stay", f"SELECT {r('avg(stay)', 'unweighted')}, {r('sum(stay * n) / sum(n)', 'weighted')} FROM stay")(lambda s, d: basins.mean_stability(set_cells(s, d), positive_states(s, d)))

# Appends by commits


def committed(s: SparkSession, d: str) -> DataFrame:
    """The panel in four batches that overlap, of which one comes twice and one fails before its commit; the first of a key stays."""
    rows, path = panel(s, d).select("code", "date", "close"), sinks.scratch(s, "committed")
    parts = {"a": rows.where("date < '1996-01-01'"), "b": rows.where("date < '1998-01-01'").withColumn("close", F.col("close") * 2), "c": rows.where("code % 2 = 0").withColumn("close", F.col("close") * 3), "d": rows}
    for name in ("a", "b", "a", "c"):
        commits.append_batch(parts[name], path, name)
    commits.stage(parts["d"].withColumn("close", F.lit(-1.0)), path, commits.commits(s, path))
    commits.append_batch(parts["d"], path, "d")
    return commits.read_committed(s, path, rows.schema)


_scale = "CASE WHEN date < '1996-01-01' THEN 1 WHEN date < '1998-01-01' THEN 2 WHEN code % 2 = 0 THEN 3 ELSE 1 END"
register("k3_commits", "panel", f"SELECT code, date, {r(f'close * {_scale} + 1e-9', 'close')} FROM panel")(lambda s, d: committed(s, d).withColumn("close", F.col("close") + 1e-9))

# Two fits whose labels are fixed: four hidden states, renamed and partly moved


def _fit(s: SparkSession, d: str, z, label) -> dict[str, DataFrame]:
    rows = state_rows(s, d).select("code", "date", "r", z.cast("long").alias("Z_t")).where("r is not null")
    names = s.range(4).select(F.col("id").alias("z"), label.alias("label"))
    return {"states": rows, "labels": names, "kept": rows.groupBy(F.col("Z_t").alias("z")).agg(F.avg("r").alias("m")).where("m > 0").select("z")}


def seed_gate(s: SparkSession, d: str) -> DataFrame:
    z, i = F.col("state_id") % 4, F.col("id")
    first = _fit(s, d, z, F.concat(F.lit("L"), i.cast("string")))
    other = _fit(s, d, F.when(F.col("code") % 7 == 0, (z + 2) % 4).otherwise((z + 1) % 4), F.when(i == 0, "X").otherwise(F.concat(F.lit("L"), ((i + 3) % 4).cast("string"))))
    return seeds.seed_stability(first, other, 4)


cte("fits", "states", "SELECT r, state_id % 4 AS a, CASE WHEN code % 7 = 0 THEN (state_id % 4 + 2) % 4 ELSE (state_id % 4 + 1) % 4 END AS b FROM states WHERE r IS NOT NULL")
cte("shared_rows", "fits", "SELECT a, b, count(*) AS n FROM fits GROUP BY 1, 2")
_count = lambda i: f"coalesce((SELECT n FROM shared_rows WHERE a = {i} AND b = p{i}), 0)"
cte("perms", "shared_rows", f"SELECT *, {' + '.join(map(_count, range(4)))} AS gain FROM (SELECT w.range AS p0, x.range AS p1, y.range AS p2, z.range AS p3 FROM range(4) w, range(4) x, range(4) y, range(4) z WHERE len(list_distinct([w.range, x.range, y.range, z.range])) = 4)")
cte("best_perm", "perms", "SELECT unnest([0, 1, 2, 3]) AS z, unnest([p0, p1, p2, p3]) AS o FROM (SELECT * FROM perms ORDER BY gain DESC LIMIT 1)")
_sets = "SELECT avg(CASE WHEN x.z IS NULL OR y.z IS NULL THEN 1.0 ELSE 0.0 END) FROM (SELECT a AS z FROM fits GROUP BY 1 HAVING avg(r) > 0) x FULL JOIN (SELECT best_perm.z FROM (SELECT b FROM fits GROUP BY 1 HAVING avg(r) > 0) k JOIN best_perm ON o = b) y ON x.z = y.z"
_labels = "SELECT avg(CASE WHEN 'L' || z = CASE WHEN o = 0 THEN 'X' ELSE 'L' || ((o + 3) % 4) END THEN 0.0 ELSE 1.0 END) FROM best_perm"
_moved = "SELECT 1 - sum(CASE WHEN o = b THEN n ELSE 0 END) / sum(n) FROM shared_rows JOIN best_perm ON z = a"
register("d9_seed_gate", "best_perm", f"SELECT {rs('rows_moved labels_changed set_changed')}, {r('greatest(labels_changed, set_changed)', 'value')}, greatest(labels_changed, set_changed) < 0.05 AS passed FROM (SELECT ({_moved}) AS rows_moved, ({_labels}) AS labels_changed, ({_sets}) AS set_changed)")(seed_gate)
register("d9_yearly_shares", "states", f"SELECT z, CAST(y AS INT) AS year, {r('share')}, {r('abs(share - before)', 'shift')}, coalesce(abs(share - before) < 0.15, true) AS passed FROM (SELECT *, lag(share) OVER (PARTITION BY z ORDER BY y) AS before FROM (SELECT z.range AS z, y, count(s.z) / any_value(al) AS share FROM range(4) z CROSS JOIN (SELECT year(date) AS y, count(*) AS al FROM states GROUP BY 1) a LEFT JOIN (SELECT state_id % 4 AS z, year(date) AS yy FROM states) s ON s.z = z.range AND yy = y GROUP BY 1, 2))")(
    lambda s, d: seeds.yearly_shares(state_rows(s, d).select("code", "date", (F.col("state_id") % 4).alias("Z_t")))
)

# Drift flags by date


def drift_ctes() -> None:
    late = f"date >= DATE '{P.test_start}'"
    cte("val_ref", "states", f"SELECT z_r AS x, count(CASE WHEN NOT {late} THEN 1 END) AS ref FROM states GROUP BY 1")
    cte("val_rank", "val_ref", "SELECT x, sum(ref) OVER (ORDER BY x) AS upto, sum(ref) OVER (ORDER BY x) - ref AS below, sum(ref) OVER () AS m FROM val_ref")
    for name, source, keep in (("vw", "states", "true"), ("hw", "hid", "Z_t <> -1")):
        cte(f"{name}_days", source, f"SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM {source} WHERE {late} AND {keep})")
        cte(name, f"{name}_days", f"SELECT a.date, b.date AS win FROM {name}_days a JOIN {name}_days b ON b.k BETWEEN a.k AND a.k + 4 WHERE b.k >= 5")
    cte("val_win", "vw val_rank states", f"SELECT win, z_r AS x, count(*) AS c, any_value(upto) AS upto, any_value(below) AS below, any_value(m) AS m FROM states JOIN vw USING (date) JOIN val_rank ON x = z_r WHERE {late} GROUP BY 1, 2")
    cte("val_gap", "val_win", "SELECT *, sum(c) OVER (PARTITION BY win ORDER BY x) AS seen, sum(c) OVER (PARTITION BY win) AS n FROM val_win")
    cte("val_ks", "val_gap", "SELECT win, any_value(n) AS n, any_value(m) AS m, max(greatest(abs(seen / n - upto / m), abs((seen - c) / n - below / m))) AS ks FROM val_gap GROUP BY 1")
    cte("val_p", "val_ks", "SELECT *, CASE WHEN y < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 21), lambda j: 2.0 * power(-1, j - 1) * exp(-2.0 * j * j * y * y))))) END AS p FROM (SELECT *, (sqrt(n::DOUBLE * m / (n + m)) + 0.12 + 0.11 / sqrt(n::DOUBLE * m / (n + m))) * ks AS y FROM val_ks)")
    cte("share_ref", "hid", f"SELECT Z_t AS z, count(CASE WHEN NOT {late} THEN 1 END) / sum(count(CASE WHEN NOT {late} THEN 1 END)) OVER () AS usual FROM hid WHERE Z_t <> -1 GROUP BY 1")
    cte("share_win", "hw share_ref hid", f"SELECT win, z, usual, count(h.date) / sum(count(h.date)) OVER (PARTITION BY win) AS recent FROM hw CROSS JOIN share_ref LEFT JOIN (SELECT date, Z_t FROM hid WHERE Z_t <> -1 AND {late}) h ON h.date = hw.date AND h.Z_t = z GROUP BY 1, 2, 3")
    cte("share_psi", "share_win", "SELECT win, sum((greatest(recent, 1e-6) - greatest(usual, 1e-6)) * ln(greatest(recent, 1e-6) / greatest(usual, 1e-6))) AS psi, max(abs(recent - usual)) AS shift FROM share_win GROUP BY 1")
    frame = lambda n: f"OVER (PARTITION BY z ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    cte("moved_share", "hid", f"SELECT date, max(round(abs(recent - usual), 9) > 0.1) AS excluded FROM (SELECT date, avg(x) {frame(5)} AS recent, avg(x) {frame(60)} AS usual FROM (SELECT date, z, coalesce(n, 0) / a AS x FROM (SELECT date, count(*) AS a FROM hid WHERE Z_t <> -1 GROUP BY 1) CROSS JOIN (SELECT range AS z FROM range(8)) LEFT JOIN (SELECT date, Z_t AS z, count(*) AS n FROM hid WHERE Z_t <> -1 GROUP BY 1, 2) USING (date, z))) GROUP BY 1")


drift_ctes()
register(
    "d12_drift_flags",
    "val_p share_psi moved_share",
    f"SELECT date, {rs('ks p psi shift')}, drift, coalesce(excluded, false) AS excluded, drift AND NOT coalesce(excluded, false) AS retrain FROM (SELECT win AS date, ks, p, psi, shift, coalesce(psi > 0.2, false) OR coalesce(p < 0.01, false) OR coalesce(shift > 0.15, false) AS drift FROM val_p FULL JOIN share_psi USING (win)) LEFT JOIN moved_share USING (date)",
)(lambda s, d: drift.drift_flags(state_rows(s, d), hidden(s, d), surfaces.occupancy_change(hidden(s, d)), "z_r", P.test_start))

# A mixture under fixed parameters

MIX = mixture.Mixture(np.array([0.5, 0.3, 0.2]), np.array([[0.0, 0.0], [0.5, 1.0], [-0.5, -0.5]]), np.array([[[1.0, 0.25], [0.25, 1.0]], [[2.0, -0.5], [-0.5, 1.0]], [[0.5, 0.0], [0.0, 2.0]]]))


def mixture_ctes() -> None:
    logs = []
    for w, m, c in zip(MIX.weights, MIX.means, MIX.covariances):
        det = c[0, 0] * c[1, 1] - c[0, 1] ** 2
        form = f"({c[1, 1]} * power(z_r - {m[0]}, 2) - 2 * {c[0, 1]} * (z_r - {m[0]}) * (z_sigma - {m[1]}) + {c[0, 0]} * power(z_sigma - {m[1]}, 2)) / {det}"
        logs.append(f"{w} * exp(-0.5 * {form}) / (2 * pi() * sqrt({det}))")
    cte("dens", "zs", f"SELECT code, date, z_r, z_sigma, {', '.join(f'CAST({x} AS DOUBLE) AS d{i}' for i, x in enumerate(logs))} FROM zs WHERE z_r IS NOT NULL AND z_sigma IS NOT NULL")
    cte("resp", "dens", f"SELECT code, date, z_r, z_sigma, {', '.join(f'd{i} / (d0 + d1 + d2) AS g{i}' for i in range(3))} FROM dens")


def mixture_step(s: SparkSession, d: str) -> DataFrame:
    after, _ = mixture.next_mixture(valid_z(s, d), ["z_r", "z_sigma"], MIX, 0.0)
    rows = [(i, float(after.weights[i]), *map(float, after.means[i]), float(after.covariances[i][0, 0]), float(after.covariances[i][0, 1]), float(after.covariances[i][1, 1])) for i in range(3)]
    return s.createDataFrame(rows, "component int, weight double, mean_r double, mean_sigma double, var_r double, cov double, var_sigma double")


mixture_ctes()
register("d16_responsibilities", "resp", f"SELECT code, date, {rs('g0 g1 g2')} FROM resp")(lambda s, d: mixture.responsibilities(valid_z(s, d).select("code", "date", "z_r", "z_sigma"), ["z_r", "z_sigma"], MIX).select("code", "date", "g0", "g1", "g2"))
_moment = lambda i: f"SELECT {i} AS component, sum(g{i}) / count(*) AS weight, sum(g{i} * z_r) / sum(g{i}) AS mean_r, sum(g{i} * z_sigma) / sum(g{i}) AS mean_sigma, sum(g{i} * z_r * z_r) / sum(g{i}) AS rr, sum(g{i} * z_r * z_sigma) / sum(g{i}) AS rs, sum(g{i} * z_sigma * z_sigma) / sum(g{i}) AS ss FROM resp"
register("d16_em_step", "resp", f"SELECT component, {rs('weight mean_r mean_sigma')}, {r('rr - mean_r * mean_r', 'var_r')}, {r('rs - mean_r * mean_sigma', 'cov')}, {r('ss - mean_sigma * mean_sigma', 'var_sigma')} FROM ({' UNION ALL '.join(map(_moment, range(3)))})")(mixture_step)
