"""Queries that write tables in the forms that sources know, and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TABLES as P
from ..operators import latent, macro
from ..operators.features import horizon_return
from ..sources import bucketed, sinks, tables
from .catalog import ORACLES, hidden, holdings, labelled, panel, register, rs, state_rows
from .oracles import cte, r

BUCKETS = 8


def bucketed_panel(s: SparkSession, d: str) -> DataFrame:
    """raw, states and regimes as bucketed tables, joined, with the return over five rows; no exchange after the tables are written."""
    raw = bucketed.write_bucketed(panel(s, d).select("code", "date", "close", "volume"), "raw", BUCKETS)
    vec = bucketed.write_bucketed(state_rows(s, d).select("code", "date", "state_id"), "states", BUCKETS)
    reg = bucketed.write_bucketed(labelled(s, d).select("code", "date", "regime").where("code % 3 > 0"), "regimes", BUCKETS)
    return horizon_return(bucketed.joined_buckets(s, raw, vec, reg, {raw: ["code", "date", "close"]}), 5)


def label_map(s: SparkSession, d: str) -> DataFrame:
    """Edges of hidden states with the labels of a written label map."""
    path = sinks.scratch(s, "label-map")
    sinks.write_label_map(latent.label_scores(hidden(s, d)), path)
    return latent.edge_state(hidden(s, d)).join(F.broadcast(tables.read_label_map(s, path)), "z", "left").select("z", "label", "n", "e")


def single_and_parts(s: SparkSession, d: str) -> DataFrame:
    """State vectors of a folder that has them in one panel.parquet, and of one that has them by years only."""
    columns, one, parts = ["code", "date", "state_id", "p", "v"], sinks.scratch(s, "single"), sinks.scratch(s, "parts")
    state_rows(s, d).coalesce(1).write.parquet(f"{one}/panel.parquet")
    sinks.write_state_vector(state_rows(s, d), parts)
    read = lambda folder, form: tables.single_or_parts(s, folder, columns).withColumn("form", F.lit(form))
    return read(one, "single").unionByName(read(parts, "parts"))


def regime_scan(s: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(s, "regime")
    hidden(s, d).write.parquet(path)
    return tables.read_panel(s, path, ["date", "code", "Z_t"])


RET = "lead(close, 5) OVER (PARTITION BY code ORDER BY date) / close - 1"
register("s4_bucketed", "states reg", f"SELECT code, date, state_id, regime, {r('ret_h')} FROM (SELECT states.code, states.date, states.state_id, CASE WHEN states.code % 3 > 0 THEN regime END AS regime, {RET} AS ret_h FROM states LEFT JOIN reg USING (state_id))")(lambda s, d: bucketed_panel(s, d).select("code", "date", "state_id", "regime", "ret_h"))
VECTOR = f"code, date, state_id, {rs('p v')}"
register("s5_single_or_parts", "states", f"SELECT {VECTOR}, 'single' AS form FROM states UNION ALL SELECT {VECTOR}, 'parts' AS form FROM states")(single_and_parts)
register("s6_regime_scan", "hid", "SELECT date, code, Z_t FROM hid")(regime_scan)
_scores = ORACLES["a33_label_scores"]
cte("hlab", "hid", "SELECT z, label FROM (" + _scores[_scores.rindex("SELECT z, n, round(TREND"):] + ")")
register("s9_label_map", "hes hlab", f"SELECT hes.z, label, n, {r('e')} FROM hes LEFT JOIN hlab USING (z)")(label_map)
register("p11_finite", "ctrades", f"SELECT regime, count(*) AS n, {r('sum(ret_net)', 'sum')} FROM ctrades GROUP BY 1")(lambda s, d: macro.assert_finite(macro.summary(holdings(s, d), "regime")).select("regime", "n", "sum"))
