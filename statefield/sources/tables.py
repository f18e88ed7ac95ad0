"""Sources of panels and artifacts, with checked columns and domains."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that each written artifact has.
ARTIFACTS = {
    "regime_pnl": ["macro_regime", "n_trades", "mean", "std", "sum", "hit_rate", "sharpe_ann"],
    "state_decomp": ["state_id", "macro_regime", "n", "mean", "std", "sum", "se", "t_one_sample"],
    "flip_map": ["state_id", "mu_bull", "mu_bear", "n_bull", "n_bear", "t_flip", "t_bull_pos", "t_bear_pos", "reliable"],
    "regime_labels": ["date", "equity_market", "dd", "regime"],
    "transition_drift": ["regime", "state_id", "next_state", "n", "P"],
    "kl": ["state_id", "kl_bull_bear"],
    "trades": ["entry_date", "exit_date", "code", "state_id", "regime", "ret_gross", "ret_net"],
    "panel": ["date", "code", "state_id"],
}
#: Settings of the live path where a deployment names none.
DEFAULT_CONFIG = {"K": 6, "WINDOW": 252, "STD_FLOOR": 1e-6, "Z_CLIP": 5, "EPS": 1e-8}


#: Rows of a task whose windows sort and widen them; some 2 kB each in the feature chain.
TASK_ROWS = 100_000


def parts_of(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """The number of parts of about `rows` rows each; of a table as it is read, rows are counted by its files' footers."""
    return max(1, -(-df.count() // rows))


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily panel (code, date, close, volume, trade_value) from the lineitem table.

    Lines are dealt by code, so that neither the panel's groups nor windows by code need another exchange, and into as many parts as
    they fill: a task's rows don't grow with the table.
    """
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    rows = rows.repartition(parts_of(rows), "l_suppkey")
    return rows.groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("trade_value")
    )


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raises if df lacks a column."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Raises if a column has other values than allowed, null among them (S8, U2); the list of odd ones is bounded."""
    odd = [r[0] for r in df.where(~F.col(column).isin(allowed) | F.col(column).isNull()).select(column).distinct().limit(10).collect()]
    if odd:
        raise ValueError(f"{column} has {odd}")
    return df


def read_artifact(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A written artifact with its required columns."""
    return require_columns(spark.read.parquet(path), ARTIFACTS[name])


def read_panel(spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """A panel by years, as year=YYYY folders or year=YYYY.parquet files, pruned to a range of years and columns."""
    df = spark.read.parquet(path)
    year = F.col("year") if "year" in df.columns else F.year("date")
    if first is not None:
        df = df.where(year >= first)
    if last is not None:
        df = df.where(year <= last)
    return df.select(*columns) if columns else df


def joined_panel(raw: DataFrame, states: DataFrame, regimes: DataFrame) -> DataFrame:
    """raw with states (inner) and regimes (left) on date and code.

    All three have a row a date and code, so none is broadcast, however small its files are.
    """
    return raw.join(states.hint("merge"), ["date", "code"]).join(regimes.hint("merge"), ["date", "code"], "left")


def merge_checked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner merge on date and code that must keep every row of both."""
    out = a.join(b.hint("merge"), ["date", "code"])
    n = out.count()
    if n != a.count() or n != b.count():
        raise ValueError("the merge lost or multiplied rows")
    return out


def close_of(panel: DataFrame, fallback: DataFrame) -> DataFrame:
    """Non-null closes from the panel if it has them, else from the fallback."""
    src = panel if "close" in panel.columns else fallback
    return src.select("date", "code", "close").dropna()


def high_water_mark(panel: DataFrame):
    """The latest date, None if there are no rows."""
    return panel.agg(F.max("date")).first()[0]


def read_config(path: str | None) -> dict:
    """Deployment settings with defaults (S9); a small driver-side file."""
    if not path:
        return dict(DEFAULT_CONFIG)
    with open(path, encoding="utf-8") as f:
        return DEFAULT_CONFIG | json.load(f)


def live_inputs(spark: SparkSession, states_path: str, config_path: str | None, names_path: str | None = None) -> tuple[DataFrame, DataFrame, dict, DataFrame | None]:
    """States, priorities (state_id, edge) of the tradeable states, settings, and names of codes of the live path.

    The settings' state_priority maps states to their edges, tradeable_states lists those that count.
    """
    config = read_config(config_path)
    allowed = {int(x) for x in config.get("tradeable_states", config.get("state_priority", {}))}
    rows = [(int(k), float(v)) for k, v in config.get("state_priority", {}).items() if int(k) in allowed]
    names = spark.read.parquet(names_path).select("code", "name") if names_path else None
    return spark.read.parquet(states_path), spark.createDataFrame(rows, "state_id long, edge double"), config, names


def read_meta(spark: SparkSession, path: str) -> dict:
    """What write_meta wrote."""
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """code for each symbol of a universe file."""
    return spark.read.json(path, multiLine=True).select(F.explode("symbols").alias("code")).select(F.lpad("code", 6, "0").alias("code"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """z, label of a label map file (S9); no rows where there is no such file or it has no map."""
    if not exists(spark, path):
        return spark.createDataFrame([], "z long, label string")
    maps = spark.read.schema("label_map map<string,string>").json(path, multiLine=True)
    return maps.select(F.explode("label_map").alias("z", "label")).select(F.col("z").cast("long").alias("z"), "label")


def single_or_parts(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Some columns of a folder's panel.parquet, where it is there, else of its parts by year."""
    if exists(spark, f"{folder}/panel.parquet"):
        return spark.read.parquet(f"{folder}/panel.parquet").select(*columns)
    return read_panel(spark, folder, columns)


def landed_market(df: DataFrame, names: dict[str, str], market: str) -> DataFrame:
    """Landed rows of a market under common column names, with padded codes."""
    return df.withColumnsRenamed(names).withColumn("code", F.lpad(F.col("code").cast("string"), 6, "0")).withColumn("market", F.lit(market))


def business_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Weekdays of a range; holidays need a calendar table to join away."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return d.where(F.dayofweek("date").between(2, 6))


def matrix_as_long(spark: SparkSession, matrix) -> DataFrame:
    """i, j, v of a small dense matrix."""
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], "i int, j int, v double")
