"""Command line over the observation reports: build, summary, class, regime, drift."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import TABLES
from .operators import macro
from .plans import catalog
from .sources import sinks, tables

NEEDED = ("trades", "state_class", "regime_labels", "transition_drift")


def build(spark: SparkSession, source: str, out: str) -> None:
    """Writes the report tables, the JSON reports and the charts made from the tables in source."""
    trades, classes, labels, drift = (f(spark, source) for f in (catalog.holdings, catalog.classes, catalog.macro_labels, catalog.drift))
    sinks.write_tables({"trades": trades, "state_class": classes, "regime_labels": labels, "transition_drift": drift}, out)
    marked = macro.attribution(trades, classes)
    sinks.report_json({"total": macro.summary(marked), "by_class": macro.summary(marked, "state_class"), "by_regime": macro.summary(marked, "regime"), "contributors": macro.contributors(marked)}, os.path.join(out, "attribution.json"))
    kl, stay, frequency = macro.kl_bull_bear(drift, TABLES), macro.stay_by_regime(drift), macro.regime_frequency(labels)
    sinks.report_json({"top_kl": macro.top(kl, "kl_bull_bear", TABLES.top_states, "state_id"), "stay": macro.top(stay, "abs_delta", TABLES.top_states, "state_id"), "frequency": frequency}, os.path.join(out, "diagnostics.json"))
    results = marked.groupBy("regime").agg(F.sum("ret_gross").alias("gross"), F.sum("ret_net").alias("net")).orderBy("regime")
    most = macro.top(kl, "kl_bull_bear", TABLES.top_states, "state_id").orderBy(F.desc("kl_bull_bear"), "state_id")
    sinks.charts(
        {
            "regime_pnl": lambda path: sinks.bar_chart([(r.regime, {"ret_gross": r.gross, "ret_net": r.net}) for r in results.collect()], path, "Results by regime, gross and net"),
            "class_distribution": lambda path: sinks.bar_chart([(r.state_class, {"states": r.n}) for r in macro.class_distribution(classes).collect()], path, "States of each class", counts=True),
            "kl_topN": lambda path: sinks.bar_chart([(str(r.state_id), {"kl": r.kl_bull_bear}) for r in most.collect()], path, "States with the largest divergence of BULL from BEAR", across=True),
            "classes": lambda path: sinks.bar_chart([(r.state_class, {"ret_net": r.sum}) for r in macro.summary(marked, "state_class").collect()], path, "Result of each class"),
            "drawdown": lambda path: sinks.line_chart({"drawdown": [(r.date.toordinal(), r.dd) for r in labels.collect()]}, path, "Drawdown of the market"),
            "regimes": lambda path: sinks.line_chart({c: [(r.year, r[f"share_{c}"]) for r in frequency.collect()] for c in ("BULL", "BEAR", "RECOVERY")}, path, "Share of each regime by year"),
        },
        out,
    )


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="statefield")
    p.add_argument("command", choices=["build", "summary", "class", "regime", "drift"])
    p.add_argument("--source", default="/root/testdata/sf0.001")
    p.add_argument("--out", default="reports")
    p.add_argument("--name", default="INVARIANT", help="class to list")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("statefield").getOrCreate()
    if a.command == "build":
        os.makedirs(a.out, exist_ok=True)
        build(spark, a.source, a.out)
        return 0
    if not all(os.path.isdir(os.path.join(a.out, n)) for n in NEEDED):
        print("not built", file=sys.stderr)
        return 2
    read = lambda n: spark.read.parquet(os.path.join(a.out, n))
    if a.command == "summary":
        macro.summary(macro.attribution(read("trades"), read("state_class")), "state_class").show()
    elif a.command == "class":
        tables.require_domain(read("state_class"), "state_class", macro.CLASSES)
        macro.states_of_class(read("state_class"), a.name).show()
    elif a.command == "regime":
        macro.regime_frequency(tables.require_columns(read("regime_labels"), ["date", "dd", "regime"])).show()
    else:
        macro.top(macro.kl_bull_bear(read("transition_drift")), "kl_bull_bear", 20, "state_id").withColumn("kl_bull_bear", F.round("kl_bull_bear", 6)).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
