"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

All queries run once on the smallest tables first, so that no figure holds the start of Spark. Each timed query then starts
without kept stages from the base tables, and writes all its rows to a sink that drops them. `stages` has the stages that
the reference publishes times for, each from its written input as there, and the whole chain of learned models; `value` is the
sum of the queries.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from statefield.operators import features, latent, states, strategy  # noqa: E402
from statefield.plans import catalog  # noqa: E402
from statefield.plans.catalog import P  # noqa: E402

#: The reference's timed stages first, then what it doesn't publish times for.
HEADLINE = ["w4_state_vector", "a7_regimes", "q4_portfolio_path", "b3_metrics", "a13_hidden_transitions", "a14_edge_transition", "d1_ev_surface", "b4_horizons", "b6_walk_forward", "w7_live_states", "a21_classes", "d20_kernel_edge"]
WARM_UP = "/root/testdata/sf0.001"


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def stages(spark, sf: str, folder: str) -> dict[str, float]:
    """State vector, transition build and non-overlapping backtest, each from a written table."""

    def written(name, df):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    found = {}
    panel = written("panel", catalog.panel(spark, sf))
    found["state_vector"] = timed(features.warmed_up(features.state_vector(panel, P)))
    rows = written("states", features.warmed_up(features.state_vector(panel, P)))
    found["transition_build"] = timed(states.state_table(states.pairs(features.forward(rows)), P))
    labelled = written("labelled", states.labelled(features.forward(rows), states.state_table(states.pairs(features.forward(rows)), P)))
    test = labelled.where(F.col("date") >= F.lit(P.test_start).cast("date")).select("date")
    found["non_overlapping"] = timed(strategy.portfolio_path(strategy.trades_of(labelled, P), labelled, test, P.cost))
    hidden = written("hidden", catalog.hidden(spark, sf))
    found["hidden_transitions"] = timed(latent.transition_matrix(hidden))
    found["hidden_edges"] = timed(latent.edge_transition(hidden))
    return found


def chain(spark, sf: str) -> float:
    """Clusters, hidden Markov model, Viterbi and labels, all of it from the base tables: 20 restarts, up to 200 steps."""
    catalog.forget()
    began = time.time()
    timed(catalog.regimes(spark, sf))
    return round(time.time() - began, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="statefield-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, times = catalog.queries(), {}
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    if os.path.isdir(WARM_UP):
        for name in names:
            timed(found[name](spark, WARM_UP))
        stages(spark, WARM_UP, folder)
    for name in names:
        catalog.forget()
        times[name] = timed(found[name](spark, sf))
    catalog.forget()
    parts = stages(spark, sf, folder) | {"clusters_and_hidden_chain": chain(spark, sf)}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "stages": parts, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
