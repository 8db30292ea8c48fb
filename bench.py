"""Time the headline queries; prints one JSON line.

Stage tables (inputs, prepared panel, bins, fits) are timed when they are first
built; queries that read them are timed on their own after one warm-up run, as
the median of BENCH_RUNS runs (one by default).  Stages are written below
BENCH_SHARED_DIR, or below a new folder of this machine.
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

QUERIES = [
    "panel_natural_left_join", "panel_semi_index", "log_and_scrub", "built_panel", "rolling_cv3",
    "long_series_windows", "prepared_panel", "quantile_bins20", "binned_and_scaled", "standardise",
    "diversity_indices", "rook_edges", "graph_laplacian", "suff_stats_xtx", "suff_stats_xty",
    "demeaned_xty", "fe_within_slope", "diag_mse_r2", "pit_histogram", "effect_curves", "curve_band",
    "area_effect_map", "fit_effects", "fit_diagnostics",
]


def main():
    from fallow.catalog import CATALOG, analog, basics, models

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("fallow-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="fallow-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    stages = {
        "stage_input_panel": lambda: analog.input_panel(spark, SF_DIR),
        "stage_water": lambda: analog.water(spark, SF_DIR),
        "stage_expenses": lambda: (analog.fertilizer(spark, SF_DIR), analog.herbicide(spark, SF_DIR)),
        "stage_built": lambda: basics.built_stage(spark, SF_DIR),
        "stage_prepared": lambda: basics.prepared_stage(spark, SF_DIR),
        "stage_bins": lambda: basics.bins(spark, SF_DIR),
        "stage_design": lambda: models.design_stage(spark, SF_DIR),
        "stage_simple_scores": lambda: models.simple_scores(spark, SF_DIR),
        "stage_fit": lambda: models.fits(spark, SF_DIR),
        "stage_scores": lambda: models.scored(spark, SF_DIR),
    }
    times = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    for name, run in stages.items():
        times[name] = round(timed(name, run), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    for name in QUERIES:
        run = CATALOG[name].run

        def once():
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()

        once()
        times[name] = round(statistics.median(timed(name, once) for _ in range(RUNS)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of stage builds and warm headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
