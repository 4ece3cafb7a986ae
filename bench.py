"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from greensward.plans.catalog import QUERIES
from greensward.session import session

HEADLINE = [
    "ground_raster", "canopy_raster", "raster_downsample", "error_stats", "band_summary", "circle_mean_sample", "local_variation", "jacobi_step",
    "render_fold", "render_composed", "stamp_influence_max", "candidate_score", "way_classify", "point_in_polygon", "buffer_mask", "nearest_path_distance",
    "cart_pearls", "water_level_p90", "gap_fill", "contour_poisson",
]


def started(frames):
    import greensward.operators.stamps  # noqa: F401  what workers would import at the first query that needs them

    yield from frames


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp()})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["ground_raster"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine, and next its Python workers
    spark.range(int(cpus) * 8).repartition(int(cpus)).mapInPandas(started, "id long").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
