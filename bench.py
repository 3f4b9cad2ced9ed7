"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from terraquarry.plans import catalogue
from terraquarry.session import local_session

NAMES = [
    "cosine_topk", "filtered_topk", "similar_tiles_all", "retrieval_metrics", "nearest_in_time", "all_pairs", "band_stats",
    "class_distribution", "change_magnitude", "mad_threshold", "neighbors8", "suppression", "tile_windows", "affine_lstsq",
    "change_and_suppress", "nearest_of_each", "footprint_pairs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus))
    catalogue.QUERIES["class_distribution"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM and the scan
    seconds = {}
    for name in NAMES:
        start = time.time()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
