"""Time headline analyses on the sf fixture replicated N times (Spark-derived).

Usage: python tools/scale_run.py sf_dir N [cpus]
Every copy gets fresh facility IDs, so facility counts, slices and the hot
state all grow N-fold while scores repeat (many ties at every rank cut).
Prints one JSON line with rows and warm median seconds per query, for Spark
and for the equivalent SQL on DuckDB over the same files.
"""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F  # noqa: E402

from bench import _duckdb_reference, spark_action  # noqa: E402
from wardrank.plans import recommend as rec  # noqa: E402
from wardrank.plans import reports as rep  # noqa: E402
from wardrank.session import build_session, scratch_path  # noqa: E402
from wardrank.sources import files  # noqa: E402
from wardrank.sources.fixture import cms_fixture  # noqa: E402

HEADLINE = {
    "composite_weighted": rep.composite_weighted,
    "composite_ranked": rep.composite_ranked,
    "best_worst_20": rep.best_worst,
    "state_ranking": rep.state_ranking,
    "mortality_by_condition": rep.mortality_by_condition,
    "national_avg": rep.national_avg,
    "eligible_by_state": rec.eligible_by_state,
    "recommend_all": rec.recommend_all,
}


def replicate(df, n):
    copy = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_copy")
    return df.select("*", copy).withColumn(
        "facility_id", F.concat("facility_id", F.lit("-"), F.col("_copy").cast("string"))
    ).drop("_copy")


def main():
    sf_dir, n = sys.argv[1], int(sys.argv[2])
    cpus = int(sys.argv[3]) if len(sys.argv) > 3 else 8
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus * 4)
    c, h = cms_fixture(spark, sf_dir)
    root = scratch_path(spark, f"scale{n}")
    t = time.perf_counter()
    files.save_tables(replicate(c, n), replicate(h, n), root)
    ingest = time.perf_counter() - t
    c, h = files.load_tables(spark, root)
    rows = c.count()
    out = {}
    for name, fn in HEADLINE.items():
        run = spark_action(name, fn, c, h, {})
        run()
        ts = []
        for _ in range(3):
            t = time.perf_counter()
            run()
            ts.append(time.perf_counter() - t)
        out[name] = round(statistics.median(ts), 3)
    print(json.dumps({"replicas": n, "fact_rows": rows, "ingest_sec": round(ingest, 2),
                      "queries": out, "total": round(sum(out.values()), 3),
                      **_duckdb_reference(root, cpus, 3, 1, HEADLINE)}))


if __name__ == "__main__":
    main()
