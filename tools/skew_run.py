"""Task balance under a hot key, from Spark's event log (no UI).

Usage: python tools/skew_run.py sf_dir N [cpus] [--plain]
``--plain`` turns broadcast joins off and leaves the skew settings at Spark's
defaults, so that the balance does not rest on either.
Builds the sf fixture replicated N times plus one facility holding a third
of all fact rows, stores it, runs headline analyses and reports, per query,
the stages' task count, max and median task time, the max/median ratio and the
largest share of a stage's shuffled rows that one task reads
(from SparkListenerTaskEnd events in an event log under the scratch folder).
"""
import glob
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F  # noqa: E402

from scale_run import replicate  # noqa: E402
from wardrank.plans import recommend as rec  # noqa: E402
from wardrank.plans import reports as rep  # noqa: E402
from wardrank.session import build_session, ensure_checkpoint_dir, scratch_path  # noqa: E402
from wardrank.sources import files  # noqa: E402
from wardrank.sources.fixture import cms_fixture  # noqa: E402

QUERIES = {
    "composite_weighted": rep.composite_weighted,
    "state_ranking": rep.state_ranking,
    "mortality_by_condition": rep.mortality_by_condition,
    "eligible_by_state": rec.eligible_by_state,
    "va_stroke_classes": rep.va_stroke_classes,
    "recommend_all": rec.recommend_all,
}


def main():
    args = [a for a in sys.argv[1:] if a != "--plain"]
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
             # many partitions, so that a key with a third of the rows stands out
             "spark.sql.adaptive.coalescePartitions.enabled": "false"} if "--plain" in sys.argv else {}
    sf_dir, n = args[0], int(args[1])
    cpus = int(args[2]) if len(args) > 2 else 8
    import tempfile
    log_dir = tempfile.mkdtemp(prefix="wardrank-eventlog-", dir="/tmp")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus * 4, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false", **plain})
    ensure_checkpoint_dir(spark)
    c, h = cms_fixture(spark, sf_dir)
    c, h = replicate(c, n), replicate(h, n)
    # one facility gets a third of all rows: copies of its own measure rows
    base = c.filter(F.col("facility_id") == "F000001-0")
    copies = (c.count() // 2) // max(base.count(), 1)
    hot = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(copies)))).alias("_k")) \
        .drop("_k")
    root = scratch_path(spark, f"skew{n}")
    files.save_tables(c.unionByName(hot), h, root)
    c, h = files.load_tables(spark, root)
    total = c.count()
    hot_rows = c.filter(F.col("facility_id") == "F000001-0").count()
    marks = {}
    for name, fn in QUERIES.items():
        df = fn(c, h)
        df.write.format("noop").mode("overwrite").save()  # warm
        spark.sparkContext.setJobGroup(name, name)
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        marks[name] = time.perf_counter() - t
    spark.sparkContext.setJobGroup("done", "done")
    spark.stop()
    # parse the event log: job group -> stages -> task durations
    stage_group, tasks, shuffled = {}, {}, {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if not os.path.isfile(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    grp = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = grp
                elif kind == "SparkListenerTaskEnd":
                    info = ev["Task Info"]
                    tasks.setdefault(ev["Stage ID"], []).append(
                        info["Finish Time"] - info["Launch Time"])
                    read = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics", {})
                    shuffled.setdefault(ev["Stage ID"], []).append(read.get("Total Records Read", 0))
    out = {"replicas": n, "fact_rows": total, "hot_facility_rows": hot_rows, "queries": {}}
    for name in QUERIES:
        stages = []
        for sid, grp in sorted(stage_group.items()):
            if grp == name and sid in tasks and len(tasks[sid]) > 1:
                d = tasks[sid]
                med = statistics.median(d)
                stages.append({"stage": sid, "tasks": len(d), "max_ms": max(d),
                               "median_ms": med, "max_over_median": round(max(d) / max(med, 1), 2),
                               "rows_read": sum(shuffled[sid]),
                               "largest_share": round(max(shuffled[sid]) / max(sum(shuffled[sid]), 1), 3)})
        out["queries"][name] = {"sec": round(marks[name], 3), "stages": stages}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
