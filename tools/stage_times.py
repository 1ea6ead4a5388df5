"""Stage times of registered queries from Spark's event log (no UI, no server).

Runs each query twice (the second run is reported) with the event log written to a fresh scratch
folder, then prints the slowest stages with their task counts.

Usage: python tools/stage_times.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import glob
import io
import json
import sys
import tempfile

import zstandard

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from pyspark.sql import SparkSession  # noqa: E402

from arrears.catalog import QUERIES, load_all  # noqa: E402
from arrears.session import RECOMMENDED_CONF, ensure_checkpoint_dir  # noqa: E402


def _events(folder: str):
    for path in sorted(glob.glob(f"{folder}/eventlog_v2_*/events_*")):
        with open(path, "rb") as fh:
            raw = zstandard.ZstdDecompressor().stream_reader(fh) if path.endswith(".zstd") else fh
            for line in io.TextIOWrapper(raw, encoding="utf-8"):
                yield json.loads(line)


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    folder = tempfile.mkdtemp(prefix="stage-times-")
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{folder}")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    load_all()
    marks = []
    for name in args:
        for run in range(2):
            spark.sparkContext.setJobGroup(f"{name}#{run}", name)
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        marks.append(name)
    spark.stop()

    job_group, stage_job, stages = {}, {}, {}
    for e in _events(folder):
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id", "")
            job_group[e["Job ID"]] = group
            for sid in e.get("Stage IDs", []):
                stage_job[sid] = e["Job ID"]
        elif kind == "SparkListenerStageCompleted":
            s = e["Stage Info"]
            stages[s["Stage ID"]] = ((s.get("Completion Time", 0) - s.get("Submission Time", 0)) / 1000, s["Number of Tasks"])
    for name in marks:
        mine = [(sid, d, n) for sid, (d, n) in stages.items() if job_group.get(stage_job.get(sid)) == f"{name}#1"]
        total = sum(d for _, d, _ in mine)
        print(f"== {name}: {len(mine)} stages, {total:.2f} s summed stage time")
        for sid, d, n in sorted(mine, key=lambda t: -t[1])[:6]:
            print(f"   stage {sid}: {d:.2f} s, {n} tasks")
    print(f"(event log in {folder})")


if __name__ == "__main__":
    main()
