"""Benchmark: run every registered analysis at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each analysis is executed to completion through the ``noop`` sink (the full
physical plan runs, nothing is collected to the driver).  Two passes; the
per-query figure is the faster of the two (the first pass also pays JVM
warm-up).  Shuffle bytes per analysis (first pass) come from Spark's event
log, written to a fresh scratch folder.  Prints one JSON line.
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from salesdeck.params import DEFAULT  # noqa: E402
from salesdeck.registry import ANALYSES  # noqa: E402
from salesdeck.session import get_session  # noqa: E402
from salesdeck.sources.star import load_star  # noqa: E402


def shuffle_bytes(log_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job description, from the event log."""
    try:
        import zstandard
    except ImportError:  # pragma: no cover
        return {}
    job_desc, stage_job, out = {}, {}, {}
    for f in sorted(glob.glob(f"{log_dir}/*/events_*")):
        raw = open(f, "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if f.endswith(".zstd") else raw
        for line in io.TextIOWrapper(stream, encoding="utf-8"):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                d = (e.get("Properties") or {}).get("spark.job.description")
                for sid in e.get("Stage IDs", []):
                    stage_job[sid] = d
            elif ev == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                d = stage_job.get(si["Stage ID"])
                if not d:
                    continue
                for acc in si.get("Accumulables", []):
                    if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                        out[d] = out.get(d, 0) + int(acc.get("Value", 0))
    return out


def line_count(sf_dir: str) -> int | None:
    try:
        import pyarrow.parquet as pq
        return pq.ParquetFile(f"{sf_dir}/lineitem.parquet").metadata.num_rows
    except Exception:
        return None


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    passes = int(os.environ.get("BENCH_PASSES", "2"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    log_dir = tempfile.mkdtemp(prefix="salesdeck-bench-")
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
             **json.loads(os.environ.get("BENCH_CONF", "{}"))}
    spark = get_session(cores=cpus, shuffle_partitions=cpus, extra=extra)
    sc = spark.sparkContext
    star = load_star(spark, sf_dir)
    names = only or list(ANALYSES)
    runs: dict[str, list[float]] = {n: [] for n in names}
    for p in range(passes):
        for name in names:
            sc.setJobDescription(name if p == 0 else f"{name}#{p}")
            t0 = time.perf_counter()
            ANALYSES[name](star, DEFAULT).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - t0)
    sc.setJobDescription(None)
    conf = {k: spark.conf.get(k) for k in (
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
        "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold")}
    spark.stop()
    best = {n: round(min(v), 3) for n, v in runs.items()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    lines = line_count(sf_dir)
    total = round(sum(best.values()), 3)
    out = {
        "metric": "sum_of_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": best,
        "cold_total": round(sum(v[0] for v in runs.values()), 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "passes": passes,
        "order_lines": lines,
        "us_per_line_per_query": round(total / len(best) / lines * 1e6, 3) if lines else None,
        "shuffle_bytes": {k: v for k, v in shuffle_bytes(log_dir).items() if k in best},
        "conf": conf,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
