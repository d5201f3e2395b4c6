"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose input and
cores. Each query runs once to warm up and then three times; its figure is
the median. Results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from presence.session import apply_recommended  # noqa: E402
from presence.workload import REGISTRY  # noqa: E402
from presence.workload.views import IMAGE_WIDTH  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "verdict_counts",
    "pad_verdict",
    "fuse_verdict",
    "weighted_signal_sum",
    "geometry_gate",
    "crop_window",
    "ip_allowlist",
    "replay_guard",
    "parse_document_reply",
    "best_detection",
    "attach_detection",
    "ensemble_vote",
    "consume_once",
    "session_verdict",
    "rate_limit",
    "rate_limit_by_address",
    "lbp",
    "color",
    "sharpness",
    "jpeg",
    "moire",
    "fft",
    "recapture",
    "qc_metrics",
    "apcer_bpcer",
    "threshold_sweep",
    "latency_summary",
    "verdict_monitor",
    "cross_file_similarity",
    "score_model",
    "write_audit_log",
]
ONCE = ["rate_limit_stream", "session_state", "pad_check", "pad_requests", "judge_attempts"]


def timed(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("presence-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = apply_recommended(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        timed(spark, name)
        seconds[name] = round(statistics.median(timed(spark, name) for _ in range(RUNS)), 3)
    for name in ONCE:
        seconds[name] = round(timed(spark, name), 3)

    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    images = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr(
        "count(*) as n", f"sum(greatest(16, ceil(n_chars / {IMAGE_WIDTH})) * {IMAGE_WIDTH}) as px"
    ).first()
    attempts = REGISTRY["session_verdict"].build(spark, SF_DIR).count()
    signal_s = sum(seconds[n] for n in ("lbp", "color", "sharpness", "jpeg", "moire", "fft", "recapture"))
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "events_per_s_verdict": round(events / seconds["verdict_counts"]),
                "images_per_s_seven_signals": round(images["n"] / signal_s),
                "pixels_per_s_seven_signals": round(images["px"] / signal_s),
                "images_per_s_photo_plan": round(images["n"] / seconds["pad_check"]),
                "sessions_per_s": round(attempts / seconds["session_verdict"]),
                "limiter_rows_per_s": round(events / seconds["rate_limit"]),
                "limiter_stream_rows_per_s": round(events / seconds["rate_limit_stream"]),
                "session_stream_rows_per_s": round(events / seconds["session_state"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
