"""Rate limits, one-shot sessions and streams against plain folds."""

import random
from collections import deque
from dataclasses import replace

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from presence.config import DEFAULTS
from presence.operators import limits, reports, sessions
from presence.session import shared_folder
from presence.streaming import run, stateful, stateless
from presence.workload.attempts import LONG_TTL, judged_attempts
from presence.workload.streams import session_events

SF = "/root/testdata/sf0.001"


def brute(times, s):
    window, out = deque(), []
    short, long = int(s.burst_window_s * 1e6), int(s.sustained_window_s * 1e6)
    for t in times:
        while window and window[0] < t - long:
            window.popleft()
        ok = sum(x >= t - short for x in window) < s.burst and len(window) < s.sustained_limit
        if ok:
            window.append(t)
        out.append(ok)
    return out


def test_simultaneous():
    five = replace(DEFAULTS, burst=5)
    assert limits.Stamps(five).run(np.zeros(10, dtype=np.int64)).sum() == 5
    slow = replace(DEFAULTS, burst=1000, sustained_per_s=1.0)
    assert limits.Stamps(slow).run(np.zeros(65, dtype=np.int64)).sum() == 60
    assert replace(DEFAULTS, sustained_per_s=0.0).sustained_limit == 1


def test_fold_equals_brute():
    rng = random.Random(5)
    for _ in range(60):
        s = replace(
            DEFAULTS, burst=rng.randint(1, 6), burst_window_s=1.0, sustained_per_s=rng.randint(1, 12) / 10, sustained_window_s=10.0
        )
        times = sorted(rng.randint(0, 40) * 250_000 for _ in range(rng.randint(1, 200)))
        assert limits.Stamps(s).run(np.array(times)).tolist() == brute(times, s)


def requests(spark, seed, n=3000):
    """A hot key with a third of all rows, quiet keys, and bursts after gaps."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}"
        base = rng.choice([0, 100, 101, 400, 900]) if key != "hot" else rng.randint(0, 1000)
        rows.append((i, key, (base * 1_000_000 + rng.randint(0, 20_000_000))))
    df = spark.createDataFrame(rows, "id long, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    return rows, df


SMALL = replace(DEFAULTS, burst=3, burst_window_s=1.0, sustained_per_s=0.5, sustained_window_s=20.0)


def expected(rows, s):
    want = {}
    for key in {r[1] for r in rows}:
        own = sorted((r[2], r[0]) for r in rows if r[1] == key)
        want.update(zip([i for _, i in own], brute([t for t, _ in own], s)))
    return want


def test_rate_limit_batch(spark):
    rows, df = requests(spark, 1)
    got = {r["id"]: r["allowed"] for r in limits.rate_limit(df, "key", "ts", "id", SMALL).collect()}
    assert got == expected(rows, SMALL)


def test_rate_limit_mostly_settled(spark):
    rows, df = requests(spark, 2)
    for s in (
        replace(SMALL, burst=40, sustained_per_s=2.0),
        replace(SMALL, burst=2, burst_window_s=0.7, sustained_per_s=3.0),
        replace(SMALL, burst=2, burst_window_s=30.0, sustained_per_s=1.0),
    ):
        got = {r["id"]: r["allowed"] for r in limits.rate_limit(df, "key", "ts", "id", s).collect()}
        want = expected(rows, s)
        assert got == want and 0 < sum(want.values()) <= len(want)


def files(df, spark, order, parts):
    """The rows as several files in time order, read one per micro-batch."""
    folder = shared_folder(spark, "files")
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(folder)
    import glob
    import os

    for k, path in enumerate(sorted(glob.glob(f"{folder}/part-*"))):
        os.utime(path, (k + 1, k + 1))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_rate_limit_stream_over_batches(spark):
    rows, df = requests(spark, 3, 900)
    stream = files(df, spark, "us", 5)
    out = stateful.rate_limit_stream(stream, "key", "ts", "id", "1 second", SMALL)
    got = {r["id"]: r["allowed"] for r in run.drain(out, shared_folder(spark, "limits")).collect()}
    assert got == expected(rows, SMALL)


def test_session_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    flat = session_events(events).withColumn("us", F.unix_micros("ts"))
    # ids are issued once: keep each session's first creation
    first = F.min(F.when(~F.col("is_use"), F.col("us"))).over(Window.partitionBy("session_id"))
    flat = flat.withColumn("first", first).where(F.col("is_use") | (F.col("us") == F.col("first"))).drop("first")
    stream = files(flat, spark, "us", 6)
    out = run.drain(stateful.session_state(stream, "1 day", LONG_TTL), shared_folder(spark, "state"))
    got = {r["attempt_id"]: r["session_error"] for r in out.collect()}
    created = flat.where(~F.col("is_use")).groupBy("session_id").agg(
        F.min("ts").alias("created_at"), F.min("correlation_id").alias("correlation_id")
    )
    uses = flat.where("is_use").withColumnRenamed("ts", "attempted_at").drop("us", "is_use")
    batch = sessions.bind_correlation(
        sessions.consume_once(sessions.lookup_session(uses, created, LONG_TTL), LONG_TTL)
    )
    assert got == {r["attempt_id"]: r["session_error"] for r in batch.collect()} and got


def test_session_boundaries(spark):
    made = spark.createDataFrame([(1, 0, "c")], "session_id long, s long, correlation_id string").select(
        "session_id", F.timestamp_seconds("s").alias("created_at"), "correlation_id"
    )

    def outcome(*seconds):
        uses = spark.createDataFrame(
            [(i, 1, float(t), "c") for i, t in enumerate(seconds)],
            "attempt_id long, session_id long, t double, correlation_id string",
        ).withColumn("attempted_at", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
        done = sessions.bind_correlation(sessions.consume_once(sessions.lookup_session(uses, made)))
        return [r["session_error"] for r in done.orderBy("attempt_id").collect()]

    assert outcome(90) == [None]
    assert outcome(90.000001) == ["SESSION_EXPIRED"]
    assert outcome(241, 241.000001) == ["SESSION_EXPIRED", "SESSION_NOT_FOUND"]
    assert outcome(10, 10, 200) == [None, "SESSION_ALREADY_USED", "SESSION_ALREADY_USED"]
    assert outcome(-1) == ["SESSION_NOT_FOUND"]


def test_mismatch_burns_the_session(spark):
    made = spark.createDataFrame([(1, "c")], "session_id long, correlation_id string").withColumn(
        "created_at", F.timestamp_seconds(F.lit(0))
    )
    uses = spark.createDataFrame([(1, 1, "other"), (2, 1, "c")], "attempt_id long, session_id long, correlation_id string")
    uses = uses.withColumn("attempted_at", F.timestamp_seconds("attempt_id"))
    done = sessions.bind_correlation(sessions.consume_once(sessions.lookup_session(uses, made)))
    got = [r["session_error"] for r in done.orderBy("attempt_id").collect()]
    assert got == ["SESSION_CORRELATION_MISMATCH", "SESSION_ALREADY_USED"]


def verdicts(spark, transform=lambda f: f, **kwargs):
    bound, frames = judged_attempts(spark, SF)
    return sorted(
        (r["attempt_id"], r["verdict"], r["reason"], r["best_frame_seq"], r["frame_consistency_score"])
        for r in sessions.session_verdict(bound, transform(frames), **kwargs).collect()
    )


def test_frame_order_does_not_matter(spark):
    assert verdicts(spark) == verdicts(spark, lambda f: f.orderBy(F.rand(1)))


def test_scorer_sees_only_undecided_frames(spark):
    seen = {}

    def label(frames):
        seen["n"] = frames.count()
        return frames.select("attempt_id", "seq", F.col("kept").alias("pad_label"))

    late = verdicts(
        spark, lambda f: f.withColumn("kept", F.col("pad_label")).drop("pad_label"), label_frames=label
    )
    assert late == verdicts(spark)
    bound, frames = judged_attempts(spark, SF)
    assert 0 < seen["n"] < frames.count()


def test_oversized_attempt_is_refused_whole(spark):
    rows = [("a", q) for q in range(9)] + [("b", q) for q in (0, 1, 1)] + [("c", 0), ("d", -1), ("e", None)]
    df = spark.createDataFrame(rows, "attempt_id string, seq int")
    got = {r["attempt_id"]: r for r in sessions.gather_frames(df).collect()}
    assert {k: (r["shape_reject"], r["n_received"]) for k, r in got.items()} == {
        "a": ("FRAME_COUNT", 9), "b": ("DUPLICATE_SEQ", 3), "c": (None, 1), "d": ("NEGATIVE_SEQ", 1), "e": ("NEGATIVE_SEQ", 1),
    }
    assert {k for k, r in got.items() if r["frames"] is not None} == {"c"}


def test_malformed_attempts_do_not_use_the_session(spark):
    made = spark.createDataFrame([(1, "c")], "session_id long, correlation_id string").withColumn(
        "created_at", F.timestamp_seconds(F.lit(1000))
    )
    seqs = {1: [], 2: range(10), 3: [0, 1, 1, 2], 4: [-1, 0, 1, 2], 5: range(4), 6: range(4)}
    uses = spark.createDataFrame([(i, 1, "c") for i in seqs], "attempt_id long, session_id long, correlation_id string")
    uses = uses.withColumn("attempted_at", F.timestamp_seconds(F.col("attempt_id") + 1000))
    frames = spark.createDataFrame([(i, q) for i, qs in seqs.items() for q in qs], "attempt_id long, seq int")
    shaped = sessions.guard_shapes(uses, frames)
    done = sessions.bind_correlation(sessions.consume_once(sessions.lookup_session(shaped, made)))
    got = [(r["shape_reject"], r["session_error"], r["n_received"]) for r in done.orderBy("attempt_id").collect()]
    assert got == [
        ("FRAME_COUNT", None, 0), ("FRAME_COUNT", None, 10), ("DUPLICATE_SEQ", None, 4), ("NEGATIVE_SEQ", None, 4),
        (None, None, 4), (None, "SESSION_ALREADY_USED", 4),
    ]
    created = made.select("session_id", F.col("created_at").alias("ts"), F.lit(False).alias("is_use"),
                          F.lit(None).cast("long").alias("attempt_id"), "correlation_id", F.lit(None).cast("string").alias("shape_reject"))
    events = created.unionByName(
        shaped.select("session_id", F.col("attempted_at").alias("ts"), F.lit(True).alias("is_use"), "attempt_id", "correlation_id", "shape_reject")
    ).withColumn("us", F.unix_micros("ts"))
    out = run.drain(stateful.session_state(files(events, spark, "us", 3), "1 day"), shared_folder(spark, "shapes"))
    assert {r["attempt_id"]: r["session_error"] for r in out.collect()} == {5: None, 6: "SESSION_ALREADY_USED"}


def test_similarity_blocks_equal_brute(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    cls = ["x" if i % 3 else "y" for i in range(60)]
    df = spark.createDataFrame([(i, cls[i], v[i].tolist()) for i in range(60)], "id long, c string, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = {}
    for i in range(60):
        for j in range(i + 1, 60):
            pairs.setdefault(tuple(sorted((cls[i], cls[j]))), []).append(float(unit[i] @ unit[j]))
    for block in (7, 100):
        for r in reports.cross_file_similarity(df, "id", "c", "v", block).collect():
            p = pairs[r["class_a"], r["class_b"]]
            assert r["pairs"] == len(p)
            assert np.allclose([r["min_cos"], r["mean_cos"], r["max_cos"]], [min(p), np.mean(p), max(p)])


def test_replayed_batch_replaces_itself(spark):
    folder = shared_folder(spark, "split")
    write = stateless.split_batches("bad", f"{folder}/ok", f"{folder}/no")
    df = spark.createDataFrame([(1, None), (2, "X")], "id long, bad string")
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(f"{folder}/ok").count() == 1
    assert spark.read.parquet(f"{folder}/no").count() == 1


def test_late_uses_are_answered(spark, tmp_path):
    """Three arrivals; the last holds uses far behind the watermark."""
    import datetime

    from presence.streaming import run, stateful

    at = lambda m: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=m)
    fields = "session_id long, ts timestamp, is_use boolean, attempt_id long, correlation_id string"
    arrivals = [
        [(1, at(0), False, None, "a"), (2, at(0), False, None, "b"), (1, at(1), True, 10, "a")],
        [(3, at(600), False, None, "c"), (3, at(601), True, 11, "c")],
        [(1, at(1), True, 12, "a"), (2, at(1), True, 13, "b"), (2, at(2), True, 14, "b"), (9, at(1), True, 15, "x"), (3, at(603), True, 16, "c")],
    ]
    folder = str(tmp_path / "in")
    for rows in arrivals:
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run.drain(stateful.session_answers(events), str(tmp_path / "answers"), idle_batches=False)
    got = {r.attempt_id: r.session_error for r in out.collect()}
    assert got == {
        10: None, 11: None, 12: "SESSION_ALREADY_USED", 13: None, 14: "SESSION_ALREADY_USED", 15: "SESSION_NOT_FOUND", 16: "SESSION_ALREADY_USED",
    }
