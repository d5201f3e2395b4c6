"""Hand-built cases: boundaries, malformed input, branch order."""

import math

import pytest
from pyspark.sql import functions as F

from presence.config import DEFAULTS, Settings
from presence.functions import text, vector
from presence.functions.numeric import ramp
from presence.operators import gates, scores, sessions

SIGNALS = "struct<fft:double,lbp:double,color:double,moire:double,sharpness:double,jpeg:double,recapture:double>"

# nn_label, nn_score, recapture, spoof_probability, lbp, moire -> label, score
FUSE = [
    (1, 0.9997, 0.541, 0.3035, 0.3, 0.0, "spoof", 0.541),
    (1, 0.9909, 0.6309, 0.3589, 0.3, 0.0, "spoof", 0.6309),
    (0, 0.5542, 0.3148, 0.1567, 0.0, 0.0, "real", 1 - 0.1567),
    (0, 0.95, 0.3148, 0.1567, 0.0, 0.0, "spoof", 0.95),
    (1, 0.99, 0.9, 0.5, 0.0, 0.0, "real", 0.99),
    (1, 0.95, 1.0, 0.61, 0.0, 0.0, "spoof", 0.61),
    (1, 0.65, 0.2, 0.4, 0.0, 0.0, "spoof", 0.4),
    (1, 0.55, 0.2, 0.15, 0.0, 0.0, "spoof", 0.22),
    (1, 0.55, 0.2, 0.1, 0.0, 0.0, "real", 0.55),
    (1, 0.9, 0.5, 0.3, 0.0, 0.15, "spoof", 0.5),
    (2, 0.6, None, 0.1, None, None, "real", 0.9),
    (1, 0.9, 0.4999, 0.3, 0.6, 0.0, "real", 0.9),
]


def test_fuse(spark):
    rows = [
        (i, label, nn, p, (0.0, lbp, 0.0, moire, 0.0, 0.0, rec))
        for i, (label, nn, rec, p, lbp, moire, _, _) in enumerate(FUSE)
    ]
    df = spark.createDataFrame(
        rows, f"i int, nn_label int, nn_score double, spoof_probability double, signal_scores {SIGNALS}"
    )
    got = {r["i"]: (r["label"], r["score"]) for r in gates.fuse_verdict(df).collect()}
    for i, case in enumerate(FUSE):
        assert got[i][0] == case[6], case
        assert got[i][1] == pytest.approx(case[7]), case


def test_signal_sum_drops_missing_recapture(spark):
    df = spark.createDataFrame(
        [(0.3, 0.6, 0.0, 0.0, 0.0, 0.1, 0.5), (0.3, 0.6, 0.0, 0.0, 0.0, 0.1, None), (None,) * 7],
        "fft double, lbp double, color double, moire double, sharpness double, jpeg double, recapture double",
    )
    full, part, none = scores.weighted_signal_sum(df).collect()
    assert none["spoof_probability"] == 0.0 and none["signals_triggered"] == []
    assert full["spoof_probability"] == pytest.approx(0.34)
    assert part["spoof_probability"] == pytest.approx(0.115 / 0.55, abs=5e-5)
    assert full["signals_triggered"] == ["fft", "lbp", "recapture"]
    assert part["signals_triggered"] == ["fft", "lbp"]


# frame_w, frame_h, w, h -> ran, document, area ratio
GEOMETRY = [
    (993, 1275, 748, 799, True, True, 0.4721),
    (993, 1275, 611, 668, True, True, 0.3224),
    (960, 1280, 484, 545, True, False, 0.2147),
    (0, 1280, 484, 545, False, False, 0.0),
    (960, 1280, -4, 545, False, False, 0.0),
    (960, 1280, None, 545, False, False, 0.0),
]


def test_geometry(spark):
    rows = [(i, fw, fh, w, h) for i, (fw, fh, w, h, *_) in enumerate(GEOMETRY)]
    df = spark.createDataFrame(rows, "i int, frame_w int, frame_h int, w int, h int")
    for r in gates.geometry_gate(df).collect():
        ran, document, area = GEOMETRY[r["i"]][4:]
        assert (r["geometry_ran"], r["is_document"]) == (ran, document)
        assert r["face_area_ratio"] == pytest.approx(area)


def test_geometry_thresholds_are_inclusive(spark):
    df = spark.createDataFrame([(200, 200, 100, 100)], "frame_w int, frame_h int, w int, h int")
    assert gates.geometry_gate(df, Settings(face_ratio_reject=0.25)).first()["is_document"]
    assert gates.geometry_gate(df, width_threshold=0.5).first()["is_document"]
    assert not gates.geometry_gate(df, width_threshold=0.51).first()["is_document"]


def test_crop_window_stays_inside(spark):
    df = spark.createDataFrame(
        [(0, 100, 80, -10, -5, 30, 30), (1, 100, 80, 80, 60, 30, 30), (2, 100, 80, 40, 30, 20, 20)],
        "i int, frame_w int, frame_h int, x int, y int, w int, h int",
    )
    got = {r["i"]: (r["ltx"], r["lty"], r["rbx"], r["rby"]) for r in gates.crop_window(df, 2.0).collect()}
    assert got[0] == (0, 0, 60, 60)
    assert got[1] == (39, 19, 99, 79)
    assert got[2] == (30, 20, 70, 60)


def test_quality_order(spark):
    rows = [
        (0, False, 1, 100.0, 90.0, 120.0, "NO_FACE"),
        (1, True, 2, 10.0, 90.0, 120.0, "MULTIPLE_FACES"),
        (2, True, 1, 59.9, 1.0, 120.0, "TOO_SMALL"),
        (3, True, 1, 60.0, 39.9, 5.0, "BLURRY"),
        (4, True, 1, 60.0, 40.0, 39.9, "TOO_DARK"),
        (5, True, 1, 60.0, 40.0, 235.1, "TOO_BRIGHT"),
        (6, True, 1, 60.0, 40.0, 235.0, None),
    ]
    df = spark.createDataFrame(
        rows,
        "i int, face_detected boolean, n_faces int, face_edge double, sharpness double, brightness double, want string",
    )
    for r in gates.frame_qc(df).collect():
        assert r["qc_reason"] == r["want"] and r["qc_valid"] == (r["want"] is None)


REPLAY = [
    ("1000", None), ("880", None), ("1120", None), ("879.9", "OUTSIDE_WINDOW"), ("1120.1", "OUTSIDE_WINDOW"),
    ("", "MISSING"), (None, "MISSING"), ("abc", "INVALID"), ("12d", "INVALID"), (" 1000 ", None), ("1_000", None),
    ("1e3", None), ("1__0", "INVALID"), ("1e999", "INVALID"), ("   ", "INVALID"),
    *[(t, "INVALID") for t in ("nan", "NaN", "+nan", "-nan", "NAN", "inf", "-inf", "Infinity")],
]


def test_replay_guard(spark):
    df = spark.createDataFrame([(t, w) for t, w in REPLAY], "header string, want string")
    for r in gates.replay_guard(df, "header", F.lit(1000)).collect():
        assert r["replay_reject"] == r["want"], r["header"]


PROXY = [
    ("127.0.0.1", "6.6.6.6, 10.1.2.3", "10.1.2.3"),
    ("127.0.0.1", "10.1.2.3, nonsense", "127.0.0.1"),
    ("127.0.0.1", None, "127.0.0.1"),
    ("127.0.0.1", " , ,", "127.0.0.1"),
    ("::1", "2001:db8::7", "2001:db8::7"),
    ("8.8.8.8", "10.1.2.3", "8.8.8.8"),
    ("testclient", "10.1.2.3", "testclient"),
    (None, "10.1.2.3", "0.0.0.0"),
]


def test_effective_ip(spark):
    df = spark.createDataFrame(PROXY, "peer string, xff string, want string")
    for r in gates.resolve_client(df, "peer", "xff", Settings(trust_proxy_headers=True)).collect():
        assert r["client_ip"] == r["want"]
    for r in gates.resolve_client(df, "peer", "xff").collect():
        assert r["client_ip"] == (r["peer"] or "0.0.0.0")


def test_allowlist(spark):
    cases = {
        "127.9.9.9": True, "192.168.0.255": True, "192.168.1.0": False, "10.255.0.1": True, "172.31.255.255": True,
        "172.32.0.0": False, "8.8.8.8": False, "::1": False, "2001:db8::1": False, "testclient": True,
        "010.0.0.1": True, "256.1.1.1": True, "1.2.3": True,
    }
    df = spark.createDataFrame(list(cases.items()), "client_ip string, want boolean")
    for r in gates.ip_allowlist(df).collect():
        assert r["admitted"] == r["want"], r["client_ip"]


REPLIES = [
    ("LABEL=STUDIO_BACKGROUND CONFIDENCE=90", True, 0.9),
    ("LABEL=REAL_BACKGROUND CONFIDENCE=80", False, 0.2),
    ("label: studio_backdrop confience: 85", True, 0.85),
    ("LABEL=STUDIO_BACKGROUND", True, 0.5),
    ("it looks like a REAL_BACKGROUND", False, 0.5),
    ("LABEL=STUDIO_BACKDROP CONFIDENCE=250", True, 1.0),
    ("STUDIO_BACKDROP, not REAL_BACKGROUND. Conf: 7", True, 0.07),
    ("cannot tell", None, None),
    ("", None, None),
]


def test_document_replies(spark):
    df = spark.createDataFrame(REPLIES, "reply string, want boolean, conf double")
    for r in text.parse_document_replies(df, "reply").collect():
        assert r["is_document"] == r["want"] and r["ran"] == (r["want"] is not None)
        assert r["confidence"] == pytest.approx(r["conf"]) if r["conf"] is not None else r["confidence"] is None


def test_base64_lenient(spark):
    df = spark.createDataFrame([("aGk=", "hi"), ("aG\nk=", "hi"), ("abcde", None), ("", "")], "e string, want string")
    for r in df.withColumn("d", text.decode_payload(F.col("e"))).collect():
        assert (None if r["d"] is None else bytes(r["d"]).decode()) == r["want"]


def _frames(spark, frames, steps):
    rows = [("a", q, yaw, ear, steps) for q, yaw, ear in frames]
    df = spark.createDataFrame(
        rows, "attempt_id string, seq int, yaw double, min_ear double, steps array<string>"
    ).withColumn("qc_reason", F.lit(None).cast("string"))
    wide = sessions.gather_frames(df).withColumn("steps", F.array(*[F.lit(s) for s in steps]))
    checked = sessions.challenge_check(sessions.valid_frames(), F.col("steps"))
    r = wide.select(checked["challenge_reason"].alias("reason"), checked["missing_steps"].alias("missing")).first()
    return r["reason"], r["missing"]


CHALLENGES = [
    ([0.0, 25.0], ["NOD"], "UNSUPPORTED_STEP"),
    ([35.0, 40.0], ["TURN_LEFT"], "NO_FRONTAL_REFERENCE"),
    ([0.0, 25.0], ["TURN_LEFT"], None),
    ([0.0, 20.0], ["TURN_LEFT"], None),
    ([10.0, -20.0], ["TURN_RIGHT"], None),
    ([0.0, 25.0], ["TURN_RIGHT"], "STEP_NOT_DETECTED"),
    ([-2.2, -1.2, 3.9, 0.4], ["TURN_RIGHT", "TURN_LEFT"], "STEP_NOT_DETECTED"),
    ([0.0, 25.0, 0.0, -25.0], ["TURN_RIGHT", "TURN_LEFT"], None),
]


@pytest.mark.parametrize("yaws,steps,want", CHALLENGES)
def test_challenge(spark, yaws, steps, want):
    reason, missing = _frames(spark, [(i, y, None) for i, y in enumerate(yaws)], steps)
    assert reason == want
    if want == "STEP_NOT_DETECTED":
        assert missing == steps


def test_blink_compares_rounded(spark):
    assert _frames(spark, [(0, 0.0, 0.2004), (1, 0.0, None)], ["BLINK"])[0] is None
    assert _frames(spark, [(0, 0.0, 0.2006), (1, 0.0, None)], ["BLINK"])[0] == "STEP_NOT_DETECTED"
    assert _frames(spark, [(0, 0.0, None)], ["BLINK"])[0] == "STEP_NOT_DETECTED"


def test_eye_ratio(spark):
    def eye(lift):
        return [(0, 0), (1, lift), (2, lift), (3, 0), (2, -lift), (1, -lift)]

    pts = [(0.0, 0.0)] * 36 + eye(0.9) + eye(0.15) + [(0.0, 0.0)] * 20
    df = spark.createDataFrame([([[float(a), float(b)] for a, b in pts],)], "p array<array<double>>")
    r = df.select(vector.min_ear(F.col("p")).alias("m"), vector.eye_aspect_ratio(F.col("p"), vector.RIGHT_EYE).alias("r")).first()
    assert r["r"] == pytest.approx(0.6) and r["m"] == pytest.approx(0.1)


IDENTITY = [
    ([], False, -1.0),
    ([[1.0, 0.0, 0.0]], True, 1.0),
    ([[1.0, 0.0, 0.0]] * 3, True, 1.0),
    ([[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], False, 0.0),
    ([[1.0, 0.0, 0.0], [0.4, math.sqrt(1 - 0.16), 0.0]], True, 0.4),
]


@pytest.mark.parametrize("vectors,passed,low", IDENTITY)
def test_identity(spark, vectors, passed, low):
    rows = [("a", i, v, None) for i, v in enumerate(vectors)] or [("a", 0, [0.0], "NO_FACE")]
    df = spark.createDataFrame(rows, "attempt_id string, seq int, embedding array<double>, qc_reason string")
    wide = sessions.gather_frames(df).withColumns(
        {**sessions.frame_counts(), **sessions.identity_consistency(sessions.valid_frames())}
    )
    r = wide.withColumns(sessions.identity_outcome()).first()
    assert r["identity_passed"] == passed and r["min_similarity"] == pytest.approx(low)


def test_ramp(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 0.5), (4.0, 0.0), (9.0, 0.0)], "x double, want double")
    for r in df.withColumn("r", ramp(F.col("x"), 2.0, 4.0)).collect():
        assert r["r"] == pytest.approx(r["want"])


def test_challenge_steps(spark):
    df = spark.range(500).withColumn("steps", text.challenge_steps(F.col("id"), "A, B ,C", 2))
    rows = [tuple(r["steps"]) for r in df.collect()]
    assert all(len(set(r)) == 2 for r in rows) and len(set(rows)) == 6
    capped = spark.range(5).select(text.challenge_steps(F.col("id"), "A,B", 9, random=True).alias("s"))
    assert all(sorted(r["s"]) == ["A", "B"] for r in capped.collect())


def test_audit_holds_no_pixels(spark):
    from presence.sources import sinks

    df = spark.createDataFrame(
        [("c", "sale", "r", "live", None, 0.91239, 1.26, False, None, None, None, b"PIXELS")],
        "correlation_id string, transaction_type string, transaction_ref string, verdict string, reason string, "
        f"score double, processing_ms double, save_frame boolean, signal_scores {SIGNALS}, nn_label int, nn_score double, data binary",
    ).withColumn("ts", F.timestamp_seconds(F.lit(0)))
    line = sinks.pad_audit_lines(df).first()["value"]
    assert line == (
        '{"timestamp":"1970-01-01T00:00:00+0000","correlation_id":"c","transaction_type":"sale","transaction_ref":"r",'
        '"verdict":"live","reason":null,"score":0.9124,"model_version":"unversioned","processing_ms":1.3,"save_frame":false}'
    )


def test_defaults():
    assert DEFAULTS.sustained_limit == 300 and DEFAULTS.session_retention_s == 241.0
