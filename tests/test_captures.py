"""Whole capture sessions from frames to verdict, one attempt per outcome."""

import base64
import datetime

import pytest

from presence.plans.session import judge_attempts
from presence.workload.captures import HEIGHT, MODELS, SETTINGS, WIDTH

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def photo(faces=1, yaw=0, amp=3, level=120, edge=62, ear=30, spoofed=0, boom=0, took=1):
    facts = (faces, yaw + 40, amp, level // 3, edge - 50, ear, 93 * spoofed, boom, took)
    body = bytes(f + 33 for f in facts) + b"d" * (HEIGHT * WIDTH - len(facts))
    return base64.b64encode(f"P5 {WIDTH} {HEIGHT} 255\n".encode() + body).decode()


def frames(*changes):
    out = [{}, {"yaw": 30}, {"yaw": -30}, {}, {"ear": 10}]
    for seq, change in changes:
        out[seq] = change if isinstance(change, str) else out[seq] | change
    return [(i, f if isinstance(f, str) else photo(**f)) for i, f in enumerate(out)]


JUNK = base64.b64encode(b"junk").decode()
CASES = {
    # name: (frames, steps, expected verdict, reason, valid frames)
    "live": (frames(), ["TURN_LEFT", "BLINK"], "live", None, 5),
    "no_blink": (frames((4, {"ear": 30})), ["BLINK"], "spoof", "CHALLENGE_FAILED", 5),
    "nod": (frames(), ["NOD"], "incomplete", "ACTIVE_CHALLENGE_NOT_IMPLEMENTED", 5),
    "one_undecodable": (frames((0, JUNK)), ["TURN_LEFT"], "live", None, 4),
    "two_undecodable": (frames((0, JUNK), (3, JUNK)), ["TURN_LEFT"], "incomplete", "LOW_QUALITY_FRAMES", 3),
    "no_base64": (frames((2, "a")), ["TURN_LEFT"], "incomplete", "INTERNAL_ERROR", 0),
    "model_fails": (frames((2, {"boom": 1})), ["TURN_LEFT"], "incomplete", "INTERNAL_ERROR", 0),
    "slow": (frames(*[(i, {"took": 20}) for i in range(5)]), ["TURN_LEFT"], "incomplete", "TIMEOUT", 0),
    "document": (frames((3, {"edge": 80})), ["TURN_LEFT"], "spoof", "DOCUMENT_PHOTO", 5),
    "swap": (frames((3, {"level": 225})), ["TURN_LEFT"], "spoof", "IDENTITY_SWAP_MID_SESSION", 5),
    "passive": (frames((3, {"spoofed": 1})), ["TURN_LEFT"], "spoof", "PASSIVE_PAD_SPOOF", 5),
    "profile": (frames(*[(i, {"yaw": 15}) for i in (0, 3, 4)]), ["TURN_LEFT"], "incomplete", "NO_FRONTAL_REFERENCE", 5),
    "unknown": (frames(), None, "incomplete", "SESSION_NOT_FOUND", 0),
    "refused": (frames()[:1] * 2, ["TURN_LEFT"], None, None, 0),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    attempts = [(n, n, "c", START + datetime.timedelta(seconds=5), None, f) for n, (f, *_) in CASES.items()]
    # the refused request leaves its session to a later, sound attempt
    attempts.append(("later", "refused", "c", START + datetime.timedelta(seconds=9), None, frames()))
    table = spark.createDataFrame(
        attempts, "attempt_id string, session_id string, correlation_id string, attempted_at timestamp, request_reject string, frames array<struct<seq:int, base64:string>>"
    ).repartition(3)
    known = [(n, START, "c", steps) for n, (_, steps, *_) in CASES.items() if steps]
    sessions = spark.createDataFrame(known, "session_id string, created_at timestamp, correlation_id string, steps array<string>")
    return judge_attempts(table, sessions, MODELS, SETTINGS)


def test_outcomes(verdicts):
    got = {r.attempt_id: r for r in verdicts.collect()}
    for name, (_, _, verdict, reason, valid) in CASES.items():
        assert (got[name].verdict, got[name].reason, got[name].n_frames_valid or 0) == (verdict, reason, valid), name
    assert got["refused"].shape_reject == "DUPLICATE_SEQ" and got["later"].verdict == "live"
    live = {f.seq: f for f in got["live"].frame_signals}
    assert got["live"].best_frame_seq == 0 and live[1].metrics.pose_yaw == 30.0 and live[0].metrics.sharpness == 144.0
    assert [f.label for f in got["passive"].frame_signals] == ["no_face"] * 3 + ["spoof", "no_face"]
    assert got["one_undecodable"].frame_signals[0].reason == "DECODE_ERROR"
    assert got["document"].frame_signals[3].document_ratio == pytest.approx(0.3333) and got["document"].frame_signals[3].label is None
    assert got["no_base64"].frame_signals is None and got["slow"].frame_consistency_score == -1.0


def test_frame_bytes_are_not_exchanged(verdicts):
    plan = verdicts._jdf.queryExecution().optimizedPlan().toString()
    gathering = plan[: plan.index("MapInArrow")] if "MapInArrow" in plan else plan
    assert "Aggregate" in gathering
    for line in plan.splitlines():
        if "Aggregate" in line or "Join" in line:
            assert "base64" not in line and "data#" not in line and "aligned" not in line
