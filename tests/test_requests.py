"""Request files to decisions: one plan, bad rows kept, records replayable."""

import base64
import json
import os

import numpy as np
import pytest

from presence.plans import pad
from presence.sources import codecs, scan
from presence.workload import requests as written
from presence.workload.requests import MODELS, SETTINGS


def ppm(h, w, level):
    return f"P6 {w} {h} 255\n".encode() + bytes([level]) * (h * w * 3)


def line(key, photo, **more):
    text = photo if isinstance(photo, str) or photo is None else base64.b64encode(photo).decode()
    return json.dumps({"correlation_id": f"c{key}", "transaction_ref": f"t{key}", "face_photo": text} | more)


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("requests")
    lines = [
        line(1, ppm(60, 50, 40)), line(2, ppm(60, 50, 120)), line(3, ppm(60, 50, 119)), line(4, b"junk"), line(5, "a"),
        line(6, None), line(7, ppm(60, 50, 90), transaction_type="refund"), '{"broken', line(8, ppm(601, 1, 90)), line(9, b"P6 9 9 255\n12"),
    ]
    (folder / "requests.json").write_text("\n".join(lines))
    return str(folder)


def test_every_record_gets_its_row(spark, requests):
    got = {r.correlation_id: r for r in pad.pad_requests(scan.scan_requests(spark, requests), MODELS, s=SETTINGS).collect()}
    assert len(got) == 10
    refused = {k: r.input_reject for k, r in got.items() if r.input_reject}
    assert refused == {
        "c4": "DECODE_ERROR", "c5": "INVALID_BASE64", "c6": "MISSING_FIELD", "c7": "TRANSACTION_TYPE", None: "MALFORMED",
        "c8": "DIMENSIONS_TOO_LARGE", "c9": "DECODE_ERROR",
    }
    assert all(r.verdict is None and r.reason is None and not r.save_frame for r in got.values() if r.input_reject)
    assert [got[k].reason for k in ("c1", "c2", "c3")] == ["NO_FACE", "PASSIVE_PAD_SPOOF", "DOCUMENT_PHOTO"]
    assert got["c2"].score == 1.0 and got["c2"].signal_scores.recapture == 1.0 and got["c3"].nn_label is None


def test_one_plan_without_exchange_or_action(spark, requests):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tracker = spark.sparkContext.statusTracker()
        before = len(tracker.getJobIdsForGroup(None))
        out = pad.pad_requests(scan.scan_requests(spark, requests), MODELS, s=SETTINGS)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(tracker.getJobIdsForGroup(None)) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "Join" not in plan
    # decode, detect, measure: once each
    assert plan.count("ArrowEvalPython") == 3


def test_gate_switched_off(spark, requests):
    from dataclasses import replace

    off = replace(SETTINGS, geometry_check=False)
    got = {r.correlation_id: r for r in pad.pad_requests(scan.scan_requests(spark, requests), MODELS, s=off).collect()}
    assert got["c3"].reason == "PASSIVE_PAD_SPOOF" and not got["c3"].geometry_ran


def test_netpbm():
    decode = codecs.netpbm()
    assert decode(b"P5 2 1 255\n\x01\x02").tolist() == [[[1], [2]]]
    assert decode(b"P6\n# made by hand\n1 1\n255\n\x01\x02\x03").tolist() == [[[3, 2, 1]]]
    assert decode(b"P6 1 1 65535\n123456") is None and decode(b"") is None and decode(b"P5 0 0 255\n") is None
    assert isinstance(decode(b"P5 3 2 255\n123456")[0, 0, 0], np.uint8)


def test_request_files_are_small_and_whole(spark, tmp_path, monkeypatch):
    """Photos take little disk, no file grows with the data, no request is lost."""
    rows = [(k, 50 + k) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(written, "PER_FILE", 30)
    folder = written.request_folder(spark, str(tmp_path)).removeprefix("file:")
    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-")]
    texts = [[r.value for r in spark.read.text(f).collect()] for f in files]
    assert max(map(len, texts)) <= 30 and sum(map(len, texts)) == 400
    assert sum(map(os.path.getsize, files)) < sum(len(t) for lines in texts for t in lines) / 5
    got = scan.scan_requests(spark, folder).select("correlation_id").collect()
    assert sorted(r[0] for r in got if r[0]) == sorted(f"c{k}" for k in range(400) if k % 13)
