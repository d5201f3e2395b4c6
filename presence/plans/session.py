"""Capture sessions from request file to verdict.

Frames are judged row by row where their bytes are: decoded, analysed,
measured, embedded and scored before anything is exchanged. What leaves a
task is one small struct per frame; the frames of an attempt, at most
``max_frames``, meet in one array, and the session's state decides.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.config import DEFAULTS, Settings
from presence.functions import text, vector
from presence.operators import gates, measures, scoring, sessions
from presence.plans import pad


@dataclass(frozen=True)
class SessionModels:
    """Injected models. ``analyser`` maps an image to None or a dict: ``faces``,
    ``det_score``, ``box`` (x1, y1, x2, y2), ``yaw``, ``pitch``, ``landmarks``
    (68 points or None) and ``aligned`` (the face warped to a square BGR
    crop); a replayed analyser may say how long it took (``took_ms``).
    ``embedder`` maps stacked crops to vectors; ``photo`` scores frames alone.
    """

    decoder: Callable[[], Callable[[bytes], np.ndarray | None]]
    analyser: Callable[[], Callable[[np.ndarray], dict | None]]
    embedder: Callable[[], scoring.Predict]
    photo: pad.Models


SEEN = (
    "fault string, took_ms double, faces int, det_score double, x1 double, y1 double, x2 double, y2 double, yaw double, "
    "pitch double, landmarks array<array<double>>, side int, aligned binary, sharpness double, brightness double"
)
_FIELDS = [f.split()[0] for f in SEEN.split(", ")]


def analysed(data, h, w, factory):
    """Struct SEEN of each frame; an analyser that raises is a fault of its
    row, no face is ``faces`` 0. Sharpness and brightness are the aligned
    crop's Laplacian variance and mean."""

    def make():
        analyse = factory()

        def one(raw, rows, cols) -> dict:
            started = time.perf_counter()
            try:
                face = analyse(measures.bgr_of(raw, int(rows), int(cols)))
            except Exception as error:  # noqa: BLE001 - a model may raise anything
                return {"fault": type(error).__name__, "took_ms": (time.perf_counter() - started) * 1000}
            if face is None:
                return {"faces": 0, "took_ms": (time.perf_counter() - started) * 1000}
            crop = np.ascontiguousarray(face["aligned"], np.uint8)
            lap, _, _, mean = (v[0] for v in measures.detail(measures.luma(crop[None])))
            points = face.get("landmarks")
            return {
                "took_ms": face.get("took_ms", (time.perf_counter() - started) * 1000), "faces": face["faces"], "det_score": face["det_score"],
                **dict(zip(("x1", "y1", "x2", "y2"), map(float, face["box"]), strict=True)), "yaw": face["yaw"], "pitch": face["pitch"],
                "landmarks": None if points is None else [list(map(float, p)) for p in points], "side": crop.shape[0], "aligned": crop.tobytes(),
                "sharpness": lap, "brightness": mean,
            }

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            rows = [{} if raw is None else one(raw, r, c) for raw, r, c in zip(frame["data"], frame["h"], frame["w"], strict=True)]
            out = pd.DataFrame([{k: x.get(k) for k in _FIELDS} for x in rows], columns=_FIELDS)
            return out.astype({"faces": "Int32", "side": "Int32", **{k: "Float64" for k in ("took_ms", "det_score", "x1", "y1", "x2", "y2", "yaw", "pitch", "sharpness", "brightness")}})

        return work

    udf = measures.per_row(measures.iterated(make), SEEN)
    return udf(F.struct(data.alias("data"), h.alias("h"), w.alias("w")))


def embedded(aligned, side, factory):
    """Unit vectors of square BGR crops of one size; NULL where there is none."""

    def make():
        predict = factory()

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            out: list = [None] * len(frame)
            some = [i for i, raw in enumerate(frame["aligned"]) if raw is not None]
            for k in range(0, len(some), measures.STACK):
                part = some[k : k + measures.STACK]
                stack = np.stack([np.frombuffer(frame["aligned"].iloc[i], np.uint8).reshape(int(frame["side"].iloc[i]), -1, 3) for i in part])
                v = np.asarray(predict((stack.transpose(0, 3, 1, 2) / 255.0 - 0.5) / 0.5), float)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                for i, x in zip(part, v / np.where(norm < vector.MIN_NORM, 1.0, norm), strict=True):
                    out[i] = x.tolist()
            return pd.DataFrame({"v": out})

        return work

    return measures.per_row(measures.iterated(make), "v array<double>")(F.struct(aligned.alias("aligned"), side.alias("side")))["v"]


def frame_stage(frames: DataFrame, models: SessionModels, s: Settings = DEFAULTS) -> DataFrame:
    """Rows of (attempt columns, ``seq``, ``base64``) with every layer's
    outcome on the frame and without its bytes. Rows whose ``open`` is false
    are not looked at. Text that is not base64 is a fault of the attempt; a
    payload that is too large or no image is a frame of reason DECODE_ERROR."""
    keep = [c for c in frames.columns if c not in ("base64", "open")]
    payload = text.decode_payload(F.when(F.col("open"), F.col("base64")))
    rows = frames.withColumn("_payload", payload).drop("base64")
    rows = rows.withColumn("_bad", F.col("open") & F.col("_payload").isNull())
    small = F.octet_length("_payload") <= s.max_payload_bytes
    rows = rows.withColumn("_image", measures.decoded(F.when(small, F.col("_payload")), models.decoder)).drop("_payload")
    rows = gates.guard_dimensions(rows.withColumns({c: F.col(f"_image.{c}") for c in ("frame_h", "frame_w")}), "frame_h", "frame_w", s)
    rows = rows.withColumn("data", F.when(F.col("dimension_reject").isNull(), F.col("_image.data"))).drop("_image")
    rows = rows.withColumn("_seen", analysed(F.col("data"), F.col("frame_h"), F.col("frame_w"), models.analyser))
    rows = rows.withColumns({c: F.col(f"_seen.{c}") for c in _FIELDS}).drop("_seen")
    found = F.coalesce(F.col("faces") > 0, F.lit(False))
    rows = rows.withColumns(
        {
            "face_detected": found,
            "n_faces": F.col("faces"),
            "face_edge": F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")),
            "box": F.struct("x1", "y1", "x2", "y2"),
            "min_ear": vector.min_ear(F.col("landmarks")),
        }
    )
    rows = gates.geometry_gate(gates.bbox_xyxy_to_xywh(rows), s)
    hit = F.col("is_document") if s.geometry_check else F.lit(False)
    area = F.try_divide(F.col("w").cast("double") * F.col("h"), F.col("frame_w").cast("double") * F.col("frame_h"))
    rows = gates.frame_qc(rows, s).withColumns(
        {
            "fault": F.when(F.col("_bad"), F.lit("payload")).otherwise(F.col("fault")),
            "is_document": hit,
            "area_ratio": area,
            "qc_reason": F.when(F.col("open") & F.col("data").isNull(), F.lit("DECODE_ERROR")).otherwise(F.col("qc_reason")),
        }
    )
    usable = F.col("open") & F.col("qc_reason").isNull() & F.col("fault").isNull()
    rows = rows.withColumn("embedding", embedded(F.when(usable, F.col("aligned")), F.col("side"), models.embedder))
    # the photo plan names its own box and outcome: what is known goes in one struct
    known = ("qc_reason", "qc_metrics", "is_document", "area_ratio", "yaw", "min_ear", "sharpness", "embedding", "fault", "took_ms")
    shut = F.when(~(usable & ~F.col("is_document")), F.lit("CLOSED"))
    photo = rows.select(*keep, F.struct(*known).alias("_frame"), "frame_h", "frame_w", "data", shut.alias("size_reject"))
    scored = pad.pad_decisions(photo, models.photo, s=replace(s, geometry_check=False))
    return scored.select(*keep, "_frame.*", F.col("label").alias("pad_label"), F.col("score").alias("pad_score"))


ATTEMPT = ("attempt_id", "session_id", "correlation_id", "attempted_at", "shape_reject", "n_received")


def judge_attempts(attempts: DataFrame, sessions_: DataFrame, models: SessionModels, s: Settings = DEFAULTS) -> DataFrame:
    """Verdict per scanned attempt (``attempt_id``, ``attempted_at``, the ids,
    nested ``frames`` of ``seq`` and ``base64``, ``request_reject``).

    Refused requests keep their row with ``shape_reject`` and no verdict, and
    use no session. Frame bytes are never exchanged: an attempt's frames are
    exploded, judged and gathered again as small structs.
    """
    shaped = gates.guard_attempt_shape(attempts.withColumn("_seqs", F.col("frames.seq")), "_seqs", s)
    shaped = shaped.withColumns(
        {
            "shape_reject": F.coalesce("request_reject", "shape_reject"),
            "n_received": F.coalesce(F.size("frames"), F.lit(0)),
        }
    )
    sound = F.col("shape_reject").isNull()
    rows = shaped.select(*ATTEMPT, F.explode_outer(F.when(sound, F.col("frames"))).alias("_f"))
    rows = rows.select(*ATTEMPT, F.col("_f.seq").alias("seq"), F.col("_f.base64").alias("base64"), F.col("_f").isNotNull().alias("open"))
    judged = frame_stage(rows, models, s)
    cell = F.struct(*[c for c in sessions.FRAME_FIELDS if c in judged.columns])
    gathered = judged.groupBy(*ATTEMPT).agg(F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), cell))).alias("frames"))
    used = sessions.consume_once(sessions.lookup_session(gathered, sessions_, s), s)
    return sessions.judge_frames(sessions.bind_correlation(used), s)
