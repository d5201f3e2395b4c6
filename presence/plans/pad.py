"""Photo decisions as one plan without an exchange: gates as expressions, one
Python call that finds faces and one that measures and scores what is left.

Decided rows hand no bytes to Python, so models see only undecided ones; no
row is joined, split off or written between its scan and its verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.config import DEFAULTS, Settings
from presence.functions import numeric, text
from presence.operators import gates, measures, scores, scoring, spectral
from presence.operators.spectral import View
from presence.sources import sinks


@dataclass(frozen=True)
class Models:
    """Injected models: a detector, and one liveness scorer per crop scale.

    The first scale also cuts the crop the signals read. ``decoder`` turns
    file bytes into an (h, w[, channels]) image, BGR; None or an error means
    the bytes are no image.
    """

    detector: Callable[[], Callable[[np.ndarray], np.ndarray]]
    scorers: dict[float, Callable[[], scoring.Predict]]
    scorer_size: int = 80
    decoder: Callable[[], Callable[[bytes], np.ndarray | None]] | None = None


SIGNAL_SIZE, DETAIL_SIZE = 160, 224
DETAIL = View("detail", DETAIL_SIZE, window="window0")
TEXTURE = View("texture", SIGNAL_SIZE, parent="detail")


def locate(images: DataFrame, models: Models, s: Settings = DEFAULTS) -> DataFrame:
    """Images with their face box and geometry outcome.

    Adds ``input_reject`` for requests refused before any decision (an
    upstream ``size_reject``, oversized or undecodable images); those never
    reach the detector.
    """
    sized = gates.guard_dimensions(images, "frame_h", "frame_w", s)
    if "size_reject" not in images.columns:
        sized = sized.withColumn("size_reject", F.lit(None).cast("string"))
    undecoded = F.when(F.coalesce(F.col("frame_h"), F.lit(0)) <= 0, F.lit("DECODE_ERROR"))
    sized = sized.withColumn(
        "input_reject", F.coalesce("size_reject", undecoded, "dimension_reject")
    ).drop("size_reject", "dimension_reject")
    seen = F.when(F.col("input_reject").isNull(), F.col("data"))
    found = sized.withColumn(
        "_found", measures.detections(seen, F.col("frame_h"), F.col("frame_w"), models.detector)
    ).withColumn("_best", measures.best_of(F.col("_found")))
    best = {c: F.col(f"_best.{c}") for c in ("conf", "l", "t", "r", "b")}
    boxed = found.withColumns({**best, "n_candidates": F.greatest(F.size("_found"), F.lit(0))})
    placed = gates.face_px(gates.geometry_gate(gates.face_bbox(boxed, s), s)).drop("_found", "_best")
    if not s.geometry_check:
        placed = placed.withColumns({"geometry_ran": F.lit(False), "is_document": F.lit(False)})
    return placed


def measured(located: DataFrame, models: Models, alive, crop_mode: str = "single", s: Settings = DEFAULTS) -> DataFrame:
    """Adds signals, the scorers' call and the fused label to rows that are
    ``alive``; NULL on the others. Needs ``data`` and the face box."""
    shared = crop_mode == "batch"
    scales = list(models.scorers)[:1] if shared else list(models.scorers)
    views, windows, cut = [DETAIL, TEXTURE], {}, located
    for i, scale in enumerate(scales):
        corners = ("ltx", "lty", "rbx", "rby")
        box = F.when(alive & F.col("ltx").isNotNull(), F.array(*corners))
        cut = gates.crop_window(cut, scale).withColumn(f"_window{i}", box).drop(*corners)
        windows[f"window{i}"] = F.col(f"_window{i}")
        place = {"parent": "detail"} if shared else {"window": f"window{i}"}
        views.append(View(f"scorer{i}", models.scorer_size, **place))
    called = [(f"scorer{0 if shared else i}", f) for i, f in enumerate(models.scorers.values())]
    usable = F.col("_window0").isNotNull()
    looked = cut.withColumn(
        "_seen",
        measures.photo_measures(F.when(usable, F.col("data")), F.col("frame_h"), F.col("frame_w"), windows, views, "detail", "texture", called),
    )
    raw = [*measures.names(*measures.DETAIL), *measures.names(*measures.TEXTURE)]
    rows = looked.withColumns({c: F.col(f"_seen.{c}") for c in raw}).withColumn("_probs", F.col("_seen.probs"))
    signals = {**measures.texture_scores(), "recapture": measures.recapture(F.col("face_px"))["recapture"]}
    rows = scores.weighted_signal_sum(rows.withColumns(signals))
    sums = []
    for k in range(3):  # each scorer's three probabilities, side by side
        total = F.lit(0.0)
        for i in range(len(called)):
            total = total + F.col("_probs")[3 * i + k]
        sums.append(total)
    rows = gates.fuse_verdict(rows.withColumns(scores.vote(*sums, s)), s)
    scored = F.col("_probs").isNotNull()
    out = ("signal_scores", "spoof_probability", "signals_triggered", "nn_label", "nn_score", "label", "score")
    rows = rows.withColumns({c: F.when(scored, F.col(c)) for c in out})
    return rows.drop("_seen", "_probs", *[f"_window{i}" for i in range(len(scales))], *raw, *signals)


def pad_decisions(
    images: DataFrame,
    models: Models,
    reply: str | None = None,
    crop_mode: str = "single",
    s: Settings = DEFAULTS,
) -> DataFrame:
    """Verdict per image, one row per input row, ``data`` left out.

    ``crop_mode`` "single" cuts every scorer's crop from the frame at its own
    scale; "batch" feeds all scorers one view of the signals' crop.

    Refused inputs keep their row with ``input_reject`` and no verdict;
    faceless and document rows are decided by expressions alone.
    """
    located = locate(images, models, s)
    if reply is not None:
        located = gates.document_reject(located, reply, s)
    else:
        located = located.withColumns(
            {"document_reject": F.lit(False), "reply_confidence": F.lit(None).cast("double")}
        )
    taken = F.col("input_reject").isNull()
    alive = F.col("face_detected") & ~F.col("is_document") & ~F.col("document_reject") & taken
    fused = measured(located, models, alive, crop_mode, s).drop("data")
    labelled = gates.final_label(fused, s)
    by_reply = F.col("face_detected") & ~F.col("is_document") & F.col("document_reject")
    labelled = labelled.withColumns(
        {
            "label": F.when(by_reply, F.lit("document_photo")).otherwise(F.col("label")),
            "score": F.when(by_reply, F.col("reply_confidence")).otherwise(F.col("score")),
            "threshold": F.when(by_reply, F.lit(s.document_reject)).otherwise(F.col("threshold")),
        }
    )
    judged = gates.route_save_frame(gates.pad_verdict(labelled, s), s)
    return judged.withColumns(
        {
            **{c: F.when(taken, F.col(c)) for c in ("label", "score", "verdict", "reason")},
            "save_frame": taken & F.col("save_frame"),
        }
    )


def pad_requests(
    requests: DataFrame, models: Models, reply: str | None = None, s: Settings = DEFAULTS
) -> DataFrame:
    """Decisions on scanned request records, one row per record.

    ``face_photo`` text becomes bytes, bytes become pixels through the
    injected decoder, pixels a verdict. A record that is refused on the way
    keeps its row with the first ``input_reject``: the scan's reason,
    INVALID_BASE64, PAYLOAD_TOO_LARGE, DECODE_ERROR or DIMENSIONS_TOO_LARGE;
    it has no verdict and no later stage sees its bytes.
    """
    text_ = F.when(F.col("request_reject").isNull(), F.col("face_photo"))
    rows = requests.withColumn("payload", text.decode_payload(text_)).drop("face_photo")
    rows = gates.guard_payload_size(rows, "payload", s)
    bad = F.when(F.col("request_reject").isNull() & F.col("payload").isNull(), F.lit("INVALID_BASE64"))
    rows = rows.withColumn("size_reject", F.coalesce("request_reject", bad, "size_reject"))
    image = measures.decoded(F.when(F.col("size_reject").isNull(), F.col("payload")), models.decoder)
    rows = rows.withColumn("_image", image).drop("payload", "request_reject")
    rows = rows.withColumns({c: F.col(f"_image.{c}") for c in ("frame_h", "frame_w", "data")}).drop("_image")
    return pad_decisions(rows, models, reply, s=s)


def record(decided: DataFrame, folder: str, s: Settings = DEFAULTS) -> DataFrame:
    """Decide once, then write all three records from the stored decisions:
    audit lines (every decision, ``audit``), ids of frames to keep
    (``evidence``) and service faults (``events``). Needs the request's ids,
    ``ts`` and ``processing_ms``; refused requests leave no record. Gives the
    stored decisions; nothing is decoded or scored again by what reads them."""
    decided.write.parquet(f"{folder}/decisions")
    stored = decided.sparkSession.read.schema(decided.schema).parquet(f"{folder}/decisions")
    judged = stored.where(F.col("verdict").isNotNull())
    sinks.write_audit_log(judged, f"{folder}/audit", s)
    sinks.write_evidence(judged, f"{folder}/evidence", "correlation_id", "transaction_ref")
    sinks.write_security_events(judged, f"{folder}/events", "correlation_id", "transaction_ref")
    return stored


def verify_batch(
    images: DataFrame, models: Models, s: Settings = DEFAULTS
) -> DataFrame:
    """Upload results: rejected uploads keep their row and error text, the
    rest is decided like any photo. Needs ``content_type`` and ``data``."""
    checked = gates.guard_upload(images, "content_type", "data")
    good = checked.where(F.col("upload_error").isNull()).drop("upload_error", "content_type")
    decided = gates.is_real(pad_decisions(good, models, crop_mode="batch", s=s), s).select(
        "image_id",
        F.coalesce("is_real", F.lit(False)).alias("is_real"),
        F.coalesce("label", F.lit("no_face")).alias("label"),
        F.coalesce(numeric.round_dp(F.col("score"), 4), F.lit(0.0)).alias("score"),
        "threshold",
        "face_detected",
        F.col("input_reject").alias("error"),
    )
    refused = checked.where(F.col("upload_error").isNotNull()).select(
        "image_id",
        F.lit(False).alias("is_real"),
        F.lit("no_face").alias("label"),
        F.lit(0.0).alias("score"),
        F.lit(s.liveness_threshold).alias("threshold"),
        F.lit(False).alias("face_detected"),
        F.col("upload_error").alias("error"),
    )
    return decided.unionByName(refused)
