"""Explicit schemas of the JSON inputs and outputs; nothing is inferred."""

from __future__ import annotations

CORRUPT = "_corrupt_record"

PAD_REQUEST = (
    "correlation_id string, transaction_type string, transaction_ref string, face_photo string"
)
VERDICT_REQUEST = (
    "correlation_id string, session_id string, transaction_type string, transaction_ref string, "
    "frames array<struct<seq:int, base64:string, captured_at:string>>"
)
SIGNAL_SCORES = (
    "struct<fft:double, lbp:double, color:double, moire:double, sharpness:double, jpeg:double, "
    "recapture:double>"
)
# union of both audit record shapes
AUDIT = (
    "timestamp string, endpoint string, correlation_id string, session_id string, "
    "transaction_type string, transaction_ref string, verdict string, reason string, score double, "
    "frame_consistency_score double, n_frames_received int, n_frames_valid int, "
    "model_version string, processing_ms double, save_frame boolean, "
    f"signal_scores {SIGNAL_SCORES}, nn_label string, nn_score double"
)
AUDIT_TIME = "yyyy-MM-dd'T'HH:mm:ssxx"
