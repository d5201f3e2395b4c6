"""Decision thresholds and limits, passed to operators as plan literals."""

from __future__ import annotations

from dataclasses import dataclass

# Class order of the liveness scorer and the signal weights.
REAL_CLASS = 1
SIGNAL_WEIGHTS = {
    "fft": 0.05,
    "lbp": 0.15,
    "color": 0.10,
    "moire": 0.10,
    "sharpness": 0.05,
    "jpeg": 0.10,
    "recapture": 0.45,
}
CHALLENGE_STEPS = ("TURN_LEFT", "TURN_RIGHT", "BLINK")


@dataclass(frozen=True)
class Settings:
    # passive decision
    liveness_threshold: float = 0.5
    n_models: int = 2
    recapture_spoof: float = 0.5
    confirm_min: float = 0.1
    weak_spoof_max: float = 0.90
    override_real_max: float = 0.20
    save_frame_verdicts: tuple[str, ...] = ("spoof",)
    model_version: str = "unversioned"
    # input limits
    max_payload_bytes: int = 8 * 1024 * 1024
    max_dimension: int = 4000
    max_batch: int = 16
    # gates; the document question runs where replies are given
    geometry_check: bool = True
    detector_confidence: float = 0.4
    face_ratio_reject: float = 0.27
    document_reject: float = 0.70
    min_face_edge: float = 60.0
    min_sharpness: float = 40.0
    min_brightness: float = 40.0
    max_brightness: float = 235.0
    match_score_min: float = 70.0
    # capture sessions
    challenge_pool: str = "TURN_LEFT,TURN_RIGHT"
    challenge_step_count: int = 2
    yaw_turn_min: float = 20.0
    yaw_frontal_max: float = 10.0
    ear_blink_max: float = 0.20
    min_frames: int = 4
    max_frames: int = 6
    identity_min: float = 0.40
    session_ttl_s: float = 90.0
    # request admission
    replay_tolerance_s: float = 120.0
    burst: int = 20
    burst_window_s: float = 1.0
    sustained_per_s: float = 5.0
    sustained_window_s: float = 60.0
    trust_proxy_headers: bool = False
    allowed_networks: tuple[str, ...] = (
        "127.0.0.0/8",
        "192.168.0.0/24",
        "10.0.0.0/8",
        "172.16.0.0/12",
    )
    # latency budgets
    pad_budget_ms: float = 2000.0
    session_budget_ms: float = 8000.0

    @property
    def sustained_limit(self) -> int:
        return max(1, int(self.sustained_per_s * self.sustained_window_s))

    @property
    def session_retention_s(self) -> float:
        """Late calls are still told EXPIRED, not NOT_FOUND, for this long."""
        return float(int(2 * self.session_ttl_s + 60) + 1)


DEFAULTS = Settings()
