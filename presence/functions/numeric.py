"""Scalar numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_dp(x: Column, digits: int) -> Column:
    """Half-up rounding as plain double arithmetic.

    ``F.round`` on doubles builds a BigDecimal per row; this form stays in
    generated code and is reproducible by any engine with IEEE doubles.
    """
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def ramp(x: Column, lo: float, hi: float) -> Column:
    """1 at or below ``lo``, 0 at or above ``hi``, linear in between."""
    return (
        F.when(x <= lo, F.lit(1.0))
        .when(x >= hi, F.lit(0.0))
        .otherwise((F.lit(hi) - x) / F.lit(hi - lo))
    )


def softmax3(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Class probabilities of three logits, shifted by their maximum."""
    top = F.greatest(a, b, c)
    ea, eb, ec = F.exp(a - top), F.exp(b - top), F.exp(c - top)
    total = ea + eb + ec
    return ea / total, eb / total, ec / total


def first_argmax3(a: Column, b: Column, c: Column) -> Column:
    """Index of the largest of three values, lowest index on ties."""
    return (
        F.when((a >= b) & (a >= c), F.lit(0)).when(b >= c, F.lit(1)).otherwise(F.lit(2))
    )


def step_down(x: Column, steps: list[tuple[float, float]]) -> Column:
    """Value of the first step whose bound lies strictly above ``x``, else 0."""
    out = F.lit(0.0)
    for bound, value in reversed(steps):
        out = F.when(x < bound, F.lit(value)).otherwise(out)
    return out


def step_up(x: Column, steps: list[tuple[float, float]]) -> Column:
    """Value of the first step whose bound lies strictly below ``x``, else 0."""
    out = F.lit(0.0)
    for bound, value in reversed(steps):
        out = F.when(x > bound, F.lit(value)).otherwise(out)
    return out


# Score tables of the image signals.
LBP_STEPS = [(0.60, 0.6), (0.70, 0.3), (0.75, 0.15)]
JPEG_STEPS = [(1.5, 0.4), (1.3, 0.25), (1.15, 0.1)]
PEAK_STEPS = [(15.0, 0.5), (10.0, 0.3)]
FFT_BASE = 0.3


def lbp_score(norm_entropy: Column) -> Column:
    return step_down(norm_entropy, LBP_STEPS)


def jpeg_score(ratio: Column) -> Column:
    return step_up(ratio, JPEG_STEPS)


def fft_score(peak_ratio: Column) -> Column:
    """Spectral-peak score. The band-share term is the whole band by
    definition, so it always adds its full 0.3; NULL means no energy."""
    return F.when(peak_ratio.isNull(), F.lit(0.0)).otherwise(
        F.lit(FFT_BASE) + step_up(peak_ratio, PEAK_STEPS)
    )


def color_score(cr_std: Column, cb_std: Column) -> Column:
    return (
        F.when((cr_std < 4) & (cb_std < 3), F.lit(0.6))
        .when((cr_std < 6) & (cb_std < 5), F.lit(0.35))
        .when((cr_std < 8) & (cb_std < 6), F.lit(0.15))
        .otherwise(F.lit(0.0))
    )


def sharpness_score(cv: Column) -> Column:
    return (
        F.when(cv < 0.1, F.lit(0.4))
        .when(cv < 0.2, F.lit(0.2))
        .when(cv > 1.5, F.lit(0.25))
        .otherwise(F.lit(0.0))
    )


def recapture_score(
    lap: Column, teng: Column, resid: Column, hf: Column, face_px: Column | None
) -> dict[str, Column]:
    """Ramped detail cues, their blend, and the final recapture score."""
    out = {
        "s_lap": ramp(lap, 800.0, 2600.0),
        "s_teng": ramp(teng, 25.0, 68.0),
        "s_resid": ramp(resid, 3.0, 10.0),
        "s_hf": ramp(hf, 0.15, 0.42),
    }
    out["detail"] = (
        out["s_lap"] * 0.45 + out["s_teng"] * 0.20 + out["s_resid"] * 0.20 + out["s_hf"] * 0.15
    )
    if face_px is None:
        out["recapture"] = F.least(F.lit(1.0), out["detail"])
        return out
    out["s_res"] = ramp(face_px.cast("double"), 20000.0, 45000.0)
    out["recapture"] = F.when(face_px.isNull(), F.least(F.lit(1.0), out["detail"])).otherwise(
        F.least(F.lit(1.0), out["detail"] * 0.80 + out["s_res"] * 0.20)
    )
    return out
