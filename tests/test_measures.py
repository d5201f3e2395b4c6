"""The measures of the one-pass kernel against the pixel aggregations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from presence.operators import measures, pixels, spectral

RNG = np.random.default_rng(17)
SHAPES = [(20, 33), (64, 64), (41, 17), (16, 16), (64, 64), (18, 90)]
IMAGES = [RNG.integers(0, 256, (*s, 3)) for s in SHAPES] + [np.full((40, 24, 3), 77), np.zeros((17, 17, 3), int)]


@pytest.fixture(scope="module")
def planes(spark):
    rows = []
    for i, x in enumerate(IMAGES):
        b, g, r = ([int(v) - 256 if v > 127 else int(v) for v in x[:, :, c].ravel()] for c in range(3))
        gray = [int(v) - 256 if v > 127 else int(v) for v in measures.luma(x).ravel()]
        rows.append((i, *x.shape[:2], b, g, r, gray, i * 100))
    return spark.createDataFrame(rows, "image_id long, h int, w int, b array<byte>, g array<byte>, r array<byte>, gray array<byte>, face_px long")


def close(got, want, names):
    assert len(got) == len(want) == len(IMAGES)
    for r in got:
        for name in names:
            a, b = r[name], want[r["image_id"]][name]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)), (r["image_id"], name, a, b)


def test_measures_equal_pixel_aggregations(spark, planes):
    parts = ("lbp", "color", "sharpness", "jpeg", "detail")
    got = measures.measure(planes, *parts, keep=("face_px",)).collect()
    native = pixels.lbp(planes).join(pixels.block_signals(planes), "image_id").join(pixels.detail_stats(planes), "image_id")
    want = {r["image_id"]: r for r in native.collect()}
    close(got, want, measures.names(*parts))
    assert all(r["face_px"] == 100 * r["image_id"] for r in got)


def test_spectral_measures(spark, planes):
    got = {r["image_id"]: r for r in measures.measure(planes, "hf", "fft", "moire").collect()}
    for i, x in enumerate(IMAGES):
        g = measures.luma(x)[None].astype(float)
        for name, value in zip(("hf", "peak_ratio", "p95", "density"), (spectral.hf_share(g), spectral.peak_ratio(g), *spectral.residual_density(g)), strict=True):
            assert (got[i][name] is None and math.isnan(value[0])) or got[i][name] == pytest.approx(value[0])


def test_resampled_measures(spark, planes):
    got = {r["image_id"]: r for r in measures.measure(planes, "detail", "lbp", size=48).collect()}
    for i, x in enumerate(IMAGES):
        small = spectral.resample(measures.luma(x)[:, :, None], 48)[None, :, :, 0]
        want = (*measures.detail(small), measures.lbp_entropy(small))
        assert [got[i][n] for n in ("lap", "teng", "resid", "brightness", "lbp_entropy")] == pytest.approx([v[0] for v in want])


def test_tiny_images_have_no_measure():
    g = np.zeros((2, 2, 2), int)
    assert np.isnan(measures.lbp_entropy(g)).all() and np.isnan(measures.sharpness_cv(g)).all() and np.isnan(measures.block_ratio(g)).all()


def test_decoding_costs_only_the_bad_row(spark):
    def decoder():
        def decode(raw):
            if raw == b"stop":
                raise ValueError("broken")
            return None if raw == b"none" else np.frombuffer(raw, np.uint8).reshape(1, -1, 1)

        return decode

    rows = spark.createDataFrame([(1, b"abc"), (2, b"stop"), (3, None), (4, b"none"), (5, b"z")], "k int, raw binary")
    got = {r.k: r.i for r in rows.select("k", measures.decoded(F.col("raw"), decoder).alias("i")).collect()}
    assert [(got[k].frame_h, got[k].frame_w, got[k].data) for k in range(1, 6)] == [
        (1, 3, b"abc"), (None, None, None), (None, None, None), (None, None, None), (1, 1, b"z"),
    ]


def test_best_detection(spark):
    kind = "k int, found array<struct<conf double, l double, t double, r double, b double>>"
    rows = spark.createDataFrame([(1, [(0.5, 1.0, 0.0, 0.0, 0.0), (0.7, 2.0, 0.0, 0.0, 0.0), (0.7, 3.0, 0.0, 0.0, 0.0)]), (2, []), (3, None)], kind)
    got = {r.k: r.b for r in rows.select("k", measures.best_of(F.col("found")).alias("b")).collect()}
    assert (got[1].conf, got[1].l) == (0.7, 2.0) and got[2] is None and got[3] is None


def test_text_planes_equal_arrays_and_shapes_share_stacks(spark):
    """A plane as text (a character a pixel) measures like an array, with and
    without resampling, whatever shapes lie side by side."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(20):
        h, w = 16 + i % 5, 64 + i % 3
        text = "".join(map(chr, rng.choice([33, 77, 126, 228, 8364, 128512], h * w)))
        rows.append((i, h, w, text, [ord(c) % 256 for c in text]))
    df = spark.createDataFrame(rows, "image_id long, h int, w int, text string, codes array<int>").coalesce(1)
    for parts, size in ((("lbp", "detail"), None), (("fft", "moire"), 160), (("detail", "hf"), 224)):
        a, b = (
            {r["image_id"]: r for r in measures.measure(df.select("image_id", "h", "w", df[c].alias("gray")), *parts, size=size).collect()}
            for c in ("text", "codes")
        )
        assert len(a) == 20
        for i in a:
            assert np.allclose(list(a[i].asDict().values()), list(b[i].asDict().values()), rtol=1e-9), (parts, i)


def test_half_spectra_and_percentiles_equal_whole_ones():
    from presence.operators import spectral

    rng = np.random.default_rng(6)
    for h, w in ((160, 160), (33, 64), (31, 47), (224, 224)):
        stack = rng.integers(0, 256, (2, h, w)).astype(float)
        whole = np.fft.fftshift(np.abs(np.fft.fft2(stack)), axes=(1, 2))
        far = whole[:, spectral._radius(h, w) > spectral.HF_RADIUS].sum(axis=1) / (whole.sum(axis=(1, 2)) + 1e-9)
        assert np.allclose(spectral.hf_share(stack), far, rtol=1e-12)
        whole = np.fft.fftshift(np.abs(np.fft.fft2(stack * np.hanning(h)[:, None] * np.hanning(w))), axes=(1, 2))
        side, dist = min(h, w), spectral._radius(h, w)
        ring = whole[:, (dist >= max(5, side // 6)) & (dist <= side // 2 - 2)]
        assert np.allclose(spectral.peak_ratio(stack), ring.max(axis=1) / (ring.mean(axis=1) + 1e-10), rtol=1e-12)
        flat = spectral.blur_residual(stack).reshape(2, -1)
        p95, density = spectral.residual_density(stack)
        assert (p95 == np.percentile(flat, 95, axis=1)).all() and (density == (flat > p95[:, None]).mean(axis=1)).all()


def test_plane_sums(spark):
    """Sums of byte planes, wrapped values included, over several stacks."""
    from presence.operators import spectral

    rng = np.random.default_rng(8)
    planes = rng.integers(0, 256, (40, 12))
    rows = [(i, 3, 4, [int(v) for v in p.astype(np.uint8).view(np.int8)], [int(p[0]) - 256 if p[0] > 127 else int(p[0])] * 12) for i, p in enumerate(planes)]
    df = spark.createDataFrame(rows, "image_id long, h int, w int, b array<byte>, gray array<byte>").coalesce(1)
    for r in spectral.plane_sums(df, "b", "gray").collect():
        assert (r["sum_b"], r["sum_gray"]) == (planes[r["image_id"]].sum(), planes[r["image_id"], 0] * 12)
