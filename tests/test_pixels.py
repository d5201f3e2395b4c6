"""Image measures against plain loops and numpy on small images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from presence.operators import pixels, spectral
from presence.plans import pad
from presence.workload.inputs import MODELS, linear_scorer

RNG = np.random.default_rng(7)
IMAGES = {
    1: RNG.integers(0, 256, (32, 48)),
    2: np.full((16, 16), 77),
    3: np.add.outer(np.arange(40), np.arange(24)) * 3 % 256,
    4: RNG.integers(100, 110, (19, 37)),
}


@pytest.fixture(scope="module")
def gray(spark):
    # byte planes, as the crop stage writes them
    rows = [
        (k, *g.shape, g.astype(np.uint8).view(np.int8).ravel().tolist()) for k, g in IMAGES.items()
    ]
    return spark.createDataFrame(rows, "image_id long, h int, w int, gray array<tinyint>")


def reflect(i, n):
    return (n - 1) - abs((n - 1) - abs(i))


def stats(g):
    h, w = g.shape
    at = lambda y, x: int(g[reflect(y, h), reflect(x, w)])
    lap, grad, res = [], [], []
    for y in range(h):
        for x in range(w):
            p = {(a, b): at(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
            lap.append(p[-1, 0] + p[1, 0] + p[0, -1] + p[0, 1] - 4 * p[0, 0])
            gx = sum(k * (p[a, 1] - p[a, -1]) for a, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (p[1, b] - p[-1, b]) for b, k in ((-1, 1), (0, 2), (1, 1)))
            grad.append(math.hypot(gx, gy))
            blur = sum(p[a, b] * (2 - abs(a)) * (2 - abs(b)) for a, b in p) / 16
            res.append(p[0, 0] - blur)
    return np.var(lap), np.mean(grad), np.std(res), g.mean()


def test_detail(gray):
    for r in pixels.detail_stats(gray).collect():
        want = stats(IMAGES[r["image_id"]])
        assert (r["lap"], r["teng"], r["resid"], r["brightness"]) == pytest.approx(want)


def test_lbp(gray):
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    for r in pixels.lbp(gray).collect():
        g = IMAGES[r["image_id"]]
        codes = [
            sum((g[y + a, x + b] >= g[y, x]) << (7 - k) for k, (a, b) in enumerate(ring))
            for y in range(1, g.shape[0] - 1)
            for x in range(1, g.shape[1] - 1)
        ]
        p = np.unique(codes, return_counts=True)[1] / len(codes)
        assert r["lbp_entropy"] == pytest.approx(-(p * np.log2(p)).sum() / 8, abs=1e-9)


def cell_variance(c):
    up, left = np.pad(c, 1, mode="reflect"), None
    lap = up[:-2, 1:-1] + up[2:, 1:-1] + up[1:-1, :-2] + up[1:-1, 2:] - 4 * c
    return lap.var()


def test_sharpness(gray):
    for r in pixels.sharpness(gray).collect():
        g = IMAGES[r["image_id"]].astype(np.int64)
        ch, cw = g.shape[0] // 4, g.shape[1] // 4
        v = [cell_variance(g[a * ch : a * ch + ch, b * cw : b * cw + cw]) for a in range(4) for b in range(4)]
        assert r["sharpness_cv"] == pytest.approx(np.std(v) / (np.mean(v) + 1e-10), abs=1e-9)


def test_jpeg(gray):
    for r in pixels.jpeg(gray).collect():
        g = IMAGES[r["image_id"]].astype(float)
        edge, inner = [], []
        for m in (g, g.T):
            for y in range(8, m.shape[0] - 8, 8):
                edge.append(np.abs(m[y] - m[y - 1]).mean())
                inner.append(np.abs(m[y + 3] - m[y + 4]).mean())
        if not edge or np.mean(inner) < 1e-10:
            assert r["jpeg_ratio"] is None and r["jpeg"] == 0.0
        else:
            assert r["jpeg_ratio"] == pytest.approx(np.mean(edge) / np.mean(inner))


def test_color(spark):
    b, g, r = (RNG.integers(0, 256, 20 * 12) for _ in range(3))
    df = spark.createDataFrame(
        [(1, 20, 12, b.tolist(), g.tolist(), r.tolist())],
        "image_id long, h int, w int, b array<int>, g array<int>, r array<int>",
    )
    y = (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14
    cr = np.clip(((r - y) * 11682 + (128 << 14) + 8192) >> 14, 0, 255)
    cb = np.clip(((b - y) * 9241 + (128 << 14) + 8192) >> 14, 0, 255)
    got = pixels.color(df).first()
    assert (got["cr_std"], got["cb_std"]) == pytest.approx((cr.std(), cb.std()))
    assert np.abs(y - (0.299 * r + 0.587 * g + 0.114 * b)).max() < 1


def dft(g):
    h, w = g.shape
    fy = np.exp(-2j * np.pi * np.outer(np.arange(h), np.arange(h)) / h)
    fx = np.exp(-2j * np.pi * np.outer(np.arange(w), np.arange(w)) / w)
    return np.abs(fy @ g @ fx)


def test_fft(gray):
    for r in spectral.fft(gray).collect():
        g = IMAGES[r["image_id"]].astype(float)
        h, w = g.shape
        m = dft(g * np.hanning(h)[:, None] * np.hanning(w)[None, :])
        side, ring = min(h, w), []
        for y in range(h):
            for x in range(w):
                d = math.hypot((y + h // 2) % h - h // 2, (x + w // 2) % w - w // 2)
                if max(5, side // 6) <= d <= side // 2 - 2:
                    ring.append(m[y, x])
        assert r["peak_ratio"] == pytest.approx(max(ring) / np.mean(ring), rel=1e-6)
        assert r["fft"] in (0.3, 0.6, 0.8)


def test_hf(spark):
    g = RNG.integers(0, 256, (140, 150))
    df = spark.createDataFrame([(1, 140, 150, g.ravel().tolist())], "image_id long, h int, w int, gray array<int>")
    m = np.fft.fftshift(dft(g.astype(float)))
    yy, xx = np.mgrid[0:140, 0:150]
    far = np.sqrt((yy - 70) ** 2 + (xx - 75) ** 2) > 60
    assert spectral.hf(df).first()["hf"] == pytest.approx(m[far].sum() / m.sum(), rel=1e-6)


def test_moire_diagnostics(gray):
    for r in spectral.moire(gray).collect():
        g = IMAGES[r["image_id"]].astype(float)
        k = np.exp(-(np.arange(-5, 6) ** 2) / 18.0)
        k /= k.sum()
        padded = np.pad(g, 5, mode="reflect")
        blur = np.array(
            [[(padded[y : y + 11, x : x + 11] * np.outer(k, k)).sum() for x in range(g.shape[1])] for y in range(g.shape[0])]
        )
        assert r["p95"] == pytest.approx(np.percentile(np.abs(g - blur), 95), abs=2e-6)


def test_moire_bound():
    stack = RNG.integers(0, 256, (20, 160, 160)).astype(float)
    assert (spectral.residual_density(stack)[1] <= 0.05).all()


def test_resample():
    flat = np.full((30, 50, 3), 9, dtype=np.uint8)
    assert (spectral.resample(flat, 16) == 9).all()
    img = RNG.integers(0, 256, (16, 16, 3)).astype(np.uint8)
    assert (spectral.resample(img, 16) == img).all()
    half = spectral.resample(img, 8)
    want = np.floor(img.reshape(8, 2, 8, 2, 3).mean(axis=(1, 3)) + 0.5)
    assert (half == want).all()


def test_scanline_neighbours(gray):
    lines = pixels.scanline_neighbours(pixels.scanlines(gray)).where("image_id = 1").collect()
    g = IMAGES[1]
    unsign = lambda v: [x & 255 for x in v]
    for r in lines:
        assert unsign(r["line"]) == g[r["y"]].tolist()
        assert unsign(r["above"]) == g[reflect(r["y"] - 1, 32)].tolist()
        assert unsign(r["below"]) == g[reflect(r["y"] + 1, 32)].tolist()


def photos(spark):
    rng, rows = np.random.default_rng(11), []
    for i in range(12):
        h, w = 120 + i, 90 + 2 * i
        shade = np.clip(rng.normal(120 + 5 * i, 30, (h, w, 3)), 0, 255).astype(np.uint8)
        rows.append((i, h, w, shade.tobytes()))
    return spark.createDataFrame(rows, "image_id long, frame_h int, frame_w int, data binary")


def test_photo_plan_matches_loop(spark):
    images = photos(spark)
    rows = {r["image_id"]: r for r in pad.pad_decisions(images, MODELS).collect()}
    assert len(rows) == 12
    for src in images.collect():
        full = np.frombuffer(src["data"], np.uint8).reshape(src["frame_h"], src["frame_w"], 3)
        got = rows[src["image_id"]]
        best = max(MODELS.detector()(full), key=lambda c: c[0])
        assert got["face_detected"] == (best[0] >= 0.4)
        if got["label"] in ("no_face", "document_photo"):
            continue
        x, y, w, h = got["x"], got["y"], got["w"], got["h"]
        total = np.zeros(3)
        for scale, factory in MODELS.scorers.items():
            sides = min((src["frame_h"] - 1) / h, (src["frame_w"] - 1) / w, scale)
            l, t = int(w / 2 + x - w * sides / 2), int(h / 2 + y - h * sides / 2)
            r, b = int(w / 2 + x + w * sides / 2), int(h / 2 + y + h * sides / 2)
            r, l = r - min(l, 0), max(l, 0)
            b, t = b - min(t, 0), max(t, 0)
            l, r = l - max(r - src["frame_w"] + 1, 0), min(r, src["frame_w"] - 1)
            t, b = t - max(b - src["frame_h"] + 1, 0), min(b, src["frame_h"] - 1)
            crop = spectral.resample(full[t : b + 1, l : r + 1], 80)
            total += factory()(crop[:, :, ::-1].transpose(2, 0, 1)[None].astype(np.float32))[0]
            if scale == 2.7:
                detail = spectral.resample(full[t : b + 1, l : r + 1], 224)
        assert got["nn_label"] == int(total.argmax())
        assert got["nn_score"] == pytest.approx(total.max() / 2)
        g = (detail[:, :, 0] * 1868 + detail[:, :, 1] * 9617 + detail[:, :, 2] * 4899 + 8192) >> 14
        up = np.pad(g, 1, mode="reflect").astype(float)
        lap = (up[:-2, 1:-1] + up[2:, 1:-1] + up[1:-1, :-2] + up[1:-1, 2:] - 4 * up[1:-1, 1:-1]).var()
        gx = (up[:-2, 2:] + 2 * up[1:-1, 2:] + up[2:, 2:]) - (up[:-2, :-2] + 2 * up[1:-1, :-2] + up[2:, :-2])
        gy = (up[2:, :-2] + 2 * up[2:, 1:-1] + up[2:, 2:]) - (up[:-2, :-2] + 2 * up[:-2, 1:-1] + up[:-2, 2:])
        blur = sum(up[a : a + 224, b : b + 224] * (2 - abs(a - 1)) * (2 - abs(b - 1)) for a in range(3) for b in range(3)) / 16
        spec = np.fft.fftshift(np.abs(np.fft.fft2(g)))
        yy, xx = np.mgrid[0:224, 0:224]
        hf = spec[np.sqrt((yy - 112) ** 2 + (xx - 112) ** 2) > 60].sum() / spec.sum()

        def ramp(v, lo, hi):
            return min(1.0, max(0.0, (hi - v) / (hi - lo)))

        detail_score = (
            0.45 * ramp(lap, 800, 2600) + 0.2 * ramp(np.hypot(gx, gy).mean(), 25, 68)
            + 0.2 * ramp((g - blur).std(), 3, 10) + 0.15 * ramp(hf, 0.15, 0.42)
        )
        want = 0.8 * detail_score + 0.2 * ramp(w * h, 20000, 45000)
        assert got["signal_scores"]["recapture"] == pytest.approx(want, abs=1e-4)


def test_batch_mode_shares_one_view(spark):
    images = photos(spark)
    one = pad.pad_decisions(images, MODELS, crop_mode="batch")
    got = {r["image_id"]: r for r in one.where(F.col("nn_label").isNotNull()).collect()}
    assert got
    single = pad.pad_decisions(images, MODELS)
    assert {r["image_id"] for r in single.where("nn_label is not null").collect()} == set(got)


def test_scorer_shapes():
    p = linear_scorer(0)()(np.zeros((4, 64)))
    assert p.shape == (4, 3) and np.allclose(p.sum(axis=1), 1)


def test_upload_batch_keeps_every_row(spark):
    kind = F.when(F.col("image_id") == 3, F.lit("text/plain")).otherwise(F.lit("image/png"))
    body = F.when(F.col("image_id") == 4, F.lit(b"")).otherwise(F.col("data"))
    uploads = photos(spark).withColumns({"content_type": kind, "data": body})
    rows = {r["image_id"]: r for r in pad.verify_batch(uploads, MODELS).collect()}
    assert len(rows) == 12
    assert (rows[3]["error"], rows[4]["error"]) == ("not an image", "empty file")
    assert rows[3]["label"] == "no_face" and not rows[4]["is_real"]
    assert all(r["error"] is None for k, r in rows.items() if k not in (3, 4))


def test_document_reply_rejects_before_scoring(spark):
    images = photos(spark).withColumn(
        "reply",
        F.when(F.col("image_id") % 2 == 0, F.lit("LABEL=STUDIO_BACKGROUND CONFIDENCE=70")).otherwise(
            F.lit("LABEL=STUDIO_BACKGROUND CONFIDENCE=69")
        ),
    )
    plain = {r["image_id"]: r for r in pad.pad_decisions(photos(spark), MODELS).collect()}
    for r in pad.pad_decisions(images, MODELS, reply="reply").collect():
        before = plain[r["image_id"]]
        if before["label"] in ("no_face", "document_photo") or r["image_id"] % 2:
            assert (r["label"], r["score"], r["reason"]) == (before["label"], before["score"], before["reason"])
        else:
            assert (r["verdict"], r["reason"], r["score"], r["threshold"]) == ("spoof", "DOCUMENT_PHOTO", 0.7, 0.7)
            assert r["nn_label"] is None and r["save_frame"]


def test_grey_and_alpha_images(spark):
    base = RNG.integers(0, 256, (20, 30, 1)).astype(np.uint8)
    rows = [
        (1, 20, 30, base.tobytes()),
        (3, 20, 30, np.repeat(base, 3, axis=2).tobytes()),
        (4, 20, 30, np.concatenate([np.repeat(base, 3, axis=2), base * 0], axis=2).tobytes()),
    ]
    df = spark.createDataFrame(rows, "image_id long, frame_h int, frame_w int, data binary")
    df = df.withColumns({"ltx": F.lit(2), "lty": F.lit(1), "rbx": F.lit(25), "rby": F.lit(18)})
    crops = [bytes(v & 255 for v in r["gray"]) for r in spectral.crop_and_resample(df, 16).collect()]
    assert len(crops) == 3 and len(set(crops)) == 1


def test_refused_inputs_have_no_verdict(spark):
    good = photos(spark).where("image_id < 3")
    bad = spark.createDataFrame(
        [(90, -1, -1, b""), (91, 4001, 10, b"")], "image_id long, frame_h int, frame_w int, data binary"
    )
    rows = {r["image_id"]: r for r in pad.pad_decisions(good.unionByName(bad), MODELS).collect()}
    assert len(rows) == 5
    assert (rows[90]["input_reject"], rows[91]["input_reject"]) == ("DECODE_ERROR", "DIMENSIONS_TOO_LARGE")
    assert all(rows[k]["verdict"] is None and not rows[k]["save_frame"] for k in (90, 91))
    assert all(rows[k]["verdict"] is not None for k in range(3))
