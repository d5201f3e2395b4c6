"""The measures built-ins cannot express: Fourier magnitudes, the wide-blur
residual, and cropping of packed image bytes. Arrow batches in, scalars or
planes out; every function sees a bounded number of images at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presence.functions import numeric

STACK = 16  # images of one shape transformed together
HF_RADIUS = 60
BLUR_TAPS, BLUR_SIGMA = 11, 3.0


def _radius(h: int, w: int) -> np.ndarray:
    yy, xx = np.ogrid[0:h, 0:w]
    return np.sqrt((yy - h // 2) ** 2 + (xx - w // 2) ** 2)


def _halved(mask: np.ndarray) -> np.ndarray:
    """How often each frequency of a real transform's half plane stands in a
    mask of the whole, centred plane: itself and its mirror."""
    h, w = mask.shape
    whole = np.fft.ifftshift(mask).astype(np.float64)
    half = whole[:, : w // 2 + 1].copy()
    mirrored = np.roll(whole[::-1, ::-1], 1, axis=(0, 1))[:, : w // 2 + 1]
    own = np.arange(w // 2 + 1)
    twice = (own > 0) & (2 * own != w)  # columns whose mirror lies outside the half
    half[:, twice] += mirrored[:, twice]
    return half.ravel()


@lru_cache(maxsize=8)
def _ring(h: int, w: int) -> tuple[np.ndarray, ...]:
    """Window, weights outside the centre, weights in the ring and its places."""
    window = np.hanning(h)[:, None] * np.hanning(w)[None, :]
    side, cy, cx = min(h, w), h // 2, w // 2
    r = max(3, side // 10)
    outside = np.ones((h, w), dtype=bool)
    outside[max(0, cy - r) : min(h, cy + r), max(0, cx - r) : min(w, cx + r)] = False
    dist = _radius(h, w)
    ring = _halved((dist >= max(5, side // 6)) & (dist <= side // 2 - 2))
    return window, _halved(outside), ring, np.flatnonzero(ring)


@lru_cache(maxsize=8)
def _far(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    return _halved(_radius(h, w) > HF_RADIUS), _halved(np.ones((h, w), dtype=bool))


def _magnitudes(stack: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft2(stack)).reshape(len(stack), -1)


def peak_ratio(stack: np.ndarray) -> np.ndarray:
    """Peak over mean magnitude in the mid-frequency ring; NaN without energy
    outside the centre or without a ring."""
    window, outside, ring, places = _ring(*stack.shape[1:])
    if not len(places):
        return np.full(len(stack), np.nan)
    spectrum = _magnitudes(stack * window)
    peak, mean = spectrum.take(places, axis=1).max(axis=1), spectrum @ ring / ring.sum()
    return np.where(spectrum @ outside < 1e-10, np.nan, peak / (mean + 1e-10))


def hf_share(stack: np.ndarray) -> np.ndarray:
    """Share of spectral magnitude beyond a fixed radius, no window."""
    far, whole = _far(*stack.shape[1:])
    spectrum = _magnitudes(stack)
    return spectrum @ far / (spectrum @ whole + 1e-9)


def blur_residual(stack: np.ndarray) -> np.ndarray:
    """Absolute difference to a separable Gaussian, reflected borders."""
    d = np.arange(BLUR_TAPS) - BLUR_TAPS // 2
    taps = np.exp(-(d**2) / (2 * BLUR_SIGMA**2))
    taps /= taps.sum()
    out = stack
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (BLUR_TAPS // 2, BLUR_TAPS // 2)
        wide, n = np.pad(out, pad, mode="reflect"), stack.shape[axis]
        out, term = np.zeros(stack.shape), np.empty(stack.shape)
        for k, t in enumerate(taps):
            out += np.multiply(wide[:, k : k + n] if axis == 1 else wide[:, :, k : k + n], t, out=term)
    out = np.abs(stack - out)
    out *= 1e6
    out += 0.5
    np.floor(out, out=out)
    out /= 1e6
    return out


def _percentile(flat: np.ndarray, share: float) -> float:
    """Interpolated between the two ranks around it; one selection, where
    ``np.percentile`` sorts out both."""
    at = share * (len(flat) - 1)
    k = int(at)
    part = np.partition(flat, k)
    low, t = part[k], at - k
    high = part[k + 1 :].min() if k + 1 < len(part) else low
    return low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)


def residual_density(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """95th percentile of the residual and the share strictly above it."""
    p95, density = np.empty(len(stack)), np.empty(len(stack))
    for i in range(len(stack)):  # one plane at a time stays in the cache
        flat = blur_residual(stack[i : i + 1]).ravel()
        p95[i] = _percentile(flat, 0.95)
        density[i] = (flat > p95[i]).mean()
    return p95, density


def _stacks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, float stack) of equally shaped images, at most STACK at a time."""
    for batch in batches:
        for (h, w), group in batch.groupby(["h", "w"]):
            for lo in range(0, len(group), STACK):
                part = group.iloc[lo : lo + STACK]
                planes = np.stack([np.asarray(g) for g in part["gray"]]).astype(np.int32) & 255
                yield part["image_id"].to_numpy(), planes.astype(np.float64).reshape(len(part), h, w)


def _measure(images: DataFrame, fields: str, compute) -> DataFrame:
    id_type = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, stack in _stacks(batches):
            yield pd.DataFrame({"image_id": ids, **compute(stack)})

    return images.select("image_id", "h", "w", "gray").mapInPandas(
        run, f"image_id {id_type}, {fields}"
    )


def fft(images: DataFrame) -> DataFrame:
    out = _measure(images, "peak_ratio double", lambda s: {"peak_ratio": peak_ratio(s)})
    ratio = F.when(~F.isnan("peak_ratio"), F.col("peak_ratio"))
    return out.select("image_id", ratio.alias("peak_ratio"), numeric.fft_score(ratio).alias("fft"))


def moire(images: DataFrame) -> DataFrame:
    """Residual diagnostics of 160-pixel views and the score they yield.

    At that size no more than 1280 of 25600 pixels, exactly 5 %, can lie
    strictly above the 95th percentile, and the lowest score step needs more
    than 5 %: the score is always 0.
    """

    def both(stack):
        p95, density = residual_density(stack)
        return {"p95": p95, "density": density}

    return _measure(images, "p95 double, density double", both).withColumn("moire", F.lit(0.0))


def hf(images: DataFrame) -> DataFrame:
    return _measure(images, "hf double", lambda s: {"hf": hf_share(s)})


def spectral_view(images: DataFrame) -> DataFrame:
    """``peak_ratio`` and moire diagnostics of one view in one Python pass."""

    def both(stack):
        p95, density = residual_density(stack)
        return {"peak_ratio": peak_ratio(stack), "p95": p95, "density": density}

    return _measure(images, "peak_ratio double, p95 double, density double", both)


# -- crops ------------------------------------------------------------------


@lru_cache(maxsize=1024)
def _grid(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    lo = np.floor(c).astype(int)
    return lo, np.minimum(lo + 1, n - 1), c - lo


def resample(image: np.ndarray, size: int) -> np.ndarray:
    """Bilinear resize of an (h, w) plane or (h, w, channels) image to ``size``
    squared with half-pixel centres."""
    if image.ndim == 3:  # plane by plane: each stays in the cache
        out = np.empty((size, size, image.shape[2]), np.int32)
        for c in range(image.shape[2]):
            out[:, :, c] = resample(image[:, :, c], size)
        return out
    y0, y1, fy = _grid(image.shape[0], size)
    x0, x1, fx = _grid(image.shape[1], size)

    def mixed(src: np.ndarray, lo: np.ndarray, hi: np.ndarray, f: np.ndarray) -> np.ndarray:
        f = f[:, None]
        out, more = src[lo], src[hi]
        out *= 1 - f
        more *= f
        out += more
        return out

    rows = mixed(image.astype(np.float64), y0, y1, fy)
    # columns first: whole rows are gathered, not single values
    out = mixed(np.ascontiguousarray(rows.swapaxes(0, 1)), x0, x1, fx)
    out += 0.5
    return np.ascontiguousarray(np.floor(out, out=out).swapaxes(0, 1), dtype=np.int32)


@dataclass(frozen=True)
class View:
    """A square crop: cut from the frame by a window struct column, or
    resampled from another view named earlier in the list."""

    name: str
    size: int
    planes: tuple[str, ...] = ("b", "g", "r", "gray")
    window: str | None = None
    parent: str | None = None


PLANE_AT = {"b": 0, "g": 1, "r": 2}


def _plane(bgr: np.ndarray, name: str) -> np.ndarray:
    if name == "gray":
        b, g, r = (bgr[:, :, c] for c in range(3))
        return (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14
    return bgr[:, :, PLANE_AT[name]]


def crop_views(images: DataFrame, views: list[View], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per image with a column ``view_plane`` per view and plane.

    Planes are flat byte arrays (values above 127 wrap; readers mask), so a
    crop costs a byte per pixel and plane on the wire and on disk, and a later
    stage reads only the planes it names. Needs packed ``data`` with
    ``frame_h, frame_w`` and the windows' structs (``ltx, lty, rbx, rby``).
    Grey and four-channel images become BGR. Rows without a usable window are
    dropped; filter decided rows before the call.
    """
    windows = list(dict.fromkeys(v.window for v in views if v.window))
    usable = F.lit(True)
    for name in windows:
        usable = usable & F.col(name)["ltx"].isNotNull()
    source = images.where(usable).select("image_id", *keep, "frame_h", "frame_w", *windows, "data")
    columns = [(f"{v.name}_{p}", v, p) for v in views for p in v.planes]
    schema = T.StructType(
        [images.schema[c] for c in ("image_id", *keep)]
        + [T.StructField(name, T.ArrayType(T.ByteType())) for name, _, _ in columns]
    )

    def cut(row: dict) -> dict[str, np.ndarray]:
        full = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["frame_h"], row["frame_w"], -1)
        full = np.repeat(full, 3, axis=2) if full.shape[2] == 1 else full[:, :, :3]
        done: dict[str, np.ndarray] = {}
        for v in views:
            if v.parent:
                part = done[v.parent]
            else:
                box = row[v.window]
                part = full[box["lty"] : box["rby"] + 1, box["ltx"] : box["rbx"] + 1]
            done[v.name] = resample(part, v.size)
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STACK):
                part = batch.slice(lo, STACK)
                cuts = [cut(row) for row in part.to_pylist()]
                arrays = [part.column(c) for c in ("image_id", *keep)]
                for _, v, p in columns:
                    flat = np.concatenate([_plane(c[v.name], p).ravel() for c in cuts])
                    offsets = np.arange(len(cuts) + 1, dtype=np.int32) * v.size**2
                    arrays.append(
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint8).view(np.int8)))
                    )
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def view_planes(crops: DataFrame, view: View, *keep: str) -> DataFrame:
    """One view of ``crop_views`` as an image table."""
    return crops.select(
        "image_id",
        *keep,
        F.lit(view.size).alias("h"),
        F.lit(view.size).alias("w"),
        *[F.col(f"{view.name}_{p}").alias(p) for p in view.planes],
    )


def crop_and_resample(images: DataFrame, size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The single-view form over ``ltx, lty, rbx, rby`` columns."""
    box = F.struct("ltx", "lty", "rbx", "rby").alias("window")
    cut = images.select("image_id", *keep, "frame_h", "frame_w", "data", box)
    view = View("crop", size, window="window")
    return view_planes(crop_views(cut, [view], keep), view, *keep)


def plane_sums(images: DataFrame, *planes: str) -> DataFrame:
    """``image_id, h, w`` and the sum of each plane's pixels, added up over the
    whole batch's bytes at once rather than element by element."""
    fields = [images.schema[c].simpleString().replace(":", " ", 1) for c in ("image_id", "h", "w")]
    names = [f"sum_{p}" for p in planes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STACK):
                part, sums = batch.slice(lo, STACK), []
                for column in part.columns[3:]:
                    starts, flat = column.offsets.to_numpy(), column.values.to_numpy()
                    ends = np.r_[0, np.cumsum(flat[starts[0] : starts[-1]].view(np.uint8), dtype=np.int64)]
                    sums.append(pa.array(np.diff(ends[starts - starts[0]])))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *sums], names=["image_id", "h", "w", *names])

    schema = ", ".join([*fields, *[f"{n} long" for n in names]])
    return images.select("image_id", "h", "w", *planes).mapInArrow(run, schema)
