"""All image measures in one Arrow pass: planes or packed bytes in, a few
doubles per image out. Nothing is exchanged, exploded or written between a
scan and its verdict; scores are column expressions over the measures.

Functions take stacks of equally shaped images, ``(n, h, w)`` planes or
``(n, h, w, 3)`` BGR, at most STACK at a time, and give one value per image.
``presence.operators.pixels`` says the same measures as pixel aggregations;
tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from presence.functions import numeric
from presence.operators import spectral
from presence.operators.spectral import STACK

GRID, BLOCK = 4, 8
MEASURES = {
    "lbp": ("lbp_entropy",),
    "color": ("cr_std", "cb_std"),
    "sharpness": ("sharpness_cv",),
    "jpeg": ("jpeg_ratio",),
    "detail": ("lap", "teng", "resid", "brightness"),
    "hf": ("hf",),
    "fft": ("peak_ratio",),
    "moire": ("p95", "density"),
}
TEXTURE = ("lbp", "color", "sharpness", "jpeg", "fft")
DETAIL = ("detail", "hf")


def lbp_entropy(gray: np.ndarray) -> np.ndarray:
    """Entropy of local binary patterns of the interior over 8; NaN without one."""
    n, h, w = gray.shape
    if h < 3 or w < 3:
        return np.full(n, np.nan)
    count = np.empty((n, 256))
    for i, plane in enumerate(gray.astype(np.uint8)):
        centre, code = plane[1:-1, 1:-1], np.zeros((h - 2, w - 2), np.uint8)
        for bit, (y, x) in zip(range(7, -1, -1), ((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))):
            code |= (plane[y : y + h - 2, x : x + w - 2] >= centre).view(np.uint8) << bit
        count[i] = np.bincount(code.ravel(), minlength=256)
    total = count.sum(axis=1)
    logs = np.where(count > 0, np.log2(np.maximum(count, 1)), 0.0)
    return (np.log2(total) - (count * logs).sum(axis=1) / total) / 8


def _deviation(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """Variance over ``axes`` from exact whole sums."""
    x = x.astype(np.float64)  # whole sums below 2 ** 53 are exact
    n = np.prod([x.shape[a] for a in axes])
    mean = x.sum(axis=axes) / n
    return np.maximum(np.square(x, out=x).sum(axis=axes) / n - mean * mean, 0.0)


def luma(bgr: np.ndarray) -> np.ndarray:
    out = np.empty(bgr.shape[:-1], np.int32)  # 255 << 14 fits
    for i, image in enumerate(bgr):
        b, g, r = (image[..., c].astype(np.int32) for c in range(3))
        out[i] = (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14
    return out


def chroma_spread(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population deviation of both chroma planes."""
    y = luma(bgr)

    def spread(channel: int, weight: int) -> np.ndarray:
        plane = ((bgr[..., channel].astype(np.int32) - y) * weight + (128 << 14) + 8192) >> 14
        return np.sqrt(_deviation(np.clip(plane, 0, 255), (1, 2)))

    return spread(2, 11682), spread(0, 9241)


def _reflected(plane: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours before and after along an axis; the inner one at the ends."""
    n = plane.shape[axis]
    i = np.arange(n)
    return tuple(np.take(plane, (n - 1) - np.abs((n - 1) - np.abs(i + d)), axis=axis) for d in (-1, 1))


def _laplacian(plane: np.ndarray, axes: tuple[int, int]) -> np.ndarray:
    up, down = _reflected(plane, axes[0])
    left, right = _reflected(plane, axes[1])
    return up + down + left + right - 4 * plane


def sharpness_cv(gray: np.ndarray) -> np.ndarray:
    """Spread of the Laplacian variance over a 4 x 4 grid of lone cells; NaN
    where a cell has no pixel."""
    n, h, w = gray.shape
    ch, cw = h // GRID, w // GRID
    if not ch or not cw:
        return np.full(n, np.nan)
    cells = gray[:, : ch * GRID, : cw * GRID].astype(np.int32).reshape(n, GRID, ch, GRID, cw)
    variance = _deviation(_laplacian(cells, (2, 4)), (2, 4)).reshape(n, -1)
    return variance.std(axis=1) / (variance.mean(axis=1) + 1e-10)


def block_ratio(gray: np.ndarray) -> np.ndarray:
    """Steps across 8-pixel block edges over steps inside blocks; NaN where
    there are none of either."""
    g = gray.astype(np.int32)
    n, h, w = g.shape

    def steps(offset: int) -> tuple[np.ndarray, int]:
        total, lines = np.zeros(n), 0
        for axis, size, across in ((1, h, w), (2, w, h)):
            at = np.arange(BLOCK, size - BLOCK, BLOCK)
            lines += len(at)
            if len(at):
                a, b = np.take(g, at + offset, axis=axis), np.take(g, at + offset - 1, axis=axis)
                total = total + np.abs(a - b).sum(axis=(1, 2)) / across
        return total, lines

    (edge, lines), (inner, _) = steps(0), steps(BLOCK // 2)
    if not lines:
        return np.full(n, np.nan)
    edge, inner = edge / lines, inner / lines
    return np.where(inner >= 1e-10, edge / np.where(inner >= 1e-10, inner, 1.0), np.nan)


def detail(gray: np.ndarray) -> tuple[np.ndarray, ...]:
    """Laplacian variance, mean gradient, spread of the 3 x 3 blur residual
    and mean brightness; one plane at a time, which stays in the cache."""
    each = [_detail(plane) for plane in gray]
    return tuple(np.concatenate(x) for x in zip(*each, strict=True))


def _detail(plane: np.ndarray) -> tuple[np.ndarray, ...]:
    p = plane.astype(np.int16)  # no value here passes 16 * 255, squares are formed as doubles
    wide = p
    for axis in (0, 1):  # the inner neighbour outside the border
        n = p.shape[axis]
        wide = np.take(wide, (n - 1) - np.abs((n - 1) - np.abs(np.arange(-1, n + 1))), axis=axis)
    up, mid, down = wide[:-2], wide[1:-1], wide[2:]
    column, step = up + 2 * mid + down, down - up  # smoothed and differenced down the columns
    gx = column[:, 2:] - column[:, :-2]
    gy = step[:, :-2] + 2 * step[:, 1:-1] + step[:, 2:]
    blur16 = column[:, :-2] + 2 * column[:, 1:-1] + column[:, 2:]
    lap = up[:, 1:-1] + down[:, 1:-1] + mid[:, :-2] + mid[:, 2:] - 4 * p
    a, b = np.empty(p.shape), np.empty(p.shape)

    def variance(x: np.ndarray) -> float:
        np.copyto(a, x)
        total, squares = a.sum(), np.dot(a.ravel(), a.ravel())  # whole, below 2 ** 53: exact
        mean = total / x.size
        return max(squares / x.size - mean * mean, 0.0)

    out = [variance(lap), 0.0, np.sqrt(variance(16 * p - blur16)) / 16.0, p.mean()]
    np.copyto(a, gx)
    np.square(a, out=a)
    np.copyto(b, gy)
    np.square(b, out=b)
    out[1] = np.sqrt(np.add(a, b, out=a), out=a).mean()
    return tuple(np.array([x]) for x in out)


def _values(part: str, gray: np.ndarray, bgr: np.ndarray | None) -> tuple[np.ndarray, ...]:
    if part == "color":
        return chroma_spread(bgr)
    if part == "detail":
        return detail(gray)
    if part == "moire":
        return spectral.residual_density(gray.astype(np.float64))
    one = {"lbp": lbp_entropy, "sharpness": sharpness_cv, "jpeg": block_ratio}.get(part)
    if one is None:
        one = {"hf": spectral.hf_share, "fft": spectral.peak_ratio}[part]
        gray = gray.astype(np.float64)
    return (one(gray),)


def measured(parts: tuple[str, ...], gray: np.ndarray, bgr: np.ndarray | None = None) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for part in parts:
        out |= dict(zip(MEASURES[part], _values(part, gray, bgr), strict=True))
    return out


def names(*parts: str) -> list[str]:
    return [n for p in parts for n in MEASURES[p]]


def _planes(column: pa.Array, text: bool) -> Callable[[int], np.ndarray]:
    """Reader of one row's pixels; a row is unpacked when it is asked for."""
    if text:
        return lambda i: np.frombuffer(column[i].as_py().encode("utf-32-le"), np.uint32).astype(np.uint8)
    starts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return lambda i: flat[starts[i] : starts[i + 1]].astype(np.int64) & 255


def measure(images: DataFrame, *parts: str, size: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw measures of plane images (``image_id, h, w`` and ``gray``, or ``b,
    g, r`` where colour is asked for; arrays, or text whose characters modulo
    256 are the pixels), NULL where an image has none. ``size`` resamples to a square first. Rows are
    unpacked as they are measured, STACK images of one shape at a time."""
    colour = "color" in parts
    planes = ["b", "g", "r"] if colour else ["gray"]
    text = {p: images.schema[p].dataType.typeName() == "string" for p in planes}
    fields = [images.schema[c].simpleString().replace(":", " ", 1) for c in ("image_id", *keep)]
    schema = ", ".join([*fields, *[f"{n} double" for n in names(*parts)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            h, w = (col(c).to_numpy().astype(np.int64) for c in ("h", "w"))
            read = [_planes(col(p), text[p]) for p in planes]

            def plane(get: Callable[[int], np.ndarray], i: int) -> np.ndarray:
                image = get(i).reshape(h[i], w[i])  # noqa: B023
                return image if size is None else spectral.resample(image, size)

            # images of one size need no shape in common before it
            shape = h * (1 << 32) + w if size is None else np.zeros(len(h), np.int64)
            for one in np.unique(shape):
                at = np.flatnonzero(shape == one)
                for k in range(0, len(at), STACK):
                    some = at[k : k + STACK]
                    stack = [np.stack([plane(get, i) for i in some]).astype(np.int32) for get in read]
                    bgr = np.stack(stack, axis=-1) if colour else None
                    gray = luma(bgr) if colour else stack[0]
                    out = measured(parts, gray, bgr)
                    kept = [col(c).take(pa.array(some)) for c in ("image_id", *keep)]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, *[pa.array(v, from_pandas=True) for v in out.values()]], names=["image_id", *keep, *out]
                    )

    return images.select("image_id", *keep, "h", "w", *planes).mapInArrow(run, schema)


# -- scores -------------------------------------------------------------------


def texture_scores() -> dict[str, Column]:
    """Scores of the texture measures, from the raw columns."""
    ratio = F.col("jpeg_ratio")
    return {
        "fft": numeric.fft_score(F.col("peak_ratio")),
        "lbp": numeric.lbp_score(F.col("lbp_entropy")),
        "color": numeric.color_score(F.col("cr_std"), F.col("cb_std")),
        # at 160 pixels at most 5 % of the residuals lie above their 95th percentile
        "moire": F.lit(0.0),
        "sharpness": numeric.sharpness_score(F.col("sharpness_cv")),
        "jpeg": F.when(ratio.isNull(), F.lit(0.0)).otherwise(numeric.jpeg_score(ratio)),
    }


def recapture(face_px: Column | None) -> dict[str, Column]:
    return numeric.recapture_score(*[F.col(c) for c in ("lap", "teng", "resid", "hf")], face_px)


# -- photos -------------------------------------------------------------------


UNPACKED = 4 * STACK  # rows of a batch that stand as Python objects at a time


def per_row(run: Callable, schema: str):
    """A column function over structs, run by ``run(iterator of frames)``.

    Only the arguments go to Python; rows and their other columns stay. A batch
    stays in Arrow: UNPACKED rows of it become a frame, and their answers Arrow
    again, before the next. It counts as nondeterministic so that no rewrite
    evaluates it twice."""
    kind = to_arrow_type(T._parse_datatype_string(schema))

    def parts(batch: pa.Array, sizes: list[int]) -> Iterator[pd.DataFrame]:
        whole = pa.RecordBatch.from_struct_array(batch)
        for lo in range(0, len(batch), UNPACKED):
            yield whole.slice(lo, UNPACKED).to_pandas()
        sizes.append(len(batch))

    def column(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes: list[int] = []
        done: list[pa.Array] = []
        empty = pa.array([], kind)
        frames = (frame for batch in it for frame in parts(batch, sizes))
        # a batch has ended when the next frame is asked for, or none is left
        for answer in run(frames):
            while sizes:
                sizes.pop()
                yield pa.concat_arrays(done) if done else empty
                done = []
            done.append(pa.RecordBatch.from_pandas(answer, pa.schema(list(kind)), preserve_index=False).to_struct_array())
        while sizes:
            sizes.pop()
            yield pa.concat_arrays(done) if done else empty
            done = []

    column.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(column, schema).asNondeterministic()


def iterated(make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]):
    """``make`` builds a batch function once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = make()
        for frame in frames:
            yield work(frame)

    return run


def bgr_of(data: bytes, h: int, w: int) -> np.ndarray:
    """Packed bytes as an (h, w, 3) image: grey repeated, alpha left out."""
    full = np.frombuffer(data, dtype=np.uint8).reshape(h, w, -1)
    return np.repeat(full, 3, axis=2) if full.shape[2] == 1 else full[:, :, :3]


IMAGE = "frame_h int, frame_w int, data binary"


def decoded(payload: Column, decoder: Callable[[], Callable[[bytes], np.ndarray | None]]) -> Column:
    """``struct<frame_h, frame_w, data>`` of each payload, all NULL where it
    is NULL or the decoder gives None or raises: one bad file costs its row."""

    def make():
        decode = decoder()

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for raw in frame["raw"]:
                image = None
                if raw is not None:
                    try:
                        image = decode(raw)
                    except Exception:  # noqa: BLE001 - whatever a codec raises
                        image = None
                rows.append((None, None, None) if image is None or not image.size else (image.shape[0], image.shape[1], np.ascontiguousarray(image, np.uint8).tobytes()))
            return pd.DataFrame(rows, columns=["frame_h", "frame_w", "data"]).astype({"frame_h": "Int32", "frame_w": "Int32"})

        return work

    return per_row(iterated(make), IMAGE)(F.struct(payload.alias("raw")))


def detections(data: Column, h: Column, w: Column, factory: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Column:
    """Candidates as an array of structs, in the detector's order; NULL
    without image bytes."""

    def make():
        detect = factory()

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            for raw, rows, cols in zip(frame["data"], frame["h"], frame["w"], strict=True):
                if raw is None:
                    out.append(None)
                    continue
                found = np.asarray(detect(np.frombuffer(raw, np.uint8).reshape(int(rows), int(cols), -1)), float).reshape(-1, 5)
                out.append([dict(zip(("conf", "l", "t", "r", "b"), map(float, x), strict=True)) for x in found])
            return pd.DataFrame({"found": out})

        return work

    kind = "found array<struct<conf double, l double, t double, r double, b double>>"
    return per_row(iterated(make), kind)(F.struct(data.alias("data"), h.alias("h"), w.alias("w")))["found"]


def best_of(found: Column) -> Column:
    """Most confident candidate, the first at a tie, as a struct with ``cand``."""
    ranked = F.transform(found, lambda c, i: F.struct(c["conf"].alias("conf"), (-i).alias("at"), c["l"].alias("l"), c["t"].alias("t"), c["r"].alias("r"), c["b"].alias("b")))
    return F.array_max(ranked)


def photo_measures(
    data: Column,
    h: Column,
    w: Column,
    windows: dict[str, Column],
    views: list[spectral.View],
    detail_view: str,
    texture_view: str,
    scorers: list[tuple[str, Callable]],
) -> Column:
    """Struct of the detail and texture measures and each scorer's three class
    probabilities (``probs``, scorer by scorer), from one read of the pixels.

    ``views`` are cut and resampled once each; scorers get stacks of at most
    STACK images. Rows without bytes or with an unusable window give NULLs.
    """
    fields, boxes = [*names(*DETAIL), *names(*TEXTURE)], list(windows)

    def make():
        predictors = [(view, factory()) for view, factory in scorers]

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            n = len(frame)
            out = {c: np.full(n, np.nan) for c in fields}
            probs: list = [None] * n
            alive = [i for i, raw in enumerate(frame["data"]) if raw is not None and all(frame[c].iloc[i] is not None for c in boxes)]
            for k in range(0, len(alive), STACK):
                some = alive[k : k + STACK]
                cuts: dict[str, list[np.ndarray]] = {v.name: [] for v in views}
                for i in some:
                    full, done = bgr_of(frame["data"].iloc[i], int(frame["h"].iloc[i]), int(frame["w"].iloc[i])), {}
                    for v in views:
                        if v.parent:
                            part = done[v.parent]
                        else:
                            ltx, lty, rbx, rby = (int(x) for x in frame[v.window].iloc[i])
                            part = full[lty : rby + 1, ltx : rbx + 1]
                        done[v.name] = spectral.resample(part, v.size)
                        cuts[v.name].append(done[v.name])
                stacks = {name: np.stack(x) for name, x in cuts.items()}
                fine, coarse = stacks[detail_view], stacks[texture_view]
                for name, value in {**measured(DETAIL, luma(fine)), **measured(TEXTURE, luma(coarse), coarse)}.items():
                    out[name][some] = value
                # planes r, g, b one after the other, as the scorers read them
                called = [np.asarray(p(stacks[v][..., ::-1].transpose(0, 3, 1, 2).astype(np.float32)), float) for v, p in predictors]
                for j, i in enumerate(some):
                    probs[i] = np.concatenate([c[j] for c in called]).tolist()
            return pd.DataFrame({**{c: pd.array(np.where(np.isnan(v), None, v), "Float64") for c, v in out.items()}, "probs": probs})

        return work

    schema = ", ".join([*[f"{c} double" for c in fields], "probs array<double>"])
    cells = [data.alias("data"), h.alias("h"), w.alias("w"), *[c.alias(name) for name, c in windows.items()]]
    return per_row(iterated(make), schema)(F.struct(*cells))
