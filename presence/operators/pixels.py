"""Image signals as pixel aggregations.

An image is one row: ``image_id, h, w`` and flat row-major planes (``gray``,
or ``b, g, r``) as arrays of bytes or ints. Crops have a fixed size (160, 224 or 112
pixels square), so a row is bounded. The pixel index is generated next to the
row and neighbours are read from the same array, all inside generated code;
the partial aggregates that leave a task hold one row per image and histogram
bin or grid cell. Pixels are never shuffled, sorted or buffered.

Borders reflect without repeating the edge pixel. Integer luma and chroma use
the usual 14-bit fixed-point weights, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presence.functions import numeric

GRID = 4
BLOCK = 8


def explode_pixels(images: DataFrame, *planes: str) -> DataFrame:
    """One row per pixel beside the (shared) plane arrays.

    Adds ``y, x``, the offset of the pixel's line (``row``) and of the lines
    around it (``above``, ``below``), and the columns around it (``left``,
    ``right``); line values are computed once per line. Unused ones are pruned.
    """
    y, h, w = F.col("y"), F.col("h"), F.col("w")
    lines = images.select(
        "image_id", "h", "w", *planes, F.explode(F.sequence(F.lit(0), h - 1)).alias("y")
    ).select(
        "*",
        (y * w).alias("row"),
        (reflect(y - 1, h) * w).alias("above"),
        (reflect(y + 1, h) * w).alias("below"),
    )
    x = F.col("x")
    return lines.select("*", F.explode(F.sequence(F.lit(0), w - 1)).alias("x")).select(
        "*", reflect(x - 1, w).alias("left"), reflect(x + 1, w).alias("right")
    )


def reflect(c: Column, n: Column) -> Column:
    return (n - 1) - F.abs((n - 1) - F.abs(c))


def value(plane: str, index: Column) -> Column:
    """Pixel value; the mask undoes the wrap of planes kept as bytes."""
    return F.get(F.col(plane), index).cast("int").bitwiseAND(F.lit(255))


def at(plane: str, line: str, column: str) -> Column:
    return value(plane, F.col(line) + F.col(column))


def luma(b: Column, g: Column, r: Column) -> Column:
    return F.shiftright(b * 1868 + g * 9617 + r * 4899 + 8192, 14)


def _variance(total: Column, squares: Column, n: Column) -> Column:
    mean = total / n
    return F.greatest(squares / n - mean * mean, F.lit(0.0))


# -- texture ----------------------------------------------------------------


def lbp(images: DataFrame) -> DataFrame:
    """Entropy of local binary patterns over 8, and its score.

    Neighbours at least as bright as the centre set bits 7..0 clockwise from
    the top-left; only interior pixels count.
    """
    around = [
        ("above", "left"), ("above", "x"), ("above", "right"), ("row", "right"),
        ("below", "right"), ("below", "x"), ("below", "left"), ("row", "left"),
    ]
    code = F.lit(0)
    for bit, place in zip(range(7, -1, -1), around):
        code = code + F.when(at("gray", *place) >= at("gray", "row", "x"), F.lit(1 << bit)).otherwise(
            F.lit(0)
        )
    inner = explode_pixels(images, "gray").where(
        F.col("x").between(1, F.col("w") - 2) & F.col("y").between(1, F.col("h") - 2)
    )
    histogram = inner.groupBy("image_id", code.alias("code")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    # -sum(p log p) with p = n / total, without a pass for the total
    bits = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    entropy = histogram.groupBy("image_id").agg((bits / 8.0).alias("lbp_entropy"))
    return entropy.withColumn("lbp", numeric.lbp_score(F.col("lbp_entropy")))


# -- colour, sharpness by cell, block edges ---------------------------------


def _laplacian(up: Column, down: Column, left: Column, right: Column, centre: Column) -> Column:
    return (up + down + left + right - centre * 4).cast("long")


def _chroma(channel: str, weight: int) -> Column:
    wide = F.shiftright((F.col(channel) - F.col("luma")) * weight + (128 << 14) + 8192, 14)
    return F.greatest(F.least(wide, F.lit(255)), F.lit(0)).cast("long")


def _cell_laplacian() -> dict[str, Column]:
    """Grid cell and Laplacian with the cell's own edges reflected; both NULL
    for the remainder of lines and columns outside the grid."""
    row, x, y, ch, cw = (F.col(c) for c in ("row", "x", "y", "ch", "cw"))
    inside = (y < ch * GRID) & (x < cw * GRID)
    top, bottom = y % ch == 0, y % ch == ch - 1
    first, last = x % cw == 0, x % cw == cw - 1
    # at a cell edge the inner neighbour stands in; one-pixel cells see themselves
    up = F.when(ch == 1, row).when(top, row + F.col("w")).otherwise(row - F.col("w"))
    down = F.when(ch == 1, row).when(bottom, row - F.col("w")).otherwise(row + F.col("w"))
    before = F.when(cw == 1, x).when(first, x + 1).otherwise(x - 1)
    after = F.when(cw == 1, x).when(last, x - 1).otherwise(x + 1)
    around = (up + x, down + x, row + before, row + after, row + x)
    cell = F.floor(y / ch).cast("int") * GRID + F.floor(x / cw).cast("int")
    return {
        "cell": F.when(inside, cell),
        "lap": F.when(inside, _laplacian(*[value("gray", i) for i in around])),
    }


def _block_steps() -> dict[str, Column]:
    """Absolute steps on block edges and on the lines inside blocks."""
    centre = at("gray", "row", "x")
    steps = {
        "row": (F.abs(centre - at("gray", "above", "x")).cast("long"), F.col("y"), F.col("h")),
        "col": (F.abs(centre - at("gray", "row", "left")).cast("long"), F.col("x"), F.col("w")),
    }
    out = {}
    for axis, (step, place, extent) in steps.items():
        for kind, offset in (("edge", 0), ("inner", BLOCK // 2)):
            line = place - offset
            used = (line % BLOCK == 0) & (line >= BLOCK) & (line < extent - BLOCK)
            out[f"{axis}_{kind}"] = F.when(used, step).otherwise(F.lit(0).cast("long"))
    return out


def block_signals(images: DataFrame, parts: tuple[str, ...] = ("color", "sharpness", "jpeg")) -> DataFrame:
    """Colour, sharpness and block-edge signals from one pass over the pixels.

    color: population spread of the chroma planes. sharpness: spread of the
    Laplacian variance over a 4x4 grid whose cells stand alone. jpeg: steps
    across 8-pixel block edges against steps inside blocks. Each comes with
    its raw measure and its score.
    """
    by_cell = "sharpness" in parts
    planes = (["b", "g", "r"] if "color" in parts else []) + (["gray"] if by_cell or "jpeg" in parts else [])
    sized = images.withColumns({c: F.floor(F.col(n) / GRID).cast("int") for c, n in (("ch", "h"), ("cw", "w"))})
    px = explode_pixels(sized, *planes, "ch", "cw")
    columns: dict[str, Column] = {}
    if "color" in parts:
        px = px.withColumns({f"v{c}": at(c, "row", "x") for c in "bgr"}).withColumn(
            "luma", luma(F.col("vb"), F.col("vg"), F.col("vr"))
        )
        columns |= {"cr": _chroma("vr", 11682), "cb": _chroma("vb", 9241)}
    if by_cell:
        columns |= _cell_laplacian()
    steps = _block_steps() if "jpeg" in parts else {}
    px = px.select("image_id", "h", "w", *[c.alias(n) for n, c in {**columns, **steps}.items()])

    squares = [c for c in ("cr", "cb", "lap") if c in columns]
    sums = [F.max("h").alias("h"), F.max("w").alias("w"), F.count(F.lit(1)).alias("n")]
    sums += [F.sum(c).alias(c) for c in (*squares, *steps)]
    sums += [F.sum(F.col(c) * F.col(c)).alias(f"{c}2") for c in squares]
    if by_cell:
        cells = px.groupBy("image_id", "cell").agg(*sums)
        cells = cells.withColumn("var", F.when(F.col("cell").isNotNull(), _variance(F.col("lap"), F.col("lap2"), F.col("n"))))
        rest = [c for c in ("n", "cr", "cb", "cr2", "cb2", *steps) if c in cells.columns]
        totals = cells.groupBy("image_id").agg(
            F.max("h").alias("h"),
            F.max("w").alias("w"),
            *[F.sum(c).alias(c) for c in rest],
            (F.stddev_pop("var") / (F.avg("var") + 1e-10)).alias("sharpness_cv"),
        )
    else:
        totals = px.groupBy("image_id").agg(*sums)

    out = [F.col("image_id")]
    if "color" in parts:
        spreads = [F.sqrt(_variance(F.col(c), F.col(f"{c}2"), F.col("n"))) for c in ("cr", "cb")]
        out += [spreads[0].alias("cr_std"), spreads[1].alias("cb_std"), numeric.color_score(*spreads).alias("color")]
    if by_cell:
        out += [F.col("sharpness_cv"), numeric.sharpness_score(F.col("sharpness_cv")).alias("sharpness")]
    if steps:

        def lines(n: str) -> Column:
            return F.greatest(F.ceil((F.col(n) - 2 * BLOCK) / BLOCK), F.lit(0))

        count = lines("h") + lines("w")
        edge, inner = (
            F.try_divide(F.col(f"row_{k}") / F.col("w") + F.col(f"col_{k}") / F.col("h"), count)
            for k in ("edge", "inner")
        )
        ratio = F.when(inner >= 1e-10, F.try_divide(edge, inner))
        score = F.when(ratio.isNull(), F.lit(0.0)).otherwise(numeric.jpeg_score(ratio))
        out += [ratio.alias("jpeg_ratio"), score.alias("jpeg")]
    return totals.select(*out)


def color(images: DataFrame) -> DataFrame:
    return block_signals(images, ("color",))


def sharpness(images: DataFrame) -> DataFrame:
    return block_signals(images, ("sharpness",))


def jpeg(images: DataFrame) -> DataFrame:
    return block_signals(images, ("jpeg",))


# -- detail -----------------------------------------------------------------


def detail_stats(images: DataFrame) -> DataFrame:
    """Laplacian variance, mean gradient, 3x3-blur residual spread and mean
    brightness. Unused measures are pruned by the planner."""
    lines, columns = {-1: "above", 0: "row", 1: "below"}, {-1: "left", 0: "x", 1: "right"}
    places = {(dy, dx): f"p{dy + 1}{dx + 1}" for dy in lines for dx in columns}
    px = explode_pixels(images, "gray").select(
        "image_id",
        *[at("gray", lines[dy], columns[dx]).alias(n) for (dy, dx), n in places.items()],
    )
    p = {place: F.col(n) for place, n in places.items()}
    lap = _laplacian(p[-1, 0], p[1, 0], p[0, -1], p[0, 1], p[0, 0])
    gx = (p[-1, 1] + p[0, 1] * 2 + p[1, 1]) - (p[-1, -1] + p[0, -1] * 2 + p[1, -1])
    gy = (p[1, -1] + p[1, 0] * 2 + p[1, 1]) - (p[-1, -1] + p[-1, 0] * 2 + p[-1, 1])
    blur16 = (
        p[-1, -1] + p[-1, 1] + p[1, -1] + p[1, 1]
        + (p[-1, 0] + p[1, 0] + p[0, -1] + p[0, 1]) * 2
        + p[0, 0] * 4
    )
    px = px.select(
        "image_id",
        p[0, 0].cast("long").alias("gray"),
        lap.alias("lap"),
        F.sqrt((gx * gx + gy * gy).cast("double")).alias("grad"),
        (p[0, 0] * 16 - blur16).cast("long").alias("res16"),
    )
    n = F.count(F.lit(1))
    return px.groupBy("image_id").agg(
        _variance(F.sum("lap"), F.sum(F.col("lap") * F.col("lap")), n).alias("lap"),
        F.avg("grad").alias("teng"),
        (F.sqrt(_variance(F.sum("res16"), F.sum(F.col("res16") * F.col("res16")), n)) / 16.0).alias(
            "resid"
        ),
        F.avg("gray").alias("brightness"),
    )


def qc_metrics(images: DataFrame) -> DataFrame:
    """Sharpness and brightness of aligned crops, as the quality gate needs."""
    return detail_stats(images).select(
        "image_id", F.col("lap").alias("sharpness"), "brightness"
    )


# -- scanlines --------------------------------------------------------------


def scanlines(images: DataFrame, plane: str = "gray") -> DataFrame:
    """Images as lines: ``image_id, y, h, line``, without a shuffle."""
    return images.select(
        "image_id",
        "h",
        plane,
        "w",
        F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"),
    ).select(
        "image_id", "h", "y", F.slice(F.col(plane), F.col("y") * F.col("w") + 1, F.col("w")).alias("line")
    )


def scanline_neighbours(lines: DataFrame) -> DataFrame:
    """Lines with the ones above and below, for images stored as lines.

    An image has at most ``max_dimension`` lines, so a window per image is
    bounded. At the first and last line the inner neighbour stands in.
    """
    w = Window.partitionBy("image_id").orderBy("y")
    above, below = F.lag("line").over(w), F.lead("line").over(w)
    return lines.withColumns(
        {
            "above": F.coalesce(above, below, F.col("line")),
            "below": F.coalesce(below, above, F.col("line")),
        }
    )
