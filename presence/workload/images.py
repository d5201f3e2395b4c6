"""Image signals over images made from whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from presence.functions.numeric import round_dp
from presence.operators import measures, pixels
from presence.plans import pad
from presence.workload.base import query
from presence.workload.views import IMAGE_WIDTH as W
from presence.workload.views import oracle, rnd, text_images, text_planes


def _score(name: str):
    return measures.texture_scores()[name]


def _var(c: str) -> str:
    """Variance from exact integer sums, as the operators form it."""
    n = "count(*)"
    return f"(cast(sum({c} * {c}) as double) / {n} - (cast(sum({c}) as double) / {n}) * (cast(sum({c}) as double) / {n}))"


_PX = f"""near as (select *, lag(v, {W + 1}) over o as p00, lag(v, {W}) over o as p01, lag(v, {W - 1}) over o as p02,
 lag(v, 1) over o as p10, v as p11, lead(v, 1) over o as p12, lead(v, {W - 1}) over o as p20, lead(v, {W}) over o as p21,
 lead(v, {W + 1}) over o as p22 from v_pixels window o as (partition by image_id order by i))"""


@query(
    "lbp",
    oracle(
        f"""select image_id, {rnd('e', 6)} as lbp_entropy, case when e < 0.6e0 then 0.6e0 when e < 0.7e0 then 0.3e0
         when e < 0.75e0 then 0.15e0 else 0e0 end as lbp from (
         select image_id, -sum(n / total * log2(n / total)) / 8e0 as e from (
          select image_id, code, count(*) as n, max((h - 2) * (w - 2)) * 1e0 as total from (
           select *, (p00 >= v)::int * 128 + (p01 >= v)::int * 64 + (p02 >= v)::int * 32 + (p12 >= v)::int * 16
            + (p22 >= v)::int * 8 + (p21 >= v)::int * 4 + (p20 >= v)::int * 2 + (p10 >= v)::int as code
           from near where x between 1 and w - 2 and y between 1 and h - 2) group by image_id, code) group by image_id)""",
        "v_pixels",
        extra=_PX,
    ),
)
def _(spark, sf_dir):
    out = measures.measure(text_planes(spark, sf_dir), "lbp")
    return out.select("image_id", round_dp(F.col("lbp_entropy"), 6).alias("lbp_entropy"), _score("lbp").alias("lbp"))


def _bgr(spark, sf_dir):
    return text_images(spark, sf_dir).select(
        "image_id",
        "h",
        "w",
        F.col("gray").alias("b"),
        F.transform("gray", lambda v: (v * 7 + 3) % 256).alias("g"),
        F.transform("gray", lambda v: (v * 13 + 5) % 256).alias("r"),
    )


@query(
    "color",
    oracle(
        f"""select image_id, {rnd('cr', 6)} as cr_std, {rnd('cb', 6)} as cb_std, case when cr < 4 and cb < 3 then 0.6e0
         when cr < 6 and cb < 5 then 0.35e0 when cr < 8 and cb < 6 then 0.15e0 else 0e0 end as color from (
         select image_id, sqrt({_var('cr')}) as cr, sqrt({_var('cb')}) as cb from (select image_id,
          least(greatest(cast(floor(((r - l) * 11682 + 2105344) / 16384e0) as bigint), 0), 255) as cr,
          least(greatest(cast(floor(((b - l) * 9241 + 2105344) / 16384e0) as bigint), 0), 255) as cb
          from (select *, (b * 1868 + g * 9617 + r * 4899 + 8192) // 16384 as l from (
           select image_id, v as b, (7 * v + 3) % 256 as g, (13 * v + 5) % 256 as r from v_pixels))) group by image_id)""",
        "v_pixels",
    ),
)
def _(spark, sf_dir):
    out = measures.measure(_bgr(spark, sf_dir), "color").withColumn("color", _score("color"))
    return out.withColumns({c: round_dp(F.col(c), 6) for c in ("cr_std", "cb_std")})


@query(
    "sharpness",
    oracle(
        f"""select image_id, {rnd('cv', 6)} as sharpness_cv, case when cv < 0.1e0 then 0.4e0 when cv < 0.2e0 then 0.2e0
         when cv > 1.5e0 then 0.25e0 else 0e0 end as sharpness from (select image_id, stddev_pop(q) / (avg(q) + 1e-10) as cv from (
          select image_id, cy, cx, {_var('lap')} as q from (select *,
           case when ry = 0 then p21 else p01 end + case when ry = h // 4 - 1 then p01 else p21 end
           + case when rx = 0 then p12 else p10 end + case when rx = w // 4 - 1 then p10 else p12 end - 4 * v as lap
          from (select *, y // (h // 4) as cy, x // (w // 4) as cx, y % (h // 4) as ry, x % (w // 4) as rx from near))
          where cy < 4 and cx < 4 group by image_id, cy, cx) group by image_id)""",
        "v_pixels",
        extra=_PX,
    ),
)
def _(spark, sf_dir):
    out = measures.measure(text_planes(spark, sf_dir), "sharpness").withColumn("sharpness", _score("sharpness"))
    return out.withColumn("sharpness_cv", round_dp(F.col("sharpness_cv"), 6))


@query(
    "jpeg",
    oracle(
        f"""select image_id, {rnd('ratio', 6)} as jpeg_ratio, case when ratio > 1.5e0 then 0.4e0 when ratio > 1.3e0 then 0.25e0
         when ratio > 1.15e0 then 0.1e0 else 0e0 end as jpeg from (
         select image_id, case when inn >= 1e-10 then edge / inn end as ratio from (
          select image_id, avg(m) filter (where kind = 0) as edge, avg(m) filter (where kind = 1) as inn from (
           select image_id, 'r' as ax, y as line, y % 8 // 4 as kind, avg(abs(v - p01)) as m from near
            where (y % 8 = 0 and y >= 8 and y < h - 8) or (y % 8 = 4 and y >= 12 and y < h - 4) group by 1, 2, 3, 4
           union all select image_id, 'c', x, x % 8 // 4, avg(abs(v - p10)) from near
            where (x % 8 = 0 and x >= 8 and x < w - 8) or (x % 8 = 4 and x >= 12 and x < w - 4) group by 1, 2, 3, 4)
          group by image_id))""",
        "v_pixels",
        extra=_PX,
    ),
)
def _(spark, sf_dir):
    out = measures.measure(text_planes(spark, sf_dir), "jpeg").withColumn("jpeg", _score("jpeg"))
    return out.withColumn("jpeg_ratio", round_dp(F.col("jpeg_ratio"), 6))


# borders: the reflected neighbour is the opposite one; at corners both flip
_REFLECTED = f"""{_PX}, side as (select image_id, h, w, v, y, x,
 case when y = 0 then p21 else p01 end as n, case when y = h - 1 then p01 else p21 end as s,
 case when x = 0 then p12 else p10 end as e0, case when x = w - 1 then p10 else p12 end as e1,
 case when y = 0 then p20 else p00 end as nw0, case when y = 0 then p22 else p02 end as ne0,
 case when y = h - 1 then p00 else p20 end as sw0, case when y = h - 1 then p02 else p22 end as se0 from near),
 full_ring as (select *, case when x = 0 then ne0 else nw0 end as nw, case when x = w - 1 then nw0 else ne0 end as ne,
  case when x = 0 then se0 else sw0 end as sw, case when x = w - 1 then sw0 else se0 end as se from side),
 measured as (select image_id, v, n + s + e0 + e1 - 4 * v as lap,
  (ne + 2 * e1 + se) - (nw + 2 * e0 + sw) as gx, (sw + 2 * s + se) - (nw + 2 * n + ne) as gy,
  16 * v - (nw + ne + sw + se + 2 * (n + s + e0 + e1) + 4 * v) as res from full_ring),
 detailed as (select image_id, {_var('lap')} as lap, avg(sqrt(gx * gx + gy * gy)) as teng, sqrt({_var('res')}) / 16e0 as resid, avg(v) as brightness
  from measured group by image_id)"""


@query(
    "detail_stats",
    oracle(
        f"""select image_id, {rnd('lap', 4)} as lap, {rnd('teng', 6)} as teng, {rnd('resid', 6)} as resid,
        {rnd('brightness', 6)} as brightness from detailed""",
        "v_pixels",
        extra=_REFLECTED,
    ),
)
def _(spark, sf_dir):
    out = measures.measure(text_planes(spark, sf_dir), "detail")
    return out.withColumns(
        {
            "lap": round_dp(F.col("lap"), 4),
            **{c: round_dp(F.col(c), 6) for c in ("teng", "resid", "brightness")},
        }
    )


@query(
    "qc_metrics",
    oracle(
        f"select image_id, {rnd('lap', 4)} as sharpness, {rnd('brightness', 6)} as brightness from detailed",
        "v_pixels",
        extra=_REFLECTED,
    ),
)
def _(spark, sf_dir):
    out = measures.measure(text_planes(spark, sf_dir), "detail")
    return out.select(
        "image_id", round_dp(F.col("lap"), 4).alias("sharpness"), round_dp(F.col("brightness"), 6).alias("brightness")
    )


@query(
    "scanline_neighbours",
    oracle(
        """select image_id, y, cast(sum(v) as bigint) as line_sum, cast(sum(case when y = 0 then p21 else p01 end) as bigint) as above_sum,
        cast(sum(case when y = h - 1 then p01 else p21 end) as bigint) as below_sum from near group by image_id, y""",
        "v_pixels",
        extra=_PX,
    ),
)
def _(spark, sf_dir):
    lines = pixels.scanline_neighbours(pixels.scanlines(text_images(spark, sf_dir)))

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)

    return lines.select(
        "image_id",
        F.col("y").cast("long").alias("y"),
        total("line").alias("line_sum"),
        total("above").alias("above_sum"),
        total("below").alias("below_sum"),
    )


# The signals' own views: texture at 160 pixels, detail at 224, resampled in the
# same pass that measures them.
def textured(spark, sf_dir, *parts):
    return measures.measure(text_planes(spark, sf_dir), *parts, size=pad.SIGNAL_SIZE)


def detailed(spark, sf_dir):
    images = text_planes(spark, sf_dir).withColumn("face_px", F.col("h").cast("long") * F.col("w"))
    rows = measures.measure(images, *measures.DETAIL, size=pad.DETAIL_SIZE, keep=("face_px",))
    return rows.withColumns(measures.recapture(F.col("face_px")))


@query("fft")
def _(spark, sf_dir):
    out = textured(spark, sf_dir, "fft").withColumn("fft", _score("fft"))
    return out.withColumn("peak_ratio", round_dp(F.col("peak_ratio"), 6))


@query("moire")
def _(spark, sf_dir):
    out = textured(spark, sf_dir, "moire").withColumn("moire", _score("moire"))
    return out.withColumns({c: round_dp(F.col(c), 6) for c in ("p95", "density")})


@query("recapture_components")
def _(spark, sf_dir):
    cols = ("lap", "teng", "resid", "hf", "s_lap", "s_teng", "s_resid", "s_hf", "s_res", "detail", "recapture")
    return detailed(spark, sf_dir).select("image_id", "face_px", *[round_dp(F.col(c), 4).alias(c) for c in cols])


@query("recapture")
def _(spark, sf_dir):
    return detailed(spark, sf_dir).select("image_id", round_dp(F.col("recapture"), 4).alias("recapture"))
