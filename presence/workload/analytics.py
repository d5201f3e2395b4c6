"""Reports over decisions, latencies and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from presence.functions.numeric import round_dp
from presence.operators import reports
from presence.workload.base import query
from presence.workload.decisions import LABELLED, fused, judged
from presence.workload.views import oracle, rnd, table, view

_JUDGED = ("v_scored", "v_faces", "v_truth")
TRUTH = f"""{LABELLED}, known as (select j.frame_id, label, score, verdict, reason, t.bona_fide, t.species,
 s.recapture, s.lbp, s.color, s.spoof_probability, f.w * f.h * 1e0 / (f.frame_w * f.frame_h) as area from judged j
 join v_truth t on t.frame_id = j.frame_id join summed s on s.frame_id = j.frame_id join v_faces f on f.frame_id = j.frame_id)"""


def known(spark, sf_dir):
    rows = judged(spark, sf_dir).drop("species")
    return reports.attach_truth(rows, view(spark, sf_dir, "v_truth"))


@query(
    "attach_truth",
    oracle("select frame_id, label, bona_fide, species from known", *_JUDGED, extra=TRUTH),
)
def _(spark, sf_dir):
    return known(spark, sf_dir).select("frame_id", "label", "bona_fide", "species")


@query(
    "confusion_counts",
    oracle(
        """select bona_fide, count(*) filter (where label <> 'no_face' and ((bona_fide and label = 'real')
          or (not bona_fide and label in ('spoof', 'document_photo')))) as correct,
         count(*) filter (where label <> 'no_face') as total from known group by bona_fide""",
        *_JUDGED,
        extra=TRUTH,
    ),
)
def _(spark, sf_dir):
    return reports.confusion_counts(known(spark, sf_dir))


_APCER = f"""{TRUTH}, per as (select species, count(*) filter (where not bona_fide) as attacks,
  count(*) filter (where not bona_fide and verdict = 'live') as accepted, count(*) filter (where bona_fide) as genuine,
  count(*) filter (where bona_fide and verdict <> 'live') as rejected from known group by species)"""


@query(
    "apcer_bpcer",
    oracle(
        f"""select species, attacks, accepted, genuine as bona_fide, rejected, {rnd('accepted * 1e0 / attacks', 6)} as apcer,
          {rnd('rejected * 1e0 / genuine', 6)} as bpcer, {rnd('accepted * 1e0 / attacks', 6)} as apcer_max,
          false as overall, null as worst_species from per
         union all select null, cast(sum(attacks) as bigint), cast(sum(accepted) as bigint), cast(sum(genuine) as bigint),
          cast(sum(rejected) as bigint), {rnd('sum(accepted) * 1e0 / sum(attacks)', 6)}, {rnd('sum(rejected) * 1e0 / sum(genuine)', 6)},
          {rnd('max(accepted * 1e0 / attacks)', 6)}, true,
          (select species from per where attacks > 0 order by accepted * 1e0 / attacks desc, species nulls first limit 1) from per""",
        *_JUDGED,
        extra=_APCER,
    ),
)
def _(spark, sf_dir):
    out = reports.apcer_bpcer(known(spark, sf_dir))
    return out.withColumns({c: round_dp(F.col(c), 6) for c in ("apcer", "bpcer", "apcer_max")})


_SIGNALS = ["recapture", "lbp", "color", "spoof_probability"]


@query(
    "signal_distribution",
    oracle(
        " union all ".join(
            f"""select bona_fide, '{s}' as signal, count({s}) as n, {rnd(f'min({s})', 6)} as min, {rnd(f'quantile_cont({s}, 0.5)', 6)} as median,
            {rnd(f'max({s})', 6)} as max, {rnd(f'avg({s})', 6)} as mean from known group by bona_fide"""
            for s in _SIGNALS
        ),
        *_JUDGED,
        extra=TRUTH,
    ),
)
def _(spark, sf_dir):
    out = reports.signal_distribution(known(spark, sf_dir), _SIGNALS)
    return out.withColumns({c: round_dp(F.col(c), 6) for c in ("min", "median", "max", "mean")})


@query(
    "threshold_margin",
    oracle(
        f"""select {rnd('hi', 6)} as bona_fide_max, {rnd('lo', 6)} as spoof_min, {rnd('0.27e0 / hi - 1', 6)} as margin_above,
         {rnd('0.27e0 / lo - 1', 6)} as margin_below from (select max(area) filter (where bona_fide) as hi,
          min(area) filter (where not bona_fide and area > 0) as lo from known)""",
        *_JUDGED,
        extra=TRUTH,
    ),
)
def _(spark, sf_dir):
    area = F.col("w") * F.col("h") / (F.col("frame_w") * F.col("frame_h"))
    rows = known(spark, sf_dir).withColumn("area", F.when(area > 0, area))
    out = reports.threshold_margin(rows, "area", 0.27)
    return out.select(*[round_dp(F.col(c), 6).alias(c) for c in out.columns])


@query(
    "threshold_sweep",
    oracle(
        f"""select threshold, {rnd('''count(*) filter (where not bona_fide and recapture < threshold) * 1e0
          / count(*) filter (where not bona_fide)''', 6)} as far,
         {rnd('count(*) filter (where bona_fide and recapture >= threshold) * 1e0 / count(*) filter (where bona_fide)', 6)} as frr
        from known cross join (select unnest(range(101)) / 100e0 as threshold) where recapture is not null group by threshold""",
        *_JUDGED,
        extra=TRUTH,
    ),
)
def _(spark, sf_dir):
    out = reports.threshold_sweep(
        known(spark, sf_dir).withColumn("recapture", F.col("signal_scores.recapture")), "recapture"
    )
    return out.withColumns({c: round_dp(F.col(c), 6) for c in ("far", "frr")})


@query(
    "calibration_report",
    oracle(
        f"""select 'confusion' as section, case when bona_fide then 'bona_fide' else 'attack' end as "group", 'correct' as measure,
          count(*) filter (where label <> 'no_face' and ((bona_fide and label = 'real')
          or (not bona_fide and label in ('spoof', 'document_photo')))) * 1e0 as value from known group by bona_fide
         union all select 'confusion', case when bona_fide then 'bona_fide' else 'attack' end, 'total',
          count(*) filter (where label <> 'no_face') * 1e0 from known group by bona_fide
         union all select 'error_rates', species, unnest(['apcer', 'bpcer', 'apcer_max']), unnest([{rnd('accepted * 1e0 / attacks', 6)},
          {rnd('rejected * 1e0 / genuine', 6)}, {rnd('accepted * 1e0 / attacks', 6)}]) from per
         union all select 'error_rates', 'overall', unnest(['apcer', 'bpcer', 'apcer_max']), unnest([
          {rnd('sum(accepted) * 1e0 / sum(attacks)', 6)}, {rnd('sum(rejected) * 1e0 / sum(genuine)', 6)},
          {rnd('max(accepted * 1e0 / attacks)', 6)}]) from per
         union all select 'distribution', concat(case when bona_fide then 'bona_fide' else 'attack' end, '/recapture'),
          unnest(['n', 'min', 'median', 'max', 'mean']), unnest([count(recapture) * 1e0, {rnd('min(recapture)', 6)},
          {rnd('quantile_cont(recapture, 0.5)', 6)}, {rnd('max(recapture)', 6)}, {rnd('avg(recapture)', 6)}]) from known group by bona_fide
         union all select 'margin', 'recapture', unnest(['bona_fide_max', 'spoof_min', 'margin_above', 'margin_below']),
          unnest([{rnd('hi', 6)}, {rnd('lo', 6)}, {rnd('0.5e0 / hi - 1', 6)}, {rnd('0.5e0 / nullif(lo, 0) - 1', 6)}]) from (
           select max(recapture) filter (where bona_fide) as hi, min(recapture) filter (where not bona_fide) as lo from known)
         union all select 'sweep', printf('%.2f', t), 'far', {rnd('''count(*) filter (where not bona_fide and recapture < t) * 1e0
          / count(*) filter (where not bona_fide)''', 6)} from known cross join (select unnest(range(21)) / 20e0 as t)
          where recapture is not null group by t
         union all select 'sweep', printf('%.2f', t), 'frr', {rnd('''count(*) filter (where bona_fide and recapture >= t) * 1e0
          / count(*) filter (where bona_fide)''', 6)} from known cross join (select unnest(range(21)) / 20e0 as t)
          where recapture is not null group by t""",
        *_JUDGED,
        extra=_APCER,
    ),
)
def _(spark, sf_dir):
    rows = known(spark, sf_dir).withColumn("recapture", F.col("signal_scores.recapture"))
    out = reports.calibration_report(rows, ["recapture"], "recapture", 0.5)
    return out.withColumn("value", round_dp(F.col("value"), 6))


@query(
    "latency_summary",
    oracle(
        f"""select endpoint, n, {rnd('avg_ms', 6)} as avg_ms, p50, p95, p99, median, p95_low, {rnd('n * 1000e0 / busy', 6)} as per_busy_second from (
         select endpoint, count(*) as n, avg(processing_ms) as avg_ms, sum(processing_ms) as busy,
          list_sort(list(processing_ms))[count(*) // 2 + 1] as p50,
          list_sort(list(processing_ms))[cast(floor(count(*) * 0.95e0) as int) + 1] as p95,
          list_sort(list(processing_ms))[cast(floor(count(*) * 0.99e0) as int) + 1] as p99,
          (list_sort(list(processing_ms))[(count(*) - 1) // 2 + 1] + list_sort(list(processing_ms))[count(*) // 2 + 1]) / 2e0 as median,
          list_sort(list(processing_ms))[cast(floor(count(*) * 0.95e0) as int)] as p95_low
         from v_latency group by endpoint)""",
        "v_latency",
    ),
)
def _(spark, sf_dir):
    out = reports.latency_summary(view(spark, sf_dir, "v_latency"))
    return out.withColumns({c: round_dp(F.col(c), 6) for c in ("avg_ms", "per_busy_second")})


@query(
    "batch_summary",
    oracle(
        f"""select request_id // 16 as batch, count(*) as count, {rnd('sum(processing_ms)', 4)} as total_ms
        from v_latency group by 1""",
        "v_latency",
    ),
)
def _(spark, sf_dir):
    out = reports.batch_summary(view(spark, sf_dir, "v_latency"), "request_id")
    return out.withColumn("total_ms", round_dp(F.col("total_ms"), 4))


@query(
    "verdict_monitor",
    oracle(
        f"""select epoch_us(ts) // 300000000 * 300 as window_s, 'pad' as endpoint, verdict, reason, count(*) as n,
        {rnd('count(*) * 1e0 / sum(count(*)) over (partition by epoch_us(ts) // 300000000)', 6)} as rate
        from judged group by epoch_us(ts) // 300000000, verdict, reason""",
        "v_scored",
        "v_faces",
        extra=LABELLED,
    ),
)
def _(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("endpoint", F.lit("pad"))
    out = reports.verdict_monitor(rows)
    return out.select(
        F.unix_seconds("window_start").alias("window_s"),
        "endpoint",
        "verdict",
        "reason",
        "n",
        round_dp(F.col("rate"), 6).alias("rate"),
    )


@query(
    "worst_k",
    oracle(
        f"""select species, frame_id, {rnd('spoof_probability', 4)} as spoof_probability, rank from (select species, frame_id, spoof_probability,
         row_number() over (partition by species order by spoof_probability desc, frame_id) as rank from summed) where rank <= 10""",
        "v_scored",
        extra=LABELLED.split(", fused as")[0],
    ),
)
def _(spark, sf_dir):
    rows = fused(spark, sf_dir).select("species", "frame_id", "spoof_probability")
    out = reports.worst_k(rows, "spoof_probability", 10, "frame_id", "species")
    return out.withColumn("spoof_probability", round_dp(F.col("spoof_probability"), 4))


@query(
    "cross_file_similarity",
    f"""with u as (select vec_id, label, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) as e from (
      select vec_id, label, cast(embedding as double[]) as e from embeddings))
     select least(a.label, b.label) as class_a, greatest(a.label, b.label) as class_b, count(*) as pairs,
      {rnd('min(list_dot_product(a.e, b.e))', 6)} as min_cos, {rnd('avg(list_dot_product(a.e, b.e))', 6)} as mean_cos,
      {rnd('max(list_dot_product(a.e, b.e))', 6)} as max_cos from u a join u b on a.vec_id < b.vec_id group by 1, 2""",
)
def _(spark, sf_dir):
    out = reports.cross_file_similarity(
        table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", block=128
    )
    return out.withColumns({c: round_dp(F.col(c), 6) for c in ("min_cos", "mean_cos", "max_cos")})
