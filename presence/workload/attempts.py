"""Sessions, frame sets and admission limits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from presence.config import DEFAULTS
from presence.functions import vector
from presence.functions.numeric import round_dp
from presence.operators import gates, limits, sessions
from presence.workload.base import query
from presence.workload.views import oracle, rnd, view

# the event table spans a month, so sessions live for days here
LONG_TTL = replace(DEFAULTS, session_ttl_s=432000.0)
TTL_US, KEPT_US = 432000 * 10**6, (2 * 432000 + 61) * 10**6

_LOOKED = f"""looked as (select a.*, epoch_us(attempted_at) - epoch_us(created_at) as age_us, s.correlation_id as session_correlation_id,
 coalesce(epoch_us(attempted_at) - epoch_us(created_at) between 0 and {KEPT_US}, false) as session_found
 from v_attempts a left join v_sessions s on a.session_id = s.session_id),
 ranked as (select *, row_number() over (partition by session_id order by case when session_found and age_us <= {TTL_US} then 0 else 1 end,
   attempted_at, attempt_id) as rn,
  min(case when session_found and age_us <= {TTL_US} then attempted_at end) over (partition by session_id) as won_at from looked),
 consumed as (select *, case when not session_found then 'SESSION_NOT_FOUND'
  when won_at is not null and rn > 1 and attempted_at >= won_at then 'SESSION_ALREADY_USED'
  when age_us > {TTL_US} then 'SESSION_EXPIRED' end as session_error from ranked)"""


def _looked(spark, sf_dir):
    return sessions.lookup_session(
        view(spark, sf_dir, "v_attempts"), view(spark, sf_dir, "v_sessions"), LONG_TTL
    )


@query(
    "lookup_session",
    oracle(
        "select attempt_id, session_id, session_found, age_us from looked",
        "v_sessions",
        "v_attempts",
        extra=_LOOKED,
    ),
)
def _(spark, sf_dir):
    return _looked(spark, sf_dir).select("attempt_id", "session_id", "session_found", "age_us")


@query(
    "consume_once",
    oracle(
        "select attempt_id, session_error from consumed", "v_sessions", "v_attempts", extra=_LOOKED
    ),
)
def _(spark, sf_dir):
    return sessions.consume_once(_looked(spark, sf_dir), LONG_TTL).select(
        "attempt_id", "session_error"
    )


@query(
    "bind_correlation",
    oracle(
        """select attempt_id, case when session_error is not null then session_error
        when session_correlation_id <> correlation_id then 'SESSION_CORRELATION_MISMATCH' end as session_error from consumed""",
        "v_sessions",
        "v_attempts",
        extra=_LOOKED,
    ),
)
def _(spark, sf_dir):
    consumed = sessions.consume_once(_looked(spark, sf_dir), LONG_TTL)
    return sessions.bind_correlation(consumed).select("attempt_id", "session_error")


@query(
    "issue_challenges",
    oracle(
        """select request_id, sha256(concat('c', cast(request_id as string), '|', cast(request_id as string), '|',
          cast(epoch_us(ts) as string))) as session_id, case when sha256(concat(session_id, '|TURN_LEFT')) < sha256(concat(session_id, '|TURN_RIGHT'))
          then ['TURN_LEFT', 'TURN_RIGHT'] else ['TURN_RIGHT', 'TURN_LEFT'] end as steps, 4 as min_frames, 6 as max_frames, 90 as valid_s from v_access""",
        "v_access",
    ),
)
def _(spark, sf_dir):
    requests = view(spark, sf_dir, "v_access").select(
        F.concat(F.lit("c"), F.col("request_id")).alias("correlation_id"),
        F.lit("sale").alias("transaction_type"),
        F.col("request_id").cast("string").alias("transaction_ref"),
        F.col("ts").alias("requested_at"),
    )
    issued = sessions.issue_challenges(requests)
    return issued.select(
        F.col("transaction_ref").cast("long").alias("request_id"),
        "session_id",
        "steps",
        "min_frames",
        "max_frames",
        (F.unix_seconds("expires_at") - F.unix_seconds("created_at")).alias("valid_s"),
    )


# -- frames -----------------------------------------------------------------

_QC = """case when not face_detected then 'NO_FACE' when n_faces > 1 then 'MULTIPLE_FACES' when face_edge < 60 then 'TOO_SMALL'
 when sharpness < 40 then 'BLURRY' when brightness < 40 then 'TOO_DARK' when brightness > 235 then 'TOO_BRIGHT' end"""
# the stored vectors are unrelated, so frames lean on the first one of their
# session; one frame in seven sessions keeps its own (the swap)
_FRAMES = f"""ref as (select session_id as rid, cast(embedding as double[]) as re from v_session_frames where seq = 0),
 mixed as (select f.*, {_QC} as qc_reason, case when session_id % 7 = 0 and seq = 3 then cast(embedding as double[])
  else list_transform(list_zip(re, cast(embedding as double[])), lambda p: 0.9e0 * p[1] + 0.3e0 * p[2]) end as m
  from v_session_frames f join ref on rid = session_id),
 unit as (select * exclude (m), list_transform(m, lambda v: v / sqrt(list_dot_product(m, m))) as u from mixed),
 good as (select *, row_number() over (partition by session_id order by seq) as pos from unit where qc_reason is null),
 sims as (select g.session_id, g.seq, list_dot_product(r.u, g.u) as sim from good g join good r
  on r.session_id = g.session_id and r.pos = 1 where g.pos > 1),
 least_sim as (select session_id, min(sim) as low from sims group by session_id),
 counted as (select u.session_id, count(*) as n_received, count(*) filter (where qc_reason is null) as n_valid,
  bool_or(area_ratio >= 0.27e0) as document_hit,
  coalesce(bool_or(abs(yaw) <= 10) filter (where qc_reason is null), false) as frontal,
  coalesce(bool_or(yaw >= 20) filter (where qc_reason is null), false) as l,
  coalesce(bool_or(yaw <= -20) filter (where qc_reason is null), false) as r,
  coalesce(bool_or(pad_label = 'spoof') filter (where qc_reason is null), false) as passive,
  min(steps_kind) as kind, min(seq) filter (where qc_reason is null) as first_valid from unit u group by u.session_id),
 layered as (select c.*, low, case when n_valid = 0 then -1e0 when n_valid = 1 then 1e0 else {rnd('low', 4)} end as min_similarity,
  case when n_valid = 0 then false when n_valid = 1 then true else low >= 0.4e0 end as same_person,
  case when not frontal then 'NO_FRONTAL_REFERENCE' when (kind in (0, 1) and not l) or (kind in (0, 2) and not r)
   then 'STEP_NOT_DETECTED' end as challenge_reason from counted c left join least_sim s on s.session_id = c.session_id),
 best as (select session_id, seq as best_seq from (select *, row_number() over (partition by session_id
  order by case when abs(yaw) <= 10 then 1 else 0 end desc, {rnd('sharpness', 1)} desc, seq) as rn from good) where rn = 1)"""


def _steps(kind):
    return (
        F.when(kind == 0, F.array(F.lit("TURN_LEFT"), F.lit("TURN_RIGHT")))
        .when(kind == 1, F.array(F.lit("TURN_LEFT")))
        .otherwise(F.array(F.lit("TURN_RIGHT")))
    )


def session_frames(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("seq")
    own = F.col("embedding")
    blended = F.zip_with(
        F.first("embedding").over(w),
        own,
        lambda a, b: a.cast("double") * 0.9 + b.cast("double") * 0.3,
    )
    frames = view(spark, sf_dir, "v_session_frames").withColumn(
        "embedding",
        F.when(
            (F.col("session_id") % 7 == 0) & (F.col("seq") == 3),
            F.transform(own, lambda v: v.cast("double")),
        ).otherwise(blended),
    )
    return frames.withColumns(
        {
            "embedding": vector.l2_normalize(F.col("embedding")),
            "qc_reason": gates.qc_reason(),
            "is_document": F.col("area_ratio") >= DEFAULTS.face_ratio_reject,
            "min_ear": F.lit(None).cast("double"),
            "steps": _steps(F.col("steps_kind")),
        }
    )


def _gathered(spark, sf_dir):
    frames = session_frames(spark, sf_dir)
    kinds = frames.where(F.col("seq") == 0).select("session_id", "steps")
    return sessions.gather_frames(frames, "session_id").join(kinds, "session_id")


@query(
    "session_frame_counts",
    oracle(
        """select u.session_id, count(*) as n_received, count(*) filter (where qc_reason is null) as n_valid,
         count(*) filter (where qc_reason = 'MULTIPLE_FACES') as n_multiple, count(*) filter (where qc_reason = 'TOO_SMALL') as n_small,
         count(*) filter (where qc_reason = 'BLURRY') as n_blurry, count(*) filter (where qc_reason = 'TOO_DARK') as n_dark,
         count(*) filter (where qc_reason = 'TOO_BRIGHT') as n_bright from unit u group by u.session_id""",
        "v_session_frames",
        extra=_FRAMES,
    ),
)
def _(spark, sf_dir):
    counts = sessions.frame_counts()
    failed = counts["failed"]
    named = {
        "MULTIPLE_FACES": "n_multiple",
        "TOO_SMALL": "n_small",
        "BLURRY": "n_blurry",
        "TOO_DARK": "n_dark",
        "TOO_BRIGHT": "n_bright",
    }
    return _gathered(spark, sf_dir).select(
        "session_id",
        counts["n_received"].alias("n_received"),
        counts["n_valid"].alias("n_valid"),
        *[F.coalesce(failed[r], F.lit(0)).alias(n) for r, n in named.items()],
    )


@query(
    "session_document_hit",
    oracle(
        """select session_id, bool_or(area_ratio >= 0.27e0) as document_hit,
        coalesce(string_agg(concat(cast(seq as string), '=', cast(area_ratio as string)), ',' order by seq)
         filter (where area_ratio >= 0.27e0), '') as ratios
        from v_session_frames group by session_id""",
        "v_session_frames",
    ),
)
def _(spark, sf_dir):
    hits = sessions.document_hits()
    return _gathered(spark, sf_dir).select(
        "session_id",
        hits["document_hit"].alias("document_hit"),
        F.array_join(
            F.transform(
                F.map_entries(hits["document_ratios"]),
                lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")),
            ),
            ",",
        ).alias("ratios"),
    )


@query(
    "challenge_check",
    oracle(
        """select session_id, challenge_reason, concat_ws(',', case when kind in (0, 1) and not l then 'TURN_LEFT' end,
        case when kind in (0, 2) and not r then 'TURN_RIGHT' end) as missing from layered""",
        "v_session_frames",
        extra=_FRAMES,
    ),
)
def _(spark, sf_dir):
    checked = sessions.challenge_check(sessions.valid_frames(), F.col("steps"))
    return _gathered(spark, sf_dir).select(
        "session_id",
        checked["challenge_reason"].alias("challenge_reason"),
        F.concat_ws(",", checked["missing_steps"]).alias("missing"),
    )


@query(
    "missing_steps",
    oracle(
        """select session_id, cast(len(list_filter(case when kind = 0 then ['TURN_LEFT', 'TURN_RIGHT'] when kind = 1 then ['TURN_LEFT']
        else ['TURN_RIGHT'] end, lambda s: not ((s = 'TURN_LEFT' and l) or (s = 'TURN_RIGHT' and r)))) as int) as n_missing from layered""",
        "v_session_frames",
        extra=_FRAMES,
    ),
)
def _(spark, sf_dir):
    checked = sessions.challenge_check(sessions.valid_frames(), F.col("steps"))
    return _gathered(spark, sf_dir).select(
        "session_id", F.size(checked["missing_steps"]).alias("n_missing")
    )


@query(
    "identity_consistency",
    oracle(
        """select session_id, same_person as identity_passed, min_similarity, coalesce(first_valid, -1) as reference_seq from layered""",
        "v_session_frames",
        extra=_FRAMES,
    ),
)
def _(spark, sf_dir):
    rows = _gathered(spark, sf_dir).withColumns(
        {**sessions.frame_counts(), **sessions.identity_consistency(sessions.valid_frames())}
    )
    return rows.withColumns(sessions.identity_outcome()).select(
        "session_id", "identity_passed", "min_similarity", "reference_seq"
    )


@query(
    "reference_join",
    oracle(
        f"select session_id, seq, {rnd('sim', 4)} as similarity from sims",
        "v_session_frames",
        extra=_FRAMES,
    ),
)
def _(spark, sf_dir):
    rows = _gathered(spark, sf_dir).withColumns(
        sessions.identity_consistency(sessions.valid_frames())
    )
    return rows.select("session_id", F.inline("_sims")).select(
        "session_id", "seq", round_dp(F.col("sim"), 4).alias("similarity")
    )


@query(
    "identity_reference",
    oracle(
        f"select session_id, seq as reference_seq, {rnd('u[1]', 6)} as first_value from good where pos = 1",
        "v_session_frames",
        extra=_FRAMES,
    ),
)
def _(spark, sf_dir):
    valid = session_frames(spark, sf_dir).where(F.col("qc_reason").isNull())
    return (
        valid.groupBy("session_id")
        .agg(F.min("seq").alias("reference_seq"), F.min_by("embedding", "seq").alias("e"))
        .select("session_id", "reference_seq", round_dp(F.col("e")[0], 6).alias("first_value"))
    )


@query(
    "session_passive_pad",
    oracle("select session_id, passive from layered", "v_session_frames", extra=_FRAMES),
)
def _(spark, sf_dir):
    return _gathered(spark, sf_dir).select(
        "session_id", sessions.passive_spoof(sessions.valid_frames()).alias("passive")
    )


@query(
    "best_frame",
    oracle("select session_id, best_seq from best", "v_session_frames", extra=_FRAMES),
)
def _(spark, sf_dir):
    return (
        _gathered(spark, sf_dir)
        .select("session_id", sessions.best_frame(sessions.valid_frames()).alias("best_seq"))
        .where(F.col("best_seq").isNotNull())
    )


@query(
    "order_frames",
    oracle(
        """select session_id, string_agg(cast(seq as string), ',' order by seq) as seqs from v_session_frames group by session_id""",
        "v_session_frames",
    ),
)
def _(spark, sf_dir):
    shuffled = session_frames(spark, sf_dir).repartition(7, F.rand(3))
    return sessions.gather_frames(shuffled, "session_id").select(
        "session_id", F.array_join(F.transform("frames.seq", lambda q: q.cast("string")), ",").alias("seqs")
    )


def judged_attempts(spark, sf_dir):
    attempts = view(spark, sf_dir, "v_frame_attempts").withColumn(
        "attempted_at", F.timestamp_seconds("attempted_s")
    )
    known = view(spark, sf_dir, "v_frame_sessions").select(
        "session_id",
        F.timestamp_seconds("created_s").alias("created_at"),
        "correlation_id",
        _steps(F.col("steps_kind")).alias("steps"),
    )
    links = attempts.select("attempt_id", "session_id", "shape")
    sent = session_frames(spark, sf_dir).drop("steps").join(links, "session_id").where("shape <> 1")
    seq = F.col("seq")
    numbers = (
        F.when(F.col("shape") == 2, F.array(seq, seq + 5))
        .when(F.col("shape") == 3, F.array(F.greatest(seq, F.lit(1))))
        .when(F.col("shape") == 4, F.array(seq - 1))
        .otherwise(F.array(seq))
    )
    frames = sent.withColumn("seq", F.explode(numbers)).drop("shape")
    shaped = sessions.guard_shapes(attempts.drop("shape"), frames)
    bound = sessions.bind_correlation(
        sessions.consume_once(sessions.lookup_session(shaped, known))
    )
    return bound, frames


_SESSION_SQL = """attempted as (select a.*, s.session_id is not null as known, s.correlation_id as owner, attempted_s - created_s as age,
  row_number() over (partition by a.session_id order by case when attempted_s - created_s <= 90 then 0 else 1 end, attempted_s, attempt_id) as rn
  from v_frame_attempts a left join v_frame_sessions s on s.session_id = a.session_id where shape = 0),
 erred as (select *, case when not known then 'SESSION_NOT_FOUND' when rn > 1 then 'SESSION_ALREADY_USED'
  when age > 90 then case when exists (select 1 from attempted b where b.session_id = a.session_id and b.age <= 90 and
    b.attempted_s < a.attempted_s) then 'SESSION_ALREADY_USED' else 'SESSION_EXPIRED' end
  when owner <> correlation_id then 'SESSION_CORRELATION_MISMATCH' end as session_error from attempted a),
 reasoned as (select attempt_id, e.session_id, session_error, l.*,
  case when session_error is not null then session_error when document_hit then 'DOCUMENT_PHOTO' when n_valid < 4 then 'LOW_QUALITY_FRAMES'
   when challenge_reason = 'NO_FRONTAL_REFERENCE' then challenge_reason when challenge_reason is not null then 'CHALLENGE_FAILED'
   when not same_person then 'IDENTITY_SWAP_MID_SESSION' when passive then 'PASSIVE_PAD_SPOOF' end as reason
  from erred e join layered l on l.session_id = e.session_id)"""


SESSION_VERDICT = oracle(
        """select attempt_id, reason, case when reason is null then 'live' when reason in ('DOCUMENT_PHOTO', 'CHALLENGE_FAILED',
          'IDENTITY_SWAP_MID_SESSION', 'PASSIVE_PAD_SPOOF') then 'spoof' else 'incomplete' end as verdict,
         case when reason is null or reason in ('IDENTITY_SWAP_MID_SESSION', 'PASSIVE_PAD_SPOOF') then min_similarity else -1e0 end
          as frame_consistency_score,
         case when reason is null then best_seq end as best_frame_seq, n_received as n_frames_received,
         case when session_error is null then n_valid else 0 end as n_frames_valid, null as shape_reject
        from reasoned r left join best b on b.session_id = r.session_id
        union all select attempt_id, null, null, -1e0, null, case shape when 1 then 0 when 2 then 10 else 5 end, 0,
         case shape when 3 then 'DUPLICATE_SEQ' when 4 then 'NEGATIVE_SEQ' else 'FRAME_COUNT' end from v_frame_attempts where shape > 0""",
        "v_session_frames",
        "v_frame_sessions",
        "v_frame_attempts",
        extra=f"{_FRAMES}, {_SESSION_SQL}",
    )


@query("session_verdict", SESSION_VERDICT)
def session_verdicts(spark, sf_dir):
    bound, frames = judged_attempts(spark, sf_dir)
    return sessions.session_verdict(bound, frames).select(
        "attempt_id",
        "reason",
        "verdict",
        "frame_consistency_score",
        "best_frame_seq",
        "n_frames_received",
        "n_frames_valid",
        "shape_reject",
    )


# -- rate limit -------------------------------------------------------------

# the test stream has a few requests an hour, so its windows are hours and days
SLOW = replace(
    DEFAULTS,
    burst=3,
    burst_window_s=3600.0,
    sustained_per_s=20 / 86400.0 + 1e-9,
    sustained_window_s=86400.0,
)


def limit_sql(key: str, burst: int, short_us: int, sustained: int, long_us: int) -> str:
    return f"""with recursive v_access as ({view_sql('v_access')}),
 ordered as (select {key} as k, request_id as id, epoch_us(ts) as t,
  row_number() over (partition by {key} order by ts, request_id) as rn from v_access),
 fold as (select k, id, rn, true as allowed, [t] as stamps from ordered where rn = 1
  union all select k, id, rn, ok, case when ok then list_append(kept, t) else kept end from (
   select *, len(kept) < {sustained} and len(list_filter(kept, lambda s: s >= t - {short_us})) < {burst} as ok from (
    select o.k, o.id, o.rn, o.t, list_filter(f.stamps, lambda s: s >= o.t - {long_us}) as kept
    from fold f join ordered o on o.k = f.k and o.rn = f.rn + 1)))
 select k as {key}, id as request_id, allowed from fold"""


def view_sql(name: str) -> str:
    from presence.workload.views import VIEWS

    return VIEWS[name].strip()


@query("rate_limit", limit_sql("client_key", 3, 3600 * 10**6, 20, 86400 * 10**6))
def _(spark, sf_dir):
    return limits.rate_limit(view(spark, sf_dir, "v_access"), "client_key", "ts", "request_id", SLOW)


# quieter keys: most requests are settled without the fold
QUIET = replace(
    DEFAULTS,
    burst=2,
    burst_window_s=600.0,
    sustained_per_s=3 / 7200.0 + 1e-9,
    sustained_window_s=7200.0,
)


@query(
    "rate_limit_by_address",
    limit_sql("peer_ip", 2, 600 * 10**6, 3, 7200 * 10**6),
)
def _(spark, sf_dir):
    return limits.rate_limit(view(spark, sf_dir, "v_access"), "peer_ip", "ts", "request_id", QUIET)


@query(
    "window_pressure",
    oracle(
        """select client_key, bucket, n, cast(n + coalesce(case when lag(bucket) over w = bucket - 1 then lag(n) over w end, 0) as bigint) as at_most
        from (select client_key, epoch_us(ts) // 86400000000 as bucket, count(*) as n from v_access group by 1, 2)
        window w as (partition by client_key order by bucket)""",
        "v_access",
    ),
)
def _(spark, sf_dir):
    return limits.window_pressure(
        view(spark, sf_dir, "v_access"), "client_key", "ts", "request_id", SLOW
    )
