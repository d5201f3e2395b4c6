"""Row-wise gates, scalar functions, signal sums and verdicts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from presence.config import DEFAULTS, SIGNAL_WEIGHTS
from presence.functions import numeric, text, vector
from presence.functions.numeric import round_dp
from presence.operators import gates, scores
from presence.workload.base import query
from presence.workload.views import oracle, rnd, table, view

# -- SQL building blocks ----------------------------------------------------

_TOTAL = " + ".join(
    f"coalesce({n} * {w!r}e0, 0e0)" if n == "recapture" else f"{n} * {w!r}e0"
    for n, w in SIGNAL_WEIGHTS.items()
)
_WEIGHTS = " + ".join(
    f"(case when {n} is null then 0e0 else {w!r}e0 end)" for n, w in SIGNAL_WEIGHTS.items()
)
SUMMED = (
    f"summed as (select *, {rnd(f'({_TOTAL}) / ({_WEIGHTS})', 4)} as spoof_probability from v_scored)"
)
_C = "(lbp > 0.1e0 or moire > 0.1e0)"
_R = "coalesce(recapture, 0e0)"
FUSED = f"""{SUMMED}, fused as (select *,
 case when {_R} >= 0.5e0 and {_C} then 'spoof'
  when nn_label <> 1 and nn_score < 0.9e0 and spoof_probability < 0.2e0 and not {_C} and {_R} < 0.5e0 then 'real'
  when nn_label <> 1 then 'spoof'
  when spoof_probability > 0.6e0 or (spoof_probability > 0.35e0 and nn_score < 0.7e0)
   or (spoof_probability > 0.1e0 and nn_score < 0.6e0) then 'spoof' else 'real' end as label,
 case when {_R} >= 0.5e0 and {_C} then greatest({_R}, spoof_probability)
  when nn_label <> 1 and nn_score < 0.9e0 and spoof_probability < 0.2e0 and not {_C} and {_R} < 0.5e0
   then 1e0 - spoof_probability
  when nn_label <> 1 then greatest(nn_score, spoof_probability)
  when spoof_probability > 0.6e0 then spoof_probability
  when spoof_probability > 0.35e0 and nn_score < 0.7e0 then greatest(nn_score * 0.5e0, spoof_probability)
  when spoof_probability > 0.1e0 and nn_score < 0.6e0 then greatest(nn_score * 0.4e0, spoof_probability)
  else nn_score end as score from summed)"""
_DOC = "(w > 0 and h > 0 and (w * h * 1e0) / (frame_w * frame_h * 1e0) >= 0.27e0)"
LABELLED = f"""{FUSED}, labelled as (select s.frame_id, client_id, species, ts, s.nn_label, nn_score, spoof_probability,
 case when not face_detected then 'no_face' when {_DOC} then 'document_photo' else label end as label,
 case when not face_detected then 0e0 when {_DOC} then {rnd('(w * h * 1e0) / (frame_w * frame_h * 1e0)', 4)}
  else score end as score,
 case when face_detected and {_DOC} then 0.27e0 else 0.5e0 end as threshold, face_detected
 from fused s join v_faces f on s.frame_id = f.frame_id), judged as (select *,
 case when label in ('document_photo', 'spoof') then 'spoof'
  when label = 'no_face' or score < 0.5e0 then 'low_quality' else 'live' end as verdict,
 case when label = 'document_photo' then 'DOCUMENT_PHOTO' when label = 'no_face' then 'NO_FACE'
  when label = 'spoof' then 'PASSIVE_PAD_SPOOF' when score < 0.5e0 then 'LOW_QUALITY' end as reason
 from labelled)"""


def fused(spark, sf_dir):
    return gates.fuse_verdict(scores.weighted_signal_sum(view(spark, sf_dir, "v_scored")))


def labelled(spark, sf_dir):
    faces = gates.geometry_gate(view(spark, sf_dir, "v_faces"))
    return gates.final_label(fused(spark, sf_dir).join(faces, "frame_id"))


def judged(spark, sf_dir):
    return gates.pad_verdict(labelled(spark, sf_dir))


# -- input limits -----------------------------------------------------------


@query(
    "guard_payload_size",
    "select doc_id, case when strlen(text) > 4096 then 'PAYLOAD_TOO_LARGE' end as size_reject from documents",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("payload", F.encode("text", "utf-8"))
    limit = replace(DEFAULTS, max_payload_bytes=4096)
    return gates.guard_payload_size(docs, "payload", limit).select("doc_id", "size_reject")


@query(
    "guard_dimensions",
    oracle(
        """select frame_id, case when frame_h * 3 > 4000 or frame_w * 3 > 4000 then 'DIMENSIONS_TOO_LARGE' end
        as dimension_reject from v_faces""",
        "v_faces",
    ),
)
def _(spark, sf_dir):
    frames = view(spark, sf_dir, "v_faces").withColumns(
        {"hh": F.col("frame_h") * 3, "ww": F.col("frame_w") * 3}
    )
    return gates.guard_dimensions(frames, "hh", "ww").select("frame_id", "dimension_reject")


@query(
    "guard_upload",
    """select page_id, case when page_id % 5 = 0 then 'not an image' when page_id % 7 = 0 then 'empty file' end
    as upload_error from pages""",
)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 10 == 0, F.lit("text/html"))
        .when(F.col("page_id") % 5 != 0, F.lit("image/png"))
        .alias("content_type"),
        F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.col("html")).alias("body"),
    )
    return gates.guard_upload(pages, "content_type", "body").select("page_id", "upload_error")


@query(
    "guard_attempt_shape",
    """select o_orderkey, case when n < 1 or n > 6 then 'FRAME_COUNT' when neg then 'NEGATIVE_SEQ'
    when d <> n then 'DUPLICATE_SEQ' end as shape_reject from (
     select o_orderkey, o_orderkey % 8 as n, o_orderkey % 11 = 0 as neg,
      case when o_orderkey % 13 = 0 and o_orderkey % 8 > 1 then o_orderkey % 8 - 1 else o_orderkey % 8 end as d from orders)""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    n = (key % 8).cast("int")
    attempts = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(n == 0, F.array().cast("array<int>"))
        .otherwise(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.when((key % 11 == 0) & (i == n), -i)
                .when((key % 13 == 0) & (i == 2), F.lit(1))
                .otherwise(i),
            )
        )
        .alias("seqs"),
    )
    return gates.guard_attempt_shape(attempts, "seqs").select("o_orderkey", "shape_reject")


# -- boxes and geometry -----------------------------------------------------


@query(
    "face_bbox",
    oracle(
        """select frame_id, cand, conf >= 0.4e0 as face_detected,
        case when conf >= 0.4e0 then cast(trunc(l * 960) as int) end as x,
        case when conf >= 0.4e0 then cast(trunc(t * 1280) as int) end as y,
        case when conf >= 0.4e0 then cast(trunc(r * 960) - trunc(l * 960) + 1 as int) end as w,
        case when conf >= 0.4e0 then cast(trunc(b * 1280) - trunc(t * 1280) + 1 as int) end as h
        from v_detections""",
        "v_detections",
    ),
)
def _(spark, sf_dir):
    cand = view(spark, sf_dir, "v_detections").withColumns(
        {"frame_w": F.lit(960), "frame_h": F.lit(1280)}
    )
    return gates.face_bbox(cand).select("frame_id", "cand", "face_detected", "x", "y", "w", "h")


@query(
    "bbox_xyxy_to_xywh",
    oracle(
        """select frame_id, cast(trunc(x + 0.75e0) as int) as x, cast(trunc(y - 0.75e0) as int) as y,
        cast(trunc(w + 0.5e0) as int) as w, cast(trunc(h + 1.25e0) as int) as h from v_faces""",
        "v_faces",
    ),
)
def _(spark, sf_dir):
    x1, y1 = F.col("x") + 0.75, F.col("y") - 0.75
    boxed = view(spark, sf_dir, "v_faces").select(
        "frame_id",
        F.struct(
            x1.alias("x1"),
            y1.alias("y1"),
            (x1 + F.col("w") + 0.5).alias("x2"),
            (y1 + F.col("h") + 1.25).alias("y2"),
        ).alias("box"),
    )
    return gates.bbox_xyxy_to_xywh(boxed).drop("box")


@query(
    "face_px",
    oracle(
        "select frame_id, cast(greatest(0, w - 100) * greatest(0, h - 100) as bigint) as face_px from v_faces",
        "v_faces",
    ),
)
def _(spark, sf_dir):
    faces = view(spark, sf_dir, "v_faces").select(
        "frame_id", (F.col("w") - 100).alias("w"), (F.col("h") - 100).alias("h")
    )
    return gates.face_px(faces).select("frame_id", "face_px")


@query(
    "crop_window",
    oracle(
        """select frame_id, cast(l2 - ox as int) as ltx, cast(t2 - oy as int) as lty,
         cast(r2 - ox as int) as rbx, cast(b2 - oy as int) as rby from (
          select *, greatest(r2 - (frame_w - 1), 0) as ox, greatest(b2 - (frame_h - 1), 0) as oy from (
           select *, greatest(l, 0) as l2, r + greatest(-l, 0) as r2, greatest(t, 0) as t2, b + greatest(-t, 0) as b2 from (
            select frame_id, frame_w, frame_h, trunc(w / 2e0 + x - w * s / 2e0) as l, trunc(w / 2e0 + x + w * s / 2e0) as r,
             trunc(h / 2e0 + y - h * s / 2e0) as t, trunc(h / 2e0 + y + h * s / 2e0) as b from (
             select *, least((frame_h - 1) / (h * 1e0), (frame_w - 1) / (w * 1e0), 2.7e0) as s from v_faces where w > 0))))
         union all select frame_id, null, null, null, null from v_faces where w <= 0""",
        "v_faces",
    ),
)
def _(spark, sf_dir):
    out = gates.crop_window(view(spark, sf_dir, "v_faces"), 2.7)
    return out.select("frame_id", "ltx", "lty", "rbx", "rby")


@query(
    "geometry_gate",
    oracle(
        f"""select frame_id, ok as geometry_ran, ok and area >= 0.27e0 as is_document,
         case when ok then {rnd('area', 4)} else 0e0 end as face_area_ratio,
         case when ok then {rnd('w * 1e0 / frame_w', 4)} else 0e0 end as face_width_ratio,
         case when ok then {rnd('frame_w * 1e0 / frame_h', 4)} else 0e0 end as frame_aspect_ratio
        from (select *, w > 0 and h > 0 as ok, (w * h * 1e0) / (frame_w * frame_h * 1e0) as area from v_faces)""",
        "v_faces",
    ),
)
def _(spark, sf_dir):
    return gates.geometry_gate(view(spark, sf_dir, "v_faces")).select(
        "frame_id",
        "geometry_ran",
        "is_document",
        "face_area_ratio",
        "face_width_ratio",
        "frame_aspect_ratio",
    )


_QC_SQL = """case when not face_detected then 'NO_FACE' when n_faces > 1 then 'MULTIPLE_FACES'
 when least(w, h) < 60 then 'TOO_SMALL' when sharpness < 40 then 'BLURRY'
 when brightness < 40 then 'TOO_DARK' when brightness > 235 then 'TOO_BRIGHT' end"""


def _qc_frames(spark, sf_dir):
    faces = view(spark, sf_dir, "v_faces")
    return gates.frame_qc(faces.withColumn("face_edge", F.least("w", "h").cast("double")))


@query(
    "frame_qc",
    oracle(
        f"""select frame_id, {_QC_SQL} as qc_reason, {_QC_SQL} is null as qc_valid,
        case when face_detected and n_faces > 1 then n_faces end as n_faces_detected,
        case when face_detected and n_faces <= 1 and least(w, h) >= 60 then {rnd('sharpness', 1)} end as sharpness,
        case when face_detected and n_faces <= 1 and least(w, h) >= 60 then {rnd('brightness', 1)} end as brightness from v_faces""",
        "v_faces",
    ),
)
def _(spark, sf_dir):
    return _qc_frames(spark, sf_dir).select(
        "frame_id",
        "qc_reason",
        "qc_valid",
        F.col("qc_metrics.n_faces_detected").alias("n_faces_detected"),
        F.col("qc_metrics.sharpness").alias("sharpness"),
        F.col("qc_metrics.brightness").alias("brightness"),
    )


# -- signals, fusion, verdicts ----------------------------------------------


@query(
    "weighted_signal_sum",
    oracle(
        """select frame_id, spoof_probability,
        concat_ws(',', case when fft > 0.1e0 then 'fft' end, case when lbp > 0.1e0 then 'lbp' end,
         case when color > 0.1e0 then 'color' end, case when moire > 0.1e0 then 'moire' end,
         case when sharpness > 0.1e0 then 'sharpness' end, case when jpeg > 0.1e0 then 'jpeg' end,
         case when recapture > 0.1e0 then 'recapture' end) as triggered from summed""",
        "v_scored",
        extra=SUMMED,
    ),
)
def _(spark, sf_dir):
    out = scores.weighted_signal_sum(view(spark, sf_dir, "v_scored"))
    return out.select(
        "frame_id", "spoof_probability", F.concat_ws(",", "signals_triggered").alias("triggered")
    )


@query(
    "fuse_verdict",
    oracle(
        f"select frame_id, label, {rnd('score', 6)} as score from fused", "v_scored", extra=FUSED
    ),
)
def _(spark, sf_dir):
    return fused(spark, sf_dir).select("frame_id", "label", round_dp(F.col("score"), 6).alias("score"))


@query(
    "is_real",
    oracle(
        "select frame_id, label = 'real' and score >= 0.5e0 as is_real from fused",
        "v_scored",
        extra=FUSED,
    ),
)
def _(spark, sf_dir):
    return gates.is_real(fused(spark, sf_dir)).select("frame_id", "is_real")


@query(
    "pad_verdict",
    oracle(
        f"select frame_id, verdict, reason, {rnd('score', 4)} as score, threshold from judged",
        "v_scored",
        "v_faces",
        extra=LABELLED,
    ),
)
def _(spark, sf_dir):
    return judged(spark, sf_dir).select(
        "frame_id", "verdict", "reason", round_dp(F.col("score"), 4).alias("score"), "threshold"
    )


@query(
    "verdict_counts",
    oracle(
        f"""select verdict, reason, count(*) as n, {rnd('avg(score)', 6)} as mean_score
        from judged group by verdict, reason""",
        "v_scored",
        "v_faces",
        extra=LABELLED,
    ),
)
def verdict_counts(spark, sf_dir):
    return (
        judged(spark, sf_dir)
        .groupBy("verdict", "reason")
        .agg(F.count(F.lit(1)).alias("n"), round_dp(F.avg("score"), 6).alias("mean_score"))
    )


@query(
    "legacy_verdict",
    oracle(
        """select frame_id, verdict, reason, case when label = 'real' and score >= 0.5e0 then 0 else 1 end
        as is_spoof from judged""",
        "v_scored",
        "v_faces",
        extra=LABELLED,
    ),
)
def _(spark, sf_dir):
    return gates.legacy_verdict(labelled(spark, sf_dir)).select(
        "frame_id", "verdict", "reason", "is_spoof"
    )


_VLM = r"""parsed as (select frame_id, response, upper(regexp_extract(response, 'LABEL\s*[:=]?\s*(STUDIO_BACK\w*|REAL_BACKGROUND)', 1, 'i')) as lab,
 regexp_extract(response, 'CONF[A-Z]*\s*[:=]\s*(\d{1,3})', 1, 'i') as num from v_vlm), answered as (select *,
 case when lab like 'STUDIO_BACK%' then true when lab = 'REAL_BACKGROUND' then false
  when contains(upper(response), 'STUDIO_BACKGROUND') or contains(upper(response), 'STUDIO_BACKDROP') then true
  when contains(upper(response), 'REAL_BACKGROUND') then false end as is_doc,
 case when num <> '' then least(cast(num as double), 100e0) / 100e0 else 0.5e0 end as share from parsed), replied as (select *,
 case when is_doc then share when not is_doc then 1e0 - share end as conf from answered)"""


def _replies(spark, sf_dir):
    return view(spark, sf_dir, "v_vlm")


@query(
    "parse_document_reply",
    oracle(
        f"""select frame_id, is_doc is not null as ran, is_doc as is_document, {rnd('conf', 6)} as confidence,
        case when is_doc then 'STUDIO_BACKGROUND' when not is_doc then 'REAL_BACKGROUND' end as raw_label from replied""",
        "v_vlm",
        extra=_VLM,
    ),
)
def _(spark, sf_dir):
    parsed = text.parse_document_replies(_replies(spark, sf_dir), "response")
    return parsed.select(
        "frame_id",
        "ran",
        "is_document",
        round_dp(F.col("confidence"), 6).alias("confidence"),
        "raw_label",
    )


@query(
    "document_reject",
    oracle(
        "select frame_id, coalesce(is_doc and conf >= 0.7e0, false) as document_reject from replied",
        "v_vlm",
        extra=_VLM,
    ),
)
def _(spark, sf_dir):
    return gates.document_reject(_replies(spark, sf_dir), "response").select(
        "frame_id", "document_reject"
    )


@query(
    "error_default",
    oracle(
        """select request_id, case when failed and endpoint = 'session' then 'incomplete' when failed then 'low_quality' end
         as default_verdict, case when failed then 'INTERNAL_ERROR' end as default_reason,
         case when failed and endpoint = 'session' then -1e0 when failed then 0e0 end as default_score,
         case when failed and endpoint = 'legacy' then 1 end as default_is_spoof
        from (select *, request_id % 7 = 0 as failed from v_latency)""",
        "v_latency",
    ),
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "v_latency").withColumn(
        "error", F.when(F.col("request_id") % 7 == 0, F.lit("boom"))
    )
    return gates.error_default(rows).select(
        "request_id", "default_verdict", "default_reason", "default_score", "default_is_spoof"
    )


@query(
    "timeout_default",
    oracle(
        """select request_id, late as timed_out,
        case when late and endpoint = 'session' then 'incomplete' when late then 'low_quality' end as timeout_verdict,
        case when late then 'TIMEOUT' end as timeout_reason from (select *, processing_ms * 100 >
         case when endpoint = 'session' then 8000e0 else 2000e0 end as late from v_latency)""",
        "v_latency",
    ),
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "v_latency").withColumn(
        "processing_ms", F.col("processing_ms") * 100
    )
    return gates.timeout_default(rows).select(
        "request_id", "timed_out", "timeout_verdict", "timeout_reason"
    )


_FAULT = "case when frame_id % 17 = 0 then 'TIMEOUT' when frame_id % 29 = 0 then 'INTERNAL_ERROR' end"


@query(
    "action_for",
    oracle(
        f"""select frame_id, action, action = 'reject' as incident, action = 'proceed' as security_event from (
         select frame_id, case when frame_id % 101 < 7 then 'reject_identity' when fault is not null then 'proceed'
          when verdict = 'live' then 'continue' when verdict = 'spoof' then 'reject' else 'retake' end as action
         from (select *, {_FAULT} as fault from judged))""",
        "v_scored",
        "v_faces",
        extra=LABELLED,
    ),
)
def _(spark, sf_dir):
    fault = F.when(F.col("frame_id") % 17 == 0, F.lit("TIMEOUT")).when(
        F.col("frame_id") % 29 == 0, F.lit("INTERNAL_ERROR")
    )
    rows = judged(spark, sf_dir).withColumns(
        {
            "match_score": F.when(F.col("frame_id") % 101 < 7, F.lit(69.9)).otherwise(F.lit(70.0)),
            "verdict": F.when(fault.isNotNull(), F.lit("low_quality")).otherwise(F.col("verdict")),
            "reason": F.coalesce(fault, F.col("reason")),
        }
    )
    return gates.action_for(rows, "match_score").select(
        "frame_id", "action", "incident", "security_event"
    )


@query(
    "route_save_frame",
    oracle(
        """select frame_id, case when reason = 'DOCUMENT_PHOTO' then true when reason = 'NO_FACE' then false
        else verdict in ('spoof', 'low_quality') end as save_frame from judged""",
        "v_scored",
        "v_faces",
        extra=LABELLED,
    ),
)
def _(spark, sf_dir):
    wide = replace(DEFAULTS, save_frame_verdicts=("spoof", "low_quality"))
    return gates.route_save_frame(judged(spark, sf_dir), wide).select("frame_id", "save_frame")


# -- admission --------------------------------------------------------------


@query(
    "replay_guard",
    oracle(
        """select request_id, case when kind in (3, 4) then 'MISSING' when kind < 7 then 'INVALID'
        when abs(skew_s) > 120 then 'OUTSIDE_WINDOW' end as replay_reject from v_headers""",
        "v_headers",
    ),
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "v_headers")
    return gates.replay_guard(rows, "header", F.col("received_s")).select(
        "request_id", "replay_reject"
    )


_HOP = "trim(string_split(xff, ',')[-1])"
_CLIENT = f"""clients as (select request_id, peer_ip, case when request_id % 6 = 4 and request_id % 2 = 0 and xff is not null
 and request_id % 300 <= 255 then {_HOP} else peer_ip end as client_ip from v_access)"""


@query(
    "effective_ip",
    oracle("select request_id, client_ip from clients", "v_access", extra=_CLIENT),
)
def _(spark, sf_dir):
    trusting = replace(DEFAULTS, trust_proxy_headers=True)
    return gates.resolve_client(view(spark, sf_dir, "v_access"), "peer_ip", "xff", trusting).select(
        "request_id", "client_ip"
    )


@query(
    "ip_allowlist",
    oracle(
        """select request_id, client_ip, case when request_id % 9 in (0, 1, 3) then false
         when request_id % 9 in (2, 4) or not ok then true else (n between 2130706432 and 2147483647)
         or (n between 3232235520 and 3232235775) or (n between 167772160 and 184549375)
         or (n between 2886729728 and 2887778303) end as admitted from (
         select *, p[1]::bigint * 16777216 + p[2]::bigint * 65536 + p[3]::bigint * 256 + p[4]::bigint as n from (
          select request_id, client_ip, ok, case when ok then string_split(client_ip, '.') else ['0', '0', '0', '0'] end as p
          from (select *, len(string_split(client_ip, '.')) = 4 and not contains(client_ip, ':') as ok from v_addresses)))""",
        "v_addresses",
    ),
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "v_addresses")
    return gates.ip_allowlist(rows).select("request_id", "client_ip", "admitted")


# -- detections and ensembles -----------------------------------------------


@query(
    "best_detection",
    oracle(
        """select frame_id, cand, conf, n_candidates from (select *,
          row_number() over (partition by frame_id order by conf desc, cand) as rn,
          count(*) over (partition by frame_id) as n_candidates from v_detections) where rn = 1""",
        "v_detections",
    ),
)
def _(spark, sf_dir):
    return scores.best_detection(view(spark, sf_dir, "v_detections")).select(
        "frame_id", "cand", "conf", "n_candidates"
    )


@query(
    "best_face_and_count",
    oracle(
        """select frame_id, cand, conf as det_score, case when cand % 3 = 0 then 0e0 else l * 100 end as yaw, n_faces
        from (select *, row_number() over (partition by frame_id order by conf desc, cand) as rn,
          count(*) over (partition by frame_id) as n_faces from v_detections where conf >= 0.4e0) where rn = 1""",
        "v_detections",
    ),
)
def _(spark, sf_dir):
    yaw = F.when(F.col("cand") % 3 != 0, F.col("l") * 100)
    faces = (
        view(spark, sf_dir, "v_detections")
        .where(F.col("conf") >= 0.4)
        .withColumns({"det_score": F.col("conf"), "pitch": yaw, "yaw": yaw, "roll": yaw})
    )
    return scores.best_face_and_count(faces).select(
        "frame_id", "cand", "det_score", "yaw", "n_faces"
    )


@query(
    "attach_detection",
    oracle(
        """select o_orderkey as frame_id, coalesce(conf >= 0.4e0, false) as face_detected,
         case when conf >= 0.4e0 then cast(trunc(l * 960) as int) end as x,
         case when conf >= 0.4e0 then cast(trunc(r * 960) - trunc(l * 960) + 1 as int) end as w
        from orders left join (select * from (select *, row_number() over (partition by frame_id order by conf desc, cand)
          as rn from v_detections) where rn = 1) on o_orderkey = frame_id""",
        "v_detections",
    ),
)
def _(spark, sf_dir):
    frames = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("frame_id"),
        F.lit(960).alias("frame_w"),
        F.lit(1280).alias("frame_h"),
    )
    best = scores.best_detection(view(spark, sf_dir, "v_detections"))
    return gates.face_bbox(scores.attach_detection(frames, best)).select(
        "frame_id", "face_detected", "x", "w"
    )


_LOGITS = """logits as (select frame_id, m, (frame_id * (7 + m) % 13) / 4e0 as a, (frame_id * (11 + m) % 17) / 4e0 as b,
 (frame_id * (5 + m) % 11) / 4e0 as c from v_scored cross join (select unnest([0, 1]) as m)),
 probs as (select frame_id, exp(a - greatest(a, b, c)) as ea, exp(b - greatest(a, b, c)) as eb,
  exp(c - greatest(a, b, c)) as ec from logits)"""


def _logits(spark, sf_dir):
    key, m = F.col("frame_id"), F.col("m")
    return (
        view(spark, sf_dir, "v_scored")
        .select("frame_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("m"))
        .select(
            "frame_id",
            "m",
            ((key * (m + 7) % 13) / 4.0).alias("a"),
            ((key * (m + 11) % 17) / 4.0).alias("b"),
            ((key * (m + 5) % 11) / 4.0).alias("c"),
        )
    )


@query(
    "softmax3",
    oracle(
        f"""select frame_id, m, {rnd('ea / (ea + eb + ec)', 6)} as p0, {rnd('eb / (ea + eb + ec)', 6)} as p1,
        {rnd('ec / (ea + eb + ec)', 6)} as p2 from (select frame_id, m, exp(a) as ea, exp(b) as eb, exp(c) as ec from logits)""",
        "v_scored",
        extra=_LOGITS,
    ),
)
def _(spark, sf_dir):
    p = numeric.softmax3(F.col("a"), F.col("b"), F.col("c"))
    return _logits(spark, sf_dir).select(
        "frame_id", "m", *[round_dp(c, 6).alias(f"p{i}") for i, c in enumerate(p)]
    )


@query(
    "ensemble_vote",
    oracle(
        f"""select frame_id, case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as nn_label,
        {rnd('greatest(s0, s1, s2) / 2e0', 6)} as nn_score from (select frame_id, sum(ea / (ea + eb + ec)) as s0,
         sum(eb / (ea + eb + ec)) as s1, sum(ec / (ea + eb + ec)) as s2 from probs group by frame_id)""",
        "v_scored",
        extra=_LOGITS,
    ),
)
def _(spark, sf_dir):
    p = numeric.softmax3(F.col("a"), F.col("b"), F.col("c"))
    probs = _logits(spark, sf_dir).select(
        "frame_id", *[c.alias(f"p{i}") for i, c in enumerate(p)]
    )
    return scores.ensemble_vote(probs).select(
        "frame_id", "nn_label", round_dp(F.col("nn_score"), 6).alias("nn_score")
    )


# -- scalar functions -------------------------------------------------------


@query(
    "ramp",
    oracle(
        f"""select frame_id, {rnd('''case when nn_score <= 0.6e0 then 1e0 when nn_score >= 0.9e0 then 0e0
        else (0.9e0 - nn_score) / (0.9e0 - 0.6e0) end''', 6)} as s from v_scored""",
        "v_scored",
    ),
)
def _(spark, sf_dir):
    return view(spark, sf_dir, "v_scored").select(
        "frame_id", round_dp(numeric.ramp(F.col("nn_score"), 0.6, 0.9), 6).alias("s")
    )


@query(
    "score_bucket",
    oracle(
        """select frame_id,
         case when n < 0.6e0 then 0.6e0 when n < 0.7e0 then 0.3e0 when n < 0.75e0 then 0.15e0 else 0e0 end as lbp,
         case when j > 1.5e0 then 0.4e0 when j > 1.3e0 then 0.25e0 when j > 1.15e0 then 0.1e0 else 0e0 end as jpeg,
         case when p > 15e0 then 0.8e0 when p > 10e0 then 0.6e0 else 0.3e0 end as fft,
         case when cr < 4 and cb < 3 then 0.6e0 when cr < 6 and cb < 5 then 0.35e0 when cr < 8 and cb < 6 then 0.15e0
          else 0e0 end as color,
         case when s < 0.1e0 then 0.4e0 when s < 0.2e0 then 0.2e0 when s > 1.5e0 then 0.25e0 else 0e0 end as sharpness
        from (select frame_id, nn_score as n, nn_score * 2e0 as j, nn_score * 20e0 as p, nn_score * 10e0 as cr,
         nn_score * 8e0 as cb, (nn_score - 0.5e0) * 4e0 as s from v_scored)""",
        "v_scored",
    ),
)
def _(spark, sf_dir):
    n = F.col("nn_score")
    return view(spark, sf_dir, "v_scored").select(
        "frame_id",
        numeric.lbp_score(n).alias("lbp"),
        numeric.jpeg_score(n * 2).alias("jpeg"),
        numeric.fft_score(n * 20).alias("fft"),
        numeric.color_score(n * 10, n * 8).alias("color"),
        numeric.sharpness_score((n - 0.5) * 4).alias("sharpness"),
    )


def _ear_sql(p: list[int]) -> str:
    # landmark i of a row sits at embedding[i % 32 * 2 + 1 .. + 2]
    def gap(i: int, j: int) -> str:
        a, b = i % 32 * 2 + 1, j % 32 * 2 + 1
        dx, dy = f"(e[{a}] - e[{b}])", f"(e[{a + 1}] - e[{b + 1}])"
        return f"sqrt({dx} * {dx} + {dy} * {dy})"

    width = gap(p[0], p[3])
    return (
        f"(case when {width} < 1e-6 then 0e0 else ({gap(p[1], p[5])} + {gap(p[2], p[4])}) / ({width} * 2e0) end)"
    )


@query(
    "eye_aspect_ratio",
    f"""select vec_id, {rnd('r', 6)} as right_ear, {rnd('l', 6)} as left_ear, {rnd('least(r, l)', 6)} as min_ear,
    {rnd('least(r, l)', 3)} <= 0.2e0 as blink from (
    select vec_id, {_ear_sql([36, 37, 38, 39, 40, 41])} as r, {_ear_sql([42, 43, 44, 45, 46, 47])} as l
    from (select vec_id, cast(embedding as double[]) as e from embeddings))""",
)
def _(spark, sf_dir):
    points = F.transform(
        F.sequence(F.lit(0), F.lit(67)),
        lambda i: F.array(
            F.get("embedding", i % 32 * 2), F.get("embedding", i % 32 * 2 + 1), F.lit(0.0).cast("float")
        ),
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", points.alias("p"))
    p = F.col("p")
    return rows.select(
        "vec_id",
        round_dp(vector.eye_aspect_ratio(p, vector.RIGHT_EYE), 6).alias("right_ear"),
        round_dp(vector.eye_aspect_ratio(p, vector.LEFT_EYE), 6).alias("left_ear"),
        round_dp(vector.min_ear(p), 6).alias("min_ear"),
        (round_dp(vector.min_ear(p), 3) <= DEFAULTS.ear_blink_max).alias("blink"),
    )


@query(
    "cosine",
    f"""select vec_id, {rnd('''list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))''', 6)}
     as similarity, {rnd('e[1] / sqrt(list_dot_product(e, e))', 6)} as first_unit
    from (select vec_id, cast(embedding as double[]) as e, list_reverse(cast(embedding as double[])) as q from embeddings)""",
)
def _(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        round_dp(vector.cosine(v, F.reverse(v)), 6).alias("similarity"),
        round_dp(vector.l2_normalize(v)[0], 6).alias("first_unit"),
    )


@query(
    "pose_frontal",
    oracle(
        "select session_id, seq, abs(yaw) <= 10 as frontal from v_session_frames", "v_session_frames"
    ),
)
def _(spark, sf_dir):
    return view(spark, sf_dir, "v_session_frames").select(
        "session_id", "seq", (F.abs("yaw") <= DEFAULTS.yaw_frontal_max).alias("frontal")
    )


@query(
    "challenge_steps",
    oracle(
        """select request_id, list_transform(list_sort([[sha256(concat(request_id, '|', s)), s] for s in ['TURN_LEFT', 'TURN_RIGHT', 'BLINK']])[1:2],
         lambda p: p[2]) as steps, 2 as n_drawn, true as from_pool from v_access""",
        "v_access",
    ),
)
def _(spark, sf_dir):
    pool = "TURN_LEFT, TURN_RIGHT, BLINK"
    steps = text.challenge_steps(F.col("request_id"), pool, 2)
    drawn = text.challenge_steps(F.col("request_id"), pool, 2, random=True)
    known = F.array(*[F.lit(c.strip()) for c in pool.split(",")])
    return (
        view(spark, sf_dir, "v_access")
        .select("request_id", steps.alias("steps"), drawn.alias("drawn"))
        .select(
            "request_id",
            "steps",
            F.size(F.array_distinct("drawn")).alias("n_drawn"),
            (F.size(F.array_except("drawn", known)) == 0).alias("from_pool"),
        )
    )
