"""Capture sessions from request file to verdict.

Five embeddings in a row are a session. Each frame is a flat photo whose first
pixels state what the injected models report of it, so that SQL can follow
every layer; decoding, measuring, embedding and scoring are real.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.config import DEFAULTS
from presence.plans import pad
from presence.plans.session import SessionModels, judge_attempts
from presence.session import shared_folder
from presence.sources import codecs, scan
from presence.workload.base import query
from presence.workload.requests import tone_scorer
from presence.workload.views import VIEWS, oracle, rnd, view

HEIGHT, WIDTH = 160, 120

VIEWS["v_photo_frames"] = """
select session_id, seq, case when vec_id % 41 = 0 then 2 when vec_id % 43 = 0 then 0 else 1 end as faces,
 case when n % 13 = 2 then 15 when seq = 1 then 30 when seq = 2 then -30 else vec_id % 7 - 3 end as yaw,
 case when vec_id % 37 = 0 then 1 else 3 end as amp,
 case when n % 7 = 3 and seq = 3 then 225 when vec_id % 59 = 0 then 30 when vec_id % 67 = 0 then 240 else 120 + 3 * seq end as level,
 case when vec_id % 53 = 0 then 55 when n % 30 = 7 and seq = 2 then 80 else 62 end as edge,
 case when n % 3 <> 1 and seq = 4 then 10 else 30 end as ear, n % 9 = 5 and seq = 0 as spoofed,
 n % 17 = 4 and seq = 1 as boom, case when n % 19 = 5 then 50 else 1 end as took,
 n % 23 = 6 and seq < 2 as undecodable, n % 29 = 7 and seq = 3 as bad_text, n
from (select vec_id, vec_id - vec_id % 5 as session_id, vec_id % 5 as seq, (vec_id - vec_id % 5) / 5 as n from embeddings)
"""

VIEWS["v_capture_sessions"] = """
select session_id, n, n % 4 as kind, n % 31 <> 8 as known, case when n % 37 = 9 then 100 else 10 end as after_s,
 n % 41 = 10 as foreign_id, n % 43 = 11 as repeated
from (select distinct vec_id - vec_id % 5 as session_id, (vec_id - vec_id % 5) / 5 as n from embeddings)
"""

STEPS = {0: ("TURN_LEFT", "TURN_RIGHT"), 1: ("BLINK", "TURN_LEFT"), 2: ("TURN_RIGHT",), 3: ("NOD",)}


def _steps(kind):
    out = None
    for k, steps in STEPS.items():
        value = F.array(*[F.lit(x) for x in steps])
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out


def capture_folder(spark, sf_dir) -> str:
    folder = shared_folder(spark, "captures")
    facts = [
        F.col("faces"), F.col("yaw") + 40, F.col("amp"), F.col("level") / 3, F.col("edge") - 50, F.col("ear"),
        F.when(F.col("spoofed"), 93).otherwise(0), F.col("boom").cast("int"), F.col("took"),
    ]
    pixels = F.concat(*[F.chr((f + 33).cast("int")) for f in facts], F.repeat(F.lit("d"), HEIGHT * WIDTH - len(facts)))
    photo = F.when(F.col("undecodable"), F.lit("no photo")).otherwise(F.concat(F.lit(f"P5 {WIDTH} {HEIGHT} 255\n"), pixels))
    body = F.when(F.col("bad_text"), F.lit("a")).otherwise(F.base64(F.encode(photo, "utf-8")))
    frame = F.struct(F.when((F.col("n") % 47 == 12) & (F.col("seq") == 4), 0).otherwise(F.col("seq")).alias("seq"), body.alias("base64"))
    frames = view(spark, sf_dir, "v_photo_frames").select("session_id", frame.alias("frame")).groupBy("session_id").agg(F.collect_list("frame").alias("frames"))
    attempts = view(spark, sf_dir, "v_capture_sessions").join(frames, "session_id")
    turn = F.explode(F.when(F.col("repeated"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    lines = attempts.withColumn("turn", turn).select(
        F.concat(F.when(F.col("foreign_id"), F.lit("x")).otherwise(F.lit("c")), "session_id").alias("correlation_id"),
        F.col("session_id").cast("string").alias("session_id"),
        F.lit("sale").alias("transaction_type"),
        F.concat_ws(":", "session_id", "turn", "after_s").alias("transaction_ref"),
        "frames",
    )
    lines.select(F.to_json(F.struct(*lines.columns)).alias("value")).write.text(folder)
    return folder


def stated_analyser():
    def analyse(image: np.ndarray) -> dict | None:
        faces, yaw, amp, level, edge, ear, _, boom, took = (int(v) - 33 for v in image[0, :9, 0])
        if boom:
            raise RuntimeError("analyser failed")
        if not faces:
            return None
        gap = ear / 10.0  # lids of eyes 10 wide
        eye = [(0, 0), (3, gap / 2), (7, gap / 2), (10, 0), (7, -gap / 2), (3, -gap / 2)]
        stripes = np.where(np.arange(112) % 2, 3 * level - amp, 3 * level + amp)
        return {
            "faces": faces, "det_score": 0.9, "box": (10, 10, 60 + edge, 60 + edge), "yaw": float(yaw - 40), "pitch": 0.0,
            "landmarks": [(0, 0)] * 36 + eye + eye, "aligned": np.broadcast_to(stripes[None, :, None], (112, 112, 3)), "took_ms": took * 100.0,
        }

    return analyse


def tone_embedder():
    """A direction that turns with the crop's brightness."""

    def predict(x: np.ndarray) -> np.ndarray:
        mean = (x.reshape(len(x), -1).mean(axis=1) * 0.5 + 0.5) * 255.0
        return np.stack([np.cos(mean / 81.0), np.sin(mean / 81.0)], axis=1)

    return predict


def marked_detector():
    def run(image: np.ndarray) -> np.ndarray:
        return np.array([((int(image[0, 6, 0]) - 33) / 94, 0.3, 0.3, 0.6, 0.7)])

    return run


MODELS = SessionModels(
    codecs.netpbm, stated_analyser, tone_embedder, pad.Models(marked_detector, {2.7: tone_scorer(0.0), 4.0: tone_scorer(0.5)})
)
SETTINGS = replace(DEFAULTS, session_budget_ms=8000.0)

_VERDICTS = oracle(
    f"""select attempt_ref, case when shape is not null then null when reason is null then 'live'
   when reason in ('DOCUMENT_PHOTO', 'CHALLENGE_FAILED', 'IDENTITY_SWAP_MID_SESSION', 'PASSIVE_PAD_SPOOF') then 'spoof' else 'incomplete' end as verdict,
  shape as shape_reject, reason, case when shape is null and (reason is null or reason in ('IDENTITY_SWAP_MID_SESSION', 'PASSIVE_PAD_SPOOF'))
   then {rnd('low', 4)} else -1e0 end as frame_consistency_score, case when shape is null and reason is null then best end as best_frame_seq,
  case when shape is null and reason in ('SESSION_NOT_FOUND', 'SESSION_EXPIRED', 'SESSION_ALREADY_USED', 'SESSION_CORRELATION_MISMATCH', 'TIMEOUT', 'INTERNAL_ERROR')
   then 0 when shape is not null then 0 else valid end as n_frames_valid from (
  select *, case when shape is not null then null when not known then 'SESSION_NOT_FOUND' when turn = 1 then 'SESSION_ALREADY_USED'
   when after_s > 90 then 'SESSION_EXPIRED' when foreign_id then 'SESSION_CORRELATION_MISMATCH' when took > 8000 then 'TIMEOUT'
   when fault then 'INTERNAL_ERROR' when document then 'DOCUMENT_PHOTO' when valid < 4 then 'LOW_QUALITY_FRAMES'
   when kind = 3 then 'ACTIVE_CHALLENGE_NOT_IMPLEMENTED' when not frontal then 'NO_FRONTAL_REFERENCE'
   when (kind = 0 and not (left_ and right_)) or (kind = 1 and not (left_ and blink)) or (kind = 2 and not right_) then 'CHALLENGE_FAILED'
   when low < 0.4e0 then 'IDENTITY_SWAP_MID_SESSION' when spoof then 'PASSIVE_PAD_SPOOF' end as reason from judged_frames)""",
    "v_photo_frames",
    "v_capture_sessions",
    extra="""quality as (select *, case when undecodable then 'DECODE_ERROR' when faces = 0 then 'NO_FACE' when faces > 1 then 'MULTIPLE_FACES'
   when edge < 60 then 'TOO_SMALL' when 16 * amp * amp < 40 then 'BLURRY' when level < 40 then 'TOO_DARK' when level > 235 then 'TOO_BRIGHT' end as q,
   case when boom or undecodable or bad_text then 0 when faces = 0 then 0 else took * 100 end as ms,
   not undecodable and (boom or bad_text) or bad_text as broken,
   not undecodable and not bad_text and not boom and faces > 0 and edge * edge / 19200e0 >= 0.27e0 as document_frame from v_photo_frames),
  good as (select *, row_number() over (partition by session_id order by seq) as pos from quality where q is null and not broken),
  sims as (select g.session_id, min(cos((g.level - r.level) / 81e0)) as low from good g join good r on r.session_id = g.session_id and r.pos = 1
   where g.pos > 1 group by g.session_id),
  best_of as (select session_id, arg_max(seq, (case when abs(yaw) <= 10 then 1 else 0 end) * 1000000 + amp * 1000 - seq) as best from good group by session_id),
  facts as (select session_id, count(*) filter (where q is null and not broken) as valid, bool_or(broken) as fault, sum(ms) as took, bool_or(document_frame) as document,
   coalesce(bool_or(abs(yaw) <= 10) filter (where q is null and not broken), false) as frontal,
   coalesce(bool_or(yaw >= 20) filter (where q is null and not broken), false) as left_, coalesce(bool_or(yaw <= -20) filter (where q is null and not broken), false) as right_,
   coalesce(bool_or(ear <= 20) filter (where q is null and not broken), false) as blink, coalesce(bool_or(spoofed) filter (where q is null and not broken), false) as spoof,
   count(*) as frames from quality group by session_id),
  judged_frames as (select s.*, f.* exclude (session_id), coalesce(low, case when valid = 1 then 1e0 else -1e0 end) as low, best,
   case when s.n % 47 = 12 and frames = 5 then 'DUPLICATE_SEQ' end as shape, turn, concat_ws(':', s.session_id, turn, after_s) as attempt_ref
   from v_capture_sessions s join facts f on f.session_id = s.session_id left join sims on sims.session_id = s.session_id
   left join best_of b on b.session_id = s.session_id, (values (0), (1)) t(turn) where turn = 0 or repeated)""",
)


def judged(spark, sf_dir) -> DataFrame:
    scanned = scan.scan_attempts(spark, capture_folder(spark, sf_dir))
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    part = F.split("transaction_ref", ":")
    attempts = scanned.withColumns(
        {
            "attempt_id": F.col("transaction_ref"),
            "attempted_at": F.timestamp_seconds(F.lit(1_700_000_000) + part[2].cast("int") + part[1].cast("int")),
        }
    )
    sessions = view(spark, sf_dir, "v_capture_sessions").where("known").select(
        F.col("session_id").cast("string").alias("session_id"), start.alias("created_at"),
        F.concat(F.lit("c"), "session_id").alias("correlation_id"), _steps(F.col("kind")).alias("steps"),
    )
    return judge_attempts(attempts, sessions, MODELS, SETTINGS)


@query("judge_attempts", _VERDICTS)
def _(spark, sf_dir):
    return judged(spark, sf_dir).select(
        F.col("attempt_id").alias("attempt_ref"), "verdict", "shape_reject", "reason", "frame_consistency_score", "best_frame_seq",
        F.coalesce("n_frames_valid", F.lit(0)).alias("n_frames_valid"),
    )
