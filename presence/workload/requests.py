"""Request files to decisions: base64 text, pixels, verdict, audit line.

Every document is a request. Its photo is a flat frame whose level, size and
format follow the document, or (one in forty) a sharp two-tone one: photos of
which SQL can say every measure. Some requests are broken on the way.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.config import DEFAULTS
from presence.functions.numeric import round_dp
from presence.plans import pad
from presence.session import shared_folder
from presence.sources import codecs, scan
from presence.workload.base import query
from presence.workload.views import dealt, rnd, table

SETTINGS = replace(DEFAULTS, max_payload_bytes=400_000, max_dimension=600)
SHARP = 480
PER_FILE = 4096  # requests; a compressed file is read by one task


def photo(doc, n_chars):
    """Bytes of the photo as text: a header, and pixel characters."""
    level, w, h = F.lit(33) + n_chars % 94, F.lit(40) + doc % 25, F.lit(48) + doc % 17
    colour = doc % 2 == 0
    flat = F.concat(
        F.when(colour, F.lit("P6 ")).otherwise(F.lit("P5 ")), w, F.lit(" "), h, F.lit(" 255\n"),
        F.repeat(F.chr(level), (w * h * F.when(colour, F.lit(3)).otherwise(F.lit(1))).cast("int")),
    )
    noise = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(SHARP * SHARP // 64)), lambda i: F.sha2(F.concat_ws("-", doc, i).cast("binary"), 256)), ""
    )
    sharp = F.concat(F.lit(f"P5 {SHARP} {SHARP} 255\n~"), F.translate(F.substring(noise, 2, SHARP * SHARP), "0123456789abcdef", "!" * 8 + "~" * 8))
    wide = F.concat(F.lit("P5 601 1 255\n"), F.repeat(F.lit("z"), 601))
    return (
        F.when(doc % 23 == 7, wide)
        .when(doc % 19 == 6, F.lit("no image at all"))
        .when(doc % 29 == 8, F.repeat(F.lit("x"), SETTINGS.max_payload_bytes + 1))
        .when(doc % 40 == 9, sharp)
        .otherwise(flat)
    )


def request_folder(spark, sf_dir) -> str:
    """Request files, compressed: their photos are base64 of flat planes
    mostly, many times the documents' size as plain text."""
    folder = shared_folder(spark, "photos")
    doc = F.col("doc_id")
    encoded = F.base64(F.encode(photo(doc, F.col("n_chars")), "utf-8"))
    fields = F.struct(
        F.concat(F.lit("c"), doc).alias("correlation_id"),
        F.when(doc % 7 == 0, F.lit("refund")).when(doc % 7 != 1, F.lit("sale")).alias("transaction_type"),
        F.concat(F.lit("t:"), doc).alias("transaction_ref"),
        F.when(doc % 11 == 0, F.lit(None)).when(doc % 17 == 5, F.lit("a")).otherwise(encoded).alias("face_photo"),
    )
    line = F.when(doc % 13 == 0, F.concat(F.lit('{"broken": '), doc)).otherwise(F.to_json(fields))
    docs = dealt(spark, table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    lines = docs.select(line.alias("value")).write.option("maxRecordsPerFile", PER_FILE)
    lines.text(folder, compression="lz4")
    return folder


def corner_detector():
    """One candidate, from the first pixel: how sure it is and how wide."""

    def run(image: np.ndarray) -> np.ndarray:
        level = int(image[0, 0, 0])
        return np.array([((level - 33) / 94, 0.2, 0.1, 0.2 + 0.05 * (level % 12), 0.9)])

    return run


def tone_scorer(shift: float):
    """Calls a spread of tones real; a flat view by its level."""

    def factory():
        def predict(x: np.ndarray) -> np.ndarray:
            flat = x.reshape(len(x), -1).astype(float)
            mean, spread = flat.mean(axis=1), flat.std(axis=1)
            logits = np.stack([mean / 40 - 1, np.full(len(x), shift), (mean % 50) / 25], axis=1)
            logits = np.where((spread > 5)[:, None], [0.0, 3.0 + shift, 0.0], logits)
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return factory


MODELS = pad.Models(corner_detector, {2.7: tone_scorer(0.0), 4.0: tone_scorer(0.5)}, decoder=codecs.netpbm)

# Flat views: no pattern, colour, step or detail at all, so the signals stand
# at their ends (0.8 is the window's own spectrum against its mean). Sharp
# views are grey noise: detail beyond every ramp, no colour, no peak.
_SQL = f"""
with r as (select doc_id, 33 + n_chars % 94 as level, 40 + doc_id % 25 as w0, 48 + doc_id % 17 as h0, doc_id % 40 = 9 as sharp,
  case when doc_id % 13 = 0 then 'MALFORMED' when doc_id % 11 = 0 then 'MISSING_FIELD' when doc_id % 7 = 0 then 'TRANSACTION_TYPE'
   when doc_id % 17 = 5 then 'INVALID_BASE64' when doc_id % 23 = 7 then 'DIMENSIONS_TOO_LARGE' when doc_id % 19 = 6 then 'DECODE_ERROR'
   when doc_id % 29 = 8 then 'PAYLOAD_TOO_LARGE' end as input_reject from documents),
f as (select *, case when sharp then 126 else level end as v, case when sharp then {SHARP} else w0 end as fw, case when sharp then {SHARP} else h0 end as fh from r),
b as (select *, (v - 33) / 94e0 as conf, cast(floor((0.2e0 + 0.05e0 * (v % 12)) * fw) as bigint) - cast(floor(0.2e0 * fw) as bigint) + 1 as w,
  cast(floor(0.9e0 * fh) as bigint) - cast(floor(0.1e0 * fh) as bigint) + 1 as h from f),
g as (select *, w * h * 1e0 / (fw * fh) as area, conf >= 0.4e0 as seen from b),
l as (select *, m / 40e0 - 1e0 as x0, (m % 50) / 25e0 as x2 from (select *, v * 1e0 as m from g)),
p as (select *, (exp(case when sharp then 0e0 else x0 end) + 0e0) as e0, exp(case when sharp then 3e0 else 0e0 end) as e1a,
  exp(case when sharp then 3.5e0 else 0.5e0 end) as e1b, exp(case when sharp then 0e0 else x2 end) as e2 from l),
n as (select *, e0 / (e0 + e1a + e2) + e0 / (e0 + e1b + e2) as s0, e1a / (e0 + e1a + e2) + e1b / (e0 + e1b + e2) as s1,
  e2 / (e0 + e1a + e2) + e2 / (e0 + e1b + e2) as s2 from p),
d as (select *, case when not seen then 'NO_FACE' when area >= 0.27e0 then 'DOCUMENT_PHOTO' when sharp then null else 'PASSIVE_PAD_SPOOF' end as why,
  case when not seen then 0e0 when area >= 0.27e0 then {rnd('area', 4)} when sharp then greatest(s0, s1, s2) / 2e0 else 1e0 end as sc from n)
"""

_DECISIONS = _SQL + f"""
select case when input_reject = 'MALFORMED' then null else concat('c', cast(doc_id as string)) end as correlation_id, input_reject,
 case when input_reject is null then case when why is null then 'live' when why = 'NO_FACE' then 'low_quality' else 'spoof' end end as verdict,
 case when input_reject is null then why end as reason, case when input_reject is null then {rnd('sc', 4)} end as score,
 case when input_reject is null and why = 'DOCUMENT_PHOTO' then 0.27e0 when input_reject is null then 0.5e0 end as threshold,
 input_reject is null and seen as face_detected,
 coalesce(input_reject is null and why in ('DOCUMENT_PHOTO', 'PASSIVE_PAD_SPOOF'), false) as save_frame from d
"""


def decisions(spark, sf_dir) -> DataFrame:
    requests = scan.scan_requests(spark, request_folder(spark, sf_dir))
    return pad.pad_requests(requests, MODELS, s=SETTINGS)


@query("pad_requests", _DECISIONS)
def _(spark, sf_dir):
    return decisions(spark, sf_dir).select(
        "correlation_id", "input_reject", "verdict", "reason", round_dp(F.col("score"), 4).alias("score"),
        F.when(F.col("input_reject").isNull(), F.col("threshold")).alias("threshold"), "face_detected", "save_frame",
    )


@query(
    "pad_request_records",
    f"""select 'audit' as record, correlation_id, verdict, reason from ({_DECISIONS}) where verdict is not null
     union all select 'evidence', correlation_id, verdict, reason from ({_DECISIONS}) where save_frame
     union all select 'decision', correlation_id, verdict, coalesce(input_reject, reason) from ({_DECISIONS})""",
)
def _(spark, sf_dir):
    folder = shared_folder(spark, "photo-records")
    timed = decisions(spark, sf_dir).withColumns({"ts": F.timestamp_seconds(F.lit(0)), "processing_ms": F.lit(1.0)})
    stored = pad.record(timed, folder, SETTINGS)
    of = lambda df, kind, reason="reason": df.select(F.lit(kind).alias("record"), "correlation_id", "verdict", F.expr(reason).alias("reason"))
    return (
        of(scan.read_audit_log(spark, f"{folder}/audit"), "audit")
        .unionByName(of(spark.read.parquet(f"{folder}/evidence"), "evidence"))
        .unionByName(of(stored, "decision", "coalesce(input_reject, reason)"))
    )
