"""Sources, sinks, injected models and the photo plan over derived inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.functions.numeric import round_dp
from presence.operators import gates, scores, scoring, spectral
from presence.plans import pad
from presence.session import shared_folder
from presence.sources import scan, sinks
from presence.workload.attempts import SESSION_VERDICT, judged_attempts
from presence.operators import sessions
from presence.workload.base import query
from presence.workload.decisions import LABELLED, judged
from presence.workload.views import dealt, oracle, rnd, table, text_planes, view

# -- request files ----------------------------------------------------------


def request_lines(spark, sf_dir) -> DataFrame:
    key = F.col("event_id")
    fields = F.struct(
        F.concat(F.lit("c"), key).alias("correlation_id"),
        F.when(key % 7 == 0, F.lit("refund")).when(key % 7 != 1, F.lit("sale")).alias("transaction_type"),
        F.concat("user_id", F.lit(":"), key).alias("transaction_ref"),
        F.when(key % 11 != 0, F.base64(F.encode("event_type", "utf-8"))).alias("face_photo"),
    )
    line = F.to_json(fields)
    return table(spark, sf_dir, "events").select(
        F.when(key % 13 == 0, F.expr("concat('{\"broken\": ', cast(event_id as string))"))
        .otherwise(line)
        .alias("value")
    )


@query(
    "scan_requests",
    """select case when event_id % 13 <> 0 then concat('c', cast(event_id as string)) end as correlation_id,
     case when event_id % 13 = 0 then 'MALFORMED' when event_id % 11 = 0 then 'MISSING_FIELD'
      when event_id % 7 = 0 then 'TRANSACTION_TYPE' end as request_reject from events""",
)
def _(spark, sf_dir):
    folder = shared_folder(spark, "requests")
    request_lines(spark, sf_dir).write.text(folder)
    return scan.scan_requests(spark, folder).select("correlation_id", "request_reject")



def attempt_files(spark, sf_dir) -> str:
    """Verdict requests as JSON files; some attempts hold broken base64, some
    no frames, some repeat a sequence number."""
    folder = shared_folder(spark, "attempts")
    frame = F.struct(
        F.when((F.col("session_id") % 20 == 5) & (F.col("seq") == 4), F.lit(0)).otherwise(F.col("seq")).alias("seq"),
        F.when((F.col("session_id") % 30 == 10) & (F.col("seq") == 1), F.lit("a"))
        .otherwise(F.base64(F.encode(F.concat_ws("-", "session_id", "seq"), "utf-8")))
        .alias("base64"),
    )
    rows = (
        view(spark, sf_dir, "v_session_frames")
        .groupBy("session_id")
        .agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    )
    body = F.struct(
        F.concat(F.lit("c"), "session_id").alias("correlation_id"),
        F.col("session_id").cast("string").alias("session_id"),
        F.lit("sale").alias("transaction_type"),
        F.lit("r").alias("transaction_ref"),
        F.when(F.col("session_id") % 50 == 15, F.array().cast("array<struct<seq:bigint,base64:string>>"))
        .otherwise(F.col("frames"))
        .alias("frames"),
    )
    rows.select(F.to_json(body).alias("value")).write.text(folder)
    return folder


@query(
    "scan_attempts",
    oracle(
        """select session_id, seq, bad, case when n < 1 then 'FRAME_COUNT' when dup then 'DUPLICATE_SEQ' end as shape_reject from (
          select cast(session_id as string) as session_id, case when session_id % 20 = 5 and seq = 4 then 0 else seq end as seq,
           session_id % 30 = 10 and seq = 1 as bad, 5 as n, session_id % 20 = 5 as dup from v_session_frames where session_id % 50 <> 15
          union all select distinct cast(session_id as string), null, null, 0, false from v_session_frames where session_id % 50 = 15)""",
        "v_session_frames",
    ),
)
def _(spark, sf_dir):
    rows = scan.scan_attempts(spark, attempt_files(spark, sf_dir)).withColumn(
        "seqs", F.col("frames.seq")
    )
    flat = scan.flatten_frames(gates.guard_attempt_shape(rows, "seqs"), "session_id", "shape_reject")
    return scan.decode_frames(flat, "base64", session=True).select(
        "session_id",
        F.col("seq").cast("long").alias("seq"),
        F.when(F.col("base64").isNotNull(), F.col("decode_reject").isNotNull()).alias("bad"),
        "shape_reject",
    )


@query(
    "decode_payload",
    """select doc_id, case when doc_id % 9 = 0 then 'INVALID_BASE64' end as decode_reject,
     case when doc_id % 9 <> 0 then cast(strlen(text) as int) end as n_bytes from documents""",
)
def _(spark, sf_dir):
    # one sextet left over cannot be decoded
    encoded = F.when(F.col("doc_id") % 9 == 0, F.lit("abcde")).otherwise(
        F.base64(F.encode("text", "utf-8"))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", encoded.alias("photo"))
    return scan.decode_frames(rows, "photo").select(
        "doc_id", "decode_reject", F.octet_length("payload").alias("n_bytes")
    )


# -- audit ------------------------------------------------------------------


def audit_rows(spark, sf_dir) -> DataFrame:
    scored = (F.col("reason") != "NO_FACE") | F.col("reason").isNull()
    return gates.route_save_frame(judged(spark, sf_dir)).withColumns(
        {
            "correlation_id": F.concat(F.lit("c"), "frame_id"),
            "transaction_type": F.lit("sale"),
            "transaction_ref": F.concat("client_id", F.lit(":"), "frame_id"),
            "processing_ms": (F.col("frame_id") % 4000 + 0.26).cast("double"),
            "signal_scores": F.when(scored, F.col("signal_scores")),
        }
    )


_AUDIT_SQL = f"""select strftime(ts, '%Y-%m-%dT%H:%M:%S+0000') as timestamp, concat('c', cast(frame_id as string)) as correlation_id,
 verdict, reason, {rnd('score', 4)} as score, {rnd('cast(frame_id % 4000 as double) + 0.26e0', 1)} as processing_ms,
 case when reason <> 'NO_FACE' or reason is null then case when nn_label = 1 then 'real' else 'spoof' end end as nn_call,
 verdict = 'spoof' as save_frame from judged"""


@query("write_audit_log", oracle(_AUDIT_SQL, "v_scored", "v_faces", extra=LABELLED))
def _(spark, sf_dir):
    folder = shared_folder(spark, "audit")
    sinks.write_audit_log(audit_rows(spark, sf_dir), folder)
    return scan.read_audit_log(spark, folder).select(
        "timestamp", "correlation_id", "verdict", "reason", "score", "processing_ms",
        F.col("nn_label").alias("nn_call"), "save_frame",
    )


@query(
    "read_audit_log",
    oracle(
        """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, 'pad_check' as endpoint, verdict, reason,
        count(*) as n from judged group by 1, 3, 4""",
        "v_scored",
        "v_faces",
        extra=LABELLED,
    ),
)
def _(spark, sf_dir):
    folder = shared_folder(spark, "audit")
    sinks.write_audit_log(audit_rows(spark, sf_dir), folder)
    return (
        scan.read_audit_log(spark, folder)
        .groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), "endpoint", "verdict", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "write_session_audit",
    f"""select 'liveness_verdict' as endpoint, cast(attempt_id as string) as attempt_ref, verdict, reason, frame_consistency_score,
    n_frames_received, n_frames_valid from ({SESSION_VERDICT}) where shape_reject is null""",
)
def _(spark, sf_dir):
    folder = shared_folder(spark, "session-audit")
    bound, frames = judged_attempts(spark, sf_dir)
    # a refused request gets an error, not a verdict, and no audit line
    verdicts = sessions.session_verdict(bound, frames).where(F.col("shape_reject").isNull()).withColumns(
        {
            "ts": F.timestamp_seconds("attempt_id"),
            "transaction_type": F.lit("sale"),
            "transaction_ref": F.col("attempt_id").cast("string"),
            "processing_ms": F.lit(12.34),
        }
    )
    sinks.write_session_audit(verdicts, folder)
    return scan.read_audit_log(spark, folder).select(
        "endpoint", F.col("transaction_ref").alias("attempt_ref"), "verdict", "reason", "frame_consistency_score",
        "n_frames_received", "n_frames_valid",
    )


@query(
    "write_evidence",
    oracle(
        "select frame_id, verdict, reason from judged where verdict = 'spoof'",
        "v_scored",
        "v_faces",
        extra=LABELLED,
    ),
)
def _(spark, sf_dir):
    folder = shared_folder(spark, "evidence")
    sinks.write_evidence(gates.route_save_frame(judged(spark, sf_dir)), folder, "frame_id")
    return spark.read.parquet(folder)


@query(
    "security_events",
    oracle(
        """select request_id, case when processing_ms * 100 > case when endpoint = 'session' then 8000e0 else 2000e0 end
         then 'TIMEOUT' else 'INTERNAL_ERROR' end as reason from v_latency
        where processing_ms * 100 > case when endpoint = 'session' then 8000e0 else 2000e0 end or request_id % 7 = 0""",
        "v_latency",
    ),
)
def _(spark, sf_dir):
    folder = shared_folder(spark, "events")
    rows = view(spark, sf_dir, "v_latency").withColumns(
        {
            "processing_ms": F.col("processing_ms") * 100,
            "error": F.when(F.col("request_id") % 7 == 0, F.lit("boom")),
        }
    )
    faulty = gates.error_default(gates.timeout_default(rows)).withColumns(
        {
            "reason": F.coalesce("timeout_reason", "default_reason"),
            "verdict": F.coalesce("timeout_verdict", "default_verdict"),
        }
    )
    sinks.write_security_events(faulty, folder, "request_id")
    return spark.read.parquet(folder).select("request_id", "reason")


# -- image files ------------------------------------------------------------


PER_FOLDER = 1024  # documents whose files share a folder of either class


def bmp_folders(spark, sf_dir) -> tuple[str, list[str]]:
    """Every document as a bitmap file, written by the tasks; one file in
    seventeen is cut off. Gives the root and the folders that hold files: one
    per class below the root, and below as many numbered folders as keep all
    of them small."""
    root = shared_folder(spark, "bitmaps").removeprefix("file:")
    parts = max(1, -(-table(spark, sf_dir, "documents").count() // PER_FOLDER))

    def write(batches):
        import os

        import pyarrow as pa

        made = set()
        for batch in batches:
            new = []
            keys, heights, widths, texts, numbers = batch.columns
            for i in range(batch.num_rows):
                key, h, w, part = keys[i].as_py(), heights[i].as_py(), widths[i].as_py(), numbers[i].as_py()
                folder = "/".join([root, *([str(part)] if part else []), ("attack", "original")[key % 2]])
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                    new.append(folder)
                plane = np.frombuffer(texts[i].as_py().encode("utf-32-le"), np.uint32).astype(np.uint8).reshape(h, w)[::-1]
                body = np.repeat(plane[:, :, None], 3, axis=2).tobytes()  # w * 3 is a multiple of 4
                head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
                info = b"".join(n.to_bytes(4, "little") for n in (40, w, h))
                info += (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
                data = b"BM broken" if key % 17 == 0 else head + info + body
                with open(f"{folder}/{key}.BMP", "wb") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], names=["folder"])

    # the names of the folders come back; the files are what it is for
    images = text_planes(spark, sf_dir).select("image_id", "h", "w", "gray", F.expr(f"pmod(xxhash64(image_id), {parts})").alias("part"))
    return root, sorted(r["folder"] for r in images.mapInArrow(write, "folder string").distinct().collect())


def bmp_folder(spark, sf_dir) -> str:
    """The root alone, of bitmaps that are read at once."""
    return bmp_folders(spark, sf_dir)[0]


@query(
    "scan_images",
    oracle(
        """select concat(cast(image_id as string), '.BMP') as file, case when image_id % 17 = 0 then 'ERROR' else 'OK' end as status,
         case when image_id % 17 = 0 then -1 else h end as frame_h, case when image_id % 17 = 0 then -1 else w end as frame_w,
         case when image_id % 17 = 0 then 0 else n * 3 end as n_bytes, case when image_id % 17 = 0 then '' else first_hex end as first_pixel
        from (select image_id, max(h) as h, max(w) as w, count(*) as n, max(case when i = 0 then printf('%02X%02X%02X', v, v, v) end) as first_hex
         from v_pixels group by image_id)""",
        "v_pixels",
    ),
)
def _(spark, sf_dir):
    def scanned(paths):
        return scan.scan_images(spark, paths, recursive=True).select(
            "file",
            "status",
            "frame_h",
            "frame_w",
            F.octet_length("data").alias("n_bytes"),
            F.hex(F.substring("data", 1, 3)).alias("first_pixel"),
        )

    return scan.scan_by_folders(spark, bmp_folders(spark, sf_dir)[1], scanned, shared_folder(spark, "images"))


@query(
    "scan_labelled_sets",
    """select case when doc_id % 2 = 1 then 'REAL' else 'SPOOF' end as class, case when doc_id % 2 = 1 then 'real' else 'spoof' end as expected,
     count(*) filter (where doc_id % 17 <> 0) as ok, count(*) as n from documents where length(text) > 0 group by 1, 2""",
)
def _(spark, sf_dir):
    sets = {"original": ("REAL", "real"), "attack": ("SPOOF", "spoof")}

    def scanned(paths):
        return scan.scan_labelled_sets(spark, paths, sets).select("class", "expected", "status")

    images = scan.scan_by_folders(spark, bmp_folders(spark, sf_dir)[1], scanned, shared_folder(spark, "labelled"))
    return images.groupBy("class", "expected").agg(
        F.count_if(F.col("status") == "OK").alias("ok"), F.count(F.lit(1)).alias("n")
    )


# -- injected models --------------------------------------------------------


def linear_scorer(shift: int, scale: float = 1.0):
    """Class probabilities from three fixed linear forms of the input."""

    def factory():
        def predict(x: np.ndarray) -> np.ndarray:
            flat = x.reshape(len(x), -1).astype(np.float64)
            j = np.arange(flat.shape[1])
            forms = np.stack([((j * (k + 2 + shift)) % 7 - 3) / 4.0 for k in range(3)])
            logits = flat @ forms.T * scale
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return factory


def _linear_sql(shift: int, k: int) -> str:
    weights = ", ".join(f"{(j * (k + 2 + shift)) % 7 - 3}e0 / 4e0" for j in range(64))
    return f"list_dot_product(e, [{weights}])"


_SCORED = (
    "with e as (select vec_id, cast(embedding as double[]) as e from embeddings), "
    + "l as ("
    + " union all ".join(
        f"select vec_id, {_linear_sql(m, 0)} as a, {_linear_sql(m, 1)} as b, {_linear_sql(m, 2)} as c from e"
        for m in (0, 1)
    )
    + "), p as (select vec_id, exp(a) as ea, exp(b) as eb, exp(c) as ec from l), "
    "s as (select vec_id, sum(ea / (ea + eb + ec)) as s0, sum(eb / (ea + eb + ec)) as s1, sum(ec / (ea + eb + ec)) as s2 "
    "from p group by vec_id) "
)


@query(
    "score_model",
    _SCORED
    + f"""select vec_id, case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as nn_label,
     {rnd('greatest(s0, s1, s2) / 2e0', 6)} as nn_score from s""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("tensor"))
    inputs = [(rows, linear_scorer(0)), (rows, linear_scorer(1))]
    return scoring.score_model(inputs, "vec_id", "tensor", [64]).select(
        "vec_id", "nn_label", round_dp(F.col("nn_score"), 6).alias("nn_score")
    )


def projector():
    """Eight fixed projections of the input."""

    def predict(x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1).astype(np.float64)
        j = np.arange(flat.shape[1])
        return flat @ np.stack([((j * (k + 3)) % 5 - 2) / 2.0 for k in range(8)]).T

    return predict


_PROJ = ", ".join(
    "list_dot_product(z, [" + ", ".join(f"{(j * (k + 3)) % 5 - 2}e0 / 2e0" for j in range(64)) + "])"
    for k in range(8)
)


@query(
    "embed",
    f"""select vec_id, {rnd('u[1] / norm', 4)} as first, {rnd('u[8] / norm', 4)} as last from (select vec_id, u, sqrt(list_dot_product(u, u)) as norm
     from (select vec_id, [{_PROJ}] as u from (select vec_id, list_transform(cast(embedding as double[]),
      lambda v: (floor(v * 100) + 128) / 255e0 * 2e0 - 1e0) as z from embeddings)))""",
)
def _(spark, sf_dir):
    px = F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("float") + F.lit(128.0).cast("float"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", px.alias("px"))
    out = scoring.embed(rows, projector, "px", [64])
    return out.select(
        "vec_id",
        round_dp(F.col("embedding")[0], 4).alias("first"),
        round_dp(F.col("embedding")[7], 4).alias("last"),
    )


def packed_images(spark, sf_dir) -> DataFrame:
    """Documents as packed three-channel images: the text's bytes, repeated
    only to fill 192-byte lines and at least 48 of them."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    docs = dealt(spark, docs.select(F.col("doc_id").alias("image_id"), "text"), "image_id")
    n = F.octet_length("text")
    h = F.greatest(F.lit(48), F.ceil(n / 192)).cast("int")
    times = F.ceil(h * 192 / n).cast("int")
    return docs.select(
        "image_id",
        h.alias("frame_h"),
        F.lit(64).alias("frame_w"),
        F.substring(F.encode(F.repeat("text", times), "utf-8"), F.lit(1), h * 192).alias("data"),
    )


def band_detector():
    """Three candidates by mean brightness: top and bottom third, and a tall
    middle box whose width follows the brightness too."""

    def run(image: np.ndarray) -> np.ndarray:
        h, out = image.shape[0], []
        for k, (top, bottom) in enumerate(((0.02, 0.3), (0.05, 0.95), (0.7, 0.98))):
            mean = float(image[h * k // 3 : h * (k + 1) // 3].mean())
            width = 0.1 + 0.8 * (mean * 10 % 1)
            out.append((mean / 200.0, 0.05, top, 0.05 + width, bottom))
        return np.array(out)

    return run


@query("detect")
def _(spark, sf_dir):
    found = scoring.detect(packed_images(spark, sf_dir), band_detector, "image_id")
    return found.select("image_id", "cand", *[round_dp(F.col(c), 6).alias(c) for c in ("conf", "l", "t", "r", "b")])


@query("crop_and_resample")
def _(spark, sf_dir):
    boxed = packed_images(spark, sf_dir).withColumns(
        {"x": F.lit(16), "y": F.col("frame_h") / 4, "w": F.lit(20), "h": F.lit(24)}
    )
    cut = gates.crop_window(boxed.withColumn("y", F.col("y").cast("int")), 2.7)
    return spectral.plane_sums(spectral.crop_and_resample(cut, 80), "b", "g", "r", "gray")


MODELS = pad.Models(band_detector, {2.7: linear_scorer(0, 0.05), 4.0: linear_scorer(1, 0.05)})


@query("pad_check")
def pad_check(spark, sf_dir):
    out = pad.pad_decisions(packed_images(spark, sf_dir), MODELS)
    return out.select(
        "image_id", "verdict", "reason", round_dp(F.col("score"), 4).alias("score"), "threshold",
        "face_detected", "save_frame", "spoof_probability",
    )


@query("verify_batch")
def _(spark, sf_dir):
    uploads = packed_images(spark, sf_dir).withColumns(
        {
            "content_type": F.when(F.col("image_id") % 10 == 0, F.lit("text/plain")).otherwise(F.lit("image/png")),
            "data": F.when(F.col("image_id") % 7 == 0, F.encode(F.lit(""), "utf-8")).otherwise(F.col("data")),
        }
    )
    return pad.verify_batch(uploads, MODELS)


@query(
    "assemble_results",
    oracle(
        """select frame_id, label from labelled""", "v_scored", "v_faces", extra=LABELLED
    ),
)
def _(spark, sf_dir):
    return judged(spark, sf_dir).select("frame_id", "label")
