"""Input views derived from the given tables, for Spark and as SQL text.

Each view is whole-table. The SQL text runs in both engines unless a separate
Spark text is given; ``oracle`` prefixes a statement with the views it names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


VIEWS: dict[str, str] = {}
SPARK_TEXT: dict[str, str] = {}

VIEWS["v_scored"] = """
select event_id as frame_id, user_id as client_id, event_type as species, ts,
 case when event_id % 7 < 5 then 1 else 2 * (event_id % 2) end as nn_label,
 0.5e0 + (event_id * 37 % 500) / 1000e0 as nn_score,
 case when event_id % 11 = 0 then null else (event_id * 7919 % 1000) / 1000e0 end as recapture,
 case event_id % 5 when 0 then 0.6e0 when 1 then 0.8e0 else 0.3e0 end as fft,
 case event_id % 6 when 0 then 0.6e0 when 1 then 0.3e0 when 2 then 0.15e0 else 0e0 end as lbp,
 case event_id % 9 when 0 then 0.6e0 when 1 then 0.35e0 when 2 then 0.15e0 else 0e0 end as color,
 0e0 as moire,
 case event_id % 4 when 0 then 0.4e0 when 1 then 0.2e0 else 0e0 end as sharpness,
 case event_id % 8 when 0 then 0.4e0 when 1 then 0.25e0 when 2 then 0.1e0 else 0e0 end as jpeg
from events
"""

VIEWS["v_faces"] = """
select event_id as frame_id,
 case event_id % 3 when 0 then 960 when 1 then 1080 else 993 end as frame_w,
 case event_id % 3 when 0 then 1280 when 1 then 1440 else 1275 end as frame_h,
 cast(event_id * 17 % 300 - 20 as int) as x, cast(event_id * 29 % 400 - 20 as int) as y,
 cast(case when event_id % 50 = 0 then 0 else 40 + event_id * 53 % 700 end as int) as w,
 cast(44 + event_id * 53 % 700 + event_id % 61 as int) as h,
 case when event_id % 23 = 0 then 2 else 1 end as n_faces,
 event_id % 31 <> 0 as face_detected,
 20 + (event_id * 91 % 4000) / 10e0 as sharpness,
 30 + (event_id * 67 % 2150) / 10e0 as brightness
from events
"""

VIEWS["v_sessions"] = """
select user_id as session_id, min(ts) as created_at,
 concat('c', cast(user_id as string)) as correlation_id, user_id % 3 as steps_kind
from events where event_type = 'signup' group by user_id
"""

VIEWS["v_attempts"] = """
select event_id as attempt_id,
 user_id + case when event_id % 19 = 0 then 100000 else 0 end as session_id, ts as attempted_at,
 concat('c', cast(user_id + case when event_id % 13 = 0 then 1 else 0 end as string)) as correlation_id
from events where event_type = 'purchase'
"""

VIEWS["v_session_frames"] = """
select vec_id - vec_id % 5 as session_id, vec_id % 5 as seq, embedding,
 (vec_id * 37 % 81 - 40) / 1e0 as yaw, (20 + vec_id * 91 % 400) / 1e0 as sharpness,
 (30 + vec_id * 67 % 215) / 1e0 as brightness, (55 + vec_id * 13 % 200) / 1e0 as face_edge,
 true as face_detected, case when vec_id % 41 = 0 then 2 else 1 end as n_faces,
 case when (vec_id - vec_id % 5) % 30 = 0 and vec_id % 5 = 2 then 0.3e0
  else (vec_id * 11 % 20) / 100e0 end as area_ratio,
 case when vec_id % 53 = 0 then 'spoof' when vec_id % 47 = 0 then 'no_face' else 'real' end as pad_label,
 (vec_id - vec_id % 5) / 5 % 3 as steps_kind
from embeddings
"""

# Challenge sessions and attempts for the frame sets above: most are sound, some
# repeat, come late, carry a foreign correlation id or name no session. Some
# sessions are first tried with a malformed frame list: shape 1 sends nothing,
# 2 sends every frame under two numbers, 3 repeats a number, 4 starts below 0.
VIEWS["v_frame_sessions"] = """
select vec_id as session_id, vec_id * 1000 as created_s, concat('c', cast(vec_id as string)) as correlation_id,
 vec_id / 5 % 3 as steps_kind from embeddings where vec_id % 5 = 0 and vec_id % 95 <> 0
"""

VIEWS["v_frame_attempts"] = """
select vec_id * 10 + vec_id % 5 as attempt_id, vec_id - vec_id % 5 as session_id,
 (vec_id - vec_id % 5) * 1000 + case when vec_id % 5 = 0 and vec_id % 55 = 0 then 100 else 30 + vec_id % 5 end as attempted_s,
 concat('c', cast(vec_id - vec_id % 5 + case when vec_id % 85 = 0 then 1 else 0 end as string)) as correlation_id,
 0 as shape
from embeddings where vec_id % 5 = 0 or vec_id % 35 = 1
union all
select vec_id * 10 + 9, vec_id, vec_id * 1000 + 20, concat('c', cast(vec_id as string)), cast(1 + vec_id / 15 % 4 as int)
from embeddings where vec_id % 15 = 0
"""

VIEWS["v_detections"] = """
select l_orderkey as frame_id, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey as cand, l_discount * 10 as conf,
 l_tax as l, l_tax / 2 as t, l_tax + l_quantity / 80 as r, l_tax / 2 + l_quantity / 70 as b
from lineitem
"""

VIEWS["v_headers"] = """
select event_id as request_id, epoch_us(ts) // 1000000 as received_s,
 case event_id % 10 when 0 then 'nan' when 1 then '+nan' when 2 then '-inf' when 3 then ''
  when 4 then null when 5 then 'abc' when 6 then '12d'
  else cast(epoch_us(ts) // 1000000 + event_id * 7 % 300 - 150 as string) end as header,
 event_id % 10 as kind, event_id * 7 % 300 - 150 as skew_s
from events
"""
SPARK_TEXT["v_headers"] = VIEWS["v_headers"].replace("epoch_us(ts) // 1000000", "unix_seconds(ts)")

VIEWS["v_access"] = """
select event_id as request_id, user_id % 8 as client_key, ts,
 concat(case event_id % 6 when 0 then '10.' when 1 then '192.168.' when 2 then '172.16.' when 3 then '8.8.'
   when 4 then '127.0.' else '172.40.' end,
  cast(event_id % 2 as string), '.', cast(user_id % 250 as string),
  case when event_id % 6 = 0 then '.9' else '' end) as peer_ip,
 case when event_id % 4 = 0 then concat('203.0.113.', cast(user_id % 250 as string), ', 10.0.0.',
   cast(event_id % 300 as string)) else null end as xff
from events
"""

# zoned, plain, mapped and malformed addresses of the longer family beside v_access
VIEWS["v_addresses"] = """
select event_id as request_id, case event_id % 9
 when 0 then concat('fe80::', cast(user_id % 10 as string), case user_id % 4 when 0 then '%ens3' when 1 then '%wlp2s0'
   when 2 then '%s' else '%eth0' end)
 when 1 then concat('2001:db8:0:', cast(user_id % 10 as string), '::', cast(event_id % 10 as string))
 when 2 then concat('1:2:3:4:5::1:2:', cast(user_id % 10 as string), ':10.0.0.1')
 when 3 then concat('::ffff:10.0.0.', cast(user_id % 250 as string))
 when 4 then concat('1:2:3:4:5:6:7::', cast(user_id % 10 as string), ':9')
 else concat(case event_id % 6 when 0 then '10.' when 1 then '192.168.' when 2 then '172.16.' when 3 then '8.8.'
   when 4 then '127.0.' else '172.40.' end, cast(event_id % 2 as string), '.', cast(user_id % 250 as string),
   case when event_id % 6 = 0 then '.9' else '' end) end as client_ip
from events
"""

VIEWS["v_vlm"] = """
select doc_id as frame_id, case doc_id % 8
 when 0 then concat('LABEL=STUDIO_BACKGROUND CONFIDENCE=90 ', text)
 when 1 then concat(text, ' LABEL=REAL_BACKGROUND CONFIDENCE=80')
 when 2 then concat('label: studio_backdrop confience: 85 ', text)
 when 3 then concat('LABEL=STUDIO_BACKGROUND ', text)
 when 4 then concat('it looks like a REAL_BACKGROUND to me ', text)
 when 5 then concat(text, ' LABEL=STUDIO_BACKDROP CONFIDENCE=250')
 when 6 then concat('cannot tell ', text) else text end as response
from documents
"""

VIEWS["v_truth"] = """
select doc_id as frame_id, quality = 1 as bona_fide, concat('s', cast(toxic as string)) as species
from labels
"""

VIEWS["v_latency"] = """
select event_id as request_id, event_type as endpoint_kind,
 case event_id % 3 when 0 then 'pad' when 1 then 'session' else 'legacy' end as endpoint,
 ts, value as processing_ms
from events
"""

# One image per document, 64 pixels wide, built from the whole text: pixel i is
# the code point of character i (the text repeats only to fill the last line
# and a minimum height of 16 lines).
IMAGE_WIDTH = 64
VIEWS["v_pixels"] = f"""
select image_id, i, i % {IMAGE_WIDTH} as x, i // {IMAGE_WIDTH} as y, h, {IMAGE_WIDTH} as w,
 unicode(chars[1 + i % n]) % 256 as v
from (select doc_id as image_id, n, h, string_split(text, '') as chars, unnest(range(h * {IMAGE_WIDTH})) as i
 from (select doc_id, text, length(text) as n,
  greatest(16, (length(text) + {IMAGE_WIDTH - 1}) // {IMAGE_WIDTH}) as h from documents where length(text) > 0))
"""

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "events":  # stored without zone, meant as UTC instants
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SPARK_TEXT.get(name, VIEWS[name])
    used = [t for t in _TABLES if re.search(rf"\bfrom {t}\b", text)]
    for t in used:
        text = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Compact rows dealt to the tasks that will make images of them: the
    given tables come as one row group, and images are cut from their rows.
    The plan is the same at every size."""
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def text_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_pixels`` as one row per image whose plane is still text, a character
    a pixel: ``image_id, h, w, gray STRING``."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    docs = dealt(spark, docs.select(F.col("doc_id").alias("image_id"), "text"), "image_id")
    n = F.length("text")
    sized = docs.select(
        "image_id", F.greatest(F.lit(16), F.ceil(n / IMAGE_WIDTH).cast("int")).alias("h"), F.lit(IMAGE_WIDTH).alias("w"), "text"
    )
    pixels = F.col("h") * F.col("w")
    filled = F.substring(F.repeat("text", F.ceil(pixels / n).cast("int")), F.lit(1), pixels)
    return sized.select("image_id", "h", "w", F.when(n == pixels, F.col("text")).otherwise(filled).alias("gray"))


def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_pixels`` as one row per image: ``image_id, h, w, gray ARRAY<INT>``."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    docs = dealt(spark, docs.select(F.col("doc_id").alias("image_id"), "text"), "image_id")
    n = F.length("text")
    return (
        docs.select(
            "image_id",
            F.greatest(F.lit(16), F.ceil(n / IMAGE_WIDTH).cast("int")).alias("h"),
            F.lit(IMAGE_WIDTH).alias("w"),
            F.transform(F.split("text", ""), lambda c: F.ascii(c) % 256).alias("codes"),
        )
        .withColumn("copies", F.ceil(F.col("h") * F.col("w") / F.size("codes")).cast("int"))
        .select(
            "image_id",
            "h",
            "w",
            F.when(F.col("copies") == 1, F.col("codes"))
            .otherwise(
                F.slice(F.flatten(F.array_repeat("codes", F.col("copies"))), F.lit(1), F.col("h") * F.col("w"))
            )
            .alias("gray"),
        )
    )


def oracle(body: str, *names: str, extra: str = "") -> str:
    ctes = [f"{n} as ({VIEWS[n].strip()})" for n in names]
    if extra:
        ctes.append(extra)
    return f"with {', '.join(ctes)} {body}" if ctes else body


def rnd(expr: str, digits: int) -> str:
    """SQL twin of ``round_dp``."""
    scale = f"{10**digits}e0"
    return f"(floor(({expr}) * {scale} + 0.5e0) / {scale})"
