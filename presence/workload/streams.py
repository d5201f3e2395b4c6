"""Streams over the event table, drained and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.operators import gates, scores
from presence.session import shared_folder
from presence.sources import scan
from presence.streaming import run, stateful, stateless
from presence.workload.attempts import _LOOKED, KEPT_US, LONG_TTL, SLOW, TTL_US, limit_sql
from presence.workload.base import query
from presence.workload.decisions import FUSED
from presence.workload.views import SPARK_TEXT, VIEWS, oracle, rnd, table

MONTH = "30 days"


def stream(spark, sf_dir, name: str | None = None) -> DataFrame:
    """The event table as a file stream, or a view over it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    if name is None:
        return events
    text = SPARK_TEXT.get(name, VIEWS[name]).replace("from events", "from {events}")
    return spark.sql(text, events=events)


@query("rate_limit_stream", limit_sql("client_key", 3, 3600 * 10**6, 20, 86400 * 10**6))
def _(spark, sf_dir):
    requests = stream(spark, sf_dir, "v_access").select("request_id", "client_key", "ts")
    out = stateful.rate_limit_stream(requests, "client_key", "ts", "request_id", MONTH, SLOW)
    return run.drain(out, shared_folder(spark, "limiter"))


def session_events(events: DataFrame) -> DataFrame:
    """Creations (a user's sign-ups) and uses (purchases) as one event stream;
    ids deviate as in the batch views."""
    key, user = F.col("event_id"), F.col("user_id")
    use = F.col("event_type") == "purchase"
    session = user + F.when(use & (key % 19 == 0), 100000).otherwise(0)
    caller = user + F.when(use & (key % 13 == 0), 1).otherwise(0)
    return events.where(F.col("event_type").isin("signup", "purchase")).select(
        session.alias("session_id"),
        "ts",
        use.alias("is_use"),
        F.when(use, key).alias("attempt_id"),
        F.concat(F.lit("c"), caller).alias("correlation_id"),
    )


@query(
    "session_state",
    oracle(
        """select attempt_id, session_id, case when session_error is not null then session_error
        when session_correlation_id <> correlation_id then 'SESSION_CORRELATION_MISMATCH' end as session_error from consumed""",
        "v_sessions",
        "v_attempts",
        extra=_LOOKED,
    ),
)
def _(spark, sf_dir):
    out = stateful.session_state(session_events(stream(spark, sf_dir)), MONTH, LONG_TTL)
    return run.drain(out, shared_folder(spark, "sessions"))


FILES = 4  # per arrival


def arriving(spark, sf_dir) -> DataFrame:
    """Session events as a file stream in four arrivals: the month by thirds,
    then uses (one in nine) and creations (one in seventeen) that were held up
    until everything else had come."""
    folder = shared_folder(spark, "arrivals")
    key = F.col("event_id")
    late = (key % 9 == 0) & (F.col("event_type") == "purchase") | (key % 17 == 3) & (F.col("event_type") == "signup")
    events = table(spark, sf_dir, "events")
    arrival = F.when(late, 3).otherwise(F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10)))
    for k in range(4):
        events.where(arrival == k).repartition(FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


_ARRIVED = f"""seen as (select *, case when (event_id % 9 = 0 and event_type = 'purchase') or (event_id % 17 = 3 and event_type = 'signup') then 3
   else least(2, (day(ts) - 1) // 10) end as arrival from events),
 made as (select user_id as session_id, arg_min(ts, (arrival, ts)) as created_at, min(arrival) as known_from from seen where event_type = 'signup' group by user_id),
 used as (select event_id as attempt_id, user_id + case when event_id % 19 = 0 then 100000 else 0 end as session_id, ts, arrival,
   concat('c', cast(user_id + case when event_id % 13 = 0 then 1 else 0 end as string)) as caller from seen where event_type = 'purchase'),
 aged as (select u.*, epoch_us(u.ts) - epoch_us(m.created_at) as age, coalesce(u.arrival >= m.known_from and epoch_us(u.ts) - epoch_us(m.created_at) between 0 and {KEPT_US}, false) as found
   from used u left join made m on m.session_id = u.session_id),
 turns as (select *, row_number() over (partition by session_id order by arrival, ts, attempt_id) as turn from aged),
 won as (select session_id, min(turn) as won from turns where found and age <= {TTL_US} group by session_id)"""


@query(
    "late_data",
    f"""with {_ARRIVED} select attempt_id, t.session_id, case when not found then 'SESSION_NOT_FOUND' when turn > won then 'SESSION_ALREADY_USED'
     when age > {TTL_US} then 'SESSION_EXPIRED' when caller <> concat('c', cast(t.session_id as string)) then 'SESSION_CORRELATION_MISMATCH' end as session_error
     from turns t left join won w on w.session_id = t.session_id""",
)
def _(spark, sf_dir):
    out = stateful.session_answers(session_events(arriving(spark, sf_dir)), LONG_TTL)
    return run.drain(out, shared_folder(spark, "late"), idle_batches=False)


@query(
    "replay_guard_stream",
    oracle(
        """select request_id, case when kind in (3, 4) then 'MISSING' when kind < 7 then 'INVALID'
        when abs(skew_s) > 120 then 'OUTSIDE_WINDOW' end as replay_reject from v_headers""",
        "v_headers",
    ),
)
def _(spark, sf_dir):
    folder = shared_folder(spark, "replay")
    flagged = stateless.replay_guard_stream(
        stream(spark, sf_dir, "v_headers"), "header", F.col("received_s")
    ).select("request_id", "replay_reject")
    split = stateless.split_batches("replay_reject", f"{folder}/accepted", f"{folder}/rejected")
    run.start(flagged, folder, each_batch=split).awaitTermination()
    read = spark.read.schema("request_id long, replay_reject string")
    both = read.parquet(f"{folder}/accepted").unionByName(read.parquet(f"{folder}/rejected"))
    return both.select("request_id", "replay_reject")


@query("drop_repeats", "select event_id, event_type from events")
def _(spark, sf_dir):
    # every fifth event is delivered twice
    copies = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    doubled = stream(spark, sf_dir).select("event_id", "event_type", "ts", F.explode(copies).alias("copy"))
    out = stateless.drop_repeats(doubled, "ts", MONTH, "event_id").select("event_id", "event_type")
    return run.drain(out, shared_folder(spark, "repeats"))


def _decisions(spark, sf_dir) -> DataFrame:
    fused = gates.fuse_verdict(scores.weighted_signal_sum(stream(spark, sf_dir, "v_scored")))
    return gates.route_save_frame(gates.pad_verdict(fused))


_VERDICT = """case when label = 'spoof' then 'spoof' when score < 0.5e0 then 'low_quality' else 'live' end"""
_REASON = """case when label = 'spoof' then 'PASSIVE_PAD_SPOOF' when score < 0.5e0 then 'LOW_QUALITY' end"""


@query(
    "score_stream",
    oracle(
        f"""select concat('c', cast(frame_id as string)) as correlation_id, {_VERDICT} as verdict, {_REASON} as reason,
        {rnd('score', 4)} as score from fused""",
        "v_scored",
        extra=FUSED,
    ),
)
def _(spark, sf_dir):
    folder = shared_folder(spark, "scoring")
    rows = _decisions(spark, sf_dir).withColumns(
        {
            "correlation_id": F.concat(F.lit("c"), "frame_id"),
            "transaction_type": F.lit("sale"),
            "transaction_ref": F.col("frame_id").cast("string"),
            "processing_ms": F.lit(1.0),
        }
    )
    run.start(
        rows, folder, each_batch=stateless.record_batches(folder, "frame_id")
    ).awaitTermination()
    return scan.read_audit_log(spark, f"{folder}/audit").select(
        "correlation_id", "verdict", "reason", "score"
    )


@query(
    "monitor_stream",
    oracle(
        f"""select epoch_us(ts) // 300000000 * 300 as window_s, {_VERDICT} as verdict, {_REASON} as reason, count(*) as n from fused
        where (epoch_us(ts) // 300000000 + 1) * 300000000 <= (select max(epoch_us(ts)) // 1000 * 1000 from events) group by 1, 2, 3""",
        "v_scored",
        extra=FUSED,
    ),
)
def _(spark, sf_dir):
    rows = _decisions(spark, sf_dir).withColumn("endpoint", F.lit("pad"))
    out = stateless.monitor_stream(rows, "0 seconds")
    return run.drain(out, shared_folder(spark, "monitor")).select(
        F.unix_seconds("window_start").alias("window_s"), "verdict", "reason", "n"
    )
