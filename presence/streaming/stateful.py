"""Keyed streaming state: the live rate limiter and one-shot sessions.

State is keyed by client or session, so one task owns a key and decisions on
it are atomic. Rows of a micro-batch are put in event-time order first; a
micro-batch is bounded by the source's trigger options. Event-time timers
drop the state of idle keys once the watermark has passed their window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from presence.config import DEFAULTS, Settings
from presence.operators.limits import MICROS, Stamps


def _gather(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _rearm(handle: StatefulProcessorHandle, at_ms: int) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at_ms)


class LimiterProcessor(StatefulProcessor):
    """Accepted arrival times of one key; refused arrivals leave no trace."""

    def __init__(self, s: Settings) -> None:
        self.s = s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stamps = handle.getListState("stamps", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _gather(rows, ["us", "ord"])
        state = Stamps(self.s, [int(r[0]) for r in self.stamps.get()] if self.stamps.exists() else [])
        times = batch["us"].to_numpy(dtype=np.int64)
        allowed = state.run(times)
        oldest = int(times[-1]) - state.long
        self.stamps.put([(t,) for t in state.stamps if t >= oldest] or [(int(times[-1]),)])
        idle_ms = int(times[-1] + state.long) // 1000 + 1
        if idle_ms > timerValues.getCurrentWatermarkInMs():
            _rearm(self.handle, idle_ms)
        keys = pd.Series([key[0]] * len(batch), dtype="object")
        yield pd.DataFrame({"key": keys, "ord": batch["ord"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stamps.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(
    requests: DataFrame, key: str, ts: str, order: str, delay: str, s: Settings = DEFAULTS
) -> DataFrame:
    """Live form of ``rate_limit``: ``key, order, allowed`` per request."""
    fields = requests.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(ts).alias("ts"))
    schema = T.StructType([fields.schema["key"], fields.schema["ord"], T.StructField("allowed", T.BooleanType())])
    keyed = fields.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay).groupBy("key")
    out = keyed.transformWithStateInPandas(LimiterProcessor(s), schema, "append", "eventTime")
    return out.withColumnsRenamed({"key": key, "ord": order})


class SessionProcessor(StatefulProcessor):
    """One challenge session: created, used at most once, forgotten after its
    retention. Creation sorts before use at the same instant. With ``timed``
    false the state expires by the clock, and no input counts as late."""

    def __init__(self, s: Settings, timed: bool = True) -> None:
        self.ttl = int(s.session_ttl_s * MICROS)
        self.retention = int(s.session_retention_s * MICROS)
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept_ms = None if self.timed else self.retention // 1000 + 1
        self.session = handle.getValueState("session", "created long, owner string, used boolean", kept_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _gather(rows, ["us", "is_use", "attempt_id"])
        held = self.session.get()  # every call to the state is a message to the executor
        created, owner, used = held if held is not None else (None, None, False)
        ids, errors = [], []
        for us, is_use, attempt, caller in zip(
            batch["us"], batch["is_use"], batch["attempt_id"], batch["correlation_id"]
        ):
            if not is_use:
                if created is None:
                    created, owner, used = int(us), caller, False
                continue
            age = None if created is None else int(us) - created
            if age is None or age < 0 or age > self.retention:
                error = "SESSION_NOT_FOUND"
            elif used:
                error = "SESSION_ALREADY_USED"
            elif age > self.ttl:
                error = "SESSION_EXPIRED"
            else:
                used = True
                error = None if owner == caller else "SESSION_CORRELATION_MISMATCH"
            ids.append(int(attempt))
            errors.append(error)
        if created is not None and (held is None or bool(held[2]) != used):
            self.session.update((created, owner, used))
            forget_ms = (created + self.retention) // 1000 + 1
            if self.timed and forget_ms > timerValues.getCurrentWatermarkInMs():
                _rearm(self.handle, forget_ms)
        if not ids:
            return
        yield pd.DataFrame(
            {
                "session_id": pd.Series([key[0]] * len(ids), dtype="int64"),
                "attempt_id": pd.Series(ids, dtype="int64"),
                "session_error": pd.Series(errors, dtype="object"),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.session.clear()
        return iter(())

    def close(self) -> None:
        pass


SESSION_EVENT = ("session_id", "ts", "is_use", "attempt_id", "correlation_id")


def _session_rows(events: DataFrame) -> DataFrame:
    if "shape_reject" in events.columns:
        events = events.where(F.col("shape_reject").isNull())
    return events.select(*SESSION_EVENT).withColumns(
        {"us": F.unix_micros("ts"), "attempt_id": F.coalesce("attempt_id", F.lit(-1))}
    )


ANSWER = "session_id long, attempt_id long, session_error string"


def session_state(events: DataFrame, delay: str, s: Settings = DEFAULTS) -> DataFrame:
    """Outcome of every use event in a stream of creations and uses. A session
    is forgotten when the watermark has passed its retention: a use that
    arrives after that finds nothing, whatever its own time.

    ``events`` carry ``SESSION_EVENT``; creations have a NULL attempt id. Uses
    with a ``shape_reject`` (where that column exists) never reach the state.
    """
    keyed = _session_rows(events).withWatermark("ts", delay).groupBy("session_id")
    return keyed.transformWithStateInPandas(SessionProcessor(s), ANSWER, "append", "eventTime")


def session_answers(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``session_state`` for callers that wait for an answer: every use gets
    one row with its reason, however late it arrives. Uses are settled in the
    order of arrival (micro-batches, then event time inside one); their age is
    the event's own, so a use past its session's life is EXPIRED, past its
    retention, or of a session not yet seen, NOT_FOUND. State lives for the
    retention by the clock after its last change."""
    keyed = _session_rows(events).groupBy("session_id")
    return keyed.transformWithStateInPandas(SessionProcessor(s, False), ANSWER, "append", "processingTime")
