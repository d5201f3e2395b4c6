import pandas as pd

from presence.config import DEFAULTS
from presence.streaming.stateful import SessionProcessor


class Value:
    """A value state that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = None, []

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value


class Handle:
    def __init__(self):
        self.value = Value()

    def getValueState(self, *_):
        return self.value


def test_state_is_asked_once_and_told_only_changes():
    handle, processor = Handle(), SessionProcessor(DEFAULTS, timed=False)
    processor.init(handle)

    def feed(*rows):
        frame = pd.DataFrame(rows, columns=["us", "is_use", "attempt_id", "correlation_id"])
        return [e for out in processor.handleInputRows((1,), iter([frame]), None) for e in out["session_error"]]

    assert feed((0, False, -1, "a")) == []
    assert handle.value.calls == ["get", "update"]
    assert feed((1, True, 5, "a"), (2, True, 6, "a")) == [None, "SESSION_ALREADY_USED"]
    assert feed((3, True, 7, "a")) == ["SESSION_ALREADY_USED"]
    assert handle.value.calls == ["get", "update", "get", "update", "get"]
