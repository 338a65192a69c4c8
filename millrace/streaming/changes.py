"""Streams of observed values: only changes pass, and sessions of tentative states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "user_id long, event_type string, ts timestamp, event_id long, value double"
SESSIONS = "session string, seq long, command string, state string, ok boolean"


def changed_values(events: DataFrame, watermark: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """Of a stream of events (user_id, event_type, ts, event_id, value), those whose value differs from the last one of
    the same user and type. With forget_ms, keys that are silent for so long are forgotten; such a query runs batches
    without data too, so it doesn't end with its input."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        had = state.exists
        last = state.get[0] if had else None
        before = rows["value"].shift(1)
        keep = rows["value"] != before
        keep.iloc[0] = not had or last != rows["value"].iloc[0]
        state.update((float(rows["value"].iloc[-1]),))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        if keep.any():
            yield rows.loc[keep, ["user_id", "event_type", "ts", "event_id", "value"]]

    keyed = events.withWatermark("ts", watermark).groupBy("user_id", "event_type")
    return keyed.applyInPandasWithState(step, CHANGES, "last double", "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def sessions(commands: DataFrame) -> DataFrame:
    """Replays a stream of commands (session, seq, command, argument): start, fork (argument: from), try and submit
    (argument: token), end. A try shows the state that a submit would make, and doesn't keep it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        now = state.get[0] if state.exists else None
        out = []
        for seq, command, argument in zip(rows["seq"], rows["command"], rows["argument"], strict=True):
            shown, ok = now, now is not None or command == "start"
            if command == "start":
                now = shown = ""
            elif command == "end":
                now, shown = None, now
            elif ok:
                shown = f"{now} {argument}".strip()
                now = shown if command == "submit" else now
            out.append((key[0], seq, command, shown, ok))
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update((now,))
        yield pd.DataFrame(out, columns=["session", "seq", "command", "state", "ok"])

    return commands.groupBy("session").applyInPandasWithState(step, SESSIONS, "tokens string", "append", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each finished batch to a dataset; a batch that runs again replaces its own part."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
