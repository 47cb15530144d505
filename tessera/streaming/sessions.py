"""Session state on streams of events (session, seq, lane, key, text).

Stateful operators keep per-session state in the state store, so a session's memory is its seen keys and queues, and a lost executor
resumes from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event with each key; state grows with the keys, or within the watermark if one is set."""
    return events.dropDuplicates(keys)


def gate(events: DataFrame) -> DataFrame:
    """session, seq, key, fresh: whether the session has not seen the key; an event of kind "forget" empties its memory."""

    kind = events.schema["session"].dataType.simpleString()

    def run(session: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0].split("\x1f")) if state.exists and state.get[0] else set()
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        rows = []
        for seq, kind, key in zip(pdf["seq"], pdf["kind"], pdf["key"], strict=True):
            if kind == "forget":
                seen.clear()
                continue
            rows.append((session[0], int(seq), key, key not in seen))
            seen.add(key)
        state.update(("\x1f".join(sorted(seen)),))
        yield pd.DataFrame(rows, columns=["session", "seq", "key", "fresh"])

    return events.select("session", "seq", "kind", "key").groupBy("session").applyInPandasWithState(run, f"session {kind}, seq bigint, key string, fresh boolean", "seen string", "append", GroupStateTimeout.NoTimeout)


def merge_lanes(events: DataFrame) -> DataFrame:
    """session, place, lane, marker, text: what a session says, in order. Events of the tangent lane that have come go before the main lane's,
    with a start and an end marker; while paused nothing is said, after a cancel nothing more."""

    kind = events.schema["session"].dataType.simpleString()

    def run(session: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, paused, cancelled, held = state.get if state.exists else (0, False, False, "")
        main = [x for x in held.split("\x1e") if x]
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        tangent: list[str] = []
        rows = []
        for lane, kind, text in zip(pdf["lane"], pdf["kind"], pdf["text"], strict=True):
            if kind in ("pause", "resume"):
                paused = kind == "pause"
            elif kind == "cancel":
                cancelled = True
            else:
                (tangent if lane == "tangent" else main).append(f"{lane}\x1f{text}")
        if not paused and not cancelled:
            said = [("tangent", "start" if i == 0 else "", x.split("\x1f", 1)[1]) for i, x in enumerate(tangent)]
            said += [("tangent", "end", "")] * bool(tangent)
            said += [tuple([*x.split("\x1f", 1)[:1], "", x.split("\x1f", 1)[1]]) for x in main]
            for lane, marker, text in said:
                rows.append((session[0], place, lane, marker, text))
                place += 1
            main = []
        else:
            main = [*tangent, *main]
        state.update((place, paused, cancelled, "\x1e".join(main)))
        yield pd.DataFrame(rows, columns=["session", "place", "lane", "marker", "text"])

    return events.select("session", "seq", "lane", "kind", "text").groupBy("session").applyInPandasWithState(
        run, f"session {kind}, place bigint, lane string, marker string, text string", "place bigint, paused boolean, cancelled boolean, held string", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by window and type, late events dropped beyond the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
