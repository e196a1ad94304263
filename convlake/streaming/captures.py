"""Captures that arrive over time: settled snapshots, deadlines, tiers, alerts, incremental pairs.

Each has a batch form, which is its measure; streams need a watermark to bound their state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convlake.session import ship

MOST_HTML, MOST_TEXT, LEAST_SHARE = 600_000, 200_000, 0.5


def settled_snapshots(updates: DataFrame, key: str, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last update of each burst: (key, first_ts, last_ts, updates, value).  Batch or stream."""
    source = updates.withWatermark("ts", late) if updates.isStreaming else updates
    return source.groupBy(key, F.session_window("ts", gap).alias("burst")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("updates"), F.max_by("value", "ts").alias("value")
    ).drop("burst")


def observe_deadline(updates: DataFrame, key: str, seconds: int = 30, expire_ms: int | None = None) -> DataFrame:
    """Updates no later than ``seconds`` after the key was first seen.  Batch or stream.

    A stream keeps the first time of each key in its state, and equals the batch if no update comes in
    a later micro-batch than one with a later time.  With ``expire_ms``, a key that was silent for so long is
    forgotten and starts anew.  Updates without a time are left out.
    """
    if updates.isStreaming:
        return stream_deadline(updates, key, seconds, expire_ms)
    first = F.min("ts").over(Window.partitionBy(key))
    return updates.withColumn("__first", first).where(F.col("ts") <= F.col("__first") + F.expr(f"INTERVAL {seconds} SECONDS")).drop("__first")


def stream_deadline(updates: DataFrame, key: str, seconds: int, expire_ms: int | None) -> DataFrame:
    ship(updates.sparkSession)

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = state.get[0] if state.exists else None
        batch = [f[f["ts"].notna()] for f in frames]  # a key's first time is known only after all its frames
        micros = [f["ts"].to_numpy("datetime64[us]").astype("int64") for f in batch]
        for m in micros:
            if len(m):
                first = int(m.min()) if first is None else min(first, int(m.min()))
        if first is not None:
            state.update((first,))
            if expire_ms:
                state.setTimeoutDuration(expire_ms)
        for f, m in zip(batch, micros, strict=True):
            if len(m):
                yield f[m <= first + seconds * 1_000_000]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    return updates.groupBy(key).applyInPandasWithState(step, updates.schema, "first long", "append", timeout)


def choose_capture_tier(html: Column, html_text: Column, text: Column) -> Column:
    """``html``, ``text`` or null, from the lengths of html, of its text, and of the plain text."""
    kept = (html > 0) & (html <= MOST_HTML) & ~((text > 0) & (html_text < text * LEAST_SHARE))
    return F.when(kept, "html").when((text > 0) & (text <= MOST_TEXT), "text")


def trusted_origin(relayed: DataFrame, frames: DataFrame, origin: str, kind: str) -> DataFrame:
    """Relayed rows from an origin that fits the pattern, of the known type, with content, and a frame."""
    fine = relayed.where(F.col("origin").rlike(origin) & (F.col("type") == kind) & (F.col("html").isNotNull() | F.col("text").isNotNull()))
    return fine.join(frames.select("frame_id"), "frame_id", "left_semi")


def stream_drift_dedupe(reports: DataFrame, handled: DataFrame | None = None, late: str = "1 day") -> DataFrame:
    """One alert for each fingerprint; handled ones give none.  Batch or stream."""
    if handled is not None:
        reports = reports.join(handled.select("fingerprint"), "fingerprint", "left_anti")
    if reports.isStreaming:
        return reports.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])
    first = Window.partitionBy("fingerprint").orderBy("ts", "conv_id")
    return reports.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


PAIR = "conv_id long, pair_index int, turn long, question string, answer string"


def pair_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs as soon as an answer or the next question comes; an open question waits in the state."""
    if state.hasTimedOut:
        state.remove()
        return
    index, turn, question = state.get if state.exists else (0, None, None)
    rows = pd.concat(list(frames)).sort_values("turn")
    out = []
    for r in rows.itertuples():
        if question is not None:
            out.append((key[0], index, turn, question, r.content if r.role == "assistant" else ""))
            index, turn, question = index + 1, None, None
        if r.role == "user":
            turn, question = r.turn, r.content
    state.update((index, turn, question))
    yield pd.DataFrame(out, columns=["conv_id", "pair_index", "turn", "question", "answer"])


def stream_pairing(turns: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """Pairs of a stream of turns; after all turns, those of the batch operator.

    With ``expire_ms``, a conversation that was silent for so long is forgotten, which bounds
    the state; such a stream runs until it is stopped.
    """
    ship(turns.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from pair_step(key, frames, state)
        if expire_ms and state.exists:
            state.setTimeoutDuration(expire_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    return turns.where("role IN ('user', 'assistant')").groupBy("conv_id").applyInPandasWithState(
        step, PAIR, "pair_index int, turn long, question string", "append", timeout
    )
