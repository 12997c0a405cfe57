"""Server-sent event frames to typed events to message states, batch or stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ["token", "citation", "tool_call", "tool_result", "patch_proposed", "limit", "error", "done", "snapshot"]
STATE = "message_id string, content string, status string, citations int, unverified int, tool_calls int, tools_done int, proposal string, last_seq long"


def parse_frames(frames: DataFrame, column: str = "frame") -> DataFrame:
    """id, event, data, message_id of raw frames. Fields come in any order, the last id and event count, data lines are
    joined by line feeds, comments are skipped, a frame without fields goes."""
    lines = F.filter(F.split(column, "\r?\n"), lambda x: (x != "") & ~x.startswith(":"))
    field = lambda x: F.element_at(F.split(x, ":", 2), 1)
    value = lambda x: F.regexp_replace(F.coalesce(F.get(F.split(x, ":", 2), F.lit(1)), F.lit("")), "^ ", "")
    of = lambda name: F.transform(F.filter("__l", lambda x: field(x) == name), value)
    rows = frames.withColumn("__l", lines)
    rows = rows.withColumns({"id": F.try_element_at(of("id"), F.lit(-1)), "event": F.try_element_at(of("event"), F.lit(-1)), "data": F.array_join(of("data"), "\n"), "__n": F.size(of("data"))})
    rows = rows.where(F.col("id").isNotNull() | F.col("event").isNotNull() | (F.col("__n") > 0))
    owner = F.when(F.instr("id", ":") > 0, F.regexp_replace("id", ":[^:]*$", "")).otherwise(F.col("id"))
    return rows.withColumn("message_id", F.when(owner != "", owner)).drop("__l", "__n")


def decode_events(frames: DataFrame) -> DataFrame:
    """Adds kind, seq and the payload's fields; unknown events and bad JSON go. seq: the payload's, else the id's, else 0."""
    rows = frames.where(F.col("event").isin(KINDS)).withColumn("__v", F.try_parse_json(F.when(F.col("data") == "", "{}").otherwise(F.col("data")))).where("__v is not null")
    of = lambda *names: F.coalesce(*(F.try_variant_get("__v", f"$.{n}", "string") for n in names), F.lit(""))
    flag = lambda n: F.coalesce(F.try_variant_get("__v", f"$.{n}", "boolean"), F.lit(False))
    seq = F.coalesce(F.try_variant_get("__v", "$.seq", "long"), F.regexp_extract("id", r":(\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    return rows.select("message_id", seq.alias("seq"), F.col("event").alias("kind"), of("text").alias("text"), flag("verified").alias("verified"), of("callId", "call_id").alias("call_id"), flag("ok").alias("ok"),
                       of("summary").alias("summary"), of("proposalId", "proposal_id").alias("proposal_id"), of("message").alias("message"), of("finish").alias("finish"))


def reduce_event(state: dict, e) -> dict:
    """One event folded into a message's state."""
    k, before = e.kind, state["last_seq"]
    if k == "token":
        state["content"] += e.text
    elif k == "citation":
        state["citations"] += 1
        state["unverified"] += not e.verified
    elif k == "tool_call":
        state["calls"].append([e.call_id, False])
    elif k == "tool_result":
        for c in state["calls"]:
            c[1] = c[1] or c[0] == e.call_id
    elif k == "patch_proposed":
        state["proposal"] = e.proposal_id
    elif k == "limit":
        state["status"], state["content"] = "limit", state["content"] or e.message
    elif k == "error":
        state["status"] = "error"
    elif k == "done":
        state["status"] = e.finish or "complete"
    elif k == "snapshot":
        state = snapshot(e.message)
    state["last_seq"] = max(e.seq, before)
    return state


def snapshot(message: str) -> dict:
    """The state that a snapshot's message, a JSON object, replaces all before with."""
    m = json.loads(message) if message[:1] == "{" else {"content": message}
    calls = [[c.get("callId") or c.get("call_id") or "", c.get("ok") is not None] for c in m.get("toolCalls") or []]
    proposal = m.get("proposal") or {}
    return empty_state() | {
        "content": m.get("content") or "", "status": m.get("status") or "streaming", "citations": len(m.get("citations") or []), "unverified": m.get("unverifiedCitations") or 0,
        "calls": calls, "proposal": proposal.get("proposalId") or proposal.get("id")}


def empty_state() -> dict:
    return {"content": "", "status": "streaming", "citations": 0, "unverified": 0, "calls": [], "proposal": None, "last_seq": -1}


def _row(key: str, s: dict) -> pd.DataFrame:
    return pd.DataFrame({"message_id": [key], "content": [s["content"]], "status": [s["status"]], "citations": [s["citations"]], "unverified": [s["unverified"]], "tool_calls": [len(s["calls"])], "tools_done": [sum(c[1] for c in s["calls"])], "proposal": [s["proposal"]], "last_seq": [s["last_seq"]]})


def message_states(events: DataFrame) -> DataFrame:
    """State of every message after its events, in order of seq, each seq once.

    A stream keeps the state between batches and gives a row a message and batch; events whose seq is not above the last
    one folded are repeats and go, but for snapshots, whose number may start anew. A batch gives one row a message. A snapshot
    belongs to the message that it holds, by the ``id`` in it, whatever its frame says; without one, to the frame's.
    """
    held = F.when(F.col("kind") == "snapshot", F.get_json_object("message", "$.id"))
    events = events.withColumn("message_id", F.coalesce(held, "message_id"))
    if not events.isStreaming:

        def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            s = empty_state()
            for e in rows.sort_values("seq", kind="stable").drop_duplicates("seq").itertuples():
                s = reduce_event(s, e)
            return _row(key[0], s)

        return events.groupBy("message_id").applyInPandas(fold, STATE)

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(held.get[0]) if held.exists else empty_state()
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable").drop_duplicates("seq")
        for e in rows[(rows["seq"] > s["last_seq"]) | (rows["kind"] == "snapshot")].itertuples():
            s = reduce_event(s, e)
        held.update((json.dumps(s),))
        yield _row(key[0], s)

    return events.groupBy("message_id").applyInPandasWithState(update, STATE, "state string", "update", GroupStateTimeout.NoTimeout)


def coalesced(events: DataFrame) -> DataFrame:
    """Runs of token events in one: message_id, kind, first_seq, last_seq, text. Other events stay as they are."""
    from pyspark.sql.window import Window

    along = Window.partitionBy("message_id").orderBy("seq")
    joins = (F.col("kind") == "token") & F.lag("kind").over(along).eqNullSafe(F.lit("token"))
    runs = events.withColumn("__run", F.sum(F.when(joins, 0).otherwise(1)).over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return runs.groupBy("message_id", "__run", "kind").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), text.alias("text")).drop("__run")


def newest_pending(proposals: DataFrame) -> DataFrame:
    """The newest pending proposal of each conversation. proposals: conversation, proposal, at, decision."""
    return proposals.where("decision = 'pending'").groupBy("conversation").agg(F.max_by("proposal", F.struct("at", "proposal")).alias("proposal"))


def rate_limited(requests: DataFrame, key: str, at: str, limits: dict[str, int], late: str | None = None) -> DataFrame:
    """Windows in which a key exceeds a limit: key, window length, start, requests, over.

    ``limits`` maps window lengths to the most requests. ``late`` sets a watermark on a stream.
    """
    rows = requests if late is None else requests.withWatermark(at, late)
    out = None
    for length, most in limits.items():
        counts = rows.groupBy(key, F.window(at, length)).agg(F.count("*").alias("requests")).where(F.col("requests") > most)
        part = counts.select(key, F.lit(length).alias("length"), F.col("window.start").alias("start"), "requests", (F.col("requests") - most).alias("over"))
        out = part if out is None else out.unionByName(part)
    return out


def frames_of_chunks(chunks: DataFrame, stream: str, seq: str, chunk: str) -> DataFrame:
    """stream, place and frame of byte chunks, wherever chunks end: inside a frame, a line or a character.

    A stream is one answer: its bytes are put together in order, decoded once and cut at blank lines. What follows the last
    blank line is no frame yet and is left out.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.hex(chunk).alias("x")))), lambda c: c["x"])
    whole = F.decode(F.unhex(F.array_join(parts, "")), "UTF-8")
    cut = F.split(whole, r"\r?\n\r?\n")
    done = chunks.groupBy(stream).agg(F.slice(cut, F.lit(1), F.size(cut) - 1).alias("frames"))
    return done.select(stream, F.posexplode("frames").alias("place", "frame"))
