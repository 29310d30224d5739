"""Keyed stream state: sessions with late events, and spend that crosses its thresholds.

A batch reads and writes the state of the keys it holds, no others; state travels with the rows in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quiltlens.operators.telemetry import BASE_TOKENS, WINDOW_TOKENS, spend_of

# Event types and the phase each sets.
PHASES = {
    "generate": "generate_requested", "variants_ready": "variants_ready", "agent_done": "variants_ready", "accept": "accept_requested",
    "accept_intent": "accept_requested", "discard": "discard_requested", "discarded": "discarded", "complete": "completed", "agent_error": "agent_error",
}
WAITS = ["generate", "accept", "accept_intent", "discard"]
ENDS = ["variants_ready", "agent_done", "discarded", "complete", "agent_error"]
FINAL = ["completed", "discarded"]
READY, ACCEPTS, TURNS = {"variants_ready", "agent_done"}, {"accept", "accept_intent"}, {*WAITS, *ENDS}

BUFFER = 4_096  # newest events of a session that later arrivals can still come between
IDLE_MS = 6 * 3_600_000

EVENT = "type string, page_url string, count bigint, file string, revision bigint, phase string, owner string, variant bigint, arrived bigint"
EVENT_FIELDS = [f.split()[0] for f in EVENT.split(", ")]
SNAPSHOT = (
    "phase string, page_url string, expected bigint, arrived bigint, pending_seq bigint, revision bigint, owner string, variant bigint, file string, diagnostics bigint, last_seq bigint"
)
SNAPSHOT_FIELDS = [f.split()[0] for f in SNAPSHOT.split(", ")]
# what the fold has to remember beside the snapshot: the highest revision seen, the first count that stood for arrivals, late events left out
KEPT_FIELDS = [*SNAPSHOT_FIELDS, "top", "implied", "late"]
NEW = {"phase": None, "diagnostics": 0, "last_seq": -1, "top": 0, "late": 0}


INTS = {f.split()[0] for f in EVENT.split(", ") if f.endswith(" bigint")}


def _values(frame: pd.DataFrame, name: str) -> list:
    """A column as plain values: None for whatever stands for null, whole numbers as int."""
    name = name if name in frame else f"{name}_"
    got = [None if v is None or v is pd.NA or v != v else v for v in frame[name].tolist()]
    return [v if v is None else int(v) for v in got] if name.rstrip("_") in INTS else got


def _events(frame: pd.DataFrame) -> list[tuple[int, list]]:
    """``(seq, fields)`` of a frame's events."""
    return list(zip(map(int, frame["seq"].tolist()), map(list, zip(*(_values(frame, f) for f in EVENT_FIELDS)))))


def fold_events(kept: dict, events: pd.DataFrame) -> dict:
    """``kept`` after ``events`` (one session's, in seq order, all after ``last_seq``): the batch fold."""
    return _fold(kept, _events(events))


def _fold(kept: dict, events: list[tuple[int, list]]) -> dict:
    """``kept`` after ``(seq, fields)`` in seq order, in one pass over plain values: a session has few events in a batch.

    A checkpoint below the highest revision before it is stale: it counts as a diagnostic and sets nothing. Every other
    field is the value of the last event that sets it.
    """
    if not events:
        return kept
    out = dict(kept)
    for seq, (type_, page_url, count, file, revision, phase, owner, variant, arrived) in events:
        live = False
        if type_ == "checkpoint":
            live, said = (revision or 0) >= out["top"], phase
            out["top"] = max(out["top"], revision or 0)
        else:
            said = PHASES.get(type_)
        ready = type_ in READY
        if said is not None and (live or type_ != "checkpoint"):
            out["phase"] = said
        if ready:
            if out.get("implied") is None:
                out["implied"] = out.get("expected")
            if file is not None:
                out["file"] = file
        if type_ == "generate":
            out["page_url"] = out.get("page_url") if page_url is None else page_url
            out["expected"] = out.get("expected") if count is None else count
        if (ready or live) and arrived is not None:
            out["arrived"] = arrived
        if type_ in TURNS:
            out["pending_seq"] = seq if type_ in WAITS else None
        if live:
            if revision is not None and (out.get("revision") is None or revision > out["revision"]):
                out["revision"] = revision
            if owner is not None:
                out["owner"] = owner
        if variant is not None and (live or type_ in ACCEPTS):
            out["variant"] = variant
        if type_ == "agent_error" or (not live if type_ == "checkpoint" else type_ not in PHASES):
            out["diagnostics"] += 1
    out["last_seq"] = events[-1][0]
    return out


def _shown(kept: dict) -> dict:
    arrived = kept.get("arrived") if kept.get("arrived") is not None else kept.get("implied")
    return {**{f: kept.get(f) for f in SNAPSHOT_FIELDS}, "phase": kept.get("phase") or "new", "arrived": arrived}


def keep_session(state: tuple | None, frames: list[pd.DataFrame], buffer: int) -> tuple[tuple, dict]:
    """``_keep`` for frames of events."""
    return _keep(state, [_events(f) for f in frames], buffer)


def _keep(state: tuple | None, parts: list[list[tuple[int, list]]], buffer: int) -> tuple[tuple, dict]:
    """The state after a batch, and the session as it shows: ``(kept fields, newer events as JSON)``, and all events folded.

    ``kept`` is the snapshot up to a settled event; the newer events stay by seq, so that late ones still find their place.
    """
    kept = dict(zip(KEPT_FIELDS, state)) if state else dict(NEW)
    held = {int(k): v for k, v in json.loads(state[-1]).items()} if state else {}
    late = kept["late"]
    for part in parts:
        fresh: dict[int, list] = {}
        for seq, event in sorted(part, key=lambda e: (e[0], e[1][0] is None, e[1][0] or "")):
            fresh.setdefault(seq, event)
        late += sum(seq < kept["last_seq"] for seq in fresh)
        held = {seq: e for seq, e in fresh.items() if seq > kept["last_seq"]} | held  # an event that comes again changes nothing
    if len(held) > buffer:  # settle the older ones; what comes before them from now on is late
        settled = sorted(held)[:len(held) - buffer // 2]
        kept = _fold(kept, [(s, held.pop(s)) for s in settled])
    kept["late"] = late
    return (*(kept.get(f) for f in KEPT_FIELDS), json.dumps(held)), {**_fold(kept, sorted(held.items())), "late": late}


def session_stream(events: DataFrame, buffer: int = BUFFER, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Streaming ``session_state``: the snapshot of every session a batch has events of, with ``late`` and ``closed``.

    The newest ``buffer`` events of a session are kept by seq, so events may come late and out of order by that many and
    repeated ones count once: the snapshot equals the batch fold of all events so far. Beyond it older events are settled
    into the snapshot; an event that comes before a settled one is not applied but counted in ``late``. After ``idle_ms``
    without events the session's last snapshot comes once more, ``closed``, and its state leaves; events after that start
    a new one. Without ``idle_ms`` state stays; a stream that ends by itself (trigger ``availableNow``) needs that, as timers
    keep a query going. For update mode.
    """
    kind = events.schema["session"].dataType.simpleString()
    fields = [F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in EVENT.split(", ")]
    # a group costs as much as it has columns, so events, state and snapshots travel as one text each
    packed = events.select("session", F.col("seq").cast("bigint").alias("seq"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("event"))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, closed = tuple(json.loads(state.get[0])) if state.exists else None, state.hasTimedOut
        parts = [] if closed else [[(int(s), list(json.loads(e).values())) for s, e in zip(f["seq"].tolist(), f["event"].tolist())] for f in frames]
        after, whole = _keep(before, parts, buffer)
        if closed:
            state.remove()
        else:
            state.update((json.dumps(after),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session": [key[0]], "told": [json.dumps({**_shown(whole), "late": whole["late"], "closed": closed})]}, dtype=object)

    told = packed.filter("seq IS NOT NULL").groupBy("session").applyInPandasWithState(
        fold, f"session {kind}, told string", "kept string", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
    return told.select("session", F.from_json("told", f"{SNAPSHOT}, late bigint, closed boolean").alias("s")).select("session", "s.*")


def _pct(spend, window: int):
    """As a percentage of the window, rounded half up to one digit."""
    return np.floor((spend + BASE_TOKENS) * 1000.0 / window + 0.5) / 10


def crossing_stream(spend: DataFrame, window: int = WINDOW_TOKENS, arm: float = 50, force: float = 75) -> DataFrame:
    """Streaming ``spend_crossings``: one row per owner and threshold, when its running spend reaches it, for append mode.

    The rows of a batch are added in seq order, batches as they come; state is one number per owner and a row is given in
    the batch that crosses, so a restart from the checkpoint repeats none. Null costs count 0.
    """
    kind = spend.schema["owner"].dataType.simpleString()
    cost = F.coalesce(spend_of(F.col("kind"), F.col("n"), F.col("bytes")), F.lit(0)).cast("bigint").alias("cost")

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = int(state.get[0]) if state.exists else 0
        frame = pd.concat(list(frames)).sort_values("seq", kind="stable")  # an owner's rows of one batch, three numbers each
        after = before + frame["cost"].cumsum().to_numpy(dtype=np.int64)
        state.update((int(after[-1]),))
        prior = np.append(before, after[:-1])
        for name, limit in (("armed", arm), ("force", force)):
            hit = np.flatnonzero((_pct(prior, window) < limit) & (_pct(after, window) >= limit))
            if not len(hit):
                continue
            yield pd.DataFrame({"owner": [key[0]] * len(hit), "seq": frame["seq"].to_numpy()[hit], "state": [name] * len(hit), "spend": after[hit], "pct": _pct(after[hit], window)})

    return spend.select("owner", F.col("seq").cast("bigint").alias("seq"), cost).groupBy("owner").applyInPandasWithState(
        add, f"owner {kind}, seq bigint, state string, spend bigint, pct double", "spend bigint", "append", GroupStateTimeout.NoTimeout)
