"""Sensors and limits as keyed folds, for whole tables and for streams: fused sources, wheel and crank counters, a sliding limit.

A fold keeps what it must of one key as a small state and answers each row, in the order of time and sequence. ``folded`` runs
it over a table, ``fold`` over a stream, where the state outlives restarts; rows of one batch are taken in order. A key's state is
bounded by what the fold keeps: the last reading of each source, one counter, or the accepted requests of one window.
Rows without a key or a time are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
#: How long a reading is fresh, when a silent counter stands still, the ticks of an event clock, the limit and its window.
FRESH_US = 10 * SECOND
STALL_US = 3 * SECOND
TICKS = 1024
LIMIT, WINDOW_US = 90, 900 * SECOND

Step = Callable[[dict, dict], list[tuple]]


def fused(state: dict, row: dict) -> list[tuple]:
    """``(kind, source_id, value)`` after each reading: of its kind the source of highest priority that is fresh, of equals the newer (STM-03)."""
    kind = state.setdefault(row["kind"], {})
    had = kind.get(row["source_id"])
    if had is None or had[1] <= row["at_us"]:
        kind[row["source_id"]] = [row["priority"], row["at_us"], row["value"]]
    fresh = [(p, at, s, v) for s, (p, at, v) in kind.items() if abs(row["at_us"] - at) <= FRESH_US]
    best = max(fresh, key=lambda x: x[:3], default=None)
    return [(row["kind"], best[2], best[3])] if best else []


def counted(state: dict, row: dict) -> list[tuple]:
    """``(milli_rps)`` between the events of a counter of ``bits`` bits with a 16-bit clock of 1/1024 s; 0 once it has been silent for 3 s (STM-04).

    A row that brings no new event says nothing; the first one of a counter only begins it.
    """
    revs, clock, at = row["revs"], row["clock"], row["at_us"]
    if not state:
        state.update(revs=revs, clock=clock, at=at, still=False)
        return []
    ticks = (clock - state["clock"]) & 0xFFFF
    turned = (revs - state["revs"]) & ((1 << row["bits"]) - 1)
    if not ticks or not turned:
        if at - state["at"] >= STALL_US and not state["still"]:
            state["still"] = True
            return [(0,)]
        return []
    state.update(revs=revs, clock=clock, at=at, still=False)
    return [(turned * 1000 * TICKS // ticks,)]


def limited(state: dict, row: dict) -> list[tuple]:
    """``(accepted, wait_us)`` of each request: refused while the window before it holds ``LIMIT`` accepted ones; refused ones use up nothing (STM-09)."""
    kept = state.setdefault("kept", [])
    at = row["at_us"]
    kept[:] = [x for x in kept if x > at - WINDOW_US]
    if len(kept) < LIMIT:
        kept.append(at)
        return [(True, 0)]
    return [(False, kept[0] + WINDOW_US - at)]


#: What each fold reads beside ``key, at, seq``, and what it gives beside ``key, at_us, seq``.
FOLDS: dict[str, tuple[Step, tuple[str, ...], str]] = {
    "fused": (fused, ("kind", "source_id", "priority", "value"), "kind string, source_id bigint, value double"),
    "counted": (counted, ("revs", "clock", "bits"), "milli_rps bigint"),
    "limited": (limited, (), "accepted boolean, wait_us bigint"),
}


def _schema(name: str) -> str:
    return f"key bigint, at_us bigint, seq bigint, {FOLDS[name][2]}"


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def _taken(name: str, key: int, state: dict, rows: pd.DataFrame) -> pd.DataFrame:
    step, columns, _ = FOLDS[name]
    names = [x.split()[0] for x in _schema(name).split(", ")]
    out = []
    ordered = rows.sort_values(["at_us", "seq"], kind="stable")
    for at_us, seq, *values in ordered[["at_us", "seq", *columns]].itertuples(index=False, name=None):
        row = dict(zip(columns, map(_plain, values), strict=True), at_us=int(at_us))
        out += [(key, int(at_us), int(seq), *answer) for answer in step(state, row)]
    return pd.DataFrame(out, columns=names)


def _rows(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter("key IS NOT NULL AND at IS NOT NULL").select("key", "at", F.unix_micros("at").alias("at_us"), "seq", *FOLDS[name][1])


def folded(rows: DataFrame, name: str) -> DataFrame:
    """The answers of a fold over a whole table of ``(key, at, seq, ...)``."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _taken(name, _plain(key[0]), {}, group)

    return _rows(rows, name).groupBy("key").applyInPandas(run, _schema(name))


class _Fold(StatefulProcessor):
    def __init__(self, name: str):
        self.name = name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        if self.name == "fused":
            state = {k: {int(s): v for s, v in of.items()} for k, of in state.items()}
        found = _taken(self.name, _plain(key[0]), state, pd.concat(list(rows)))
        self.state.update((json.dumps(state),))
        yield found

    def close(self) -> None:
        pass


def fold(rows: DataFrame, name: str) -> DataFrame:
    """``folded`` on a stream."""
    return _rows(rows, name).groupBy("key").transformWithStateInPandas(_Fold(name), _schema(name), "append", "None")
