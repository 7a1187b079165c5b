"""Live rides as keyed stateful processors: the recorder with its pauses, and the guard of a planned route.

A ride's state is one row (and, for the guard, its planned line); an event-time timer stands for the recorder's clock.
The same folds serve whole tables (``recorded``, ``followed``), a ride in one group, and streams (``record``,
``follow``). A restarted stream goes on from its checkpoint, which takes the place of a journal that is folded again.
Rows without a ride or a time are dropped. Fixes without a position are dropped by both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields
from math import asin, cos, isfinite, radians, sin, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import EARTH_RADIUS_M

SECOND = 1_000_000
#: Fixed values of the recorder.
MAX_PLAUSIBLE_MPS = 30.0
MOVING_MPS = 1000 / 3600
PAUSE_GAP_US = 30 * SECOND
AUTO_PAUSE_US = 10 * SECOND
#: Fixed values of the route guard: metres, fixes and seconds.
OFF_ROUTE_M, SNAP_M, DRIFT_M, ACCURACY_CAP_M = 75.0, 30.0, 50.0, 100.0
OFF_ROUTE_FIXES, OFF_ROUTE_AFTER = 2, 8
DETOUR_AFTER, DETOUR_AFTER_M, DETOUR_MIN = 45, 150.0, 15
RECOMPUTE_GAP, RECOMPUTE_MOVED_M, PASSED_SLACK_M = 20, 300.0, 20.0
REPEAT_M, AHEAD_SLACK_M, LOOP_ENDS_M = 300.0, 2.0, 60.0
WINDOW_BEHIND, WINDOW_AHEAD, JUMP_WEIGHT = 5, 60, 0.05

EVENTS = "ride_id bigint, at timestamp, seq bigint, what string, lat double, lon double, speed double"
RECORDED = "ride_id bigint, at_us bigint, what string, distance_mm bigint, moving_us bigint, n_fixes bigint"
FOLLOWED = "ride_id bigint, at_us bigint, state string, away_dm bigint, along_dm bigint, guide_dm bigint, speak boolean, plan_detour boolean, restored boolean"


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    h = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * asin(min(1.0, sqrt(h)))


def _given(value) -> bool:
    return value is not None and value == value


@dataclass
class Recording:
    """The state of one ride's recorder (STM-01, STM-02)."""

    status: str = "active"
    auto: bool = False
    moved_us: int | None = None
    last_us: int | None = None
    lat: float | None = None
    lon: float | None = None
    distance_mm: int = 0
    moving_us: int = 0
    n_fixes: int = 0

    def _row(self, at_us: int, what: str) -> tuple:
        return at_us, what, self.distance_mm, self.moving_us, self.n_fixes

    def tick(self, now_us: int) -> list[tuple]:
        """What the clock has brought by now: standing still for long enough pauses an active ride."""
        if self.status != "active" or self.moved_us is None or now_us < self.moved_us + AUTO_PAUSE_US:
            return []
        self.status, self.auto = "paused", True
        return [self._row(self.moved_us + AUTO_PAUSE_US, "auto-paused")]

    def due_us(self) -> int | None:
        return self.moved_us + AUTO_PAUSE_US if self.status == "active" and self.moved_us is not None else None

    def take(self, at_us: int, what: str, lat: float | None, lon: float | None, speed: float | None) -> list[tuple]:
        """Fold one event: a fix, or the rider's pause, resume and stop."""
        if self.status == "stopped":
            return []
        if self.moved_us is None:
            self.moved_us = at_us
        out = self.tick(at_us)
        if what == "pause" and (self.status == "active" or self.auto):
            self.status, self.auto = "paused", False
            out.append(self._row(at_us, "paused"))
        elif what == "resume" and self.status == "paused":
            out += self._resume(at_us)
        elif what == "stop":
            self.status, self.auto = "stopped", False
            out.append(self._row(at_us, "stopped"))
        elif what == "fix" and (self.status == "active" or self.auto) and _given(lat) and _given(lon):
            out += self._fix(at_us, lat, lon, speed)
        return out

    def _resume(self, at_us: int) -> list[tuple]:
        self.status, self.auto, self.moved_us = "active", False, at_us
        return [self._row(at_us, "resumed")]

    def _fix(self, at_us: int, lat: float, lon: float, speed: float | None) -> list[tuple]:
        shown = 0.0
        if self.last_us is not None:
            took = at_us - self.last_us
            if took <= 0:
                return []
            leg = metres(self.lat, self.lon, lat, lon)
            measured = leg / (took / SECOND)
            if measured > MAX_PLAUSIBLE_MPS:
                return []
            if took <= PAUSE_GAP_US:
                self.distance_mm += int(leg * 1000 + 0.5)
                self.moving_us += took if measured >= MOVING_MPS else 0
                shown = speed if _given(speed) and isfinite(speed) and 0 <= speed <= MAX_PLAUSIBLE_MPS else measured
        self.last_us, self.lat, self.lon, self.n_fixes = at_us, lat, lon, self.n_fixes + 1
        out = [self._row(at_us, "fix")]
        if shown >= MOVING_MPS:
            self.moved_us = at_us
            if self.auto:
                out += self._resume(at_us)
        return out


_KEPT = ("seq", "what", "lat", "lon", "speed")
_STATE = {"status": "string", "auto": "boolean", "moved_us": "bigint", "last_us": "bigint", "lat": "double", "lon": "double", "distance_mm": "bigint", "moving_us": "bigint", "n_fixes": "bigint"}
assert list(_STATE) == [f.name for f in fields(Recording)]


def _plain(value):
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["at_us", "seq"], kind="stable")


def _take_all(ride: Recording, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for at_us, what, lat, lon, speed in _in_order(rows)[["at_us", "what", "lat", "lon", "speed"]].itertuples(index=False, name=None):
        out += ride.take(int(at_us), what, _plain(lat), _plain(lon), _plain(speed))
    return out


def _frame(key, rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    frame = pd.DataFrame([(key, *r) for r in rows], columns=names)
    return frame.astype({n: "int64" for n, kind in (x.split() for x in schema.split(", ")) if kind == "bigint" and not frame[n].isna().any()})


def _events(events: DataFrame, *columns: str) -> DataFrame:
    kept = events.filter("ride_id IS NOT NULL AND at IS NOT NULL")
    return kept.select("ride_id", "at", F.unix_micros("at").alias("at_us"), *columns)


def recorded(events: DataFrame, until_us: int | None = None) -> DataFrame:
    """What the recorder writes for a whole table of ``EVENTS``: accepted fixes and changes of status, with the totals so far.

    ``until_us`` is how long the clock goes on after the last event of each ride (null: not at all). A task folds its
    sorted rides one after the other and holds the state of one and the rows of a batch, however many or long they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ride = None, None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for ride_id, at_us, what, lat, lon, speed in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ride_id", "at_us", *_KEPT[1:])), strict=True):
                if ride_id != own or ride is None:
                    if ride is not None and until_us is not None:
                        out += [(own, *r) for r in ride.tick(until_us)]
                    own, ride = ride_id, Recording()
                out += [(own, *r) for r in ride.take(at_us, what, lat, lon, speed)]
            if out:
                yield told(out)
        if ride is not None and until_us is not None and (last := [(own, *r) for r in ride.tick(until_us)]):
            yield told(last)

    names, kinds = zip(*((n, {"bigint": pa.int64(), "string": pa.string()}[kind]) for n, kind in (x.split() for x in RECORDED.split(", "))), strict=True)
    dealt = _events(events, *_KEPT).drop("at").repartition("ride_id")
    return dealt.sortWithinPartitions("ride_id", "at_us", F.col("seq").asc_nulls_last()).mapInArrow(run, RECORDED)


class _Recorder(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ride", ", ".join(f"{k} {v}" for k, v in _STATE.items()))

    def _load(self) -> Recording:
        return Recording(*map(_plain, self.state.get())) if self.state.exists() else Recording()

    def _store(self, ride: Recording) -> None:
        self.state.update(astuple(ride))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if ride.due_us() is not None:
            self.handle.registerTimer(-(-ride.due_us() // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ride = self._load()
        out = _take_all(ride, pd.concat(list(rows)))
        self._store(ride)
        yield _frame(key[0], out, RECORDED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ride = self._load()
        out = ride.tick(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._store(ride)
        yield _frame(key[0], out, RECORDED)

    def close(self) -> None:
        pass


def record(events: DataFrame, delay: str) -> DataFrame:
    """``recorded`` on a stream of ``EVENTS``; the watermark, ``delay`` behind the newest event, is the clock (STM-01, STM-02, STM-13).

    Events of a ride that arrive in one batch are taken in their order; one that arrives after later ones goes back in
    time and is dropped, as the recorder drops it.
    """
    rows = _events(events, *_KEPT).withWatermark("at", delay)
    return rows.groupBy("ride_id").transformWithStateInPandas(_Recorder(), RECORDED, "append", "EventTime")


@dataclass
class Match:
    segment: int
    away: float
    along: float


class Line:
    """A planned line that positions are laid on (JOIN-12, JOIN-23)."""

    def __init__(self, lat: list[float], lon: list[float]):
        self.lat, self.lon = np.asarray(lat, float), np.asarray(lon, float)
        steps = self._metres(self.lat[:-1], self.lon[:-1], self.lat[1:], self.lon[1:])
        self.along = np.concatenate([[0.0], np.cumsum(steps)]) if len(self.lat) else np.zeros(0)
        self.loop = len(self.lat) > 1 and metres(self.lat[0], self.lon[0], self.lat[-1], self.lon[-1]) <= LOOP_ENDS_M

    @staticmethod
    def _metres(lat1, lon1, lat2, lon2):
        a, b = np.radians(lat1), np.radians(lat2)
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
        return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))

    def search(self, lat: float, lon: float, begin: int, end: int, last_along: float) -> Match:
        """The best of the segments ``begin`` to ``end``: near, and not far along the line from the last match."""
        a_lat, a_lon = self.lat[begin:end], self.lon[begin:end]
        kx = np.cos(np.radians(a_lat))
        bx, by = (self.lon[begin + 1 : end + 1] - a_lon) * kx, self.lat[begin + 1 : end + 1] - a_lat
        px, py = (lon - a_lon) * kx, lat - a_lat
        square = bx * bx + by * by
        t = np.clip(np.divide(px * bx + py * by, square, out=np.zeros_like(square), where=square > 0), 0.0, 1.0)
        away = self._metres(lat, lon, a_lat + by * t, a_lon + (self.lon[begin + 1 : end + 1] - a_lon) * t)
        along = self.along[begin:end] + (self.along[begin + 1 : end + 1] - self.along[begin:end]) * t
        i = int(np.argmin(away + JUMP_WEIGHT * np.abs(along - last_along)))
        return Match(begin + i, float(away[i]), float(along[i]))

    def snap(self, lat: float, lon: float, last: int, stray_m: float) -> Match:
        """Within a window around the last matched segment; on the whole line only if that is stray."""
        if len(self.lat) == 1:
            return Match(0, metres(lat, lon, self.lat[0], self.lon[0]), 0.0)
        segments, along = len(self.lat) - 1, float(self.along[last])
        best = self.search(lat, lon, max(0, last - WINDOW_BEHIND), min(segments, last + WINDOW_AHEAD + 1), along)
        if best.away > stray_m:
            other = self.search(lat, lon, 0, segments, along)
            best = other if other.away < best.away else best
        return best

    def way_back(self, lat: float, lon: float, along: float) -> tuple[float, float]:
        """(metres to, metres along) of the nearest point ahead, on a loop of any point, past the end of the end."""
        away = self._metres(lat, lon, self.lat, self.lon)
        if not self.loop:
            away = np.where(self.along < along - AHEAD_SLACK_M, np.inf, away)
        i = int(np.argmin(away)) if np.isfinite(away).any() else len(self.lat) - 1
        return metres(lat, lon, self.lat[i], self.lon[i]), float(self.along[i])


def accuracy_used(accuracy: float | None) -> float:
    return min(accuracy, ACCURACY_CAP_M) if _given(accuracy) and isfinite(accuracy) and accuracy > 0 else 0.0


@dataclass
class Guard:
    """The state of one ride on a planned route: on it, guided back, or on a detour (STM-06)."""

    state: str = "on"
    segment: int = 0
    along: float = 0.0
    strays: int = 0
    stray_us: int | None = None
    off_us: int | None = None
    left_lat: float | None = None
    left_lon: float | None = None
    travel: float = 0.0
    on_lat: float | None = None
    on_lon: float | None = None
    spoken: float | None = None
    detour_us: int | None = None
    detour_lat: float | None = None
    detour_lon: float | None = None
    target: float | None = None

    def _cleared(self) -> None:
        kept = self.segment, self.along, self.on_lat, self.on_lon
        self.__init__()
        self.segment, self.along, self.on_lat, self.on_lon = kept

    def detour(self, at_us: int, lat: float | None, lon: float | None, target: float | None) -> None:
        """A way back that meets the plan at ``target`` metres is followed from here on."""
        self.state, self.detour_us, self.detour_lat, self.detour_lon, self.target = "detour", at_us, lat, lon, target

    def fix(self, line: Line, at_us: int, lat: float, lon: float, accuracy: float | None, mode: str, drift: float | None) -> tuple:
        used = accuracy_used(accuracy)
        stray = max(OFF_ROUTE_M, 2 * used)
        match = line.snap(lat, lon, self.segment, stray)
        self.segment = match.segment
        if match.away <= stray and self.state == "on":
            self.along = match.along
        guide, speak, plan, restored = self._decided(line, match, at_us, lat, lon, used, mode, drift)
        tenth = lambda v: None if v is None else int(v * 10 + 0.5)
        return at_us, self.state, tenth(match.away), tenth(match.along), tenth(guide), speak, plan, restored

    def _decided(self, line: Line, match: Match, at_us: int, lat: float, lon: float, used: float, mode: str, drift: float | None) -> tuple[float | None, bool, bool, bool]:
        if self.state != "on":
            self.travel = max(self.travel, metres(self.left_lat, self.left_lon, lat, lon)) if _given(self.left_lat) else self.travel
        else:
            if match.away <= max(OFF_ROUTE_M, 2 * used):
                self.strays, self.stray_us, self.on_lat, self.on_lon = 0, None, lat, lon
                return None, False, False, False
            self.strays += 1
            self.stray_us = at_us if self.stray_us is None else self.stray_us
            if self.strays < OFF_ROUTE_FIXES and at_us - self.stray_us < OFF_ROUTE_AFTER * SECOND:
                return None, False, False, False
            self.state, self.off_us, self.spoken, self.detour_us = "guiding", at_us, None, None
            self.left_lat, self.left_lon = (self.on_lat, self.on_lon) if _given(self.on_lat) else (lat, lon)
            self.travel = metres(self.left_lat, self.left_lon, lat, lon)
        if match.away <= max(SNAP_M, used):
            self._cleared()
            self.along, self.on_lat, self.on_lon = match.along, lat, lon
            return None, False, False, True
        if self.state == "detour":
            stale = self.detour_us is None or at_us - self.detour_us >= RECOMPUTE_GAP * SECOND
            adrift = _given(drift) and drift > max(DRIFT_M, 2 * used)
            moved = not _given(self.detour_lat) or metres(self.detour_lat, self.detour_lon, lat, lon) >= RECOMPUTE_MOVED_M
            passed = _given(self.target) and match.along >= self.target - PASSED_SLACK_M
            return None, False, mode == "guide" and stale and moved and (adrift or passed), False
        guide, _ = line.way_back(lat, lon, self.along)
        due = self.spoken is None or guide >= self.spoken + REPEAT_M
        self.spoken = guide if due else self.spoken
        off = (at_us - self.off_us) / SECOND
        wants = off >= DETOUR_MIN and (off >= DETOUR_AFTER or self.travel >= DETOUR_AFTER_M)
        return guide, due, mode != "off" and wants, False


_GUARD = {
    "state": "string", "segment": "bigint", "along": "double", "strays": "bigint", "stray_us": "bigint", "off_us": "bigint", "left_lat": "double", "left_lon": "double", "travel": "double",
    "on_lat": "double", "on_lon": "double", "spoken": "double", "detour_us": "bigint", "detour_lat": "double", "detour_lon": "double", "target": "double",
}
assert list(_GUARD) == [f.name for f in fields(Guard)]
_FIX = ("seq", "what", "lat", "lon", "accuracy", "mode", "drift", "target")


def _follow_all(guard: Guard, line: Line, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for at_us, what, lat, lon, accuracy, mode, drift, target in _in_order(rows)[["at_us", *_FIX[1:]]].itertuples(index=False, name=None):
        lat, lon, accuracy, drift, target = map(_plain, (lat, lon, accuracy, drift, target))
        if what == "detour":
            guard.detour(int(at_us), lat, lon, target)
        elif what == "fix" and _given(lat) and _given(lon) and len(line.lat):
            out.append(guard.fix(line, int(at_us), lat, lon, accuracy, mode, drift))
    return out


def followed(events: DataFrame, routes: DataFrame) -> DataFrame:
    """What the guard decides at each fix of a whole table, given ``routes (ride_id, lats, lons)``; rides without a route have no rows.

    Events are fixes (with accuracy, mode ``off``, ``guide`` or ``new``, and ``drift``, the metres from a way back in use)
    and ``detour`` rows: a way back that meets the plan ``target`` metres along was begun.
    """

    def run(key: tuple, rows: pd.DataFrame, route: pd.DataFrame) -> pd.DataFrame:
        found = _follow_all(Guard(), Line(route.lats.iloc[0], route.lons.iloc[0]), rows) if len(rows) and len(route) else []
        return _frame(key[0], found, FOLLOWED)

    return _events(events, *_FIX).groupBy("ride_id").cogroup(routes.select("ride_id", "lats", "lons").groupBy("ride_id")).applyInPandas(run, FOLLOWED)


class _Follower(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.guard = handle.getValueState("guard", ", ".join(f"{k} {v}" for k, v in _GUARD.items()))
        self.route = handle.getValueState("route", "lats array<double>, lons array<double>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.route.update((list(map(float, initialState.lats.iloc[0])), list(map(float, initialState.lons.iloc[0]))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        if self.route.exists():
            guard = Guard(*map(_plain, self.guard.get())) if self.guard.exists() else Guard()
            found = _follow_all(guard, Line(*self.route.get()), pd.concat(list(rows)))
            self.guard.update(astuple(guard))
        yield _frame(key[0], found, FOLLOWED)

    def close(self) -> None:
        pass


def follow(events: DataFrame, routes: DataFrame) -> DataFrame:
    """``followed`` on a stream of fixes; ``routes`` is a table that the state begins with (STM-06, JOIN-23)."""
    begun = routes.select("ride_id", "lats", "lons").groupBy("ride_id")
    return _events(events, *_FIX).groupBy("ride_id").transformWithStateInPandas(_Follower(), FOLLOWED, "append", "None", initialState=begun)
