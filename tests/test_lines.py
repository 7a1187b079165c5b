"""Corridors, simplification, chains and climbs against plain loops and scenes worked out by hand."""

import math
import random

import pytest

from pyspark.sql import functions as F

from trailframe.operators import climbs, lines
from trailframe.sources import shared

R = 6371008.8
M = 180 / math.pi / R  # degrees of a metre along a meridian


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def placed(points, stop, corridor):
    """The first contiguous stretch beside the stop: (at, off), or None."""
    best = at = None
    along = 0.0
    for (a, b), (c, d) in zip(points, points[1:], strict=False):
        length = int(haversine(a, b, c, d) * 1000 + 0.5) / 1000
        kx = math.cos(math.radians(a))
        bx, by, px, py = (d - b) * kx, c - a, (stop[1] - b) * kx, stop[0] - a
        sq = bx * bx + by * by
        t = max(0.0, min(1.0, (px * bx + py * by) / sq)) if sq else 0.0
        off = haversine(*stop, a + by * t, b + (d - b) * t)
        if int(off * 1000 + 0.5) > corridor * 1000:
            if best is not None:
                break
        elif best is None or off < best:
            best, at = off, along + length * t
        along += length
    return None if best is None else (at, best)


def frame(spark, tracks):
    rows = [(k, i, float(y), float(x)) for k, points in tracks.items() for i, (y, x) in enumerate(points)]
    return spark.createDataFrame(rows, "line_id long, seq int, lat double, lon double")


@pytest.mark.parametrize("lat0", [0.0, 47.0, -78.0])
def test_stops_beside_lines(spark, lat0):
    draw = random.Random(int(lat0) + 100)
    tracks = {}
    for k in range(5):
        y, x, points = lat0, 8.0, []
        for _ in range(40):
            y, x = y + draw.uniform(-1, 1) * 400 * M * draw.choice((1, 1, 10)), x + draw.uniform(-1, 1) * 900 * M * draw.choice((1, 1, 10))
            points += [(y, x)] * draw.choice((1, 1, 1, 2))
        tracks[k] = points
    tracks[9] = [(lat0, 8.0)]
    stops = [(i, lat0 + draw.uniform(-1, 1) * 5000 * M, 8 + draw.uniform(-1, 1) * 9000 * M) for i in range(150)]
    found = lines.stops_along(frame(spark, tracks), spark.createDataFrame([*stops, (999, None, 8.0)], "stop_id long, lat double, lon double"))
    got = {(r.line_id, r.stop_id): (r.at_dm, r.off_mm) for r in found.collect()}
    want = {(k, i): p for k, points in tracks.items() for i, y, x in stops if len(points) > 1 and (p := placed(points, (y, x), 300))}
    assert set(got) == set(want) and len(want) > 20
    for key, (at, off) in want.items():
        assert got[key] == pytest.approx((at * 10, off * 1000), abs=2)


def test_only_the_road_ahead(spark):
    # out for 2 km and back: a stop beside the way is placed where the line comes back to it
    out = [(i * 100 * M, 0.0) for i in range(21)]
    df = frame(spark, {1: out + out[-2::-1], 2: out})
    stops = spark.createDataFrame([(7, 500 * M, 50 * M)], "stop_id long, lat double, lon double")
    ahead = spark.createDataFrame([(1, 1_000_000, 4_000_000)], "line_id long, from_mm long, to_mm long")
    assert [(r.line_id, r.at_dm) for r in lines.stops_along(df, stops, 300.0, ahead).collect()] == [(1, 35000)]
    assert sorted((r.line_id, r.at_dm) for r in lines.stops_along(df, stops).collect()) == [(1, 5000), (2, 5000)]


def test_cells_of_a_long_segment_grow_with_its_length(spark):
    df = lines.segments(frame(spark, {1: [(0.0, 0.0), (1.0, 1.0)]}))
    assert lines.on_cells(df, 1000.0).count() < 12 * 111


def kept(points, tolerance):
    scale = math.cos(math.radians(points[0][0]))
    xy = [(math.floor(x * 1e6 + 0.5) * scale, math.floor(y * 1e6 + 0.5)) for y, x in points]
    marked = {0, len(points) - 1}

    def split(a, b):
        worst, at = -1.0, None
        dx, dy = xy[b][0] - xy[a][0], xy[b][1] - xy[a][1]
        sq = dx * dx + dy * dy
        for i in range(a + 1, b):
            px, py = xy[i][0] - xy[a][0], xy[i][1] - xy[a][1]
            t = max(0.0, min(1.0, (px * dx + py * dy) / sq)) if sq else 0.0
            away = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if away > worst:
                worst, at = away, i
        if worst > tolerance * tolerance:
            marked.add(at)
            split(a, at)
            split(at, b)

    split(0, len(points) - 1)
    return marked


def test_simplified_lines(spark):
    draw = random.Random(5)
    tracks = {
        1: [(47 + math.sin(i / 30) * 0.01, 8 + i * 1e-4) for i in range(400)], 2: [(47.0, 8 + i * 1e-4) for i in range(50)], 3: [(47.0, 8.0)], 4: [(47.0, 8.0), (47.1, 8.0)],
        5: [(47 + draw.uniform(0, 0.01), 8 + draw.uniform(0, 0.01)) for _ in range(80)], 6: [(47.0, 8.0), (47.01, 8.0), (47.0, 8.0)], 7: [(47.0, 8.0)] * 5,
    }
    df = frame(spark, tracks)
    for tolerance in (0, 300.0, 2000.0):
        got = {}
        for r in lines.simplified(df, tolerance).collect():
            got.setdefault(r.line_id, set()).add(r.seq)
        assert got == {k: kept(p, tolerance) if tolerance else set(range(len(p))) for k, p in tracks.items()}
    assert lines.simplified(df.limit(0), 10.0).count() == 0


def chains(pieces):
    ends, starts = {}, {}
    for i, attrs, start, end, _ in pieces:
        if attrs is not None and end is not None:
            ends.setdefault((attrs, end), []).append(i)
        if attrs is not None and start is not None:
            starts.setdefault((attrs, start), []).append(i)
    then = {e[0]: starts[k][0] for k, e in ends.items() if len(e) == 1 and len(starts.get(k, ())) == 1 and starts[k][0] != e[0]}
    weight, out, done = {p[0]: p[4] or 0 for p in pieces}, set(), set()
    for head in [*sorted(set(weight) - set(then.values())), *sorted(weight)]:
        at, place, before = head, 0, 0
        while at is not None and at not in done:
            done.add(at)
            out.add((head, place, at, before))
            at, place, before = then.get(at), place + 1, before + weight[at]
    return out


def test_chains_rings_and_forks(spark, monkeypatch):
    draw = random.Random(1)
    pieces = [(i, "a", i, i + 1, i % 5) for i in range(10_000)]  # one long chain
    names = list(range(20_000, 20_030))
    draw.shuffle(names)
    pieces += [(n, "a", 50_000 + i, 50_000 + (i + 1) % 30, 2) for i, n in enumerate(names)]  # a ring in any order
    pieces += [(30_001, "b", 1, 2, 1), (30_002, "b", 2, 3, 1), (30_003, "b", 2, 4, None), (30_004, "b", 9, 9, 1), (30_005, None, 3, 5, 1), (30_006, "b", 3, None, 1), (30_007, "a", 3, 70_000, 1)]
    pieces += [(40_000, "c", 1, 2, 1), (40_001, "c", 2, 1, 1), (39_999, "c", 8, 7, 1), (39_998, "c", 7, 6, 1)]
    draw.shuffle(pieces)
    asked = []
    plain = shared.Rounds.next
    monkeypatch.setattr(shared.Rounds, "next", lambda self, df: asked.append(self.name) or plain(self, df))
    found = {tuple(r) for r in lines.chained(spark.createDataFrame(pieces, "piece_id long, attrs string, start long, end long, weight long").repartition(4)).collect()}
    assert found == chains(pieces)
    assert 14 <= asked.count("ranks") <= 26  # 14 doublings of the chain, then those of the rings


def test_finished_pieces_of_chains_are_written_once(spark, monkeypatch):
    pieces = [(i, "a", i, i + 1, 1) for i in range(64)] + [(1000 + i, "b", 2 * i, 2 * i + 1, 1) for i in range(500)]
    rows = []
    plain = shared.Rounds.next

    def counted(self, df):
        found = plain(self, df)
        if self.name == "ranks":
            rows.append(found.count())
        return found

    monkeypatch.setattr(shared.Rounds, "next", counted)
    found = {tuple(r) for r in lines.chained(spark.createDataFrame(pieces, "piece_id long, attrs string, start long, end long, weight long")).collect()}
    assert found == chains(pieces)
    assert rows == [564, 63, 62, 60, 56, 48, 32]  # the one chain halves; the 500 pieces are not written again


def hill(spark, profile, track=1, seconds=10, hr=None, ridden=True):
    """Legs of a track through (metres along, height), a fix every ``seconds``."""
    rows = []
    for i, (d, h) in enumerate(profile):
        d0, h0 = profile[i - 1] if i else (None, None)
        rows.append((track, i * seconds * 10**6, i, h, h0, None if d0 is None else (d - d0) * 10, seconds * 10**6, ridden and i > 0, ridden and i > 0, hr and hr + i, None))
    return spark.createDataFrame(rows, "track_id long, ts_us long, event_id long, ele int, ele0 int, dm long, dur_us long, ridden boolean, moving boolean, hr int, pwr int")


def road(*parts):
    """Heights each 50 m of road: (metres, height gained) one after the other."""
    out, d, h = [(0, 100)], 0, 100.0
    for metres, gain in parts:
        for _ in range(metres // 50):
            d, h = d + 50, h + gain * 50 / metres
            out.append((d, round(h)))
    return out


def listed(spark, *parts, **more):
    return [(r.climb, r.start_dm // 10, r.length_dm // 10, r.ascent_m) for r in climbs.climbs(hill(spark, road(*parts), **more)).orderBy("climb").collect()]


def test_climbs_by_hand(spark):
    assert listed(spark, (1000, 0), (1000, 50), (1000, 0)) == [(1, 1000, 1000, 50)]  # half a window of 5 % is too flat
    assert listed(spark, (500, 25), (100, -9), (500, 30), (500, 0)) == [(1, 0, 1100, 46)]  # a dip of 9 m does not cut
    assert [x[0] for x in listed(spark, (500, 25), (200, -20), (500, 30), (500, -30))] == [1, 2]  # one of 20 m does
    assert listed(spark, (250, 25), (1000, -25)) == []  # too short
    assert listed(spark, (400, 14), (1000, -25)) == []  # too low
    assert listed(spark, (200, 15), (2000, 0), (200, 15), (500, -40)) == []  # two bumps with a long flat between average too little
    assert listed(spark, (1000, 10), (1000, -10)) == []  # never steep
    assert listed(spark, (1000, 50), ridden=False) == []
    assert climbs.climbs(hill(spark, road((100, 0))).limit(0)).count() == 0


def test_figures_of_a_climb(spark):
    (r,) = climbs.climbs(hill(spark, road((500, 0), (300, 12), (200, 20), (300, -30)), hr=100)).collect()
    # foot at 500 m (fix 10), top at 1000 m (fix 20): 10 legs of 10 s, heart rates 110 to 119; the steepest 100 m rise by 10 m
    assert (r.start_dm, r.length_dm, r.ascent_m, r.grade_pm, r.moving_us, r.avg_hr, r.avg_power) == (5000, 5000, 32, 100, 100 * 10**6, 115, None)


def test_biggest_in_riding_order(spark):
    rows = spark.createDataFrame([(1, 1, 0, 30), (1, 2, 100, 50), (1, 3, 200, 40), (1, 4, 300, 50), (2, 1, 0, 5)], "track_id long, climb int, start_dm long, ascent_m int")
    got = [(r.track_id, r.nth, r.climb, r["rank"]) for r in climbs.biggest(rows, 2).orderBy("track_id", "nth").collect()]
    assert got == [(1, 1, 2, 1), (1, 2, 4, 2), (2, 1, 1, 1)]


def test_splits_by_hand(spark):
    from trailframe.operators import tracks

    # legs of 600 m and 100 s; the third is a break of 50 m; the ride ends 5 m past its third kilometre
    rows = [(0, None, None, 100), (1, 6000, True, 102), (2, 6000, True, 104), (3, 500, False, 150), (4, 6000, True, 149), (5, 6000, True, 140), (6, 6050, True, None)]
    data = [(1, i * 100 * 10**6, i, dm, 100 * 10**6, bool(ridden), bool(ridden) and i != 2, h) for i, dm, ridden, h in rows]
    df = spark.createDataFrame(data, "track_id long, ts_us long, event_id long, dm long, dur_us long, ridden boolean, moving boolean, ele int")
    got = [tuple(r)[1:] for r in tracks.whole_splits(df, 10_000).orderBy("split").collect()]
    # the second leg does not move, so that only the share of the others counts; 4 m up at 1.2 km, 10 m down at 2.4 km
    assert got == [(0, 10000, 100_000_000, 0.0, 0.0, False), (1, 10000, 100 * 10**6 + 33_333_333, 4.0, 0.0, False), (2, 10050, 66_666_667 + 99_173_554 + 826_446, 0.0, 10.0, False)]


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    """Files that compress well look small to Spark; a broadcast of them takes the driver's memory."""
    from trailframe.operators import lines, readings
    from trailframe.sources import shared

    plans, plain = [], shared.Rounds.next
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(shared.Rounds, "next", lambda self, df: (plan(df), plain(self, df))[1])
    at = lambda n, *more: spark.range(n).selectExpr("id % 3 AS line_id", "id AS seq", "32 + id / 1e4 AS lat", "16 + id / 1e4 AS lon", *more)
    points = at(60)
    stops = spark.createDataFrame([(1, 32.001, 16.001), (2, 32.001, 16.001), (3, 40.0, 16.0)], "stop_id long, lat double, lon double")
    along = lines.stops_along(points, stops)
    assert sorted((r.line_id, r.stop_id) for r in along.collect()) == [(line, stop) for line in (0, 1, 2) for stop in (1, 2)]  # two stops at one position
    plan(along)
    plan(lines.slices(points, spark.createDataFrame([(1, 0, 0, 5000)], "span_id long, line_id long, from_mm long, to_mm long")))
    route = points.select(F.col("line_id").alias("route_id"), "lat", "lon")
    far = readings.worst_offset(route.withColumn("waypoint", F.monotonically_increasing_id()).withColumn("lat", F.col("lat") + 0.01), route)
    assert far.count() == 3
    plan(far)
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def sliced(points, a, b):
    """The pieces of a line between two distances, as (lat, lon, lat2, lon2)."""
    out, along = [], 0
    ways = [(p, q, int(haversine(*p, *q) * 1000 + 0.5)) for p, q in zip(points, points[1:], strict=False)]
    a, b = max(a, 0), min(b, sum(mm for *_, mm in ways))
    for p, q, mm in ways:
        if a < b and along < b and along + mm > a:
            s, t = (max((a - along) / mm, 0), min((b - along) / mm, 1)) if mm else (0, 1)
            out.append((p[0] + (q[0] - p[0]) * s, p[1] + (q[1] - p[1]) * s, p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
        along += mm
    return out


def test_slices_of_lines_that_stand_still(spark):
    # points that lie on one another, at the ends and between, and lines of one point and of one place
    draw = random.Random(5)
    tracks = {line: [p for p in ((47 + draw.random() / 100, 8 + draw.random() / 100) for _ in range(12)) for _ in range(draw.choice((1, 1, 2, 3)))] for line in range(4)}
    tracks |= {4: [(47.0, 8.0)], 5: [(47.0, 8.0)] * 3, 6: [(47.0, 8.0)] * 2 + [(47.01, 8.0)] * 2}
    length = int(haversine(47.0, 8.0, 47.01, 8.0) * 1000 + 0.5)
    spans = [(i, draw.randrange(8), a := draw.randrange(-500_000, 12_000_000), a + draw.randrange(-1000, 9_000_000)) for i in range(200)]
    spans += [(200, 6, 0, length), (201, 6, 0, length + 1), (202, 6, -5, 1), (203, 6, length, length + 9), (204, 6, length - 1, length), (205, None, 0, 9), (206, 6, None, 9)]
    asked = spark.createDataFrame(spans, "span_id long, line_id long, from_mm long, to_mm long")
    want = {i: found for i, line, a, b in spans if line in tracks and a is not None and (found := sliced(tracks[line], a, b))}
    got = {}
    for r in lines.slices(frame(spark, tracks), asked).orderBy("span_id", "piece").collect():
        assert r.piece == len(got.setdefault(r.span_id, []))
        got[r.span_id].append((r.lat, r.lon, r.lat2, r.lon2))
    assert got.keys() == want.keys() and len(got) > 40
    assert all(len(got[i]) == len(want[i]) and all(v == pytest.approx(w, abs=1e-9) for v, w in zip(got[i], want[i], strict=True)) for i in want)
    ends = {r.span_id: (r.pieces, r.lat, r.lon, r.lat2, r.lon2) for r in lines.slice_ends(frame(spark, tracks), asked).collect()}
    assert ends == {i: (len(v), *v[0][:2], *v[-1][2:]) for i, v in got.items()}


def test_stretches_of_segments_meet_the_stops(spark, monkeypatch):
    """Only different cells of stretches are dealt out by their cells, not each cell of every segment."""
    draw = random.Random(8)
    tracks = {line: [(46.99 + draw.random() / 50, 7.99 + draw.random() / 50) for _ in range(n)] for line, n in ((1, 150), (2, 1), (3, 2), (4, 40))}
    tracks[4] = [p for p in tracks[4] for _ in range(3)]
    stops = [(i, 46.98 + draw.random() / 25, 7.98 + draw.random() / 25) for i in range(40)]
    want = {(line, i): found for line, points in tracks.items() for i, *stop in stops if (found := placed(points, tuple(stop), 300.0))}
    asked = spark.createDataFrame(stops, "stop_id long, lat double, lon double")
    for together, cells in ((lines.TOGETHER, lines.CELLS), (1, 1), (7, 3)):
        monkeypatch.setattr(lines, "TOGETHER", together)
        monkeypatch.setattr(lines, "CELLS", cells)
        df = lines.stops_along(frame(spark, tracks), asked)
        got = {(r.line_id, r.stop_id): (r.at_dm, r.off_mm) for r in df.collect()}
        assert got.keys() == want.keys() and len(got) > 20
        assert all(abs(got[k][1] - want[k][1] * 1000) <= 1 and abs(got[k][0] - want[k][0] * 10) <= 1 for k in want)
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [k for k, line in enumerate(plan) if "Exchange hashpartitioning(cy" in line]
    assert dealt and not any("lat2" in plan[k + 1] for k in dealt)
