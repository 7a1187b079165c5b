"""Merged extracts, dense numbers, components and radar patches by hand and against plain loops."""

import random

from pyspark.sql import functions as F

from trailframe.operators import extracts, radar
from trailframe.operators.components import components, numbered


def test_dense_numbers(spark):
    rows = [(i * 7 % 101, str(i)) for i in range(100)]
    found = numbered(spark.createDataFrame(rows, "k long, v string").repartition(5), F.desc("k"), first=10, name="n").collect()
    assert [(r.n, r.k, r.v) for r in sorted(found, key=lambda r: r.n)] == [(10 + i, *x) for i, x in enumerate(sorted(rows, reverse=True))]
    assert numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(200)] + [(1500, i) for i in range(1501, 1600)]
    nodes = {n for e in edges for n in e} | {5000}
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    found = components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == label


def plain(cells):
    cls, out, seen = {c[:3]: c[3] for c in cells}, {}, set()
    for start in cls:
        if start in seen or cls[start] in (0, 255, None):
            continue
        patch, todo = [], [start]
        seen.add(start)
        while todo:
            f, y, x = todo.pop()
            patch.append((f, y, x))
            for n in ((f, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if n not in seen and cls.get(n) not in (0, 255, None):
                    seen.add(n)
                    todo.append(n)
        if len(patch) < 4 or sum(cls[p] >= 7 for p in patch) > 0.5 * len(patch):
            out.update(dict.fromkeys(patch, 0))
    return {k: out.get(k, v) for k, v in cls.items()}


def cleared(spark, cells):
    df = spark.createDataFrame(cells, "frame int, row int, col int, cls int").repartition(3)
    return {(r.frame, r.row, r.col): r.cls for r in radar.without_clutter(df).collect()}


def picture(frame, *rows):
    """A frame drawn in letters: dots are dry, digits are classes, n is no data."""
    return [(frame, y, x, {".": 0, "n": 255}.get(c, int(c, 16) if c not in ".n" else 0)) for y, row in enumerate(rows) for x, c in enumerate(row)]


def test_patches_by_hand(spark):
    speck, corner, spoke, half, border = (
        picture(1, "11...", ".1..."), picture(2, "1....", ".1...", "..1..", "...1."), picture(3, "9992.", "....."), picture(4, "9921.", "....."), picture(5, "11n11", "nnnnn"),
    )
    got = cleared(spark, speck + corner + spoke + half + border)
    gone = {f: sorted(k[1:] for k in got if k[0] == f and got[k] == 0) for f in range(1, 6)}
    assert {k[0] for k, v in got.items() if v not in (0, 255)} == {2, 4}
    assert gone[5] == [(0, 0), (0, 1), (0, 3), (0, 4)]  # two patches of two; no data parts them and stays
    assert got[5, 1, 0] == 255 and got[4, 0, 0] == 9


def test_patches_of_any_shape(spark):
    draw = random.Random(8)
    cells = [(f, y, x, draw.choice((0, 0, 0, 1, 2, 8, 9, 255))) for f in range(2) for y in range(25) for x in range(90)]
    cells += [(7, 0, x, 1) for x in range(200)] + [(7, 1, x, 1) for x in range(0, 200, 3)] + [(7, y, 40, 1) for y in range(2, 30)]  # a comb longer than a block
    cells += [(8, 0, 31, 1), (8, 1, 32, 1), (8, 2, 31, 1), (8, 3, 32, 1), (9, 5, 5, None)]  # a zigzag over the border of two blocks
    assert cleared(spark, cells) == plain(cells)


ROW = "input int, tab int, id long, name string, kind string, ref long, lat_e7 long, lon_e7 long, osm_type string, osm_id long, importance int"


def extract_rows():
    return [
        (0, 0, 1, "Town", "town", None, 0, 0, "n", 10, 3), (0, 0, 2, "Hill", "village", 1, 0, 0, "n", 11, None), (1, 0, 1, "Other", "village", None, 0, 0, "n", 99, 1), (1, 0, 7, "Town again", "city", 1, 0, 0, "n", 10, 8),
        (0, 1, 3, "Main", "street", 1, 10_000, 20_000, None, None, None), (1, 1, 8, "Main", "street", 7, 10_100, 20_000, None, None, None),  # not the same place: its name differs
        (1, 1, 9, "Lane", "street", 1, 15_000, 0, None, None, None), (1, 1, 10, "Lane", "street", 1, 24_999, 0, None, None, None), (1, 1, 11, "Lane", "street", None, 20_000, 0, None, None, None),
        (0, 2, 4, "Tap", "water", 1, 0, 0, "w", 5, 2), (1, 2, 20, "Tap", "water", 7, 0, 0, "w", 5, 1), (1, 2, 21, "Tap", "toilets", 77, 0, 0, "w", 5, 1), (1, 2, 22, "Tap", "water", None, 0, 0, None, 5, 1),
    ]


def test_merged_rows_by_hand(spark):
    rows, remap = extracts.merged(spark.createDataFrame(extract_rows(), ROW).repartition(4))
    got = {r.new_id: (r.tab, r.name, r.ref, r.importance) for r in rows.collect()}
    assert got == {
        1: (0, "Town", None, 8), 2: (0, "Hill", 1, None), 3: (0, "Other", None, 1), 4: (1, "Main", 1, None), 5: (1, "Main", 1, None),
        6: (1, "Lane", 3, None), 7: (1, "Lane", None, None), 8: (2, "Tap", 1, 2), 9: (2, "Tap", None, 1), 10: (2, "Tap", None, 1),
    }
    new = {(r.input, r.id): r.new_id for r in remap.collect()}
    assert new[1, 7] == 1 and new[1, 10] == new[1, 9] == 6 and new[1, 20] == 8 and len(new) == len(extract_rows())
    aliases = spark.createDataFrame([(0, 1, "A"), (1, 7, "A"), (1, 7, "B"), (1, 999, "C"), (0, 2, "A")], "input int, ref long, name string")
    found = extracts.merged_aliases(aliases, remap, 11).collect()
    assert sorted((r.id, r.ref, r.name) for r in found) == [(11, 1, "A"), (12, 2, "A"), (13, 1, "B")]
    numbers = spark.createDataFrame([(1, 9, 1, 5, 5), (1, 10, 3, 6, 6), (1, 10, 1, 7, 7), (0, 3, 2, 1, 1), (1, 999, 2, 1, 1)], "input int, street_id long, number int, lat_e7 long, lon_e7 long")
    got = {(r.street_id, r.number): (r.lat_e7, r.lon_e7, r.union) for r in extracts.merged_numbers(numbers, remap).collect()}
    assert got == {(6, 1): (5, 5, False), (6, 3): (6, 6, False), (4, 2): (1, 1, False)}


def test_numbers_of_two_inputs(spark):
    rows = [(i, 0, 1, "Town", "town", None, 0, 0, "n", 10, 3) for i in (0, 1)] + [(i, 1, 2, "Main", "street", 1, 0, 0, None, None, None) for i in (0, 1)]
    _, remap = extracts.merged(spark.createDataFrame(rows, ROW))
    numbers = spark.createDataFrame([(0, 2, 1, 5, 5), (1, 2, 1, 6, 6), (1, 2, 2, 7, 7)], "input int, street_id long, number int, lat_e7 long, lon_e7 long")
    assert {(r.number, r.lat_e7, r.union) for r in extracts.merged_numbers(numbers, remap).collect()} == {(1, 5, True), (2, 7, True)}
    assert extracts.merged(spark.createDataFrame([], ROW))[0].count() == 0
