"""Edit distance, word scores, rings, calories and display units as Column expressions; folds of higher-order functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import allowed_edits

#: Coverage that a source of calories needs, the heart-rate lines (constant, weight, age, beat) and units.
COVERAGE = 0.9
BEAT_LINES = {"male": (-55.0969, 0.1988, 0.2017, 0.6309), "female": (-20.4022, -0.1263, 0.074, 0.4472)}
KJ_PER_KCAL = 4.184
M_PER_FOOT = 0.3048
M_PER_MILE = 1609.344


def _at(text: Column, i: Column) -> Column:
    return F.substr(text, i, F.lit(1))


def edit_distance(a: Column, b: Column, most: int | Column) -> Column:
    """Edits from one word to the other, neighbours swapped at most once, and ``most`` + 1 for any more than ``most`` (STR-05).

    Null if either is null. Each row of the table is folded over the letters; ``levenshtein``, which never is below it by more than
    half, should sort out far pairs first.
    """
    most = F.lit(most) if isinstance(most, int) else most
    n, m = F.length(a), F.length(b)

    def row(state: Column, i: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            swapped = (i > 1) & (j > 1) & (_at(a, i) == _at(b, j - 1)) & (_at(a, i - 1) == _at(b, j))
            cost = F.when(_at(a, i) == _at(b, j), 0).otherwise(1)
            best = F.least(F.get(done, j - 1) + 1, F.get(state["prev"], j) + 1, F.get(state["prev"], j - 1) + cost, F.when(swapped, F.get(state["before"], j - 2) + 1))
            return F.concat(done, F.array(best))

        return F.struct(state["prev"].alias("before"), F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell).alias("prev"))

    first = F.sequence(F.lit(0), m)
    full = F.aggregate(F.sequence(F.lit(1), n), F.struct(first.alias("before"), first.alias("prev")), row, lambda s: F.get(s["prev"], m))
    return F.when(a == b, 0).when(F.abs(n - m) > most, most + 1).when(n == 0, m).when(m == 0, n).when(a.isNotNull() & b.isNotNull(), F.least(full, most + 1))


def in_order(short: Column, long: Column) -> Column:
    """Whether all letters of the short word are in the long one, in order."""
    met = F.aggregate(F.sequence(F.lit(1), F.length(long)), F.lit(0), lambda k, i: k + F.when(_at(long, i) == _at(short, k + 1), 1).otherwise(0))
    return F.when(F.length(long) > 0, met == F.length(short)).otherwise(F.length(short) == 0)


def word_match(typed: Column, name: Column) -> Column:
    """How well a typed word stands for a stored one: 1 for the same, less for a prefix, an abbreviation or a typo, 0 for none (STR-07)."""
    n, edits = F.length(typed), allowed_edits(typed)
    short = (n >= 2) & (n < F.length(name)) & (_at(typed, F.lit(1)) == _at(name, F.lit(1))) & in_order(typed, name)
    abbreviated = F.when(short, F.when(n <= 4, 0.72).otherwise(0.6)).otherwise(0.0)
    distance = edit_distance(typed, name, edits)
    typo = F.when((edits > 0) & (distance <= edits), 0.8 - 0.12 * distance).otherwise(0.0)
    head = F.when((edits > 0) & (F.length(name) > n) & (edit_distance(typed, F.substr(name, F.lit(1), n), 1) <= 1), 0.62).otherwise(0.0)
    return F.when(typed == name, 1.0).when((typed == "") | (name == ""), 0.0).when(F.startswith(name, typed), 0.8 + 0.18 * n / F.length(name)).otherwise(F.greatest(abbreviated, typo, head))


def _edges(ring: Column, start: Column, step) -> Column:
    """Fold over the edges of a ring from each point's predecessor, the last one's first."""
    size = F.size(ring)
    return F.when(size > 0, F.aggregate(F.sequence(F.lit(0), size - 1), start, lambda k, i: k + step(F.get(ring, F.pmod(i - 1, size)), F.get(ring, i)))).otherwise(start)


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside a ring of ``(x, y)`` by the crossings of a ray along its y, closed or not (PRJ-07)."""
    crossed = lambda b, a: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    return _edges(ring, F.lit(0), lambda b, a: F.when(crossed(b, a), 1).otherwise(0)) % 2 == 1


def polygon_contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon of whole coordinates by its winding number; its edges belong to it (PRJ-07)."""
    side = lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
    within = lambda v, a, b: v.between(F.least(a, b), F.greatest(a, b))
    on = _edges(ring, F.lit(0), lambda a, b: F.when((side(a, b) == 0) & within(x, a["x"], b["x"]) & within(y, a["y"], b["y"]), 1).otherwise(0))
    up, down = lambda a, b: (a["y"] <= y) & (b["y"] > y) & (side(a, b) > 0), lambda a, b: (a["y"] > y) & (b["y"] <= y) & (side(a, b) < 0)
    wound = _edges(ring, F.lit(0), lambda a, b: F.when(up(a, b), 1).when(down(a, b), -1).otherwise(0))
    return (on > 0) | (wound != 0)


def calories(ride: dict[str, Column]) -> tuple[Column, Column]:
    """(kcal, source) of the best source with nine tenths of the moving time: power, heart rate, estimated power, else speed (AGG-12).

    ``ride`` names weight, age, sex, estimate (boolean), moving_us, power_us, power_kj, heart_us, beat_s, estimated_us, estimated_kj and
    met_hours. Null without a weight or moving time.
    """
    needed = ride["moving_us"] * COVERAGE
    beats = F.lit(None).cast("double")
    for sex, (constant, weight, age, beat) in BEAT_LINES.items():
        kj = (constant + weight * ride["weight"] + age * ride["age"]) * (ride["heart_us"] / 60e6) + beat * (ride["beat_s"] / 60)
        beats = F.when(ride["sex"] == sex, F.when(kj < 0, 0.0).otherwise(kj / KJ_PER_KCAL)).otherwise(beats)
    known = ride["weight"].isNotNull() & (ride["moving_us"] > 0)
    by_beat = ride["sex"].isin(*BEAT_LINES) & ride["age"].isNotNull() & (ride["heart_us"] >= needed)
    by_estimate = ride["estimate"] & (ride["estimated_us"] >= needed)
    pick = lambda p, h, e, s: F.when(known, F.when(ride["power_us"] >= needed, p).when(by_beat, h).when(by_estimate, e).otherwise(s))
    kcal = pick(ride["power_kj"], beats, ride["estimated_kj"], ride["met_hours"] * ride["weight"])
    return F.floor(kcal + 0.5).cast("long"), pick(*map(F.lit, ("power", "heartRate", "estimatedPower", "speed")))


def nearest_whole(value: Column, step: int = 1) -> Column:
    """The nearest multiple of ``step``, halves away from zero."""
    return (F.signum(value) * F.floor(F.abs(value) / step + 0.5) * step).cast("long")


def feet(metres: Column, step: int = 1) -> Column:
    """Whole feet, tens or hundreds of them (NUM-04)."""
    return nearest_whole(metres / M_PER_FOOT, step)


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def miles_an_hour(mps: Column) -> Column:
    return mps * 3600 / M_PER_MILE
