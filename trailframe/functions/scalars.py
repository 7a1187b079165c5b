"""Scalar operators as Column expressions: classes, times, tags, names, formats. No Python in the hot path."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the gradient classes (percent), floors of the rain classes (mm an hour), wind and rain limits.
GRADIENT_BOUNDS = (-3, 3, 6, 10)
RAIN_FLOORS = (0.1, 0.2, 0.4, 1, 2, 3, 5, 7.5, 10, 15, 30, 45, 75, 100, 150)
CALM_MPS = 1.5
WET_MM = 0.2
#: Tag values of surfaces and highways.
BUSY_HIGHWAYS = ("primary", "primary_link", "trunk", "trunk_link")
UNPAVED_HIGHWAYS = ("track", "path")
#: Fixed value: keys of names in a language.
LANGUAGE_NAME = r"^name:[a-z]{2,3}(-[A-Za-z]{2,8})?$"
#: Letters that search writes in two ways.
TWO_WAY = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))


def gradient_class(percent: Column) -> Column:
    """descent, flat, moderate, steep or verySteep; a bound belongs to the steeper class, the first to the descent (NUM-01)."""
    low, flat, moderate, steep = GRADIENT_BOUNDS
    return F.when(percent <= low, "descent").when(percent < flat, "flat").when(percent < moderate, "moderate").when(percent < steep, "steep").when(percent.isNotNull(), "verySteep")


def rain_class(rate: Column) -> Column:
    """0 (dry) to 15 by the floors of mm an hour (NUM-01)."""
    return F.size(F.filter(F.array(*map(F.lit, map(float, RAIN_FLOORS))), lambda x: rate >= x))


def rain_rate(dbz: Column) -> Column:
    """mm an hour of a reflectivity by Z = 200 R**1.6 (NUM-01)."""
    return F.pow(F.pow(F.lit(10.0), dbz / 10) / 200, F.lit(1 / 1.6))


def headwind(wind: Column, wind_from: Column, bearing: Column) -> Column:
    return wind * F.cos(F.radians(wind_from - bearing))


def wind_class(wind: Column, wind_from: Column, bearing: Column) -> Column:
    """calm, headwind, tailwind or crosswind of a rider who heads ``bearing`` (NUM-01)."""
    ahead = headwind(wind, wind_from, bearing)
    return F.when(wind < CALM_MPS, "calm").when(ahead >= 0.5 * wind, "headwind").when(ahead <= -0.5 * wind, "tailwind").when(ahead.isNotNull(), "crosswind")


def duration_hours(text: Column) -> Column:
    """Whole hours of an ISO-8601 duration without years and months, half up; null if none or under half an hour (DTM-02)."""
    number = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+){unit}", 1).try_cast("double"), F.lit(0.0))
    after = F.substring_index(text, "T", -1)
    clock = lambda unit: F.when(F.contains(text, F.lit("T")), F.coalesce(F.regexp_extract(after, rf"(\d+){unit}", 1).try_cast("double"), F.lit(0.0))).otherwise(0.0)
    hours = number("W") * 168 + number("D") * 24 + clock("H") + clock("M") / 60 + clock("S") / 3600
    whole = F.floor(hours + 0.5).cast("int")
    valid = text.rlike(r"^P(?:\d+W)?(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$") & (text != "P") & ~text.endswith("T")
    return F.when(valid & (whole >= 1), whole)


def sun_times(day: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """(rise, set, all day) of a date in epoch seconds, by the sunrise equation at -0.833 degrees (DTM-03)."""
    noon = F.unix_date(day) + 0.5 + 2440587.5
    n = F.floor(noon - 2451545.0 + 0.0008 + 0.5)
    solar_noon = n - lon / 360
    anomaly = F.pmod(357.5291 + 0.98560028 * solar_noon, F.lit(360.0))
    m = F.radians(anomaly)
    centre = 1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)
    longitude = F.radians(F.pmod(anomaly + centre + 180 + 102.9372, F.lit(360.0)))
    transit = 2451545.0 + solar_noon + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * longitude)
    sine = F.sin(longitude) * math.sin(math.radians(23.4397))
    cosine = (math.sin(math.radians(-0.833)) - F.sin(F.radians(lat)) * sine) / (F.cos(F.radians(lat)) * F.cos(F.asin(sine)))
    half = F.when((cosine >= -1) & (cosine <= 1), F.degrees(F.acos(cosine)) / 360)
    at = lambda julian: F.floor((julian - 2440587.5) * 86400 + 0.5).cast("long")
    return at(transit - half), at(transit + half), cosine < -1


def tags(text: Column) -> Column:
    """Tags ``key=value key`` as a map: the first ``=`` splits, a bare key has an empty value, the last of a key wins (MAP-01)."""
    tokens = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")
    key = lambda t: F.substring_index(t, "=", 1)
    keys = F.transform(tokens, key)
    last = F.filter(F.transform(tokens, lambda t, i: F.struct(key(t).alias("key"), F.when(F.contains(t, F.lit("=")), F.substr(t, F.length(key(t)) + 2)).otherwise(F.lit("")).alias("value"), i.alias("i"))), lambda e: e["i"] == F.size(keys) - F.array_position(F.reverse(keys), e["key"]).cast("int"))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def surface_kind(of: Column, paved: tuple[str, ...], unpaved: tuple[str, ...]) -> Column:
    """busy, unpaved, cycleway, paved or unknown of a way's tags, in this order (PRJ-08; cycle tracks by their tags)."""
    surface, highway = F.get(F.array(of["surface"]), F.lit(0)), of["highway"]
    rough = surface.isin(*unpaved) | (surface.isNull() & highway.isin(*UNPAVED_HIGHWAYS))
    cycle = (highway == "cycleway") | F.exists(F.map_entries(of), lambda e: e["key"].startswith("cycleway") & (e["value"] != "no"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(highway.isin(*BUSY_HIGHWAYS)), "busy").when(yes(rough), "unpaved").when(yes(cycle), "cycleway").when(yes(surface.isin(*paved)), "paved").otherwise("unknown")


def importance(of: Column) -> Column:
    """Number of ``name:<language>`` keys and 5 for an encyclopedia tag, 255 at most, null for none (PRJ-05)."""
    keys = F.map_keys(of)
    named = F.size(F.filter(keys, lambda k: k.rlike(LANGUAGE_NAME)))
    wiki = F.exists(keys, lambda k: (k == "wikidata") | (k == "wikipedia") | k.startswith("wikipedia:"))
    return F.nullif(F.least(named + F.when(wiki, 5).otherwise(0), F.lit(255)), F.lit(0))


def file_name(name: Column) -> Column:
    """A name that is safe as a file's: 80 characters at most, ``track`` if nothing is left (SRC-22)."""
    one = F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f\x7f]", " "), r'[\\/:*?"<>|]', "_")
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(one, r"\s+", " ")), r"^\.+", ""))
    return F.when(bare == "", "track").otherwise(F.substr(bare, F.lit(1), F.lit(80)))


def track_format(content: Column) -> Column:
    """gpx, fit or tcx by the first bytes, never by a name or type; null for anything else (SRC-08)."""
    head = F.decode(F.substr(content, F.lit(1), F.lit(2048)), "ISO-8859-1")
    fit = (F.substr(content, F.lit(9), F.lit(4)) == F.lit(b".FIT")) & F.ascii(head).isin(12, 14)
    root = F.regexp_extract(head, r"^[^<]*(?:<[?!][^>]*>[^<]*)*<(?:[A-Za-z_][\w.\-]*:)?([A-Za-z]+)[\s>/]", 1)
    return F.when(fit, "fit").when(head.rlike(r"<(?:[A-Za-z_][\w.\-]*:)?gpx[\s>/]"), "gpx").when(root == "TrainingCenterDatabase", "tcx")


def nanos(text: Column) -> Column:
    """Decimal text in billionths, half up at the tenth digit; null if it is no decimal (NUM-05)."""
    t = F.trim(text)
    fraction = F.rpad(F.regexp_extract(t, r"^-?\d+\.(\d+)$", 1), 10, "0")
    amount = F.regexp_extract(t, r"^-?(\d+)", 1).cast("decimal(28,0)") * 1_000_000_000 + F.substr(fraction, F.lit(1), F.lit(9)).cast("decimal(28,0)")
    rounded = amount + F.when(F.substr(fraction, F.lit(10), F.lit(1)) >= "5", 1).otherwise(0)
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), F.when(t.startswith("-"), -rounded).otherwise(rounded)).cast("long")


def match_fold(folded: Column) -> Column:
    """Folded text with letters that are written in two ways spelled out (STR-02)."""
    for a, b in TWO_WAY:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return folded


def clean_name(raw: Column) -> Column:
    """A name with single blanks, null if empty or over 200 characters (STR-13)."""
    one = F.trim(F.regexp_replace(raw, r"\s+", " "))
    return F.when((one != "") & (F.length(one) <= 200), one)


def time_of_day(hour: Column) -> Column:
    """Morning from 4, Lunch from 11, Afternoon from 14, Evening from 17, Night from 21 o'clock of the rider's own time (STR-16)."""
    return F.when(hour.between(4, 10), "Morning").when(hour.between(11, 13), "Lunch").when(hour.between(14, 16), "Afternoon").when(hour.between(17, 20), "Evening").when(hour.isNotNull(), "Night")


def ride_name(route: Column, hour: Column, start: Column, end: Column, loop: Column) -> Column:
    """The followed route's name, else the part of the day, loop or ride, and the places at its ends, each named once (STR-16)."""
    bare = lambda c: F.nullif(F.trim(c), F.lit(""))
    a, b, is_loop = bare(start), bare(end), F.coalesce(loop, F.lit(False))
    kind = F.concat(time_of_day(hour), F.when(is_loop, " loop").otherwise(" ride"))
    onward = F.when(~is_loop & (a != b), F.concat(F.lit(" to "), b))
    return F.coalesce(bare(route), F.concat(kind, F.coalesce(F.concat(F.lit(" from "), a, F.coalesce(onward, F.lit(""))), F.lit(""))))
