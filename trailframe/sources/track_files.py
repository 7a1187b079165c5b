"""Track files: GPX with Spark's XML functions, packed binary tracks with Arrow batches, each file one row.

Files are read with ``binaryFile``, so a listing is split over tasks by files; a file is one recording and bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed layout of a packed point: little-endian, version byte 2 before the first one, version 1 without the last three.
PACKED_VERSION = 2
PACKED = np.dtype([("lat", "<f8"), ("lon", "<f8"), ("ele", "<f4"), ("time_ms", "<i8"), ("speed", "<f4"), ("accuracy", "<f4"), ("hr", "<u2"), ("cad", "<u2"), ("pwr", "<u2")])
PACKED_BEFORE = np.dtype(PACKED.descr[:6])
ABSENT = 0xFFFF
#: What a task gathers of packed tracks, or of their points, before it hands them on.
BATCH_BYTES = 1 << 20
POINT = "seq int, lat double, lon double, ele float, time_ms bigint, speed float, accuracy float, hr int, cad int, pwr int"


def _xml_point() -> str:
    inner = "hr:int,heartrate:int,cad:int,cadence:int,power:int,PowerInWatts:int,TrackPointExtension:struct<hr:int,cad:int,power:int>"
    return f"struct<_lat:double,_lon:double,ele:double,time:string,extensions:struct<{inner}>>"


def _gpx(files: DataFrame, path: str, content: str, schema: str) -> DataFrame:
    """``(path, x)`` of the GPX files, without namespace prefixes."""
    text = F.regexp_replace(F.decode(F.col(content), "UTF-8"), r"(</?)[A-Za-z_][\w.\-]*:", "$1")
    body = F.regexp_replace(text, r"^\s*\x{FEFF}?\s*<\?xml[^>]*\?>", "")
    return files.filter(F.decode(F.col(content), "UTF-8").rlike(r"<(?:[A-Za-z_][\w.\-]*:)?gpx[\s>]")).select(F.col(path).alias("path"), F.from_xml(body, schema, {"mode": "PERMISSIVE"}).alias("x"))


def read_gpx(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, form, line, part, seq, name, lat, lon, ele, time, hr, cad, pwr)`` of every track and route point (SRC-01, SRC-09).

    Namespace prefixes are dropped first, so sensors are found in any extension. ``form`` is track or route, ``line`` and
    ``part`` count tracks and their segments. A file that is no GPX gives no rows; a point without a position is left out.
    """
    point = _xml_point()
    schema = f"trk array<struct<name:string,trkseg:array<struct<trkpt:array<{point}>>>>>, rte array<struct<name:string,rtept:array<{point}>>>"
    gpx = _gpx(files, path, content, schema)
    tracks = gpx.select("path", F.posexplode("x.trk").alias("line", "t")).select("path", F.lit("track").alias("form"), "line", "t.name", F.posexplode("t.trkseg").alias("part", "s")).select("path", "form", "line", "part", "name", F.posexplode("s.trkpt").alias("seq", "p"))
    routes = gpx.select("path", F.posexplode("x.rte").alias("line", "t")).select("path", F.lit("route").alias("form"), "line", F.lit(0).alias("part"), "t.name", F.posexplode("t.rtept").alias("seq", "p"))
    e = lambda *names: F.coalesce(*[F.col(f"p.extensions.{n}") for n in names])
    points = tracks.unionByName(routes).select(
        "path", "form", "line", "part", "seq", "name", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele"), F.col("p.time").try_cast("timestamp").alias("time"),
        e("hr", "heartrate", "TrackPointExtension.hr").alias("hr"), e("cad", "cadence", "TrackPointExtension.cad").alias("cad"), e("power", "PowerInWatts", "TrackPointExtension.power").alias("pwr"),
    )
    return points.filter("lat IS NOT NULL AND lon IS NOT NULL")


def read_waypoints(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, nth, name, sym, type, cmt, desc, lat, lon, ele)`` of the waypoints of GPX files; ones without a position are left out (SRC-01)."""
    schema = "wpt array<struct<_lat:double,_lon:double,ele:double,name:string,sym:string,type:string,cmt:string,desc:string>>"
    found = _gpx(files, path, content, schema).select("path", F.posexplode("x.wpt").alias("nth", "w"))
    return found.select("path", "nth", *[F.col(f"w.{c}").alias(c) for c in ("name", "sym", "type", "cmt", "desc")], F.col("w._lat").alias("lat"), F.col("w._lon").alias("lon"), F.col("w.ele").alias("ele")).filter("lat IS NOT NULL AND lon IS NOT NULL")


def preferred(points: DataFrame) -> DataFrame:
    """Of the points of ``read_gpx`` those of tracks, and of routes only where a file has no track (SRC-09)."""
    tracked = points.filter("form = 'track'").select("path").distinct()
    return points.filter("form = 'track'").unionByName(points.filter("form = 'route'").join(tracked, "path", "left_anti").select(*points.columns))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def gpx_documents(points: DataFrame, key: str = "track_id", route: bool = False) -> DataFrame:
    """``(key, gpx)``: one GPX document a track, or a route, of ``points(key, seq, name, lat, lon, ele, time, hr, cad, pwr)`` (SRC-02).

    Times are UTC in whole seconds; the sensor namespace stands only where a track has sensor values.
    """
    tag, outer, inner = ("rtept", "rte", "") if route else ("trkpt", "trk", "trkseg")
    opened, closed = (f"<{inner}>", f"</{inner}>") if inner else ("", "")
    element = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{tag}>"), F.col(c).cast("string"), F.lit(f"</{tag}>")))
    sensors = F.concat_ws("", element("gpxtpx:hr", "hr"), element("gpxtpx:cad", "cad"))
    extension = F.concat_ws("", element("power", "pwr"), F.when(sensors != "", F.concat(F.lit("<gpxtpx:TrackPointExtension>"), sensors, F.lit("</gpxtpx:TrackPointExtension>"))))
    time = F.when(F.col("time").isNotNull(), F.concat(F.lit("<time>"), F.date_format(F.to_utc_timestamp("time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time>")))
    point = F.concat(
        F.lit(f'<{tag} lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('">'),
        F.concat_ws("", element("ele", "ele"), time, F.when(extension != "", F.concat(F.lit("<extensions>"), extension, F.lit("</extensions>")))), F.lit(f"</{tag}>"),
    )
    rows = points.select(key, "name", F.struct("seq", point.alias("x")).alias("p"), (sensors != "").alias("sensed"))
    whole = rows.groupBy(key).agg(F.first("name", ignorenulls=True).alias("name"), F.sort_array(F.collect_list("p")).alias("p"), F.max("sensed").alias("sensed"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="trailframe" xmlns="http://www.topografix.com/GPX/1/1"'),
        F.when(F.col("sensed"), ' xmlns:gpxtpx="http://www.garmin.com/xmlschemas/TrackPointExtension/v1"').otherwise(""), F.lit(f"><{outer}>"),
    )
    name = F.when(F.col("name").isNotNull(), F.concat(F.lit("<name>"), _escaped(F.col("name")), F.lit("</name>"))).otherwise("")
    return whole.select(key, F.concat(head, name, F.lit(opened), F.array_join("p.x", ""), F.lit(f"{closed}</{outer}></gpx>")).alias("gpx"))


def packed_tracks(points: DataFrame, key: str = "track_id") -> DataFrame:
    """``(key, packed)``: one binary track of the points of each key, in the order of ``seq`` (SRC-10)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the track at hand, and whole ones until they are BATCH_BYTES
        own, parts, begun, keys_out, packed_out, held = None, [], False, [], [], 0
        kind = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys_out, kind), pa.array(packed_out, pa.binary())], names=[key, "packed"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, keys = batch.column(0).type, batch.column(0).to_pylist()
            data = np.zeros(batch.num_rows, PACKED)
            for i, name in enumerate(PACKED.names, 1):
                empty = {"f": np.nan, "i": 0, "u": ABSENT}[PACKED[name].kind]
                data[name] = batch.column(i).fill_null(empty).to_numpy(zero_copy_only=False)
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if begun and keys[a] != own:
                    keys_out.append(own)
                    packed_out.append(bytes([PACKED_VERSION]) + b"".join(parts))
                    parts, held = [], held + len(packed_out[-1])
                    if held >= BATCH_BYTES:
                        yield told()
                        keys_out, packed_out, held = [], [], 0
                own, begun = keys[a], True
                parts.append(data[a:b].tobytes())
        if begun:
            keys_out.append(own)
            packed_out.append(bytes([PACKED_VERSION]) + b"".join(parts))
            yield told()

    # flat rows in order within a task, so that it holds a batch of points and one track's bytes, and not a batch of whole tracks
    dealt = points.select(key, "seq", *PACKED.names).repartition(key).sortWithinPartitions(key, "seq", *PACKED.names)
    return dealt.drop("seq").mapInArrow(run, f"{key} {points.schema[key].dataType.simpleString()}, packed binary")


def unpacked_tracks(packed: DataFrame, key: str = "track_id", content: str = "packed") -> DataFrame:
    """``(key, seq, lat, ..., pwr)`` of binary tracks of either version; a trailing part of a record is ignored (SRC-10, SRC-21).

    A null or empty blob and one of an unknown version give no rows.
    """

    def points(blobs: pa.Array) -> Iterator[tuple[int, np.dtype, int, np.ndarray]]:
        """(row, layout, first seq, points) of the blobs, of long ones ``BATCH_BYTES`` at a time."""
        for row in range(len(blobs)):
            blob = memoryview(blobs[row].as_buffer() or b"")
            kind = {1: PACKED_BEFORE, PACKED_VERSION: PACKED}.get(blob[0] if len(blob) else 0)
            if kind is not None:
                data, step = np.frombuffer(blob, kind, (len(blob) - 1) // kind.itemsize, 1), BATCH_BYTES // kind.itemsize
                yield from ((row, kind, at, data[at : at + step]) for at in range(0, len(data), step))

    def told(owners: pa.Array, found: list[tuple[int, np.dtype, int, np.ndarray]]) -> pa.RecordBatch:
        kind, data = found[0][1], np.concatenate([d for *_, d in found])
        rows = np.repeat([row for row, *_ in found], [len(d) for *_, d in found])
        columns = [owners.take(pa.array(rows)), pa.array(np.concatenate([np.arange(at, at + len(d), dtype=np.int32) for _, _, at, d in found]))]
        for name in PACKED.names:
            if name not in kind.names:
                columns.append(pa.nulls(len(data), pa.int32()))
            elif PACKED[name].kind == "u":
                columns.append(pa.array(data[name].astype(np.int32), mask=data[name] == ABSENT))
            elif name == "time_ms":
                columns.append(pa.array(data[name], mask=data[name] == 0))
            else:
                columns.append(pa.array(data[name], mask=np.isnan(data[name])))
        return pa.RecordBatch.from_arrays(columns, names=[key, "seq", *PACKED.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for one in points(batch.column(1)):
                if found and (one[1] is not found[0][1] or held + one[3].nbytes > BATCH_BYTES):
                    yield told(batch.column(0), found)
                    found, held = [], 0
                found.append(one)
                held += one[3].nbytes
            if found:
                yield told(batch.column(0), found)

    return packed.select(key, content).mapInArrow(run, f"{key} {packed.schema[key].dataType.simpleString()}, {POINT}")


def packed_points(packed: Column) -> Column:
    """How many whole points a packed track holds; null for a null blob or an unknown version (SRC-10)."""
    version = F.hex(F.substring(packed, 1, 1))
    held = lambda kind: F.floor((F.octet_length(packed) - 1) / kind.itemsize).cast("int")
    return F.when(version == "01", held(PACKED_BEFORE)).when(version == "02", held(PACKED))


def appended(packed: DataFrame, points: DataFrame, key: str = "track_id") -> DataFrame:
    """``(key, packed)``: packed tracks with the points of their keys after those that they hold (SRC-10).

    A torn record at the end is dropped first; a track of the older version is written anew; a key without a track begins one.
    """
    own = packed.select(key, "packed")
    whole = F.substring("packed", F.lit(1), F.lit(1) + packed_points(F.col("packed")) * PACKED.itemsize)
    ready = own.filter(F.hex(F.substring("packed", 1, 1)) == "02").select(key, whole.alias("held"))
    older = packed_tracks(unpacked_tracks(own.filter(F.hex(F.substring("packed", 1, 1)) == "01"), key), key).select(key, F.col("packed").alias("held"))
    more = packed_tracks(points, key).select(key, F.col("packed").alias("more"))
    met = ready.unionByName(older).join(more, key, "full")
    rest = F.substring("more", F.lit(2), F.octet_length("more"))
    return met.select(key, F.when(F.col("held").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("held")).otherwise(F.concat("held", rest)).alias("packed"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
