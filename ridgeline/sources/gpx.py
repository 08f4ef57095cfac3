"""Reading GPX: repair, parsing by local names, and flattening to points.

Files are read whole, one a row, in parallel; parsing runs in Arrow batches. `read` gives one row a point
with the document's own fields, `paths` the point table. Elements and extensions are known by their local
name in any namespace and at any depth, the first value of each winning.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ridgeline.schema import COLUMNS, points

POINT = "file string, doc_name string, track_idx int, track_name string, track_type string, kind string, seg_idx int, pt_idx int, latitude_deg double, longitude_deg double, elevation_m double, time_epoch_ms long, heart_rate int, cadence int, temperature_c double, power_w double, road_width_m double, highway string, track_width_m double"
WAYPOINT = "file string, latitude_deg double, longitude_deg double, elevation_m double, name string, description string, symbol string, type string, time_epoch_ms long"

# Usual width in metres of a road by its class.
ROAD_WIDTH = {
    "motorway": 7.5, "motorway_link": 6.0, "trunk": 7.0, "trunk_link": 6.0, "primary": 6.5, "primary_link": 5.5,
    "secondary": 6.0, "secondary_link": 5.0, "tertiary": 5.5, "tertiary_link": 5.0, "unclassified": 4.5, "residential": 5.0,
    "living_street": 4.0, "service": 3.5, "road": 5.0, "track": 3.0, "cycleway": 2.5, "path": 2.5, "bridleway": 2.5,
    "footway": 2.5, "pedestrian": 3.0, "steps": 2.5,
}
EXTENSIONS = {"power": "power_w", "hr": "heart_rate", "heartrate": "heart_rate", "cad": "cadence", "cadence": "cadence", "atemp": "temperature_c", "temperature": "temperature_c", "temp": "temperature_c", "roadwidth": "road_width_m", "highway": "highway"}

_VERBATIM = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", re.S)
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_PAIR = re.compile(r"&#(?:x([dD][89abAB][0-9a-fA-F]{2})|(5[56]\d{3}));&#(?:x([dD][c-fC-F][0-9a-fA-F]{2})|(5[67]\d{3}));")
_BARE = re.compile(r"&(?!(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z_][\w.-]*);)")


def repair(xml: str) -> tuple[str, list[str]]:
    """The text with what parsers refuse mended, and the names of the repairs made. Comments, CDATA sections
    and processing instructions keep their text, but for characters that XML forbids."""
    done = []

    def note(name: str, new: str, old: str) -> str:
        if new != old and name not in done:
            done.append(name)
        return new

    xml = note("bom", xml.lstrip("\ufeff"), xml)
    xml = note("control_chars", _CONTROL.sub("", xml), xml)
    out, at = [], 0

    def plain(part: str) -> str:
        def joined(m):
            hi, lo = int(m[1], 16) if m[1] else int(m[2]), int(m[3], 16) if m[3] else int(m[4])
            if 0xD800 <= hi < 0xDC00 <= lo < 0xE000:
                return chr(0x10000 + ((hi - 0xD800) << 10) + lo - 0xDC00)
            return m[0]

        part = note("surrogate_pairs", _PAIR.sub(joined, part), part)
        return note("bare_ampersands", _BARE.sub("&amp;", part), part)

    for m in _VERBATIM.finditer(xml):
        out += [plain(xml[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, plain(xml[at:])]), done


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _children(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (c for c in e if _local(c) == name)


def _text(e: ET.Element, name: str) -> str | None:
    return next((c.text.strip() for c in _children(e, name) if c.text and c.text.strip()), None)


def _number(text: str | None) -> float | None:
    try:
        x = float(text.strip()) if text else None
    except ValueError:
        return None
    return x if x is not None and math.isfinite(x) else None


def instant(text: str | None) -> int | None:
    """Milliseconds of an ISO-8601 instant, or None."""
    if not text:
        return None
    try:
        t = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    if t.tzinfo is None:
        return None
    return int((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(milliseconds=1))


def _extensions(e: ET.Element) -> dict:
    found: dict = {}
    for c in e.iter():
        key = EXTENSIONS.get(_local(c))
        if key and key not in found and c.text and c.text.strip():
            value = c.text.strip() if key == "highway" else _number(c.text)
            if value is not None:
                found[key] = int(value) if key in ("heart_rate", "cadence") else value
    return found


def _point(e: ET.Element) -> dict:
    lat, lon = _number(e.get("lat")), _number(e.get("lon"))
    if lat is None or lon is None:
        raise ValueError(f"a point needs numeric lat and lon, got {e.get('lat')!r}, {e.get('lon')!r}")
    return {"latitude_deg": lat, "longitude_deg": lon, "elevation_m": _number(_text(e, "ele")), "time_epoch_ms": instant(_text(e, "time")), **_extensions(e)}


def parse(xml: str, mend: bool = True) -> dict:
    """name, tracks (name, type, kind, width, segments of points) and waypoints of a document. What can't be
    parsed is mended once; a second failure is an error."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as error:
        if not mend:
            raise ValueError(f"not GPX: {error}") from error
        try:
            root = ET.fromstring(repair(xml)[0])
        except ET.ParseError as again:
            raise ValueError(f"not GPX: {again}") from again
    if _local(root) != "gpx":
        raise ValueError(f"not GPX: root element {_local(root)!r}")
    name = next((n for m in _children(root, "metadata") if (n := _text(m, "name"))), None) or _text(root, "name") or "noname"
    tracks, waypoints = [], []
    for e in root:
        kind = _local(e)
        if kind in ("trk", "rte"):
            width = next((w for x in _children(e, "extensions") if (w := _extensions(x).get("road_width_m")) is not None), None)
            segments = [[_point(p) for p in _children(s, "trkpt")] for s in _children(e, "trkseg")] if kind == "trk" else [[_point(p) for p in _children(e, "rtept")]]
            tracks.append({"name": _text(e, "name"), "type": _text(e, "type"), "kind": "TRACK" if kind == "trk" else "ROUTE", "width": width, "segments": segments})
        elif kind == "wpt":
            p = _point(e)
            waypoints.append({**{k: p[k] for k in ("latitude_deg", "longitude_deg", "elevation_m", "time_epoch_ms")}, "name": _text(e, "name"), "description": _text(e, "desc"), "symbol": _text(e, "sym"), "type": _text(e, "type")})
    return {"name": name, "tracks": tracks, "waypoints": waypoints}


def point_rows(file: str, doc: dict) -> Iterator[dict]:
    for i, t in enumerate(doc["tracks"]):
        for j, segment in enumerate(t["segments"]):
            for k, p in enumerate(segment):
                yield {"file": file, "doc_name": doc["name"], "track_idx": i, "track_name": t["name"], "track_type": t["type"], "kind": t["kind"], "seg_idx": j, "pt_idx": k, "track_width_m": t["width"], **p}


def _frame(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    kinds = {"int": "Int32", "bigint": "Int64", "double": "float64", "string": "object"}
    return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=kinds[f.dataType.simpleString()]) for f in schema.fields})


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, xml of every GPX file under a folder (or of one file)."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[gG][pP][xX]").load(path)
    return b.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("xml"))


def _rows(df: DataFrame, schema_text: str, make) -> DataFrame:
    schema = T._parse_datatype_string(schema_text)

    def run(batches):
        for b in batches:
            for file, xml in zip(b["file"], b["xml"], strict=True):
                yield _frame(list(make(file, parse(xml or ""))), schema)

    return df.select("file", "xml").mapInPandas(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _rows(files(spark, path), POINT, point_rows)


def from_xml(df: DataFrame) -> DataFrame:
    """The same of a table with file and xml."""
    return _rows(df, POINT, point_rows)


def waypoints(df: DataFrame) -> DataFrame:
    return _rows(df, WAYPOINT, lambda file, doc: ({"file": file, **w} for w in doc["waypoints"]))


def width_of(highway):
    """Column: the usual width of a road class, null if unknown."""
    pairs = [F.lit(x) for p in ROAD_WIDTH.items() for x in p]
    return F.create_map(*pairs)[F.lower(F.trim(highway))]


def paths(df: DataFrame, kinds: tuple[str, ...] = ("TRACK", "ROUTE"), by_segment: bool = False) -> DataFrame:
    """Points of documents as a point table: one track for each track (its segments joined), or for each
    segment. A missing height or time is 0, other missing values NaN; a width counts between 2.5 and 20 m."""
    d = df.where(F.col("kind").isin(*kinds))
    parts = ["file", "track_idx"] + (["seg_idx"] if by_segment else [])
    key = F.concat_ws("#", *[F.col(p).cast("string") for p in parts])
    nan = F.lit(float("nan"))
    width = F.coalesce("road_width_m", "track_width_m", width_of(F.col("highway")))
    d = d.select(
        key.alias("track_id"), "seg_idx", "pt_idx",
        F.radians("latitude_deg").alias("latitude"), F.radians("longitude_deg").alias("longitude"),
        F.coalesce("elevation_m", F.lit(0.0)).alias("elevation"), F.coalesce(F.col("time_epoch_ms").cast("double"), F.lit(0.0)).alias("time"),
        F.coalesce("power_w", nan).alias("pInputPower"), F.coalesce("temperature_c", nan).alias("temperature"),
        F.coalesce(F.col("heart_rate").cast("double"), nan).alias("heartRate"), F.coalesce(F.col("cadence").cast("double"), nan).alias("cadence"),
        F.when(width.between(2.5, 20), width).otherwise(nan).alias("roadWidth"),
    )
    d = d.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy("seg_idx", "pt_idx")).cast("long") - 1)
    return points(d).select(*COLUMNS)


def start_time(df: DataFrame) -> DataFrame:
    """file and its first known instant."""
    known = df.where("time_epoch_ms is not null")
    return known.groupBy("file").agg(F.min_by("time_epoch_ms", F.struct("track_idx", "seg_idx", "pt_idx")).alias("start_ms"))


class GpxDataSource(DataSource):
    """`spark.read.format("gpx").load(folder)`: the rows of `read` from files that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "gpx"

    def schema(self) -> str:
        return POINT

    def reader(self, schema):
        return _Reader(self.options["path"], schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.names = path, [f.name for f in schema.fields]

    def partitions(self):
        import os

        found = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if f.lower().endswith(".gpx"))
        return [InputPartition(p) for p in found]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            doc = parse(f.read())
        for r in point_rows(partition.value, doc):
            yield tuple(r.get(n) for n in self.names)
