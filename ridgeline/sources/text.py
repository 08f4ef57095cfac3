"""Writing points as GPX, CSV and column-oriented JSON: one text a track, made where the track is."""

from __future__ import annotations

import datetime as dt
import json
import math
from decimal import Decimal
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.schema import UNITS

TEXT = "track_id string, text string"


def plain_decimal(x: float) -> str:
    """The shortest text that reads back as the number, without exponent or trailing `.0`."""
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if math.isnan(x):
        return "NaN"
    text = format(Decimal(repr(float(x))), "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def table_number(x: float, decimals: int | None = None) -> str:
    """A number for CSV and JSON: empty for NaN, fixed decimals (whole numbers stay whole) or the shortest text."""
    if math.isnan(x):
        return ""
    if decimals is None or math.isinf(x):
        return plain_decimal(x)
    text = f"{x:.{decimals}f}"
    whole = text.partition(".")
    if not whole[2].strip("0"):
        text = whole[0]
    return "0" if text in ("-0", "0") else text


def quoted(text: str, separator: str = ",") -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in (separator, '"', "\n", "\r")) else text


def power(source: str = "COMPUTED_OR_INPUT") -> Column:
    """The power to export; a computed power of 0 or NaN counts as absent, as NaN input does."""
    given = F.when(~F.isnan("pInputPower"), F.col("pInputPower"))
    computed = F.when(~F.isnan("pComputedPower") & (F.col("pComputedPower") != 0), F.col("pComputedPower"))
    return {"INPUT": given, "COMPUTED": computed, "COMPUTED_OR_INPUT": F.coalesce(computed, given)}[source]


def gpx_points(df: DataFrame, start_ms: int | None = None, source: str = "COMPUTED_OR_INPUT") -> DataFrame:
    """Points as GPX has them: degrees, instants (from `start_ms` on, or the points' own), absent values null."""
    t = F.col("time")
    first = F.min_by("time", "seq").over(Window.partitionBy("track_id"))
    when = F.floor(t - first + 0.5) + start_ms if start_ms is not None else F.when(t > 0, F.floor(t + 0.5))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.select(
        "track_id", "seq", F.degrees("latitude").alias("lat"), F.degrees("longitude").alias("lon"), known("elevation").alias("ele"), when.cast("long").alias("time_ms"),
        power(source).alias("power"), known("roadWidth").alias("width"), F.round(known("heartRate")).cast("int").alias("hr"), F.round(known("cadence")).cast("int").alias("cad"), known("temperature").alias("temp"),
    )


def iso(ms: int) -> str:
    t = dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(milliseconds=int(ms))
    return t.strftime("%Y-%m-%dT%H:%M:%S") + (f".{t.microsecond // 1000:03d}" if t.microsecond else "") + "Z"


def gpx_document(name: str, tracks: list[tuple[str, str | None, pd.DataFrame]], waypoints: list[dict] = (), extensions: bool = True) -> str:
    """GPX 1.1; namespaces only where they are used."""
    has = lambda c: extensions and any(p[c].notna().any() for _, _, p in tracks)
    device, road = any(has(c) for c in ("hr", "cad", "temp")), has("width")
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="ridgeline" xmlns="http://www.topografix.com/GPX/1/1"']
    if device:
        out.append(' xmlns:gpxtpx="http://www.garmin.com/xmlschemas/TrackPointExtension/v1"')
    if road:
        out.append(' xmlns:vc="urn:ridgeline:road:1"')
    out.append(f">\n <metadata><name>{escape(name)}</name></metadata>\n")
    for w in waypoints:
        out.append(f' <wpt lat="{plain_decimal(w["latitude_deg"])}" lon="{plain_decimal(w["longitude_deg"])}">')
        out.append("".join(f"<{tag}>{escape(str(w[k]))}</{tag}>" for k, tag in (("name", "name"), ("description", "desc"), ("symbol", "sym"), ("type", "type")) if w.get(k)) + "</wpt>\n")
    for title, kind, p in tracks:
        out.append(f" <trk><name>{escape(title)}</name>" + (f"<type>{escape(kind)}</type>" if kind else "") + "<trkseg>\n")
        for r in p.itertuples():
            out.append(f'  <trkpt lat="{plain_decimal(r.lat)}" lon="{plain_decimal(r.lon)}">')
            if pd.notna(r.ele):
                out.append(f"<ele>{plain_decimal(r.ele)}</ele>")
            if pd.notna(r.time_ms):
                out.append(f"<time>{iso(r.time_ms)}</time>")
            more = []
            if extensions:
                if pd.notna(r.power):
                    more.append(f"<power>{plain_decimal(r.power)}</power>")
                if pd.notna(r.width):
                    more.append(f"<vc:roadWidth>{plain_decimal(r.width)}</vc:roadWidth>")
                body = "".join(f"<gpxtpx:{tag}>{plain_decimal(float(v))}</gpxtpx:{tag}>" for tag, v in (("atemp", r.temp), ("hr", r.hr), ("cad", r.cad)) if pd.notna(v))
                if body:
                    more.append(f"<gpxtpx:TrackPointExtension>{body}</gpxtpx:TrackPointExtension>")
            out.append((f"<extensions>{''.join(more)}</extensions>" if more else "") + "</trkpt>\n")
        out.append(" </trkseg></trk>\n")
    return "".join(out) + "</gpx>\n"


def _each(df: DataFrame, make) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track_id": [str(p["track_id"].iloc[0])], "text": [make(p.sort_values("seq", kind="stable"))]})

    return df.groupBy("track_id").applyInPandas(run, TEXT)


def to_gpx(df: DataFrame, start_ms: int | None = None, source: str = "COMPUTED_OR_INPUT", extensions: bool = True) -> DataFrame:
    """track_id, text: each track as a GPX document of its own."""
    return _each(gpx_points(df, start_ms, source), lambda p: gpx_document(str(p["track_id"].iloc[0]), [(str(p["track_id"].iloc[0]), None, p)], (), extensions))


def to_csv(df: DataFrame, fields: list[str], separator: str = ",", decimals: int | None = None, units: bool = True, line: str = "\n") -> DataFrame:
    """track_id, text: a header and a line for each point."""
    head = separator.join(quoted(f"{f} ({UNITS[f]})" if units else f, separator) for f in fields)

    def make(p: pd.DataFrame) -> str:
        return line.join([head, *(separator.join(quoted(table_number(float(x), decimals), separator) for x in row) for row in p[fields].itertuples(index=False))]) + line

    return _each(df.select("track_id", "seq", *fields), make)


def to_json(df: DataFrame, fields: list[str], decimals: int | None = None, pretty: bool = False) -> DataFrame:
    """track_id, text: size, units and one array for each field; NaN and infinities are null."""

    def number(x: float):
        return None if not math.isfinite(x) else json.loads(table_number(x, decimals))

    def make(p: pd.DataFrame) -> str:
        body = {"size": len(p), "meta": {"units": {f: UNITS[f] for f in fields}}, "fields": {f: [number(float(x)) for x in p[f]] for f in fields}}
        return json.dumps(body, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))

    return _each(df.select("track_id", "seq", *fields), make)


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder for each track, written by the tasks that hold them."""
    texts.write.partitionBy("track_id").mode("overwrite").text(path)


def summaries(stats: DataFrame) -> DataFrame:
    """track_id and its statistics as a JSON record."""
    return stats.select("track_id", F.to_json(F.struct(*[c for c in stats.columns if c != "track_id"])).alias("summary"))
