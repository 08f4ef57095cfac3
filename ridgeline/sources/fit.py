"""Writing FIT course files: little-endian records with definitions, a header and two checksums."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: epoch in milliseconds, message numbers, base types (code, size, invalid).
EPOCH_MS = 631_065_600_000
FILE_ID, COURSE, LAP, RECORD, EVENT, COURSE_POINT = 0, 31, 19, 20, 21, 32
ENUM, UINT8, SINT8, UINT16, SINT32, UINT32, UINT32Z, STRING = (0x00, "B", 0xFF), (0x02, "B", 0xFF), (0x01, "b", 0x7F), (0x84, "H", 0xFFFF), (0x85, "i", 0x7FFFFFFF), (0x86, "I", 0xFFFFFFFF), (0x8C, "I", 0), (0x07, "s", 0)
SPORT = {"generic": 0, "running": 1, "cycling": 2, "hiking": 17}
POINT_TYPE = {"generic": 0, "summit": 1, "valley": 2, "water": 3, "food": 4, "danger": 5, "left": 6, "right": 7, "straight": 8, "first_aid": 9, "fourth_category": 10, "third_category": 11, "second_category": 12, "first_category": 13, "hors_category": 14, "sprint": 15}
_NIBBLES = [0x0000, 0xCC01, 0xD801, 0x1400, 0xF001, 0x3C00, 0x2800, 0xE401, 0xA001, 0x6C00, 0x7800, 0xB401, 0x5000, 0x9C01, 0x8801, 0x4400]


def crc16(data: bytes) -> int:
    crc = 0
    for b in data:
        for n in (b & 15, b >> 4):
            crc = (crc >> 4) ^ _NIBBLES[crc & 15] ^ _NIBBLES[n]
    return crc


def semicircles(deg: float) -> int:
    """180 degrees in 2**31 steps; what rounds to the far end is the lowest number."""
    x = int(np.floor(deg * (2**31 / 180.0) + 0.5))
    return (x + 2**31) % 2**32 - 2**31


def semicircles_column(deg: Column) -> Column:
    x = F.floor(deg * (2**31 / 180.0) + 0.5)
    return (F.pmod(x + 2**31, F.lit(2**32)) - 2**31).cast("long")


def altitude(m: float) -> int:
    return int(min(0xFFFE, max(0, np.floor((m + 500) * 5 + 0.5))))


def altitude_column(m: Column, most: int = 0xFFFFFFFE) -> Column:
    return F.least(F.greatest(F.floor((m + 500) * 5 + 0.5), F.lit(0)), F.lit(most)).cast("long")


def timestamp(ms: float) -> int:
    return int((ms - EPOCH_MS) // 1000)


def held(kind: tuple, value: float | None) -> float | None:
    """The value, or None (invalid) where the field's type has no number for it."""
    if value is None or not math.isfinite(value):
        return None
    least = 0 if kind[1].isupper() else -kind[2] - 1
    return value if least <= int(value) < kind[2] else None


def speed_field(m_s: float | None) -> tuple[int, tuple, float | None]:
    """`speed`, or `enhanced_speed` (the same unit in 32 bits) from 65.535 m/s."""
    mm = None if m_s is None else round(m_s * 1000)
    return (73, UINT32, held(UINT32, mm)) if mm is not None and mm >= UINT16[2] else (6, UINT16, held(UINT16, mm))


class Writer:
    def __init__(self):
        self.body, self.known = bytearray(), {}

    def add(self, message: int, *fields: tuple[int, tuple, object]) -> None:
        """fields: number, base type, value (None: invalid)."""
        shape = tuple((n, t[0], len(v) + 1 if t is STRING else struct.calcsize(t[1])) for n, t, v in fields)
        key = (message, shape)
        if key not in self.known:
            local = len(self.known) % 16
            self.known = {k: x for k, x in self.known.items() if x != local}
            self.known[key] = local
            self.body += struct.pack("<BBBHB", 0x40 | local, 0, 0, message, len(shape)) + b"".join(struct.pack("BBB", n, size, code) for n, code, size in shape)
        self.body.append(self.known[key])
        for _, t, v in fields:
            self.body += v + b"\0" if t is STRING else struct.pack("<" + t[1], t[2] if v is None else int(v))

    def done(self) -> bytes:
        head = struct.pack("<BBHI4s", 14, 0x20, 2132, len(self.body), b".FIT")
        head += struct.pack("<H", crc16(head))
        whole = head + bytes(self.body)
        return whole + struct.pack("<H", crc16(whole))


def snap(distance: np.ndarray, wanted: list[dict]) -> list[dict]:
    """Course points in order of distance, each at the nearest record (the earlier of two, the first of equals)."""
    out = []
    for w in sorted(wanted, key=lambda x: x["distance"]):
        i = int(np.abs(distance - w["distance"]).argmin())
        out.append({**w, "index": int(np.searchsorted(distance, distance[i], side="left"))})
    return out


def whole_name(name: str) -> bytes:
    """A name in UTF-8, never cut: a field holds 254 bytes and the closing zero."""
    text = name.encode()
    if len(text) > 254:
        raise ValueError("a name has more than 254 bytes")
    return text


def encode(name: str, segments: list[dict], start_ms: int, sport: str = "cycling", course_points: list[dict] = (), gap_s: float = 1.0) -> bytes:
    """A course of one or more segments (arrays lat, lon in degrees, ele, time in ms, distance, power, hr, cad,
    speed, temp; gain and loss). Time must not go back; later segments continue time and distance. A total or
    measurement that the format's widest field cannot hold is written as invalid."""
    if any((np.diff(s["time"]) < 0).any() for s in segments):
        raise ValueError("time must not go back along a segment")
    w = Writer()
    w.add(FILE_ID, (0, ENUM, 6), (1, UINT16, 255), (2, UINT16, 0), (3, UINT32Z, 1), (4, UINT32, timestamp(start_ms)))
    w.add(COURSE, (4, ENUM, SPORT[sport]), (5, STRING, whole_name(name)))
    clock, way = float(start_ms), 0.0
    plans = []
    for s in segments:
        t, d = clock + (s["time"] - s["time"][0]), way + (s["distance"] - s["distance"][0])
        plans.append((s, t, d))
        clock, way = float(t[-1]) + gap_s * 1000, float(d[-1])
    for s, t, d in plans:
        total = (t[-1] - t[0])
        w.add(LAP, (253, UINT32, timestamp(t[-1])), (2, UINT32, timestamp(t[0])), (3, SINT32, semicircles(s["lat"][0])), (4, SINT32, semicircles(s["lon"][0])), (5, SINT32, semicircles(s["lat"][-1])), (6, SINT32, semicircles(s["lon"][-1])), (7, UINT32, held(UINT32, total)), (8, UINT32, held(UINT32, total)), (9, UINT32, held(UINT32, (d[-1] - d[0]) * 100)), (21, UINT16, held(UINT16, round(s.get("gain", 0)))), (22, UINT16, held(UINT16, round(-s.get("loss", 0)))))
    for k, (s, t, d) in enumerate(plans):
        w.add(EVENT, (253, UINT32, timestamp(t[0])), (0, ENUM, 0), (1, ENUM, 0))
        known = lambda c, i, f=float: None if c not in s or not math.isfinite(s[c][i]) else f(s[c][i])  # noqa: E731, B023
        for i in range(len(t)):
            w.add(RECORD, (253, UINT32, timestamp(t[i])), (0, SINT32, semicircles(s["lat"][i])), (1, SINT32, semicircles(s["lon"][i])), (2, UINT16, known("ele", i, altitude)), (5, UINT32, held(UINT32, round(d[i] * 100))), speed_field(known("speed", i)), (7, UINT16, held(UINT16, known("power", i, lambda x: round(x) if x else 0xFFFF))), (3, UINT8, held(UINT8, known("hr", i, round))), (4, UINT8, held(UINT8, known("cad", i, round))), (13, SINT8, held(SINT8, known("temp", i, round))))
        if k == len(plans) - 1:
            whole = np.concatenate([x[2] for x in plans])
            times = np.concatenate([x[1] for x in plans])
            lats, lons = (np.concatenate([x[0][c] for x in plans]) for c in ("lat", "lon"))
            for p in snap(whole, list(course_points)):
                i = p["index"]
                w.add(COURSE_POINT, (1, UINT32, timestamp(times[i])), (2, SINT32, semicircles(lats[i])), (3, SINT32, semicircles(lons[i])), (4, UINT32, round(whole[i] * 100)), (5, ENUM, POINT_TYPE[p.get("type", "generic")]), (6, STRING, whole_name(p.get("name", ""))))
        w.add(EVENT, (253, UINT32, timestamp(t[-1])), (0, ENUM, 0), (1, ENUM, 9 if k == len(plans) - 1 else 4))
    return w.done()


def to_fit(df: DataFrame, start_ms: int, sport: str = "cycling") -> DataFrame:
    """track_id, fit (binary): each track as a course."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq", kind="stable")
        a = {c: p[c].to_numpy(dtype=float) for c in p.columns if c not in ("track_id", "seq")}
        computed = np.where(np.isnan(a["pComputedPower"]) | (a["pComputedPower"] == 0), a["pInputPower"], a["pComputedPower"])
        step = np.diff(a["elevation"])
        s = {"lat": np.degrees(a["latitude"]), "lon": np.degrees(a["longitude"]), "ele": a["elevation"], "time": a["time"], "distance": a["distance"], "speed": a["speed"], "power": computed, "hr": a["heartRate"], "cad": a["cadence"], "temp": a["temperature"], "gain": float(step[step > 0].sum()), "loss": float(step[step < 0].sum())}
        name = str(p["track_id"].iloc[0])
        return pd.DataFrame({"track_id": [name], "fit": [encode(name, [s], start_ms, sport)]})

    names = ["latitude", "longitude", "elevation", "time", "distance", "speed", "pComputedPower", "pInputPower", "heartRate", "cadence", "temperature"]
    return df.select("track_id", "seq", *names).groupBy("track_id").applyInPandas(run, "track_id string, fit binary")
