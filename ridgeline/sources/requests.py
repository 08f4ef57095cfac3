"""Requests as data: strict JSON settings, admission, and patient fetching of tiles."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import MISSING, fields, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline import options
from ridgeline.options import EnhanceOptions


class Problem(ValueError):
    """A refused request: what is wrong, and where (JSON pointers)."""

    def __init__(self, title: str, errors: dict[str, str] | None = None, status: int = 422):
        super().__init__(f"{title}: {errors}" if errors else title)
        self.title, self.errors, self.status = title, errors or {}, status

    def body(self) -> str:
        return json.dumps({"type": "about:blank", "title": self.title, "status": self.status, "errors": [{"pointer": p, "detail": d} for p, d in self.errors.items()]})


def strict(kind: type, text: str):
    """A settings object from JSON; unknown keys and wrong types are all reported."""
    try:
        data = json.loads(text)
    except ValueError as error:
        raise Problem(f"not JSON: {error}", status=400) from error
    errors: dict[str, str] = {}
    made = _build(kind, data, "", errors)
    if errors:
        raise Problem("invalid settings", errors)
    return made


def _build(kind: type, data, at: str, errors: dict[str, str]):
    if not isinstance(data, dict):
        errors[at or "/"] = "an object is needed"
        return None
    known = {f.name: f for f in fields(kind)}
    values = {}
    for key, value in data.items():
        here = f"{at}/{key}"
        f = known.get(key)
        if f is None:
            errors[here] = "unknown key"
            continue
        usual = f.default if f.default is not MISSING else f.default_factory() if f.default_factory is not MISSING else None
        inner = type(usual) if is_dataclass(usual) else getattr(options, str(f.type).split(" ")[0], None)
        if isinstance(value, dict) and inner and is_dataclass(inner):
            values[key] = _build(inner, value, here, errors)
        elif isinstance(usual, bool) and not isinstance(value, bool):
            errors[here] = "true or false is needed"
        elif isinstance(usual, (int, float)) and not isinstance(usual, bool) and (isinstance(value, bool) or not isinstance(value, (int, float))):
            errors[here] = "a number is needed"
        elif isinstance(usual, str) and not isinstance(value, str):
            errors[here] = "a text is needed"
        else:
            values[key] = tuple(value) if isinstance(value, list) else value
    if errors:
        return None
    try:
        return kind(**values)
    except ValueError as error:
        errors[at or "/"] = str(error)
        return None


def enhance_options(text: str) -> EnhanceOptions:
    return strict(EnhanceOptions, text)


def admit(stats: DataFrame, most: int = 500_000) -> DataFrame:
    """Statistics with point_bound; an error if all tracks together may exceed `most` points."""
    from ridgeline.operators.resample import densified_bound

    bounded = densified_bound(stats)
    total = bounded.agg(F.sum("point_bound").alias("n")).first()["n"] or 0
    if total > most:
        raise Problem(f"up to {total} points would be simulated; at most {most} are allowed", status=413)
    return bounded


def select_tracks(df: DataFrame, kinds: str = "all", index: int | None = None, most_points: int | None = None) -> DataFrame:
    """Points of the tracks or routes asked for, or of the index-th only; an error if there are too many."""
    if kinds not in ("all", "tracks", "routes"):
        raise Problem("invalid selection", {"/kinds": "all, tracks or routes"}, 400)
    d = df if kinds == "all" else df.where(F.col("kind") == {"tracks": "TRACK", "routes": "ROUTE"}[kinds])
    d = d if index is None else d.where(F.col("track_idx") == index)
    if most_points is not None and (n := d.limit(most_points + 1).count()) > most_points:
        raise Problem(f"more than {most_points} points ({n} or more)", status=413)
    return d


def patient(fetch: Callable[[], tuple[int, bytes, dict]], attempts: int = 6, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body of a request that is repeated on 429 and 503, waiting as told or 1, 2, 4 ... seconds; None on
    any other failure."""
    for k in range(attempts):
        status, body, headers = fetch()
        if 200 <= status < 300:
            return body
        if status not in (429, 503) or k == attempts - 1:
            return None
        told = headers.get("Retry-After", "")
        sleep(float(told) if told.isdigit() else 2.0**k)
    return None
