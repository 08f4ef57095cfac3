"""The window over a track's points in order. Windows need a session, so they are made when used."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec


def in_order() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("seq")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)
