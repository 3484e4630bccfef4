"""A registry of pose estimators, functions of (points, imu) that return poses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.motion import deskew, estimate_poses

_BACKENDS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def keep(f):
        _BACKENDS[name] = f
        return f

    return keep


def get_backend(name: str) -> Callable[..., DataFrame]:
    if name not in _BACKENDS:
        raise KeyError(f"no backend {name}; there are {sorted(_BACKENDS)}")
    return _BACKENDS[name]


@register("scan_to_map")
def scan_to_map(points: DataFrame, imu: DataFrame | None = None, **options) -> DataFrame:
    return estimate_poses(points, **options)


@register("deskewed_scan_to_map")
def deskewed_scan_to_map(points: DataFrame, imu: DataFrame, **options) -> DataFrame:
    return estimate_poses(deskew(points, imu), **options)
