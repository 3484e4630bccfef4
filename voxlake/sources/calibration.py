"""Camera calibration from YAML: intrinsics, and the camera's pose in the scanner's frame, which is inverted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from ..operators.camera import Camera
from ..storage import load_file


def rotation_of(w: float, x: float, y: float, z: float) -> np.ndarray:
    n = (w * w + x * x + y * y + z * z) ** 0.5
    w, x, y, z = w / n, x / n, y / n, z / n
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def camera(k, dist, size, quaternion_wxyz, translation) -> Camera:
    """A camera from its matrix, distortion, size, and pose in the scanner's frame."""
    r = rotation_of(*quaternion_wxyz).T
    t = -r @ np.asarray(translation, float)
    return Camera(k[0][0], k[1][1], k[0][2], k[1][2], size[0], size[1], tuple(dist), tuple(map(tuple, r.tolist())), tuple(t.tolist()))


def load_yaml(text: str | None) -> dict | None:
    """A calibration document, or None where there is none and clouds stay gray."""
    if not text:
        return None
    import yaml

    return yaml.safe_load(text)


def load_calibration(intrinsics: str | None, extrinsics: str | None) -> Camera | None:
    """A camera from its two documents (text); None if one is missing, and clouds stay gray."""
    inner, outer = load_yaml(intrinsics), load_yaml(extrinsics)
    if inner is None or outer is None:
        return None
    m = inner["camera_matrix"]["data"]
    q, t = outer["rotation"], outer["translation"]
    k1, k2, p1, p2, k3 = (*inner["distortion_coefficients"]["data"], 0.0, 0.0, 0.0, 0.0, 0.0)[:5]
    return camera([m[0:3], m[3:6], m[6:9]], (k1, k2, p1, p2, k3), (inner["image_width"], inner["image_height"]), (q["w"], q["x"], q["y"], q["z"]), (t["x"], t["y"], t["z"]))


def read_calibration(spark: SparkSession, folder: str) -> Camera | None:
    """The camera of a folder's intrinsics.yaml and extrinsics.yaml, None unless both are there."""
    text = [load_file(spark, f"{folder.rstrip('/')}/{name}.yaml") for name in ("intrinsics", "extrinsics")]
    return load_calibration(*[x and x.decode() for x in text])
