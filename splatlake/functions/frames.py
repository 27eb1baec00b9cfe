"""Source coordinate frames: detection from comments, rotations to glTF Y-up and tile Z-up."""

from __future__ import annotations

import re

# Rotation rows by frame, to glTF Y-up and to tile Z-up.
CAMERA, Z_UP, GLTF_Y_UP = "camera_y_down_z_forward", "z_up", "gltf_y_up"
TO_GLTF = {
    CAMERA: ((1, 0, 0), (0, -1, 0), (0, 0, -1)),
    Z_UP: ((1, 0, 0), (0, 0, 1), (0, -1, 0)),
    GLTF_Y_UP: ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
}
TO_TILE = {
    CAMERA: ((1, 0, 0), (0, 0, 1), (0, -1, 0)),
    Z_UP: ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    GLTF_Y_UP: ((1, 0, 0), (0, 0, -1), (0, 1, 0)),
}
# Patterns over the joined lower-case comments, in order of precedence.
PATTERNS = (
    (CAMERA, "ply_comment", (r"\bcamera[-_\s]?style\b", r"\bcamera[-_\s]?coordinates?\b", r"\bcolmap\b", r"\by[-_\s]?down\b", r"\bz[-_\s]?forward\b")),
    (GLTF_Y_UP, "ply_comment", (r"\bgltf[-_\s]?y[-_\s]?up\b", r"\bsource[-_\s]?coordinate[-_\s]?system\s*[:=]?\s*gltf\b")),
    (Z_UP, "ply_comment", (r"\bz[-_\s]?up\b", r"\bup[-_\s]?axis\s*[:=]?\s*z\b", r"\baxis[-_\s]?up\s*[:=]?\s*z\b", r"\bcoordinate[-_\s]?system\s*[:=]?.*\bz\b.*\bup\b")),
    (Z_UP, "ply_comment_projected_crs", (r"\bepsg\b", r"\bproj(?:4|ection)?\b", r"\bcrs\b", r"\butm\b", r"\boffsetx\b", r"\boffsety\b", r"\boffsetz\b")),
)


def detect(comments: list[str]) -> tuple[str, str]:
    """The frame and what says so."""
    text = "\n".join(c for c in (str(c or "").strip().lower() for c in comments) if c)
    for frame, source, patterns in PATTERNS:
        if any(re.search(p, text, re.ASCII) for p in patterns):
            return frame, source
    return CAMERA, "default"


def rotate(rows, v) -> list[float]:
    return [sum(r * x for r, x in zip(row, v)) for row in rows]


def tile_box(box: list[float], frame: str) -> list[float]:
    """A 12-number box, centre and half axes, in tile Z-up."""
    return [c for k in range(0, 12, 3) for c in rotate(TO_TILE[frame], box[k : k + 3])]


def node_matrix(translation, frame: str) -> list[float]:
    """The glTF node's matrix, in column order."""
    r, t = TO_GLTF[frame], rotate(TO_GLTF[frame], translation)
    return [float(r[i][j]) if i < 3 else 0.0 for j in range(3) for i in range(4)] + [*map(float, t), 1.0]


def box_of(low, high) -> list[float]:
    """Centre and half axes of an axis-aligned box; half extents are at least 1e-6."""
    half = [max((b - a) / 2, 1e-6) for a, b in zip(low, high)]
    return [*((a + b) / 2 for a, b in zip(low, high)), half[0], 0.0, 0.0, 0.0, half[1], 0.0, 0.0, 0.0, half[2]]
