"""SPZ packets and their GLB container, as kernels over columns of one tile."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

from .frames import node_matrix

# Fixed values of the stream format.
MAGIC, VERSION, FRACTION_BITS = 0x5053474E, 3, 12
COLOR_SCALE, SQRT1_2 = 0.15, np.sqrt(0.5)
LIMIT = (1 << 23) - 1


def half_even(v: np.ndarray) -> np.ndarray:
    """Rounds to the nearest integer, halves (within 1e-12) to the even one."""
    low = np.floor(v)
    part = v - low
    even = np.where(low % 2 == 0, low, low + 1)
    return np.where(np.abs(part - 0.5) <= 1e-12, even, np.where(part < 0.5, low, low + 1))


def _byte(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0, 255).astype(np.uint8)


def positions(xyz: np.ndarray, translation, tile: str = "") -> np.ndarray:
    """Signed 24-bit little-endian fixed point of the local positions."""
    local = (xyz.astype(np.float64) - np.asarray(translation, np.float64)).astype(np.float32).astype(np.float64)
    v = half_even(local * (1 << FRACTION_BITS))
    if len(v) and not np.abs(v).max() <= LIMIT:
        raise ValueError(f"tile {tile}: a position is outside the range of 24-bit fixed point")
    return (v.astype(np.int64) & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 3, 4)[:, :, :3]


def parts(xyz: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by the cubes of half the range that fixed point has: (the cube's centre, its rows).  What is stored is the same for
    any centre, as these are whole numbers and local positions of a cube are exact."""
    size = float(1 << (23 - FRACTION_BITS))
    cube, of = np.unique(np.rint(xyz.astype(np.float64) / size), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    return list(zip(cube * size, np.split(order, np.cumsum(np.bincount(of.ravel(), minlength=len(cube)))[:-1])))


def opacities(v: np.ndarray) -> np.ndarray:
    return _byte(half_even(np.clip(v.astype(np.float64), 0, 1) * 255))


def colors(v: np.ndarray) -> np.ndarray:
    return _byte(half_even(v.astype(np.float64) * (COLOR_SCALE * 255) + 127.5))


def scales(v: np.ndarray) -> np.ndarray:
    return _byte(half_even((v.astype(np.float64) + 10) * 16))


def harmonics(v: np.ndarray, bits: int) -> np.ndarray:
    bucket = 1 << (8 - bits)
    return _byte(np.floor((half_even(v.astype(np.float64) * 128 + 128) + bucket / 2) / bucket) * bucket)


def quaternions(q: np.ndarray) -> np.ndarray:
    """Smallest three: 2 bits for the largest component, then sign and 9 bits for each other one."""
    q = q.astype(np.float64)
    length = (q * q).sum(1, keepdims=True)
    q = np.where(length < 1e-40, [0.0, 0.0, 0.0, 1.0], q / np.sqrt(np.where(length < 1e-40, 1, length)))
    largest = np.argmax(np.abs(q), 1)
    flip = q[np.arange(len(q)), largest] < 0
    out = largest.astype(np.uint64)
    for k in range(4):
        use = largest != k
        size = np.minimum(511, np.floor(511 * (np.abs(q[:, k]) / SQRT1_2) + 0.5)).astype(np.uint64)
        sign = ((q[:, k] < 0) ^ flip).astype(np.uint64)
        out = np.where(use, (out << np.uint64(10)) | (sign << np.uint64(9)) | size, out)
    return out.astype("<u4").view(np.uint8).reshape(-1, 4)


def packet(xyz, opacity, sh, scale, quat, translation, sh1_bits: int = 8, rest_bits: int = 8, tile: str = "") -> bytes:
    """The uncompressed stream: header, then each attribute's column."""
    n, degree = len(xyz), {3: 0, 12: 1, 27: 2, 48: 3}[sh.shape[1]]
    head = struct.pack("<IIIBBBB", MAGIC, VERSION, n, degree, FRACTION_BITS, 0, 0)
    rest = sh[:, 3:]
    parts = [positions(xyz, translation, tile), opacities(opacity), colors(sh[:, :3]), scales(scale), quaternions(quat), np.concatenate([harmonics(rest[:, :9], sh1_bits), harmonics(rest[:, 9:], rest_bits)], 1)]
    return head + b"".join(p.tobytes() for p in parts)


def compress(raw: bytes, level: int = 9) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31, 9)
    return c.compress(raw) + c.flush()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    """What a packet holds, as stored integers and decoded positions; for tests and audits."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    magic, version, n, degree, bits, _, _ = struct.unpack("<IIIBBBB", raw[:16])
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a version 3 stream")
    at, out = 16, {"degree": degree}
    for name, width in (("position", 9), ("opacity", 1), ("color", 3), ("scale", 3), ("rotation", 4), ("sh", 3 * ((degree + 1) ** 2 - 1))):
        out[name] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
    if at != len(raw):
        raise ValueError("wrong length")
    p = out["position"].reshape(n, 3, 3).astype(np.int64)
    p = p[..., 0] | p[..., 1] << 8 | p[..., 2] << 16
    out["xyz"] = np.where(p > LIMIT, p - (1 << 24), p) / (1 << bits)
    return out


def glb(spz: bytes, n: int, degree: int, translation, frame: str, color_space: str = "srgb_rec709_display") -> bytes:
    """A binary glTF with the packet as its only buffer view; accessors are placeholders for the decoder."""
    accessors, attributes = [], {}

    def accessor(name: str, kind: str, component: int = 5126, **more) -> None:
        attributes[name] = len(accessors)
        accessors.append({"componentType": component, "count": n, "type": kind, **more})

    accessor("POSITION", "VEC3", min=[-1.0] * 3, max=[1.0] * 3)
    accessor("COLOR_0", "VEC4", 5121, normalized=True)
    prefix = "KHR_gaussian_splatting"
    accessor(f"{prefix}:SCALE", "VEC3")
    accessor(f"{prefix}:ROTATION", "VEC4")
    for d in range(1, degree + 1):
        for k in range(2 * d + 1):
            accessor(f"{prefix}:SH_DEGREE_{d}_COEF_{k}", "VEC4")
    codec = f"{prefix}_compression_spz_2"
    splatting = {"kernel": "ellipse", "projection": "perspective", "extensions": {codec: {"bufferView": 0}}}
    if color_space != "srgb_rec709_display":
        splatting["colorSpace"] = color_space
    size = len(spz) + -len(spz) % 4
    document = {
        "asset": {"version": "2.0"},
        "extensionsUsed": [prefix, codec, "KHR_materials_unlit"],
        "extensionsRequired": [prefix, codec],
        "scene": 0,
        "scenes": [{"nodes": [0]}],
        "nodes": [{"mesh": 0, "matrix": node_matrix(translation, frame)}],
        "materials": [{"extensions": {"KHR_materials_unlit": {}}}],
        "meshes": [{"primitives": [{"mode": 0, "attributes": attributes, "material": 0, "extensions": {prefix: splatting}}]}],
        "buffers": [{"byteLength": size}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": len(spz)}],
        "accessors": accessors,
    }
    text = json.dumps(document, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body = spz + bytes(size - len(spz))
    return b"".join([struct.pack("<4sII", b"glTF", 2, 28 + len(text) + size), struct.pack("<I4s", len(text), b"JSON"), text, struct.pack("<I4s", size, b"BIN\0"), body])
