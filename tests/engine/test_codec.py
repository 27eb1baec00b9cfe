import json
import struct

import numpy as np
import pytest

from splatlake.functions import spz


def test_rounding():
    assert spz.half_even(np.array([0.5, 1.5, 2.5, -0.5, 127.5, 2.4999999])).tolist() == [0, 2, 2, 0, 128, 2]


def test_hand_computed_bytes():
    assert spz.positions(np.array([[1, -1, 0]], np.float32), [0, 0, 0]).tobytes() == bytes([0, 0x10, 0, 0, 0xF0, 0xFF, 0, 0, 0])
    assert spz.opacities(np.array([0.5])).tolist() == [128]
    assert spz.colors(np.array([0.0])).tolist() == [128]
    assert spz.scales(np.array([-10.0, 0.0, 6.0])).tolist() == [0, 160, 255]
    assert [spz.harmonics(np.array([v]), b)[0] for v in (0.0, 0.1) for b in (8, 4)] == [128, 128, 141, 144]
    assert spz.quaternions(np.array([[0.0, 0, 0, 1]])).tobytes() == bytes([0, 0, 0, 0xC0])
    assert spz.quaternions(np.array([[0.0, 0, 0, 0]])).tobytes() == bytes([0, 0, 0, 0xC0])
    with pytest.raises(ValueError, match="tile 1/2/0/0"):
        spz.positions(np.array([[3000.0, 0, 0]], np.float32), [0, 0, 0], "1/2/0/0")


@pytest.mark.parametrize("degree", [0, 1, 2, 3])
def test_packet_and_container(degree):
    rng = np.random.default_rng(degree)
    n, m = 37, 3 * (degree + 1) ** 2
    xyz = rng.normal(size=(n, 3)).astype(np.float32)
    raw = spz.packet(xyz, rng.random(n), rng.normal(size=(n, m)), rng.normal(size=(n, 3)), rng.normal(size=(n, 4)), [0.5, 0, 0])
    assert len(raw) == 16 + n * (20 + 3 * ((degree + 1) ** 2 - 1))
    back = spz.unpack(spz.compress(raw))
    assert back["degree"] == degree and np.abs(back["xyz"] + [0.5, 0, 0] - xyz).max() <= 0.5 / 4096 + 1e-6
    data = spz.glb(spz.compress(raw), n, degree, [1, 2, 3], "z_up", "lin_rec709_display")
    magic, version, total = struct.unpack("<4sII", data[:12])
    size, kind = struct.unpack("<I4s", data[12:20])
    doc = json.loads(data[20 : 20 + size])
    assert (magic, version, total, kind) == (b"glTF", 2, len(data), b"JSON") and len(data) % 4 == 0
    assert len(doc["accessors"]) == 4 + sum(2 * d + 1 for d in range(1, degree + 1)) and all(a["count"] == n for a in doc["accessors"])
    assert doc["meshes"][0]["primitives"][0]["extensions"]["KHR_gaussian_splatting"]["colorSpace"] == "lin_rec709_display"
    body = data[28 + size :]
    assert spz.unpack(body[: doc["bufferViews"][0]["byteLength"]])["degree"] == degree
