import numpy as np
import pytest

from splatlake.sources import ply
from splatlake.sources.synthetic import cloud

NAMES = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]


def header(properties=NAMES, n=2, form="binary_little_endian", kind="float", end="\n", more=()):
    lines = ["ply", f"format {form} 1.0", *more, f"element vertex {n}", *(f"property {kind} {p}" for p in properties), "end_header"]
    return (end.join(lines) + end).encode()


def test_headers():
    for form in ("ascii", "binary_little_endian"):
        for end in ("\n", "\r\n"):
            h = ply.parse_header(header(form=form, end=end, more=["comment Z-up here"]))
            assert (h.count, h.degree, h.comments) == (2, 0, ["Z-up here"])
    for bad in (header(form="binary_big_endian"), b"nope\n", header()[:-12], header().replace(b"property float x", b"property list uchar int x"), header().replace(b"float x", b"quad x"), header().replace(b"element vertex", b"element face")):
        with pytest.raises(ply.PlyError):
            ply.parse_header(bad)


@pytest.mark.parametrize(("names", "said"), [([n for n in NAMES if n != "f_dc_1"], "f_dc_1"), ([n for n in NAMES if n != "scale_2"], "scale_"), ([n for n in NAMES if n != "rot_3"], "rot_"), (NAMES + [f"f_rest_{k}" for k in range(10)], "f_rest")])
def test_layouts_that_are_wrong(names, said):
    with pytest.raises(ply.PlyError, match=said):
        ply.layout(ply.parse_header(header(names)))


def test_binary_round_trip(spark, tmp_path):
    table = cloud(spark, 500).orderBy("splat_id").toArrow()
    path = str(tmp_path / "a.ply")
    ply.write_ply(path, table)
    back = ply.read_splats(spark, path).orderBy("splat_id").toArrow()
    for c in ("x", "y", "z", "s0", "s1", "s2", "opacity", "qx", "qw"):
        assert np.allclose(table.column(c).to_numpy(), back.column(c).to_numpy(), atol=1e-5), c
    ply.register(spark)
    parts = spark.read.format("splat_ply").option("columns", "x,nx").option("partitionRows", "100").load(path)
    assert parts.columns == ["splat_id", "x", "nx"] and parts.rdd.getNumPartitions() == 5
    assert sorted(r.splat_id for r in parts.select("splat_id").collect()) == list(range(500))
    with open(path, "r+b") as f:
        f.truncate(200 + len(header()))
    with pytest.raises(Exception, match="shorter"):
        ply.read_splats(spark, path).count()


def test_rest_order_and_newline_payload(spark, tmp_path):
    names = [*NAMES, *(f"f_rest_{k}" for k in range(9)), "label"]
    rows = np.zeros(1, [(n, "<f4") for n in names])
    for k in range(9):
        rows[f"f_rest_{k}"] = k
    rows.view(np.uint8)[0] = 10  # the data begin with a newline byte
    path = tmp_path / "b.ply"
    path.write_bytes(header(names, 1) + rows.tobytes())
    got = ply.read_splats(spark, str(path)).first()
    assert list(got.sh)[3:] == [0, 3, 6, 1, 4, 7, 2, 5, 8] and got.x == rows["x"][0]


def test_ascii(spark, tmp_path):
    path = tmp_path / "c.ply"
    values = " ".join(str(k) for k in range(14)) + "\n" + "\t".join("1" for _ in range(7)) + "\n\n" + " ".join("2" for _ in range(7)) + " 99 98\n"
    path.write_bytes(header(form="ascii") + values.encode())
    rows = ply.read_splats(spark, str(path)).orderBy("splat_id").collect()
    assert [(r.x, r.s0) for r in rows] == [(0.0, 7.0), (1.0, 2.0)]
    path.write_bytes(header(form="ascii", n=3) + values.encode())
    with pytest.raises(Exception, match="fewer values"):
        ply.read_splats(spark, str(path)).count()
    path.write_bytes(header(n=0))
    with pytest.raises(ply.PlyError):
        ply.read_splats(spark, str(path))


def test_canonical_values(spark):
    from splatlake.functions import canonical as C

    names = "splat_id long, x float, y float, z float, op_logit float, s0 float, s1 float, s2 float, r0 float, r1 float, r2 float, r3 float, f_dc_0 float, f_dc_1 float, f_dc_2 float"
    raw = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, *map(float, r), 0.0, 0.0, 0.0) for k, r in enumerate(((2, 0, 0, 0), (-1, 1, 1, 1), (0, 0, 0, 0)))], names)
    rows = C.canonicalise(raw, linear_scale=True).orderBy("splat_id").collect()
    assert [(r.qx, r.qy, r.qz, r.qw) for r in rows] == [(0, 0, 0, 1), (-0.5, -0.5, -0.5, 0.5), (0, 0, 0, 0)]
    assert rows[0].opacity == 0.5 and rows[0].s0 == np.float32(np.log(1e-8)) and rows[0].s1 == 0
    assert [r.e for r in C.canonicalise(raw).select(C.covariance()[0].alias("e")).collect()][2] == 1.0  # no rotation: identity


@pytest.mark.parametrize("in_place", [None, False])
def test_written_without_the_driver(spark, tmp_path, monkeypatch, in_place):
    splats = cloud(spark, 3000).repartition(5, "x")
    table = splats.orderBy("splat_id").toArrow()
    ply.write_ply(str(tmp_path / "want.ply"), table)

    def refuse(*_, **__):
        raise AssertionError("rows go through the driver")

    monkeypatch.setattr(type(splats), "toLocalIterator", refuse)
    monkeypatch.setattr(type(splats), "toArrow", refuse)
    assert ply.write_splats(splats, f"file://{tmp_path}/got.ply", in_place) == 3000
    assert (tmp_path / "got.ply").read_bytes() == (tmp_path / "want.ply").read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["got.ply", "want.ply"]
    with pytest.raises(ply.PlyError, match="no splats"):
        ply.write_splats(splats.limit(0), str(tmp_path / "none.ply"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["got.ply", "want.ply"]
