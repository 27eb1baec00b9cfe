"""The command line: what a bad input ends in, and a whole conversion of a file written by the engine."""

import json
import os

from splatlake import cli
from splatlake.plans import queries
from splatlake.sources import ply


def test_bad_input_is_an_exit_code(spark, tmp_path, capsys):
    bad = tmp_path / "bad.ply"
    bad.write_bytes(b"not a ply")
    assert cli.main([str(bad), str(tmp_path / "out")]) == 2 and "error:" in capsys.readouterr().err
    assert cli.main([str(tmp_path / "none.ply"), str(tmp_path / "out")]) == 2


def test_written_splats_come_back(spark, tmp_path):
    cloud = queries.cloud3(spark, "/root/testdata/sf0.001").repartition(5)
    path = f"file://{tmp_path}/cloud.ply"
    n = ply.write_splats(cloud, path)
    back = ply.read_splats(spark, path)
    assert back.count() == n == cloud.count()
    want = {r.splat_id: (r.x, r.y, r.z, *r.sh) for r in cloud.collect()}
    assert {r.splat_id: (r.x, r.y, r.z, *r.sh) for r in back.collect()} == want
    out = tmp_path / "tiles"
    assert cli.main([f"{tmp_path}/cloud.ply", str(out), "--max-depth", "1"]) == 0
    assert json.load(open(os.path.join(out, "tileset.json")))["asset"]
