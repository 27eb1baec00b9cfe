"""Queries over events whose keys go far beyond those of the test tables, against their SQL."""

import pytest

import __spark_entry__ as entry

EVENTS = """select i::bigint as event_id, timestamp '2024-01-05' + i * interval 37 minute as ts, {user} as user_id, 'view' as event_type, (i * 37 % 500 / 8.0)::double as value, '{{}}' as props from range(600) t(i)"""


def agree(spark, folder, name, user):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"copy ({EVENTS.format(user=user)}) to '{folder}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{folder}/events.parquet'")
    sql = entry.oracle_sql()[name]
    df = entry.queries()[name](spark, str(folder))
    names = sorted(df.columns)
    want = c.sql("select " + ", ".join(f'"{n}"' for n in names) + f" from ({sql})").fetchall()
    assert len(want) == 600
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["spz_position", "spz_opacity_color_scale", "spz_quat"])
@pytest.mark.parametrize("user", ["(i * 151)::bigint", "(case when i % 7 = 0 then null else -i * i * 997 end)::bigint", "(i + 1800)::bigint"])
def test_positions_beyond_one_packet(spark, tmp_path, name, user):
    agree(spark, tmp_path, name, user)
