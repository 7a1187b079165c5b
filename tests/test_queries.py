"""Every registered query of the library against its SQL counterpart in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from trailframe.plans import registry


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([str(r[i]) for i in order] for r in found))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    found = duck.execute(registry.ORACLE[name])
    assert got == rows([c[0] for c in found.description], found.fetchall())


def test_a_spike_does_not_hide_the_fix_after_it(spark):
    from trailframe.operators import tracks

    # the second fix jumps 11 km in 10 s; the third is near the first again, the fourth has the third's time
    points = [(1, 0, 1, 0.0, 0.0), (1, 10, 2, 0.1, 0.0), (1, 20, 3, 0.0001, 0.0), (1, 20, 4, 0.0001, 0.0)]
    df = spark.createDataFrame([(t, s * 1_000_000, e, la, lo) for t, s, e, la, lo in points], "track_id long, ts_us long, event_id long, lat double, lon double")
    assert sorted(r.event_id for r in tracks.accepted(df).collect()) == [1, 3]


def test_accepted_counts(spark, sf_dir):
    df = registry.QUERIES["accepted_fixes"](spark, sf_dir)
    assert 0 < df.count() <= spark.read.parquet(f"{sf_dir}/events.parquet").count()
