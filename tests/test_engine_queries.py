from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from packetloom import session
from packetloom.operators import seq
from packetloom.plans import engine_queries


def write(spark, folder, rows):
    """events.parquet of (event_id, user_id, event_type)."""
    start = datetime(2024, 1, 1)
    data = [(i, start + timedelta(seconds=i), u, t, 1.0) for i, u, t in rows]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(folder, name, columns):
    with duckdb.connect() as con:
        con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
        return con.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({engine_queries.ORACLES[name]})").fetchall()


@pytest.mark.parametrize("name", ["eng_remap"])
def test_clock_that_wraps(spark, tmp_path, name):
    rows = [(600_000 * k + j, u, t) for k in range(20) for j, (u, t) in enumerate([(0, "click"), (4, "purchase"), (4, "error"), (0, "error"), (4, "view"), (1, "purchase")])]
    folder = write(spark, tmp_path / "e", rows)  # 3.6e10 ticks: the clock of 33 bits wraps four times
    got = engine_queries.QUERIES[name](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(by_sql(folder, name, got.columns))


def test_unwrap_keeps_rows_without_a_value(spark):
    true = [None, 5, None, 2**32, 2**33 - 1, None, 2**33 + 7, 2**33 + 9]
    df = spark.createDataFrame([(1, i, None if x is None else x % 2**33) for i, x in enumerate(true)], "k int, i long, raw long")
    assert [x.t for x in seq.unwrap(df, ["k"], "i", "raw", out="t", empty=True).orderBy(F.col("i")).collect()] == true


@pytest.mark.parametrize("form", ["file:{}", "file://{}", "{}", "viewfs://mounted/shared"])
def test_shared_folder_in_any_form(spark, tmp_path, monkeypatch, form):
    (tmp_path / "shared").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.mounted.link./shared", f"file://{tmp_path}/shared")
    monkeypatch.setattr(session, "scratch_root", lambda _: form.format(tmp_path / "shared"))
    monkeypatch.setattr(engine_queries, "scratch_root", session.scratch_root, raising=False)
    folder = write(spark, tmp_path / "e", [(i, i * 7, ["click", "purchase", "signup", "error"][i % 4]) for i in range(1200)])
    for name in ("eng_file_packets", "eng_file_losses"):
        got = engine_queries.QUERIES[name](spark, folder)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, by_sql(folder, name, got.columns)))
