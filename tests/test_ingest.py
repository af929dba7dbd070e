"""Keyed tables, stateful ingest, quarantine and one-pass counts."""

import tempfile
from datetime import datetime, timedelta

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from plumbline.sources import landed, stored, tables
from plumbline.sources.keyed import KeyedTable
from plumbline.streaming import ingest

START = datetime(2024, 1, 1)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="ingest-")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_upsert_rewrites_touched_buckets_only(spark, folder):
    table = KeyedTable(spark, folder, ["ticker"], buckets=8)
    assert table.read() is None
    schema = "ticker string, name string, cik string, seq int"
    first = spark.createDataFrame([(f"T{i}", f"n{i}", f"c{i}", 0) for i in range(40)], schema)
    table.upsert(first, ["seq"])
    before = dict(table.manifest()["files"])
    files = stored.listing(spark, f"{folder}/data")
    landing = spark.createDataFrame([("T1", "a", None, 1), ("T1", "b", None, 2), ("new", "x", "y", 1)], schema)
    done = table.upsert(landing, ["seq"])
    after = table.manifest()["files"]
    assert 1 <= len(done["touched"]) <= 2
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in done["touched"]}
    assert set(files) <= set(stored.listing(spark, f"{folder}/data"))
    got = {r.ticker: (r.name, r.cik) for r in table.read().collect()}
    assert len(got) == 41 and got["T1"] == ("b", None) and got["T2"] == ("n2", "c2") and got["new"] == ("x", "y")
    # untouched buckets are not read for a change
    assert len(table.read(done["touched"]).inputFiles()) < len(table.read().inputFiles())
    table.vacuum()
    assert {r.ticker: (r.name, r.cik) for r in table.read().collect()} == got


def test_field_mask_tells_null_from_unset(spark, folder):
    table = KeyedTable(spark, folder, ["ticker"], buckets=4)
    schema = "ticker string, name string, cik string, fields array<string>"
    full = ["name", "cik"]
    table.upsert(spark.createDataFrame([("A", "a", "1", full), ("B", "b", "2", full)], schema), ["name"], "fields")
    table.upsert(spark.createDataFrame([("A", "z", None, ["name"]), ("B", "z", None, full), ("C", None, "3", ["cik"])], schema), ["fields"], "fields")
    assert rows_of(table.read().select("ticker", F.coalesce("name", F.lit("-")), F.coalesce("cik", F.lit("-")))) == [("A", "z", "1"), ("B", "z", "-"), ("C", "-", "3")]


def test_second_writer_of_a_version_fails(spark, folder):
    table = KeyedTable(spark, folder, ["k"], buckets=2)
    table.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), ["v"])
    stale = table.manifest()
    table.upsert(spark.createDataFrame([(2, "b")], "k int, v string"), ["v"])
    with pytest.raises(Py4JJavaError, match="exist"):
        table._commit(stale | {"version": stale["version"] + 1})
    assert rows_of(table.read()) == [(1, "a"), (2, "b")]
    assert table.upsert(spark.createDataFrame([], "k int, v string"), ["v"])["touched"] == []


def land(spark, folder, name, rows):
    frame = spark.createDataFrame(rows, "url string, ts timestamp, seq int")
    frame.coalesce(1).write.mode("append").parquet(folder)


def test_replayed_and_late_files_change_nothing(spark, folder):
    def run():
        stream = ingest.file_stream(spark, f"{folder}/landing", "url string, ts timestamp, seq int")
        first = ingest.first_seen(stream, ["url"], "ts", ["ts", "seq"], "2 days", 3)
        return ingest.run_table(first, f"{folder}/table", f"{folder}/checkpoint")

    day = lambda n: START + timedelta(days=n)
    original = [("a", day(1), 1), ("a", day(0), 2), ("b", day(2), 3), (None, day(1), 4)]
    land(spark, f"{folder}/landing", "1", original)
    run()
    stored_rows = {(r.url, r.seq) for r in spark.read.parquet(f"{folder}/table").collect()}
    assert stored_rows == {("a", 2), ("b", 3), (None, 4)}
    land(spark, f"{folder}/landing", "2", original)
    progress = run()
    assert {(r.url, r.seq) for r in spark.read.parquet(f"{folder}/table").collect()} == stored_rows
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) == 3
    land(spark, f"{folder}/landing", "3", [("c", day(30), 5)])
    run()
    # a row far behind the newest one, and old keys that have left the state
    land(spark, f"{folder}/landing", "4", [("late", day(3), 6), ("a", day(0), 7)])
    progress = run()
    assert {(r.url, r.seq) for r in spark.read.parquet(f"{folder}/table").collect()} == stored_rows | {("c", 5)}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


def test_late_rows_are_quarantined_and_counted(spark, folder):
    day = lambda n: START + timedelta(days=n)

    def run():
        stream = ingest.file_stream(spark, f"{folder}/landing", "url string, ts timestamp, seq int")
        ingest.run_with_quarantine(stream, f"{folder}/table", f"{folder}/late", f"{folder}/checkpoint", "ts", 7)

    land(spark, f"{folder}/landing", "1", [("a", day(0), 1), ("b", day(20), 2), ("c", None, 3)])
    run()
    land(spark, f"{folder}/landing", "2", [("d", day(12), 4), ("e", day(14), 5)])
    run()
    seqs = lambda name: {r.seq for r in spark.read.parquet(f"{folder}/{name}").collect()}
    assert seqs("table") == {2, 3, 5} and seqs("late") == {1, 4}
    counts = spark.read.parquet(f"{folder}/table_counts").orderBy("batch").collect()
    assert [(r.rows, r.late) for r in counts] == [(3, 1), (2, 1)] and counts[-1].newest == day(20)


def test_refresh_counts_read_each_side_once(spark, folder):
    schema = "url string, source string, seq int"
    existing = spark.createDataFrame([("a", "x", 0), ("b", "y", 0), (None, "x", 0)], schema)
    existing.write.parquet(f"{folder}/stored")
    incoming = spark.createDataFrame([("a", "x", 1), ("c", "x", 1), ("c", "x", 2), ("d", "y", 1), ("d", "x", 2), ("e", "z", 1)], schema)
    incoming.write.parquet(f"{folder}/landing")
    out = tables.refresh_counts(spark.read.parquet(f"{folder}/stored"), spark.read.parquet(f"{folder}/landing"), ["url"], ["source"])
    assert rows_of(out) == [("x", 4, 2, 2, 4), ("y", 1, 1, 0, 1), ("z", 1, 0, 1, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "Join" not in plan


def test_broken_documents_are_set_aside(spark):
    good = '{"us-gaap": {"Revenues": {"units": {"USD": [{"fy": 2020, "fp": "FY", "end": "2020-12-31", "filed": "2021-02-01", "val": 5}]}}}}'
    raw = spark.createDataFrame([("1", good), ("2", good[:50]), ("3", "no json"), ("4", None)], "cik string, facts string")
    assert [r.cik for r in landed.broken_documents(raw, "facts").orderBy("cik").collect()] == ["2", "3"]
    assert [(r.cik, r.val) for r in landed.explode_facts(raw).filter("val IS NOT NULL").collect()] == [("1", 5)]
