"""Streams, providers, and the driver's contract."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from folioflow.sources import providers as P
from folioflow.streaming import ingest as St

DDL = "id string, at timestamp, ocr_text string, status string"


def feed(path, name, rows):
    (path / name).write_text("\n".join(json.dumps({"id": i, "at": f"2026-01-01T{h:02}:00:00Z", "ocr_text": t, "status": s}) for i, h, t, s in rows))


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_stream_drops_repeats_and_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", "a.json", [("1", 1, "Ａ b", "ready"), ("2", 1, "a-B", "ready"), ("3", 2, "c", "failed")])
    src = lambda: St.arriving(spark, str(tmp_path / "in"), DDL)
    run(St.first_within(St.fingerprinted(src()), "at").select("id"), "firsts", "append")
    assert {r["id"] for r in spark.table("firsts").collect()} in ({"1", "3"}, {"2", "3"})
    run(St.counts(src(), "at", "status"), "counts", "complete")
    assert {(r["start"], r["status"], r["n"]) for r in spark.table("counts").collect()} == {(datetime.datetime(2026, 1, 1, 1), "ready", 2), (datetime.datetime(2026, 1, 1, 2), "failed", 1)}
    run(St.sessions(src(), "at", "status"), "sessions", "complete")
    assert sorted((r["status"], r["n"]) for r in spark.table("sessions").collect()) == [("failed", 1), ("ready", 2)]


def test_stream_of_snapshots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", "a.json", [("1", 1, "x", "ready"), ("2", 2, "X!", "ready")])
    write = St.snapshots(str(tmp_path / "out"), ["at", "id"])
    q = St.fingerprinted(St.arriving(spark, str(tmp_path / "in"), DDL)).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["id"] for r in write.read(spark).collect()] == ["2"]


def test_snapshots_survive_a_restart(spark, tmp_path):
    """A new writer and query go on from what lies in the folder; untouched buckets stay where they were; a batch run again changes nothing."""
    (tmp_path / "in").mkdir()

    def once(name, rows):
        feed(tmp_path / "in", name, rows)
        write = St.snapshots(str(tmp_path / "out"), ["at", "id"], buckets=8)
        q = St.fingerprinted(St.arriving(spark, str(tmp_path / "in"), DDL)).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return write

    once("a.json", [(str(i), 1, f"text {i}", "ready") for i in range(20)])
    write = once("b.json", [("x", 2, "TEXT 3", "ready"), ("y", 1, "new", "ready")])
    kept = sorted(r["id"] for r in write.read(spark).collect())
    assert kept == sorted([str(i) for i in range(20) if i != 3] + ["x", "y"]) and write.versions(spark) == [0, 1]
    where = [write._manifest(spark, v) for v in (0, 1)]
    assert sum(where[0].get(b) != p for b, p in where[1].items()) <= 2 and St.snapshots(str(tmp_path / "none"), ["at"]).read(spark) is None
    batch = St.fingerprinted(spark.createDataFrame([("x", "TEXT 3"), ("y", "new")], "id string, ocr_text string")).withColumns({"at": F.lit("2026-01-01T02:00:00Z").cast("timestamp"), "status": F.lit("ready")})
    write(batch, 1)
    assert sorted(r["id"] for r in write.read(spark).collect()) == kept


def test_providers_isolate_rows_and_fall_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, path string")

    def read(row):
        if row["path"] == "bad":
            raise OSError("no")
        return {"text": row["path"] + "!", "confidence": 0.5}

    first, last = P.Stub("text string, confidence double", read), P.Stub("text string, confidence double", {"text": "?", "confidence": 0.0})
    out = {r["id"]: (r["text"], r["error"]) for r in P.provide(df, "id", first, ["path"]).collect()}
    assert out == {1: ("a!", None), 2: (None, "OSError: no")}
    both = {r["id"]: r["text"] for r in P.first_available(df, "id", [first, last], ["path"]).collect()}
    assert both == {1: "a!", 2: "?"}
    words = spark.createDataFrame([(1, 0, "low", 0.9, 0.1, 0.1, 0.2, 0.05), (1, 1, "high", 0.9, 0.1, 0.8, 0.2, 0.05)], "page int, line int, text string, confidence double, x double, y double, w double, h double")
    assert [x["text"] for x in P.ocr_lines(words, "page").first()["lines"]] == ["high", "low"]


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and e.entry(spark).count() > 0


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from folioflow.plans import catalogue, forms  # noqa: F401

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in d.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    clean = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    for name, sql in catalogue.ORACLES.items():
        got = catalogue.QUERIES[name](spark, str(d))
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        at = [want.columns.index(c) for c in columns]
        a = sorted((tuple(clean(r[c]) for c in columns) for r in got.collect()), key=str)
        b = sorted((tuple(clean(r[i]) for i in at) for r in want.fetchall()), key=str)
        assert a == b, name


def test_queries_without_sql_run(spark):
    from folioflow.plans import catalogue, forms  # noqa: F401

    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()  # every column is computed


def test_adjacency_draws_each_size_once(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    from folioflow.plans import catalogue

    drawn, real = [], catalogue.Fg.interior_regions
    monkeypatch.setattr(catalogue.Fg, "interior_regions", lambda walls: drawn.append(walls.shape) or real(walls))
    assert len({catalogue._room_edges(6, 5) for _ in range(50)} | {catalogue._room_edges(5, 6) for _ in range(50)}) == 2 and len(drawn) == 2
    sizes = [None, 0, -1, -2, -3, -4, -50, *range(1, 51)]
    rows = [(k, sizes[k % len(sizes)]) for k in range(-300, 2000)] + [(None, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, catalogue.adjacency_edges(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.sql(catalogue.ORACLES["adjacency_edges"]).fetchall(), key=str)
