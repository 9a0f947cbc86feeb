import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkrag.sinks import scratch
from sparkrag.streaming import ingest

SCHEMA = "topic_id string, post_id string, posted_at string, post_number int"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_resumed_ingest_adds_each_post_once(spark, tmp_path):
    folder, out, mark = tmp_path / "in", scratch(spark, "posts"), scratch(spark, "checkpoint")
    post = lambda t, p: {"topic_id": t, "post_id": p, "posted_at": p}
    put(folder, "a.json", [post("t", "1"), post("t", "2"), post("t", "2"), post("u", "9")])
    ingest.append_posts(ingest.read_json(spark, str(folder), SCHEMA), out, mark)
    put(folder, "b.json", [post("t", "2"), post("t", "3")])
    for _ in range(2):
        ingest.append_posts(ingest.read_json(spark, str(folder), SCHEMA), out, mark)
    got = {r["post_id"]: r["post_number"] for r in spark.read.parquet(out).collect()}
    assert got == {"1": 1, "2": 2, "3": 3, "9": 1} and spark.read.parquet(out).count() == 4


def test_sessions_are_strict(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [{"u": "a", "ts": (t + timedelta(seconds=s)).isoformat()} for s in (0, 600, 1200.000001)]
    put(tmp_path / "in", "a.json", rows)
    stream = ingest.read_json(spark, str(tmp_path / "in"), "u string, ts timestamp")
    got = ingest.run_to_table(ingest.session_windows(stream, "u", "ts"), scratch(spark, "s"), scratch(spark, "c"), "complete")
    assert sorted(r["n"] for r in got.collect()) in ([1, 2], [3])


def test_unique_posts(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"post_id": "a", "ts": "2024-01-01T00:00:00"}] * 3 + [{"post_id": "b", "ts": "2024-01-01T00:00:01"}])
    stream = ingest.read_json(spark, str(tmp_path / "in"), "post_id string, ts timestamp")
    assert ingest.run_to_table(ingest.unique_posts(stream, "post_id", "ts", "1 hour"), scratch(spark, "s"), scratch(spark, "c")).count() == 2


def test_upsert_is_idempotent(spark):
    table = scratch(spark, "versions")
    rows = lambda *r: spark.createDataFrame(r, "source_id string, content_hash string, version int, text string")
    first = rows(("a", "h1", 1, "x"), ("a", "h1", 1, "y"), ("b", "k1", 1, "z"))
    assert ingest.upsert_sources(spark, first, table) == 2 and ingest.upsert_sources(spark, first, table) == 0
    assert ingest.upsert_sources(spark, rows(("a", "h2", 2, "new")), table) == 1
    assert sorted(r["text"] for r in ingest.active_chunks(spark, table).collect()) == ["new", "z"]
    assert spark.read.parquet(f"{table}/chunks").select(F.count("*")).first()[0] == 4
