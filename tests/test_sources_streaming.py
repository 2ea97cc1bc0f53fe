"""Readers, writers and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions.scoring import FACTORS
from sieveline.sources import tables
from sieveline.streaming import feedback


def test_json_lines_fail_fast(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "content": "x", "metadata": {"k": "v"}}\n{"id": "2", "text": "y"}\n')
    got = {r.id: r for r in tables.memories(tables.read_json(spark, str(tmp_path / "a.jsonl"), tables.MEMORY)).collect()}
    assert (got["1"].content, got["2"].content, got["2"].type, got["2"].metadata, got["2"].quality_score) == ("x", "y", "unknown", {}, 0.5)
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        tables.read_json(spark, str(tmp_path / "b.jsonl"), tables.MEMORY).collect()


def test_json_array_and_report(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "q", "query": "x", "target_memory_id": "m", "relevant_ids": ["m", "n"]}]))
    q = tables.read_json(spark, str(tmp_path / "a.json"), tables.QUERY, array=True)
    assert sorted(r.doc_id for r in tables.qrels(q).collect()) == ["m", "n"]
    tables.write_report(q.select("id"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().id == "q"


def test_sessions_skip_bad_lines_and_files(spark, tmp_path):
    line = lambda role, text: json.dumps({"type": "message", "message": {"role": role, "content": [{"text": text}]}})
    (tmp_path / "one.jsonl").write_text("\n".join([line("user", "a"), "broken{", json.dumps({"type": "other"}), line("assistant", "b"), line("user", "c")]))
    (tmp_path / "two.deleted.jsonl").write_text("\n".join([line("user", "z")] * 5))
    (tmp_path / "three.jsonl").write_text(line("user", "short"))
    got = tables.read_sessions(spark, str(tmp_path), more_than=2).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in got] == [(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c")]


def test_vector_table_and_deletes(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<float>")
    tables.write_vectors(df, str(tmp_path / "v"))
    tables.write_vectors(df.filter("id = 'a'").withColumn("id", F.lit("c")), str(tmp_path / "v"), "append")
    back = spark.read.parquet(str(tmp_path / "v"))
    assert sorted(r.id for r in tables.without(back, df.filter("id = 'b'")).collect()) == ["a", "c"]
    with pytest.raises(ValueError, match="mode"):
        tables.write_vectors(df, str(tmp_path / "v"), "merge")


def test_streaming_weights_equal_the_batch(spark, tmp_path):
    from sieveline.operators.learn import adaptive_weights

    rows = [("x" if i % 3 else "y", i, float(i % 2), *[1.0 + 0.01 * k for k in range(6)]) for i in range(30)]
    schema = "domain string, seq long, feedback double, " + ", ".join(f"{k} double" for k in FACTORS)
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.filter("seq < 15").write.parquet(str(tmp_path / "in/p1"))
    df.filter("seq >= 15").write.parquet(str(tmp_path / "in/p2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = feedback.streaming_weights(stream).writeStream.format("memory").queryName("w").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = {r.domain: r for r in spark.sql("select * from w").orderBy("events").collect()}
    want = {r.domain: r for r in adaptive_weights(df).collect()}
    assert {d: r.events for d, r in last.items()} == {"x": 20, "y": 10}
    assert all(last[d][k] == pytest.approx(want[d][k]) for d in want for k in FACTORS)


def test_windows_drop_late_events(spark, tmp_path):
    schema = "ts timestamp, domain string, feedback double"
    stamps = [["2024-01-01 00:01:00", "2024-01-01 00:02:00"], ["2024-01-01 02:00:00"], ["2024-01-01 02:01:00"], ["2024-01-01 00:03:00", "2024-01-01 03:00:00"]]
    for i, batch in enumerate(stamps):
        spark.createDataFrame([(s, "d", 1.0) for s in batch], "ts string, domain string, feedback double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = feedback.feedback_windows(stream).writeStream.format("memory").queryName("f").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    first = spark.sql("select * from f order by start").first()
    assert first.events == 2


def test_vector_tables_caches_and_conversions(spark, tmp_path):
    from sieveline.sources import tables

    path = str(tmp_path / "vectors")
    assert tables.create_vectors(spark, path) and not tables.create_vectors(spark, path)
    tables.write_vectors(spark.createDataFrame([(1, [0.5]), (2, [1.5])], "id long, embedding array<float>"), path, "append")
    assert spark.read.parquet(path).count() == 2
    assert tables.drop_vectors(spark, path) and not tables.drop_vectors(spark, path)

    cache = str(tmp_path / "cache")
    assert tables.load_cache(spark, cache).count() == 0
    rows = spark.createDataFrame([("k", [0.25, 0.5])], "key string, embedding array<float>").withColumn("cached_at", F.lit("2024-01-01").cast("timestamp"))
    tables.save_cache(rows, cache)
    assert [(r.key, r.embedding) for r in tables.load_cache(spark, cache).collect()] == [("k", [0.25, 0.5])]

    for scale, n in (("tiny", 2), ("small", 3)):
        (tmp_path / "in" / scale).mkdir(parents=True)
        (tmp_path / "in" / scale / "memories.json").write_text(json.dumps([{"id": f"m{i}", "content": f"text {i}"} for i in range(n)]))
    stats = tables.convert_scales(spark, str(tmp_path / "in"), str(tmp_path / "out"), ("tiny", "small", "large"))
    assert {(r.scale, r.memories) for r in stats.collect()} == {("tiny", 2), ("small", 3)}
    assert {r.text for r in spark.read.json(str(tmp_path / "out" / "tiny")).collect()} == {"text 0", "text 1"}
    tables.write_scored(spark.createDataFrame([("a",)], "id string"), F.lit(0.5), str(tmp_path / "scored"))
    assert [(r.id, r.quality_score) for r in spark.read.json(str(tmp_path / "scored")).collect()] == [("a", 0.5)]


def test_scale_sweep_and_timed_benchmark(spark):
    from sieveline.operators.evaluate import scale_sweep
    from sieveline.plans import queries
    from sieveline.plans.search import timed_benchmark

    d = "/root/testdata/sf0.001"
    runs = {k: (lambda n=n: spark.createDataFrame([(n, 0.5 / n)], "queries long, recall_1 double")) for k, n in (("small", 1), ("large", 2))}
    assert [(r.scale, r.queries, r.recall_1, r.seconds > 0) for r in scale_sweep(runs).orderBy("queries").collect()] == [("small", 1, 0.5, True), ("large", 2, 0.25, True)]
    got = timed_benchmark(queries.items(spark, d), memories=queries.memories(spark, d), vectors=queries.vectors(spark, d), asked=queries.asked(spark, d), relevant=queries.item_qrels(spark, d), kind="bm25").first()
    assert got.query_size == 40 and got.queries_per_second > 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from sieveline.sources import shared

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    assert shared.shared_dir(spark)  # a local master
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(spark)
