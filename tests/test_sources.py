import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, sinks
from weftline.streaming.latency import run_available, windowed_latency


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿John  \r\nleft.".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.txt").write_bytes(b" \n ")
    good, bad = readers.read_texts(spark, str(tmp_path))
    assert [r.cleaned_text for r in good.collect()] == ["John\nleft."]
    assert sorted(r.reason for r in bad.collect()) == ["empty", "not UTF-8"]


def test_gold_and_claims(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text(json.dumps({"example_id": "x", "narrative_path": "n", "original_claim": "c", "expected_verdict": "CONSISTENT", "gold_evidence": [{"char_start": 0, "char_end": 4, "note": "n"}]}) + "\n\n")
    assert readers.read_gold(spark, str(p)).first().gold_evidence[0].char_end == 4
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.read_gold(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "c.csv").write_text('id,book_name,char,caption,content,label\n1,B,"C, D",,"He said ""no""\nand left",consistent\n')
    r = readers.read_claims(spark, str(tmp_path / "c.csv")).first()
    assert r.char == "C, D" and r.content == 'He said "no"\nand left' and r.caption is None


def test_cache_and_resume(spark, tmp_path):
    path = str(tmp_path / "cache")
    for n, v in ((1, "old"), (2, "new")):
        sinks.append_cache(spark.createDataFrame([("k", v, n)], "key string, text string, written_at long").coalesce(1), path)
    assert [r.text for r in readers.read_cache(spark, path, "key string, text string, written_at long").collect()] == ["new"]
    twice = tmp_path / "twice.jsonl"
    twice.write_text('{"key": "a", "text": "first"}\n\n{"key": "b", "text": "only"}\n{"key": "a", "text": "last"}\n{"text": "no key"}\n')
    assert {(r.key, r.text) for r in readers.read_cache(spark, str(twice), "key string, text string").collect()} == {("a", "last"), ("b", "only")}
    rows = spark.range(5)
    assert readers.remaining(rows, spark.createDataFrame([(1,), (1,)], "id long"), "id").count() == 4


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.createDataFrame([("a", "2031-03-01 00:00:01"), ("a", "2031-03-01 00:04:01"), ("a", "2031-03-01 09:00:00")], "event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(src)
    out = windowed_latency(spark.readStream.schema(e.schema).parquet(src))
    run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.n, r.milliseconds) for r in got] == [(2, 240_000)]
