"""Properties of the word engine over random bytes, and streams."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import counts, counts_by, report, top_words, totals, words
from tallyweave.sources import binary_text, line_text, write_corpus
from tallyweave.streaming import stream_counts, windowed_counts


def plain(data, max_word):
    return Counter(w[:max_word].lower().decode() for w in re.findall(rb"[A-Za-z]+", data))


@pytest.mark.parametrize("seed", range(4))
def test_random_bytes(spark, tmp_path, seed):
    r = random.Random(seed)
    data = bytes(r.choice(b"abcXYZ \n\r\t09_\x00\xc3\xe9\xff") if r.random() < 0.9 else r.randrange(256) for _ in range(20_000))
    path = write_corpus(tmp_path, "r", data)
    for max_word in (4, 64):
        want = plain(data, max_word)
        for read in (binary_text, line_text):
            counted = counts(words(read(spark, path), max_word=max_word))
            got = {w["word"]: w["count"] for w in counted.collect()}
            assert got == want and all(re.fullmatch(rf"[a-z]{{1,{max_word}}}", w) for w in got)
            assert tuple(totals(counted).first()) == (sum(want.values()), len(want))
            first = [(w["word"], w["count"]) for w in top_words(counted, 7).collect()]
            assert first == sorted(want.items(), key=lambda e: (-e[1], e[0]))[:7]


def test_nulls_and_groups(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "a a", None), (4, "", "y")], "id int, text string, word string")
    assert {w["word"]: w["count"] for w in counts(words(df)).collect()} == {"a": 3, "b": 1}
    assert {tuple(r) for r in counts_by(words(df, keep=("id",)), "id").collect()} == {(1, 2, 2), (3, 2, 1)}
    assert tuple(report(words(df.where("false"))).first()) == (0, 0, [])


def test_plan_counts_before_the_shuffle(spark, sf_dir):
    df = counts(words(spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange") == 1
    assert re.search(r"PushedFilters: \[.*lang", plan) and "ReadSchema: struct<text:string,lang:string>" in plan


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = stream_counts(stream).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, counts(words(batch)).collect()))


def test_windowed_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a b a", 0), ("a", 70), ("b", 400)], "text string, s int")
    rows = rows.select("text", F.timestamp_seconds("s").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "at", "1 minute", "10 seconds").writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window"]["start"].timestamp() % 3600, r["word"], r["count"]) for r in spark.table("late").collect()}
    assert got == {(0.0, "a", 2), (0.0, "b", 1), (60.0, "a", 1)}
