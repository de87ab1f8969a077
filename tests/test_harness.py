import pytest
from pyspark.sql import functions as F

from tallyweave import harness as H
from tallyweave.operators import rank_nulls_last, required, rotated
from tallyweave.options import UsageError
from tallyweave.sources import sizes


def test_settings():
    found = H.parse_settings(["--top=3", "--validate"], {"TALLYWEAVE_TOP": "7", "TALLYWEAVE_MAX_WORD": "5", "HOME": "x"})
    assert (found.top, found.max_word, found.validate, found.corpus) == (3, 5, True, "default")


@pytest.mark.parametrize("args", [["--top=0"], ["--top"], ["--runs=x"], ["--what=1"], ["--corpus=none"], ["file"]])
def test_usage_errors(args):
    with pytest.raises(UsageError):
        H.parse_settings(args, {})


def test_validates(spark, tmp_path):
    settings = H.Settings(corpus="tiny-mix", samples=1, runs=1, warmups=0)
    cases = H.fixtures(settings, str(tmp_path))
    assert H.validate(spark, cases) == []
    wrong = [(n, p, d + b"more", t, m) for n, p, d, t, m in cases]
    assert len(H.validate(spark, wrong)) == 2
    table = H.summary(spark, settings, cases)
    assert table.startswith("| reader | tiny-mix median ms") and len(table.splitlines()) == 4


def test_required_results(spark):
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    one = spark.createDataFrame([("a", 5), ("b", 6)], "name string, total int")
    assert sorted(map(tuple, required(cases, one, "name").collect())) == [("a", 1, 5), ("b", 2, 6)]
    with pytest.raises(Exception, match="no result for b"):
        required(cases, one.where("name = 'a'"), "name").collect()


def test_rotated_and_ranked(spark):
    rows = spark.createDataFrame([("a", 3.5), ("b", None), ("c", 1.5)], "impl string, ms double")
    assert [(r["impl"], r["rank"]) for r in rank_nulls_last(rows, "ms").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    places = spark.range(5).select("id", rotated(F.col("id"), 2, 5).alias("place")).collect()
    assert [r["id"] for r in sorted(places, key=lambda r: r["place"])] == [2, 3, 4, 0, 1]


def test_sizes(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"12345")
    probe = sizes(spark, str(tmp_path / "f"))
    assert probe.first()["length"] == 5 and "content" not in probe._jdf.queryExecution().executedPlan().toString()


def test_any_file(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"B a b")
    assert H.fixtures(H.Settings(fixture=str(tmp_path / "f")), "")[0][2] == b"B a b"
    assert H.plain_report(b"B a b", 1, 0) == '{"total":3,"unique":2,"top":[{"word":"b","count":2}]}'
