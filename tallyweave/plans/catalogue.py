"""Queries over the driver's tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as E
from .. import operators as O
from ..render import to_json, to_text
from ..sources import CASES, PROFILES, bytes_text, column_text, generated

#: Table and text column of each source.
TEXTS = {"documents": "text", "pages": "html", "conversations": "text", "benchmark": "text"}

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(spark, sf_dir, name="documents", keep=()) -> DataFrame:
    return column_text(read(spark, sf_dir, name), TEXTS[name], keep)


def tokens_of(spark, sf_dir, name="documents", max_word=1024, keep=()) -> DataFrame:
    return O.words(text_of(spark, sf_dir, name, keep), max_word=max_word, keep=keep)


def literal(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A short literal table."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


@query
def scan_documents(spark, sf_dir):
    return text_of(spark, sf_dir, keep=("doc_id",))


@query
def letter_predicate(spark, sf_dir):
    return text_of(spark, sf_dir, keep=("doc_id",)).select("doc_id", E.has_letter(F.col("text")).alias("has_letter"))


@query
def tokens_documents(spark, sf_dir):
    return text_of(spark, sf_dir, keep=("doc_id",)).select("doc_id", F.explode(E.runs(F.col("text"))).alias("run"))


@query
def tokens_lower(spark, sf_dir):
    return tokens_of(spark, sf_dir, keep=("doc_id",))


def _truncate(n):
    def f(spark, sf_dir):
        return O.counts(tokens_of(spark, sf_dir, max_word=n))

    QUERIES[f"truncate_{n}"] = f


for _n in (4, 64, 1024):
    _truncate(_n)


@query
def clamp_table(spark, sf_dir):
    return spark.sql("SELECT explode(array(0, 1, 3, 4, 5, 64, 1024, 1025)) AS n").select("n", E.clamp_column(F.col("n")).alias("max_word"))


#: Literal texts of numbers.
NUMBERS = "('0'), ('10'), ('007'), (''), (' 12 '), ('+5'), ('-1'), ('1x'), ('9223372036854775807'), ('9223372036854775808')"


@query
def parse_number_table(spark, sf_dir):
    return literal(spark, NUMBERS, "s").select("s", E.number_column(F.col("s")).alias("n"))


@query
def prefix_table(spark, sf_dir):
    return literal(spark, "('--top=3'), ('--top='), ('--top'), ('--max-word=5'), ('x--top=1')", "arg").select("arg", E.after_prefix(F.col("arg"), "--top=").alias("value"))


def _counts(name):
    def f(spark, sf_dir):
        return O.counts(tokens_of(spark, sf_dir, name))

    QUERIES[f"word_counts_{name}"] = f


for _name in TEXTS:
    _counts(_name)


@query
def total_words(spark, sf_dir):
    return O.totals(O.counts(tokens_of(spark, sf_dir))).select("total")


@query
def unique_words(spark, sf_dir):
    return O.totals(O.counts(tokens_of(spark, sf_dir))).select("unique")


@query
def counts_by_lang(spark, sf_dir):
    return O.counts_by(tokens_of(spark, sf_dir, keep=("lang",)), "lang")


@query
def counts_by_role(spark, sf_dir):
    return O.counts_by(tokens_of(spark, sf_dir, "conversations", keep=("role",)), "role")


def _top(n):
    def f(spark, sf_dir):
        return O.top_words(O.counts(tokens_of(spark, sf_dir)), n)

    QUERIES[f"top_words_{n}"] = f


for _n in (10, 1000):
    _top(_n)


@query
def top_beyond_unique(spark, sf_dir):
    """O3: more entries are asked for than there are words."""
    return O.top_words(O.counts(tokens_of(spark, sf_dir, "benchmark")), 2_000_000)


def _report(spark, sf_dir, top=10):
    return O.report(tokens_of(spark, sf_dir), top)


@query
def report_documents(spark, sf_dir):
    pairs = F.transform("top", lambda e: F.concat_ws(" ", e["count"].cast("string"), e["word"]))
    return _report(spark, sf_dir).select("total", "unique", F.array_join(pairs, ";").alias("top"))


@query
def report_json(spark, sf_dir):
    return to_json(_report(spark, sf_dir))


@query
def report_text(spark, sf_dir):
    return to_text(_report(spark, sf_dir))


@query
def report_empty(spark, sf_dir):
    none = read(spark, sf_dir, "documents").where("false")
    return to_json(O.report(O.words(column_text(none, "text"))))


@query
def checksum_documents(spark, sf_dir):
    return O.checksum(_report(spark, sf_dir))


@query
def run_checksum(spark, sf_dir):
    rows = literal(spark, "(1768495365L), (115871001L), (757866735L)", "checksum")
    return rows.select("checksum", E.run_checksum(F.col("checksum"), 1).alias("run_1"), E.run_checksum(F.col("checksum"), 10).alias("run_10"))


@query
def word_bytes(spark, sf_dir):
    return O.counts(tokens_of(spark, sf_dir, "benchmark")).select("word", F.array_join(E.word_bytes(F.col("word")).cast("array<string>"), ",").alias("bytes"))


@query
def little_endian(spark, sf_dir):
    rows = literal(spark, "(0L), (255L), (256L), (65537L), (4294967296L), (9223372036854775807L)", "n")
    return rows.select("n", F.array_join(E.little_endian(F.col("n")).cast("array<string>"), ",").alias("bytes"))


@query
def percentile_values(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return O.percentile(events, "value", 0.5, "median").crossJoin(O.percentile(events, "value", 0.9, "p90"))


#: Literal timings: implementation, fixture, sample's ms, start-up ms.
TIMINGS = "('a','tiny',5.0D,1.0D), ('a','tiny',3.0D,4.0D), ('a','small',9.5D,1.0D), ('b','tiny',2.5D,0.5D), ('b','small',8.0D,0.5D), ('b','small',7.0D,0.25D)"


@query
def worst_and_adjusted(spark, sf_dir):
    ms = literal(spark, TIMINGS, "impl, fixture, total_ms, startup_ms")
    ms = ms.withColumn("adjusted_ms", E.adjusted(F.col("total_ms"), F.col("startup_ms")))
    return ms.groupBy("impl", "fixture").agg(F.max("adjusted_ms").alias("worst_ms"), F.avg("adjusted_ms").alias("mean_ms"))


@query
def throughput(spark, sf_dir):
    rows = literal(spark, "(524299L, 0.0D), (524299L, 2.0D), (1048576L, 1000.0D), (4100L, 0.5D)", "size, ms")
    return rows.select("size", "ms", E.throughput(F.col("size"), F.col("ms")).alias("mib_s"))


def _cases(spark):
    return spark.createDataFrame([(n, len(c), t, m) for n, c, t, m, _ in CASES], "name string, size long, top int, max_word int")


@query
def validation_product(spark, sf_dir):
    return O.product(literal(spark, "('lines'), ('binary')", "impl"), _cases(spark))


@query
def validation_cases(spark, sf_dir):
    corpora = literal(spark, "('tiny-mix', 4100L, 10, 1024), ('small-mix', 65542L, 10, 1024)", "name, size, top, max_word")
    return corpora.unionByName(_cases(spark))


def _raw_cases(spark):
    """``name, total, unique, top`` of each edge case's raw bytes, with its own top and max_word."""
    cases = spark.createDataFrame([(n, bytearray(c), t, m) for n, c, t, m, _ in CASES], "name string, content binary, top int, max_word int")
    runs = bytes_text(cases, "content", ("name", "top", "max_word")).select("name", "top", E.clamp_column(F.col("max_word")).alias("n"), F.explode(E.runs(F.col("text"))).alias("run"))
    counted = runs.select("name", "top", F.lower(F.substring(F.col("run"), F.lit(1), F.col("n"))).alias("word")).groupBy("name", "top", "word").agg(F.count("*").alias("count"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "word", "count"))), F.lit(1), F.first("top"))
    shown = F.array_join(F.transform(ranked, lambda e: F.concat_ws(" ", e["count"].cast("string"), e["word"])), ";")
    found = counted.groupBy("name").agg(F.sum("count").alias("total"), F.count("*").alias("unique"), shown.alias("top"))
    zero = F.lit(0).cast("bigint")
    return O.expected(cases.select("name"), found, "name").select("name", F.coalesce("total", zero).alias("total"), F.coalesce("unique", zero).alias("unique"), F.coalesce("top", F.lit("")).alias("top"))


@query
def raw_bytes(spark, sf_dir):
    """Bytes above 127, NUL and malformed UTF-8 separate words."""
    return _raw_cases(spark)


@query
def required_join(spark, sf_dir):
    """Every case has its result."""
    return O.required(_cases(spark).select("name", "size"), _raw_cases(spark).select("name", "total", "unique"), "name")


#: Words of each profile's corpus that is generated.
GENERATED = 4000


@query
def generated_corpora(spark, sf_dir):
    """Word counts of a corpus of each profile, generated in tasks."""
    made = [generated(spark, p, GENERATED).select(F.lit(p).alias("profile"), "text") for p in PROFILES]
    frame = made[0]
    for more in made[1:]:
        frame = frame.unionByName(more)
    return O.words(frame, keep=("profile",)).groupBy("profile", "word").agg(F.count("*").alias("count"))


@query
def expected_join(spark, sf_dir):
    results = literal(spark, "('empty', 0L, 0L), ('top-limit', 10L, 5L)", "name, total, unique")
    return O.expected(_cases(spark).select("name"), results, "name")


@query
def timing_join(spark, sf_dir):
    fixtures = literal(spark, "('tiny', 4100L), ('small', 65542L), ('medium', 524299L)", "fixture, size")
    ms = literal(spark, TIMINGS, "impl, fixture, total_ms, startup_ms").groupBy("impl", "fixture").agg(F.min("total_ms").alias("best_ms"))
    return O.expected(fixtures, ms, "fixture")


@query
def any_primary(spark, sf_dir):
    return literal(spark, "('a', true), ('a', false), ('b', false)", "grp, is_primary").groupBy("grp").agg(F.bool_or("is_primary").alias("any_primary"))


@query
def compare_results(spark, sf_dir):
    counted = lambda n: O.counts(tokens_of(spark, sf_dir, "benchmark", max_word=n))
    return O.compare(counted(4), counted(64))


@query
def rank_nulls_last(spark, sf_dir):
    rows = literal(spark, "('a', 3.5D), ('b', NULL), ('c', 1.5D), ('d', 2.0D)", "impl, ms")
    return O.rank_nulls_last(rows, "ms")


@query
def rotate(spark, sf_dir):
    rows = spark.sql("SELECT pos, k FROM (SELECT explode(sequence(0, 4)) AS pos) CROSS JOIN (SELECT explode(array(0, 1, 3)) AS k)")
    return rows.select("pos", "k", O.rotated(F.col("pos"), F.col("k"), 5).alias("place"))


@query
def tool_versions(spark, sf_dir):
    rows = literal(spark, "(array(named_struct('t','zig','on',true), named_struct('t','go','on',false))), (array(named_struct('t','awk','on',true)))", "tools")
    flat = rows.select(F.explode("tools").alias("e")).where("e.on").select(F.col("e.t").alias("tool"))
    return flat.agg(O.sorted_list(F.collect_list("tool")).alias("tools"))


@query
def file_sizes(spark, sf_dir):
    """S3: sizes in bytes of each text, without reading it on the driver."""
    return text_of(spark, sf_dir, keep=("doc_id",)).select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
