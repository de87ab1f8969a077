"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

from ..sources import CASES
from ..sources.corpora import BASE, SEPARATORS
from .catalogue import GENERATED, NUMBERS, TEXTS, TIMINGS


def _words(name="documents", keep="", n=1024, where=""):
    keep = keep and keep + ", "
    return f"(SELECT {keep}lower(left(w, {n})) AS word FROM (SELECT {keep}unnest(regexp_extract_all({TEXTS[name]}, '[A-Za-z]+')) AS w FROM {name} {where}))"


def _counts(name="documents", n=1024, where=""):
    return f"(SELECT word, count(*) AS count FROM {_words(name, n=n, where=where)} GROUP BY word)"


def _plain(values: str) -> str:
    """Literal rows without the type letters of Spark."""
    import re

    return re.sub(r"(?<=\d)[DL]\b", "", values)


_TOP = f"(SELECT word, count FROM {_counts()} ORDER BY count DESC, word LIMIT 10)"
_TOTALS = f"(SELECT coalesce(sum(count), 0)::BIGINT AS total, count(*) AS \"unique\" FROM {_counts()})"
_LE = "list_transform(range(0, {w}), lambda i: (({n})::BIGINT >> (8 * i::INT)) & 255)"
_FOLD = "list_reduce(list_prepend(2166136261::BIGINT, {b}), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


def _le(n, w=8):
    return _LE.format(n=n, w=w)


def _fold(b):
    return _FOLD.format(b=b)


_ENTRY_BYTES = f"list_concat(list_transform(string_split(e.word, ''), lambda c: ascii(c)::BIGINT), {_le('e.count')})"
_CASES = ", ".join(f"('{n}', {len(c)}::BIGINT, {t}, {m})" for n, c, t, m, _ in CASES)
_CASES = f"(SELECT * FROM (VALUES {_CASES}) t(name, size, top, max_word))"
# Raw bytes of the cases: in hex, each letter's byte as itself and all others as blanks.
_BYTES = "array_to_string(list_transform(range(0, length(hex) // 2), lambda i: chr(CASE WHEN upper(substr(hex, 2 * i::INT + 1, 2)) BETWEEN '41' AND '5A' OR upper(substr(hex, 2 * i::INT + 1, 2)) BETWEEN '61' AND '7A' THEN 16 * (instr('0123456789ABCDEF', upper(substr(hex, 2 * i::INT + 1, 1))) - 1) + instr('0123456789ABCDEF', upper(substr(hex, 2 * i::INT + 2, 1))) - 1 ELSE 32 END::INT)), '')"
_RAW = ", ".join(f"('{n}', '{c.hex()}', {t}, {m})" for n, c, t, m, _ in CASES)
_RAW = f"""(WITH c AS (SELECT name, top, CASE WHEN m = 0 THEN 64 ELSE least(1024, greatest(4, m)) END AS n, {_BYTES} AS t FROM (VALUES {_RAW}) v(name, hex, top, m)),
w AS (SELECT name, top, lower(left(run, n)) AS word FROM (SELECT name, top, n, unnest(regexp_extract_all(t, '[A-Za-z]+')) AS run FROM c)),
g AS (SELECT name, top, word, count(*) AS count FROM w GROUP BY name, top, word),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, word) AS place FROM g),
s AS (SELECT name, sum(count)::BIGINT AS total, count(*) AS "unique", string_agg(count || ' ' || word, ';' ORDER BY place) FILTER (WHERE place <= top) AS shown FROM k GROUP BY name)
SELECT c.name, coalesce(total, 0)::BIGINT AS total, coalesce("unique", 0)::BIGINT AS "unique", coalesce(shown, '') AS top FROM c LEFT JOIN s ON c.name = s.name)"""

def _syn(v):
    return f"(array_to_string(list_transform(range(0, 8), lambda k: chr((97 + ({v}) // (26 ** k)::BIGINT % 26)::INT)), '') || repeat('x', (({v}) % 5)::INT))"


_ALPHA = "list_extract([" + ", ".join(f"'{w}'" for w in BASE) + "], (i % 8 + 1)::INT)"
_SEP = "list_extract([" + ", ".join("chr(%d)" % ord(c) if len(c) == 1 else f"'{c}'" for c in SEPARATORS) + "], (i % 7 + 1)::INT)"
_FOLDED = f"CASE WHEN i % 6 <> 0 THEN {_syn('i // 4')} ELSE lower({_ALPHA}) END"
_WORDS = {
    "mixed": f"CASE WHEN i % 5 <> 0 THEN {_ALPHA} ELSE {_syn('i')} END",
    "unique": f"{_syn('i')} || {_syn('i + 17')}",
    "case-fold": f"CASE i % 4 WHEN 0 THEN upper({_FOLDED}) WHEN 1 THEN upper(left({_FOLDED}, 1)) || substr({_FOLDED}, 2) ELSE {_FOLDED} END",
    "repeated": _ALPHA,
    "long": f"lower({_ALPHA}) || repeat({_syn('i')}, 16)",
}
_GENERATED = " UNION ALL ".join(f"SELECT '{p}' AS profile, ({w}) || {_SEP} AS text FROM (SELECT unnest(range(0, {GENERATED})) AS i)" for p, w in _WORDS.items())

ORACLE_SQL = {
    "scan_documents": "SELECT doc_id, text FROM documents",
    "letter_predicate": "SELECT doc_id, regexp_matches(text, '[A-Za-z]') AS has_letter FROM documents",
    "tokens_documents": "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS run FROM documents",
    "tokens_lower": f"SELECT * FROM {_words(keep='doc_id')}",
    **{f"truncate_{n}": f"SELECT * FROM {_counts(n=n)}" for n in (4, 64, 1024)},
    "clamp_table": "SELECT n, CASE WHEN n = 0 THEN 64 ELSE least(1024, greatest(4, n)) END AS max_word FROM (SELECT unnest([0, 1, 3, 4, 5, 64, 1024, 1025]) AS n)",
    "parse_number_table": f"SELECT s, CASE WHEN regexp_full_match(s, '[0-9]+') THEN try_cast(s AS BIGINT) END AS n FROM (VALUES {NUMBERS}) t(s)",
    "prefix_table": "SELECT arg, CASE WHEN starts_with(arg, '--top=') THEN substring(arg, 7) END AS value FROM (VALUES ('--top=3'), ('--top='), ('--top'), ('--max-word=5'), ('x--top=1')) t(arg)",
    **{f"word_counts_{name}": f"SELECT * FROM {_counts(name)}" for name in TEXTS},
    "total_words": f"SELECT total FROM {_TOTALS}",
    "unique_words": f"SELECT \"unique\" FROM {_TOTALS}",
    "counts_by_lang": f"SELECT lang, count(*) AS total, count(DISTINCT word) AS \"unique\" FROM {_words(keep='lang')} GROUP BY lang",
    "counts_by_role": f"SELECT role, count(*) AS total, count(DISTINCT word) AS \"unique\" FROM {_words('conversations', keep='role')} GROUP BY role",
    **{f"top_words_{n}": f"SELECT * FROM {_counts()} ORDER BY count DESC, word LIMIT {n}" for n in (10, 1000)},
    "top_beyond_unique": f"SELECT * FROM {_counts('benchmark')}",
    "report_documents": f"SELECT total, \"unique\", (SELECT string_agg(count || ' ' || word, ';' ORDER BY count DESC, word) FROM {_TOP}) AS top FROM {_TOTALS}",
    "report_json": f"""SELECT '{{"total":' || total || ',"unique":' || "unique" || ',"top":[' || (SELECT string_agg('{{"word":"' || word || '","count":' || count || '}}', ',' ORDER BY count DESC, word) FROM {_TOP}) || ']}}' AS json FROM {_TOTALS}""",
    "report_text": f"SELECT 'count word' || chr(10) || (SELECT string_agg(count || ' ' || word, chr(10) ORDER BY count DESC, word) FROM {_TOP}) || chr(10) || 'total ' || total || chr(10) || 'unique ' || \"unique\" AS text FROM {_TOTALS}",
    "report_empty": """SELECT '{"total":0,"unique":0,"top":[]}' AS json""",
    "checksum_documents": f"SELECT {_fold(f'list_concat({_le("total")}, {_le(chr(34) + "unique" + chr(34))}, flatten(list_transform(top, lambda e: {_ENTRY_BYTES})))')}::BIGINT AS checksum FROM {_TOTALS} CROSS JOIN (SELECT list(struct_pack(word := word, count := count) ORDER BY count DESC, word) AS top FROM {_TOP})",
    "run_checksum": f"SELECT checksum, {_fold(_le('checksum', 4))}::BIGINT AS run_1, {_fold('flatten(list_transform(range(0, 10), lambda r: ' + _le('checksum', 4) + '))')}::BIGINT AS run_10 FROM (VALUES (1768495365::BIGINT), (115871001), (757866735)) t(checksum)",
    "word_bytes": f"SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c: ascii(c)), ',') AS bytes FROM {_counts('benchmark')}",
    "little_endian": f"SELECT n, array_to_string({_le('n')}, ',') AS bytes FROM (VALUES (0::BIGINT), (255), (256), (65537), (4294967296), (9223372036854775807)) t(n)",
    "percentile_values": "SELECT quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90 FROM events",
    "worst_and_adjusted": f"SELECT impl, fixture, max(greatest(0.0, total_ms - startup_ms)) AS worst_ms, avg(greatest(0.0, total_ms - startup_ms)) AS mean_ms FROM (SELECT impl, fixture, total_ms::DOUBLE AS total_ms, startup_ms::DOUBLE AS startup_ms FROM (VALUES {_plain(TIMINGS)}) t(impl, fixture, total_ms, startup_ms)) GROUP BY impl, fixture",
    "throughput": "SELECT size, ms, CASE WHEN ms = 0 THEN 'inf' ELSE printf('%.1f', size / 1048576.0 / (ms / 1000.0)) END AS mib_s FROM (SELECT size, ms::DOUBLE AS ms FROM (VALUES (524299::BIGINT, 0.0), (524299, 2.0), (1048576, 1000.0), (4100, 0.5)) t(size, ms))",
    "validation_product": f"SELECT * FROM (VALUES ('lines'), ('binary')) i(impl) CROSS JOIN {_CASES}",
    "validation_cases": f"SELECT * FROM (VALUES ('tiny-mix', 4100::BIGINT, 10, 1024), ('small-mix', 65542, 10, 1024)) t(name, size, top, max_word) UNION ALL SELECT * FROM {_CASES}",
    "generated_corpora": f"SELECT profile, word, count(*) AS count FROM (SELECT profile, lower(left(w, 1024)) AS word FROM (SELECT profile, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM ({_GENERATED}))) GROUP BY ALL",
    "raw_bytes": f"SELECT * FROM {_RAW}",
    "required_join": f"SELECT c.name, c.size, r.total, r.\"unique\" FROM {_CASES} c JOIN {_RAW} r ON c.name = r.name",
    "expected_join": f"SELECT c.name, r.total, r.\"unique\" FROM {_CASES} c LEFT JOIN (VALUES ('empty', 0::BIGINT, 0::BIGINT), ('top-limit', 10, 5)) r(name, total, \"unique\") ON c.name = r.name",
    "timing_join": f"SELECT f.fixture, f.size, m.impl, m.best_ms FROM (VALUES ('tiny', 4100::BIGINT), ('small', 65542), ('medium', 524299)) f(fixture, size) LEFT JOIN (SELECT impl, fixture, min(total_ms)::DOUBLE AS best_ms FROM (VALUES {_plain(TIMINGS)}) t(impl, fixture, total_ms, startup_ms) GROUP BY impl, fixture) m ON f.fixture = m.fixture",
    "any_primary": "SELECT grp, bool_or(is_primary) AS any_primary FROM (VALUES ('a', true), ('a', false), ('b', false)) t(grp, is_primary) GROUP BY grp",
    "compare_results": f"SELECT *, 'left' AS side FROM (SELECT * FROM {_counts('benchmark', 4)} EXCEPT ALL SELECT * FROM {_counts('benchmark', 64)}) UNION ALL SELECT *, 'right' FROM (SELECT * FROM {_counts('benchmark', 64)} EXCEPT ALL SELECT * FROM {_counts('benchmark', 4)})",
    "rank_nulls_last": "SELECT impl, ms::DOUBLE AS ms, (row_number() OVER (ORDER BY ms ASC NULLS LAST))::INT AS rank FROM (VALUES ('a', 3.5), ('b', NULL), ('c', 1.5), ('d', 2.0)) t(impl, ms)",
    "rotate": "SELECT pos::INT AS pos, k, ((pos - k + 5) % 5)::INT AS place FROM (SELECT unnest(range(0, 5)) AS pos) CROSS JOIN (SELECT unnest([0, 1, 3]) AS k)",
    "tool_versions": "SELECT 'awk, zig' AS tools",
    "file_sizes": "SELECT doc_id, octet_length(encode(text))::BIGINT AS size FROM documents",
}
