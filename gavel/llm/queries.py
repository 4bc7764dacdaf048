"""The queries opN_<name> and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, importance, near_dedup, quality_fm, quality_rules, secret_scan, sharding, substring_dedup, token_counts, vector_codes, warc

#: Where the tokenizer's ranks are; a parameter of every operator that encodes.
RANKS_FILE = "byte_bpe_50k.tiktoken"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS_FILE)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), ranks_path())


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(_table(spark, sf_dir, "documents"), ranks_path()))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge_keys(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_byte_bpe, op2_quality_fm, op3_token_counts, op4_near_duplicates, op5_decontamination, op6_quality_rules, op7_byte_shards,
        op8_substring_dedup, op9_html_text, op10_warc, op11_importance, op12_vector_codes, op13_secret_scan,
    )
    return {f.__name__: f for f in found}


OP4_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
c AS (
  WITH RECURSIVE r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
  SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP8_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM p) WHERE m < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM f),
k AS (SELECT w.doc_id, w.w, unnest(range(1, len(w.w) + 1)) AS j FROM w),
t AS (
  SELECT k.doc_id, count(*) FILTER (x.j IS NOT NULL) AS gone, string_agg(k.w[k.j], ' ' ORDER BY k.j) FILTER (x.j IS NULL) AS kept
  FROM k LEFT JOIN x ON x.doc_id = k.doc_id AND x.j = k.j GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)"""

#: 1000 is the least payload that may be a revisit.
OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, strlen(coalesce(html, '')) AS n FROM pages),
d AS (SELECT page_id, n, sha1(b) AS h FROM p),
g AS (SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h, n) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM g"""



def _op6_sql() -> str:
    q = quality_rules
    langs = ", ".join(f"'{x}'" for x in q.COMMON_WORDS)
    words = ", ".join(f"'{w}'" for w in q.WORDS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang ELSE '*' END AS g,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l,
    regexp_replace(coalesce(text, ''), '[\p{{L}}\x20\x09-\x0D]+', '', 'g') AS rest
  FROM documents),
m AS (
  SELECT doc_id, g, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(rest) - length(regexp_replace(rest, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, length(rest) AS n_rest,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
    length(rest) - length(regexp_replace(rest, '\p{{Nd}}+', '', 'g')) AS n_digits,
    list_transform([{words}], lambda x: len(list_filter(w, lambda y: y = x))) AS h
  FROM d),
grams AS (SELECT doc_id, i, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM m)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM grams),
gaps AS (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9)) AS n FROM twice WHERE c > 1),
rep AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY doc_id),
f AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
    [word_chars - n_rest - n_upper, n_upper, n_digits, n_symbols, n_rest - n_digits - n_symbols] AS c,
    list_append(h, CAST(n_words - list_sum(h) AS BIGINT)) AS hh
  FROM m LEFT JOIN rep USING (doc_id)),
one AS (
  SELECT g, 'c' AS kind, generate_subscripts(c, 1) AS k, unnest(c) AS v FROM f
  UNION ALL SELECT g, 'h', generate_subscripts(hh, 1), unnest(hh) FROM f),
sums AS (
  SELECT g, kind, k, sum(v) AS v FROM one WHERE g <> '*' GROUP BY ALL
  UNION ALL SELECT '*', kind, k, sum(v) FROM one GROUP BY kind, k),
ref AS (
  SELECT g, list(v ORDER BY k) FILTER (kind = 'c') AS rc, list(v ORDER BY k) FILTER (kind = 'h') AS rh
  FROM sums GROUP BY g),
z AS (
  SELECT f.*,
    list_transform(list_zip(c, rc), lambda x: struct_pack(p := x[1] / greatest(list_sum(c), 1), q := x[2] / list_sum(rc))) AS zc,
    list_transform(list_zip(hh, rh), lambda x: struct_pack(p := x[1] / greatest(list_sum(hh), 1), q := x[2] / list_sum(rh))) AS zh
  FROM f LEFT JOIN ref USING (g)),
v AS (
  SELECT *,
    sqrt(greatest(0, list_sum(list_transform(zc, lambda x: CASE WHEN x.p > 0 THEN x.p * log2(2 * x.p / (x.p + x.q)) ELSE 0 END + CASE WHEN x.q > 0 THEN x.q * log2(2 * x.q / (x.p + x.q)) ELSE 0 END)) / 2)) AS cd,
    sqrt(greatest(0, list_sum(list_transform(zh, lambda x: CASE WHEN x.p > 0 THEN x.p * log2(2 * x.p / (x.p + x.q)) ELSE 0 END + CASE WHEN x.q > 0 THEN x.q * log2(2 * x.q / (x.p + x.q)) ELSE 0 END)) / 2)) AS wd
  FROM z)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((word_chars >= {q.MIN_CHARS} AND cd > {q.MAX_CLASS_DISTANCE}) OR (n_words >= {q.MIN_WORDS} AND wd > {q.MAX_WORD_DISTANCE}), false) AS kept
FROM v"""


OP7_SQL = """
WITH tbl AS (
  SELECT list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY n) AS t
  FROM (SELECT CAST(n AS BIGINT) AS n FROM range(256) r(n))),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS id FROM documents),
c AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(h) // 2),
      lambda i: CAST(CAST('0x' || substring(h, i * 2 + 1, 2) AS INTEGER) AS BIGINT))),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS crc
  FROM d, tbl),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, crc ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY doc_id, crc) - 1 AS rank, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(least(7, ((2 * upto - size) * 8) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s"""


#: crc32 of the bytes that h holds in hexadecimal, with the table t of tbl.
_CRC_TABLE = """
  SELECT list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY n) AS t
  FROM (SELECT CAST(n AS BIGINT) AS n FROM range(256) r(n))"""

OP11_SQL = rf"""
WITH tbl AS ({_CRC_TABLE}),
w AS (
  SELECT 's' AS side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
u AS (SELECT side, doc_id, unnest(w) AS x FROM w),
v AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM u)),
c AS (
  SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(h) // 2), lambda i: CAST(CAST('0x' || substring(h, i * 2 + 1, 2) AS INTEGER) AS BIGINT))),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM v, tbl),
b AS (SELECT bucket, CAST(count(*) FILTER (side = 's') AS DOUBLE) AS s, CAST(count(*) FILTER (side = 't') AS DOUBLE) AS t FROM u JOIN c USING (x) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM b),
d AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM u JOIN c USING (x) JOIN g USING (bucket) WHERE side = 's' GROUP BY doc_id),
z AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substring(sha256('2024:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN d USING (doc_id) WHERE side = 's'),
e AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM z),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS drawn FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CAST(CASE WHEN rank <= drawn THEN rank END AS BIGINT) AS rank
FROM e LEFT JOIN r USING (doc_id)"""


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other; a codebook is a row for each part and entry."""
    assign = """
  SELECT vec_id, label, part, v, list_min(l) AS d, list_position(l, list_min(l)) - 1 AS entry FROM (
    SELECT vec_id, label, x.part, v, list_transform(book, lambda e: list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))) AS l
    FROM x JOIN (SELECT part, list(c ORDER BY entry) AS book FROM {book} GROUP BY part) k ON k.part = x.part)"""
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({assign.format(book=f'b{k}')})")
        steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS c FROM (
      SELECT part, entry, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL)
    GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)""")
    steps = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, part, w[part * len(w) // {parts} + 1:(part + 1) * len(w) // {parts}] AS v FROM kept, range({parts}) p(part)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM x
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
{steps},
z AS MATERIALIZED ({assign.format(book=f'b{rounds}')}),
o AS (SELECT vec_id, label, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM o"""


def _op13_sql() -> str:
    s = secret_scan
    matchers = {"assign": s.ASSIGN, "access": s.ACCESS, "hex": s.HEX, "weak": s.WEAK, "gap": s.BLANK_LINE}
    quoted = {k: p.replace("'", "''") for k, p in matchers.items()}
    lists = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, regexp_split_to_array(t, '{p}') AS g_{k}" for k, p in quoted.items())
    rows = " UNION ALL ".join(
        f"SELECT r, '{k}' AS matcher, generate_subscripts(m_{k}, 1) AS n, unnest(m_{k}) AS m, unnest(g_{k}[1:len(m_{k})]) AS g, unnest({groups}) AS s FROM f"
        for k, groups in {"assign": "v_assign", "access": "m_access", "hex": "m_hex", "weak": "list_transform(range(1, len(m_weak) + 1), lambda i: CASE WHEN v_1[i] <> '' THEN '3' WHEN v_2[i] <> '' THEN '4' ELSE '5' END)", "gap": "m_gap"}.items()
    )
    near = lambda x: f"(coalesce(start - {x}_stop <= {s.REACH}, false) OR coalesce({x}_start - stop <= {s.REACH}, false))"
    sorts = {"i": "kind IN (1, 3)", "s": "kind IN (0, 2, 4)", "e": "kind = 5"}
    nearest = lambda names: ", ".join(f"max(CASE WHEN {c} THEN stop END) OVER behind AS {n}_stop, min(CASE WHEN {c} THEN start END) OVER ahead AS {n}_start" for n, c in names.items())
    windows = "WINDOW behind AS (PARTITION BY r, scope ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ahead AS (PARTITION BY r, scope ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    name = "[" + ", ".join(f"'{k}'" for k in s.KINDS) + "][kind + 1] || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, {lists}, regexp_extract_all(t, '{quoted["assign"]}', 2) AS v_assign, regexp_extract_all(t, '{quoted["weak"]}', 1) AS v_1, regexp_extract_all(t, '{quoted["weak"]}', 2) AS v_2 FROM d),
u AS ({rows}),
l AS (SELECT r, matcher, m, s, length(m) AS size, sum(length(g) + length(m)) OVER (PARTITION BY r, matcher ORDER BY n) AS stop FROM u),
k AS (
  SELECT r, CASE matcher WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 WHEN 'gap' THEN 6 ELSE CAST(s AS INTEGER) END AS kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM l WHERE CASE WHEN matcher = 'assign' THEN length(s) >= {s.LEAST_VALUE}
    WHEN matcher = 'weak' AND s = '4' THEN regexp_matches(m, '[:=]|\\.') OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')) ELSE true END),
c AS (SELECT * FROM (SELECT *, sum(CASE WHEN kind = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY start, kind ROWS UNBOUNDED PRECEDING) AS scope FROM k) WHERE kind < 6),
a AS (SELECT * FROM (SELECT *, {nearest({"b": "kind < 3"})} FROM c {windows}) WHERE kind < 3 OR NOT (coalesce(b_stop > start, false) OR coalesce(b_start < stop, false))),
p AS (SELECT *, {nearest(sorts)} FROM a {windows}),
q AS (SELECT r, kind, start, stop FROM p WHERE kind < 3 OR (kind = 3 AND {near("s")}) OR (kind = 4 AND ({near("i")} OR {near("e")})) OR (kind = 5 AND {near("i")} AND {near("s")}))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({name}, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg({name}, ',' ORDER BY start, kind) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN q USING (r) GROUP BY r, doc_id"""


def oracle_sql() -> dict[str, str]:
    new = {"op11_importance": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_secret_scan": _op13_sql()}
    return new | {"op4_near_duplicates": OP4_SQL, "op8_substring_dedup": OP8_SQL, "op6_quality_rules": _op6_sql(), "op7_byte_shards": OP7_SQL, "op10_warc": OP10_SQL}
