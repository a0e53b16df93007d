"""The registered queries of this folder and their oracle SQL."""

from __future__ import annotations

import public_tokenizers

from quillbom.llm import html_text, importance, licenses, maxent_lm, mixing, packing, piece_codec, quality, simhash, spelling, substring_dedup, suffix_dedup, topk
from quillbom.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_piece_round_trip(spark, sf_dir):
    """Every document encoded and decoded with the 32k piece vocabulary."""
    return piece_codec.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_best_fit_packing(spark, sf_dir):
    """Every document packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_html_main_text(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op9_quality_rules(spark, sf_dir):
    """Base features and the verdict of the likelihood ratio for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op3_simhash_groups(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


@query
def op6_substring_dedup(spark, sf_dir):
    """Words of all documents outside windows of 35 words that occur twice."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


@query
def op8_suffix_dedup(spark, sf_dir):
    """Bytes of all documents outside strings of 50 bytes that an earlier document has."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


@query
def op7_exact_top_k(spark, sf_dir):
    """The ten best candidates of each query vector."""
    return topk.search(table(spark, sf_dir, "embeddings"))


ORACLES["op7_exact_top_k"] = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(c.x) = len(q.x)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 10
"""


@query
def op2_maxent_scores(spark, sf_dir):
    """Language-model scores of all documents, learnt from four fifths of them."""
    return maxent_lm.score(table(spark, sf_dir, "documents"))


@query
def op10_license_scan(spark, sf_dir):
    """Licences of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op11_source_mix(spark, sf_dir):
    """What a mix of all sources takes of each document."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, keep=["doc_id"])


# w: sizes and keys; s: sources; c: what would be full before each; level: what the sources that do not fill up share.
ORACLES["op11_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
    SELECT doc_id, source, len(ws) AS size,
           -ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
           / CASE WHEN len(ws) > 0 THEN sqrt(CAST(len(list_distinct(ws)) AS DOUBLE) / len(ws)) ELSE 1.0 END AS drawn
    FROM d
),
s AS (
    SELECT source, sum(size) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
    FROM w GROUP BY source
),
c AS (
    SELECT *, coalesce(sum(source_size) OVER before, 0) AS full_size, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_weight, sum(source_size) OVER () AS whole
    FROM s WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
    SELECT CAST(1.5 * whole - 2.0 * full_size AS DOUBLE) AS rest, CAST(rest_weight AS DOUBLE) AS by_weight, source_size / weight AS ratio FROM c
    WHERE 2.0 * source_size >= CAST(weight AS DOUBLE) * (1.5 * whole - 2.0 * full_size) / rest_weight ORDER BY ratio LIMIT 1
),
p AS (
    SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
           floor(target) - CASE WHEN source_size > 0 THEN floor(target / source_size) * source_size ELSE 0 END AS budget
    FROM (SELECT source, source_size, CASE WHEN 2.0 * source_size < CAST(weight AS DOUBLE) * rest / by_weight THEN CAST(2.0 * source_size AS DOUBLE) ELSE CAST(weight AS DOUBLE) * rest / by_weight END AS target FROM s, level)
),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY drawn, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead FROM w)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + greatest(0, least(size, budget - ahead)) AS BIGINT) AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
"""


@query
def op12_spelling_variants(spark, sf_dir):
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"), slips=spelling.SLIPS)


# The hash bit by bit: a table of 256 remainders from the polynomial, then one step a byte.
CRC32 = """
crc_table AS MATERIALIZED (
    SELECT list(r ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r FROM (SELECT unnest(range(256)) AS i)
    )
)
"""


def crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a string's UTF-8, beside the table crc_table."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({value})), {at}, 1)) - 1)"
    data = f"list_transform(range(CAST(octet_length(encode({value})) AS BIGINT)), lambda i: CAST(16 * {digit('2 * i + 1')} + {digit('2 * i + 2')} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE {CRC32},
occ AS (
    SELECT doc_id, w, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents
    ) WHERE length(w) >= 6 GROUP BY ALL
),
hashed AS MATERIALIZED (SELECT w, n, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM occ, crc_table),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS MATERIALIZED (SELECT word, length(word) AS size, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
    SELECT a.word AS word, b.word AS other FROM gone a JOIN gone b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT g.word, v.word FROM gone g JOIN v ON g.rest = v.word
    UNION SELECT v.word, g.word FROM gone g JOIN v ON g.rest = v.word
),
near AS (
    SELECT p.word, count(*) AS n_near, first(p.other ORDER BY o.n DESC, p.other) AS best, max(o.n) AS best_n FROM (SELECT DISTINCT * FROM pairs) p JOIN v o ON p.other = o.word GROUP BY p.word
),
formed AS MATERIALIZED (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN near USING (word)
),
walk AS (
    SELECT word, word AS root, form AS ahead FROM formed
    UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.ahead = f.word
)
SELECT f.word, f.form, w.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN walk w ON w.word = f.word AND w.ahead IS NULL
"""


@query
def op13_importance_resampling(spark, sf_dir):
    """A tenth of all documents, drawn towards the benchmark's words."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _features_sql(source: str, columns: str) -> str:
    return f"SELECT {columns} unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {source}"


ORACLES["op13_importance_resampling"] = f"""
WITH {CRC32},
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
f AS MATERIALIZED ({_features_sql("docs", "row,")}),
g AS MATERIALIZED ({_features_sql("benchmark", "")}),
bucket AS MATERIALIZED (SELECT w, {crc32_sql("w")} % 10000 AS b FROM (SELECT w FROM f UNION SELECT w FROM g), crc_table),
s AS (SELECT b, count(*) AS n FROM f JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN bucket USING (w) GROUP BY b),
gain AS (
    SELECT i AS b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * CAST((SELECT count(*) FROM f) + 10000 AS DOUBLE) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * CAST((SELECT count(*) FROM g) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i
),
found AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN bucket USING (w) JOIN gain USING (b) GROUP BY row),
scored AS (
    SELECT row, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
    FROM docs LEFT JOIN found USING (row)
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS open FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * open // 100 THEN place END AS rank FROM placed
"""
