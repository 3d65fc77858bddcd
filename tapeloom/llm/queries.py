"""The registered queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import audit, decontam, langid, lm, media, neardup, packing, pii, resampling, secrets, substring, tokencount, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.lm_scores(documents(spark, sf_dir), C.crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(documents(spark, sf_dir), digest=True)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = C.crc_mod("doc_id", 4) == 2
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    return langid.identify(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.as_media(documents(spark, sf_dir))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.resolved(warc.read_warc(spark, manifest, with_payload=False))


def queries() -> dict:
    each = (
        op1_pii, op2_near_duplicates, op3_token_counts, op4_lm_scores, op5_substring_dedup, op6_packing, op7_language_id, op8_decontamination, op9_secrets, op10_media,
        op11_resampling, op12_filter_audit, op13_warc,
    )
    return {f.__name__: f for f in each}


_WINDOWS = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, list_aggregate(ws[i:i+49], 'string_agg', ' ') AS win FROM p),
m AS (SELECT win, min(doc_id) AS first_doc FROM k GROUP BY win),
hit AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 50)) AS pos FROM k JOIN m ON k.win = m.win WHERE m.first_doc < k.doc_id),
gone AS (SELECT doc_id, list(pos) AS ps FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone.ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(list_aggregate(CASE WHEN gone.ps IS NULL THEN w.ws ELSE [w.ws[j] FOR j IN range(1, len(w.ws) + 1) IF NOT list_contains(gone.ps, j)] END, 'string_agg', ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""

_LINKS = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE [list_aggregate(ws[i:i+4], 'string_agg', ' ') FOR i IN range(1, len(ws) - 3)] END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
d AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, d.y FROM r JOIN d ON r.reach = d.x),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN m ON w.doc_id = m.doc_id LEFT JOIN n ON w.doc_id = n.doc_id
"""

_HITS = """
WITH lo AS (SELECT doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM lo),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, list_aggregate(ws[i:i+n-1], 'string_agg', ' ') AS win FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE len(ws) >= n),
dw AS (SELECT id, n, i, list_aggregate(ws[i:i+n-1], 'string_agg', ' ') AS win FROM di),
h AS (SELECT dw.id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + n)) AS p FROM h) GROUP BY id),
it AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN pos ON w.id = pos.id LEFT JOIN it ON w.id = it.id
"""


_GAINS = """
WITH lo AS (SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, row_number() OVER () AS r, id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM lo),
e AS (SELECT side, r, unnest(ws) AS word FROM w),
tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
hx AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM e)),
bt AS (SELECT word, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bs FROM hx),
cr AS (SELECT word, xor(list_reduce(bs, lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM bt, tab),
f AS (SELECT side, r, bucket FROM e JOIN cr ON e.word = cr.word),
n AS (SELECT bucket, CAST(count(*) FILTER (side = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (side = 'b') AS DOUBLE) AS t FROM f GROUP BY bucket),
z AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM n),
g AS (SELECT bucket, floor(1000 * ln((n.t + 1) * (z.s + 10000) / ((n.s + 1) * (z.t + 10000)))) AS gain FROM n, z),
wt AS (SELECT r, floor(sum(gain) / count(*)) AS weight FROM f JOIN g ON f.bucket = g.bucket WHERE side = 'd' GROUP BY r),
d AS (SELECT id AS doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN wt ON w.r = wt.r WHERE side = 'd'),
sc AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
rk AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () AS most FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * most // 100 THEN place END AS rank FROM rk
"""

_AUDIT = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
m AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * len(w.text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN m ON w.text = m.text LEFT JOIN l ON w.doc_id = l.doc_id),
h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY part, fails),
o(filter_order) AS (SELECT '' UNION ALL SELECT o.filter_order || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(o.filter_order, c)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) r(step) WHERE len(filter_order) = 5),
c AS (SELECT part, filter_order, step, f, n, good, toxic, fails = f AS only_this, contains(fails, f) AS fails_this, len(translate(fails, earlier, '')) < len(fails) AS gone FROM h, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails_this), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails_this), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND fails_this), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (only_this), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (NOT gone AND fails_this), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails_this), 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(sum(n) FILTER (NOT gone AND fails_this), 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM c GROUP BY part, filter_order, step, f
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first_id, sha1(html) AS h FROM p GROUP BY html),
d AS (SELECT html, first_id, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS digest FROM f)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p JOIN d ON p.html = d.html
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express a query; the others are tested against brute force (tests/llm)."""
    return {
        "op2_near_duplicates": _LINKS, "op5_substring_dedup": _WINDOWS, "op8_decontamination": _HITS, "op11_resampling": _GAINS, "op12_filter_audit": _AUDIT,
        "op13_warc": _WARC,
    }
