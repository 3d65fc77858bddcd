"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of k words is hashed; of each w consecutive k-gram hashes the smallest is a fingerprint, so any shared span
of w + k - 1 = 13 words has a fingerprint in common, on both sides.  Items of fewer words are one window, and every run
of as many words of a document is a fingerprint of its own kind.

One pass over the texts writes a narrow row for each document: its number of words and its distinct fingerprints.  These
are exploded alone and joined with the benchmark's; only documents with a hit are read again.  Their windows are hashed
128 bits wide and joined with those of the items they hit, and the words inside are counted position by position, so the
work is linear in a text's length.  The same plan serves every size: the fingerprints of the benchmark are broadcast when
their counted number is small, and joined by shuffling narrow rows otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
#: Broadcast the benchmark's fingerprints or windows up to this many rows (about 40 bytes each).
BROADCAST_ROWS = 500_000
# fixed value: what separates words, after lower-casing A-Z
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)


def _begins(n: Column, width: int | Column) -> Column:
    """Positions (from 1) at which so many entries begin; none for fewer."""
    return F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, n: Column, k: int) -> Column:
    """Hash of the k words from every position."""
    return F.transform(_begins(n, k), lambda i: F.xxhash64(F.slice(words, i, k)))


def _winnowed(grams: Column, w: int) -> Column:
    """Distinct smallest values of w consecutive ones of a column (not of an expression, which each window would repeat)."""
    return F.array_distinct(F.transform(_begins(F.size(grams), w), lambda i: F.array_min(F.slice(grams, i, w))))


def _whole(words: Column, n: Column, k: int) -> Column:
    """Distinct hashes of all runs of k words, as whole short items are hashed."""
    return F.array_distinct(F.transform(_begins(n, k), lambda i: F.xxhash64(F.lit(k), F.slice(words, i, k))))


def _windows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, at, width, a, b): the 128-bit hash of every window of each width in the column ``widths``."""
    each = df.select(*keys, "words", "n", F.explode("widths").alias("width"))
    window = lambda i: F.slice("words", i, F.col("width"))
    hashed = F.transform(_begins(F.col("n"), F.col("width")), lambda i: F.struct(i.alias("at"), F.xxhash64(window(i)).alias("a"), F.xxhash64(F.lit("second"), window(i)).alias("b")))
    return each.select(*keys, "width", F.explode(hashed).alias("w")).select(*keys, "width", "w.at", "w.a", "w.b")


def _sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its counted rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of a window (13 consecutive words of an item, or a whole shorter item);
    contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null text has no words; items without words or with a null
    id are ignored, items repeating an id count once for each text.  Repeated rows each get a row, rows with the same id
    and another text stay apart, and null ids are kept.  Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where("item is not null").distinct()
    items = C.stored(items.withColumn("n", F.size("words")).where("n > 0").withColumn("widths", F.array(F.least("n", F.lit(SPAN)))), "items")
    shorts = sorted(r.n for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())  # at most SPAN - 1 rows
    probe = F.when(F.col("n") >= SPAN, _winnowed(F.col("g"), WINDOW)).otherwise(F.array(F.xxhash64("n", F.col("words"))))
    hashed = items.withColumn("g", _grams(F.col("words"), F.col("n"), GRAM))
    prints = C.stored(hashed.select("item", F.explode(probe).alias("probe")).distinct(), "fingerprints")

    # narrow rows: a document is known by its id and a hash of its text
    keys = ["id", "same"]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("same"), F.col(text_col).alias("t"))
    words = rows.withColumn("words", words_of(F.col("t"))).withColumn("n", F.size("words"))
    words = words.withColumn("g", _grams(F.col("words"), F.col("n"), GRAM))
    probes = F.concat(_winnowed(F.col("g"), WINDOW), *(_whole(F.col("words"), F.col("n"), k) for k in shorts))
    narrow = C.stored(words.select(*keys, "n", probes.alias("probes")), "probes")
    hits = C.stored(narrow.select(*keys, F.explode("probes").alias("probe")).join(_sized(prints), "probe").select(*keys, "item").distinct(), "hits")

    # hit documents again: all their windows against those of the items they hit
    hit_docs = hits.select(*keys).distinct()
    again = rows.join(_sized(hit_docs), rows["id"].eqNullSafe(hit_docs["id"]) & (rows["same"] == hit_docs["same"]), "left_semi").dropDuplicates(keys)
    again = again.withColumn("words", words_of(F.col("t"))).withColumn("n", F.size("words")).withColumn("widths", F.array(*(F.lit(k) for k in (*shorts, SPAN))))
    known = _windows(items, "item").drop("at").distinct()
    found = _windows(again, *keys).join(_sized(known), ["width", "a", "b"]).select(*keys, "at", "width", "item")
    left, right = found.alias("f"), hits.alias("h")
    found = left.join(right, F.col("f.id").eqNullSafe(F.col("h.id")) & (F.col("f.same") == F.col("h.same")) & (F.col("f.item") == F.col("h.item")), "left_semi")
    found = C.stored(found, "windows")
    inside = found.select(*keys, "at", "width").distinct().select(*keys, F.explode(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("at")).distinct()
    counts = inside.groupBy(*keys).agg(F.count("*").alias("n_hit"))
    names = found.select(*keys, "item").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    seen = counts.alias("c").join(names.alias("i"), F.col("c.id").eqNullSafe(F.col("i.id")) & (F.col("c.same") == F.col("i.same")))
    seen = _sized(C.stored(seen.select("c.id", "c.same", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("digest")), "contaminated"))
    out = narrow.drop("probes").join(seen, narrow["id"].eqNullSafe(seen["id"]) & (narrow["same"] == seen["same"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        narrow["id"].alias(id_col), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n"))).alias("contaminated"),
    )
