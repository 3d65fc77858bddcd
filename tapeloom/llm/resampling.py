"""Importance resampling of documents towards a target set, by hashed n-gram features.

A document's features are its runs of 1 to ``max_n`` words; each falls into one of ``buckets`` by crc32.  Higher-order
functions turn a text into its array of buckets, which is written once as small integers.  The counts of all buckets, at
most ``buckets`` rows for a task, are the only totals shuffled; the gain of every bucket follows from them and is a
literal array in the plan that scores the written arrays, so scoring neither explodes nor shuffles anything.

Scores are integers in thousandths.  Their range is bounded by the logarithm of the number of features (below 120,000
values for any input), so a histogram of scores fits the driver: it gives the score from which documents are drawn and the
ranks already taken above each score.  Only the drawn documents are shuffled, by score, to be ordered within it.

Null texts have no features, weight 0 and a score, and are never drawn, as are all with fewer than ``min_words`` words.
A null id counts as empty text in the hash and comes first in ties.  Every row of the input is a document of its own: rows
with equal id and score take consecutive ranks, those with more features last.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
# fixed value: words before lower-casing A-Z
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case; letters beyond ASCII keep theirs."""
    low = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), low)


def bucket_array(words: Column, max_n: int = MAX_N, buckets: int = BUCKETS) -> Column:
    """Buckets of all runs of 1 to max_n words, repeats kept."""
    def bucket(x: Column) -> Column:
        return F.pmod(F.crc32(x.cast("binary")), F.lit(buckets)).cast("int")

    def runs(n: int) -> Column:
        begins = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: bucket(F.concat_ws(" ", F.slice(words, i, n))))

    return F.concat(F.transform(words, bucket), *(runs(n) for n in range(2, max_n + 1)))


def featured(docs: DataFrame, text_col: str, *keep: Column, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """Columns ``keep``, the number of words and the array of buckets."""
    words = docs.select(*keep, words_of(F.col(text_col)).alias("__words"))
    kept = [c for c in words.columns if c != "__words"]
    return words.select(*kept, F.size("__words").cast("long").alias("n_words"), bucket_array(F.col("__words"), max_n, buckets).alias("buckets"))


def bucket_counts(arrays: DataFrame) -> dict[int, int]:
    """Features in each bucket: one row for a bucket and task is shuffled, and at most as many rows as buckets come back."""
    return {r.bucket: r.n for r in arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def gain_array(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Log ratio of smoothed shares in thousandths, rounded down."""
    s, t = float(sum(source.values())), float(sum(target.values()))
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s + buckets) / ((source.get(b, 0) + 1.0) * (t + buckets))))
        for b in range(buckets)
    ]


def weight_of(buckets: Column, gains: list[int]) -> Column:
    """Mean gain of a document's features, rounded down; 0 without any."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one literal
    n = F.size(buckets).cast("long")
    mean = lambda total: F.when(n == 0, F.lit(0).cast("long")).otherwise(F.floor((total - F.pmod(total, n)) / n).cast("long"))
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b.cast("int") + 1), mean)


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the id's hash, rounded down."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and rank among the drawn (null: not drawn).

    Of the documents with min_words or more, percent per cent (rounded down) with the highest scores are drawn, ties to
    the smaller id.  Empty tables give no rows, or gains against an empty target.
    """
    small = featured(docs, text_col, F.col(id_col).cast("long").alias("doc_id"), max_n=max_n, buckets=buckets)
    arrays = C.stored(small.withColumn("buckets", F.col("buckets").cast("array<smallint>" if buckets <= 1 << 15 else "array<int>")), "buckets")
    gains = gain_array(bucket_counts(arrays), bucket_counts(featured(target, target_text, max_n=max_n, buckets=buckets)), buckets)
    scored = arrays.select(
        "doc_id", F.size("buckets").cast("long").alias("n_features"), weight_of(F.col("buckets"), gains).alias("weight"), (F.col("n_words") >= min_words).alias("eligible"),
    ).withColumn("score", F.col("weight") + noise("doc_id", seed))
    return drawn(C.stored(scored, "scores"), percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(scored: DataFrame, percent: int) -> DataFrame:
    """Adds rank to rows (doc_id, n_features, weight, score, eligible)."""
    counts = sorted(((r.score, r.n) for r in scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most = percent * sum(n for _, n in counts) // 100
    above, before = [], 0
    for score, n in counts:
        if before >= most:
            break
        above.append((score, before))
        before += n
    none = F.lit(None).cast("long").alias("rank")
    if not above:
        return scored.withColumn("rank", none)
    able = F.col("eligible") & (F.col("score") >= above[-1][0])
    ahead = F.broadcast(scored.sparkSession.createDataFrame(above, "score long, before long"))  # a row for a score, see the module's bound
    keys = ("doc_id", "n_features", "weight", "score")
    alike = scored.where(able).groupBy(*keys).agg(F.count("*").alias("alike")).join(ahead, "score")  # equal rows travel once
    upto = F.expr("before + sum(alike) OVER (PARTITION BY score ORDER BY doc_id, n_features, weight ROWS UNBOUNDED PRECEDING)")
    ranked = alike.withColumn("upto", upto).withColumn("rank", F.explode(F.expr("sequence(upto - alike + 1, upto)")))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.select(*keys, "rank").unionByName(scored.where(~able).select(*keys, none))
