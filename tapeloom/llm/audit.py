"""What each filter of a chain removes, in every order of the filters, from one pass over the documents.

Which filters a document fails is a mask of five bits.  The documents of a part with equal masks behave alike in every
order, so a histogram of 32 masks for each part, with those of the labelled rows beside it, says everything: stacked as
rows of a matrix they are multiplied by integer matrices of 32 masks by 600 outcomes (120 orders of five steps), one each
for kept, removed, redundant and unique.  Only histograms are shuffled to the product, at most 32 rows for a part and task.

The filter for copies needs other documents: texts are compared by sha256, the smallest id of each text is found with
partial aggregation, and a document is a first one if its (id, digest) is among these pairs.  No key of that join is shared
by copies, so a text that a third of all documents share lands in no single task.

Null text is empty text, and so equals it.  A null part is the empty string.  A null id is nobody's copy, and nobody is its
copy.  Repeated rows count each; of rows that share an id, each with the smallest id of its text is a first one.  A document
with several label rows has quality or toxic if any of them says so; null labels say nothing.  Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
# fixed value: words of a text
WORD = r"[^\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = len(LETTERS)
#: Parts multiplied at once (600 result rows each).
PARTS = 200
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def fails_of(text: Column, words: Column) -> list[Column]:
    """The four failure conditions that a text alone decides, in the order of LETTERS."""
    n, chars = F.size(words), F.char_length(text)
    capitals = chars - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * chars.cast("long"), text.rlike("[#$%&*|]")]


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, mask, good, toxic): bit i of mask is set where the document fails filter i."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(fails_of(F.col("text"), F.col("words")))), F.lit(0))
    rows = words.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    out = rows.join(firsts, ["id", "digest"], "left").join(told, "id", "left")
    return out.select("part", (F.col("mask") + copy.cast("int") * 16).alias("mask"), *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")))


def outcome_matrices() -> dict[str, np.ndarray]:
    """32 by 600: what becomes of a document with each mask at each step of each order."""
    at = {c: i for i, c in enumerate(LETTERS)}
    fails = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    order = np.array([[at[c] for c in o] for o in ORDERS])
    seen = fails[:, order]  # mask, order, step
    before = np.cumsum(seen, axis=2) - seen
    out = {"kept": (before + seen) == 0, "removed": (seen == 1) & (before == 0), "redundant": (seen == 1) & (before > 0), "unique_fails": (seen == 1) & (fails.sum(1) == 1)[:, None, None]}
    return {k: v.reshape(1 << STEPS, -1).astype(np.int64) for k, v in out.items()}


def product(batches):
    """Pandas batches (part, cells of (mask, n, good, toxic)) to the 600 rows of each part."""
    m = outcome_matrices()
    orders, steps = np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
    letter = np.array([LETTERS.index(o[s - 1]) for o, s in zip(orders, steps)])
    of_letter = np.eye(STEPS, dtype=np.int64)[letter]  # 600 by 5
    for whole in batches:
        for begin in range(0, len(whole), PARTS):
            pdf = whole.iloc[begin : begin + PARTS]
            hist = np.zeros((3, len(pdf), 1 << STEPS), np.int64)
            for i, cells in enumerate(pdf["cells"]):
                for c in cells:
                    hist[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
            stack = hist.reshape(-1, 1 << STEPS)
            removed = (stack @ m["removed"]).reshape(3, len(pdf), -1)
            shapley = removed[0] @ of_letter @ of_letter.T
            yield pd.DataFrame({
                "part": np.repeat(pdf["part"].to_numpy(), len(orders)), "filter_order": np.tile(orders, len(pdf)), "step": np.tile(steps, len(pdf)),
                "kept": (hist[0] @ m["kept"]).ravel(), "removed": removed[0].ravel(), "redundant": (hist[0] @ m["redundant"]).ravel(),
                "unique_fails": (hist[0] @ m["unique_fails"]).ravel(), "good_lost": removed[1].ravel(), "toxic_lost": removed[2].ravel(), "shapley": shapley.ravel(),
            })


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; an empty table has no parts and no rows."""
    rows = masked(docs, labels, id_col, text_col, part_col)
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return parts.mapInPandas(product, RESULT)
