"""Language identification with string kernels.

The kernel of two texts is the number of byte 1-, 2- and 3-grams (of the lower-cased text) that occur in both,
divided by the geometric mean of their own numbers: a blended-spectrum presence kernel.  Nyström landmarks give
finite features, on which one-versus-rest kernel ridge regression is solved.  The kernel is linear in the
presence vectors, so landmark vectors, Nyström map and dual weights are multiplied out once, and whole
batches are scored by one matrix product.

Fitting uses a bounded sample: at most ``per_language`` learning rows of a language and about ``most_rows`` in all, those
with the lowest hashes of id and text; every language has one at least.  Scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

UNDETERMINED = "und"
#: Three-grams are hashed to this many codes, so a worker's tables stay at a few MB; shorter ones are exact.
_SPAN = 1 << 21
_CODES = _SPAN + (1 << 16) + 256
_at: list = []


def _grams(text: bytes) -> np.ndarray:
    """Distinct codes of the text's 1-, 2- and 3-grams, lengths apart."""
    if not _at:
        _at.append(np.zeros(_CODES, np.int32))  # where a code was seen last; never cleared
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    three = ((((two[:-1] << 8) | b[2:]).astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(11)).astype(np.int32)
    codes = np.concatenate((three, two + _SPAN, b + (_SPAN + (1 << 16)))) if len(b) > 1 else b + (_SPAN + (1 << 16))
    order = np.arange(len(codes), dtype=np.int32)
    _at[0][codes] = order
    return codes[_at[0][codes] == order]


class Model:
    """Weights by n-gram code and class."""

    def __init__(self, classes: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.classes, self.codes, self.weights, self.bias = classes, codes, weights, bias

    def decide(self, texts: list[bytes], lookup: np.ndarray) -> np.ndarray:
        """Decision values, texts by classes."""
        presence, norm = np.zeros((len(texts), len(self.codes)), np.float32), np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            g = _grams(t)
            norm[i] = max(1.0, len(g)) ** 0.5
            at = lookup[g]
            presence[i, at[at >= 0]] = 1
        return presence @ self.weights / norm[:, None] + self.bias

    def lookup(self) -> np.ndarray:
        out = np.full(_CODES, -1, np.int32)
        out[self.codes] = np.arange(len(self.codes))
        return out


def fit(texts: list[bytes], langs: list[str], landmarks: int = 128, ridge: float = 0.05, seed: int = 5) -> Model | None:
    """Nyström kernel ridge regression; landmarks are dealt evenly to the classes."""
    classes = sorted(set(langs))
    if not classes:
        return None
    y = np.array([classes.index(x) for x in langs])
    rng = np.random.Generator(np.random.PCG64(seed))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: max(1, landmarks // len(classes))] for k in range(len(classes))])
    marks = [_grams(texts[i]) for i in chosen]
    codes = np.unique(np.concatenate(marks))
    p = np.zeros((len(marks), len(codes)), np.float32)
    for i, g in enumerate(marks):
        p[i, np.searchsorted(codes, g)] = 1 / max(1, len(g)) ** 0.5
    value, vector = np.linalg.eigh((p @ p.T).astype(np.float64))
    use = value > 1e-6 * value.max()
    root = vector[:, use] / np.sqrt(value[use])
    probe = Model(classes, codes, p.T.copy(), np.zeros(len(marks), np.float32))
    table = probe.lookup()
    z = np.concatenate([probe.decide(texts[a : a + 64], table) for a in range(0, len(texts), 64)]) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    weigh = (1 / np.bincount(y, minlength=len(classes)))[y][:, None]  # classes count alike
    w = np.linalg.solve(z.T @ (z * weigh) + ridge / len(classes) * np.diag([1.0] * (z.shape[1] - 1) + [1e-6]), z.T @ (target * weigh))
    return Model(classes, codes, (p.T @ (root @ w[:-1])).astype(np.float32), w[-1].astype(np.float32))


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L."""
    return any(map(str.isalpha, text))


def _prepared(text: str | None) -> bytes:
    return b"" if text is None else text.lower().encode("utf-8", "surrogatepass")


_tables: dict = {}


def _predict(shared):
    def predict(batches):
        model: Model | None = shared.value
        if model is not None and _tables.get("of") is not model:
            _tables.update(of=model, table=model.lookup())
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 64):
                part = batch.slice(a, 64)
                texts = part.column(part.schema.get_field_index("__text")).to_pylist()
                langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                able = [i for i, t in enumerate(texts) if t and has_letter(t)] if model is not None else []
                if able:
                    v = model.decide([_prepared(texts[i]) for i in able], _tables["table"])
                    best = v.argmax(1)
                    langs[able] = np.array(model.classes, object)[best]
                    scores[able] = (np.clip(v[np.arange(len(able)), best], -1, 1) + 1) / 2
                part = part.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"])

    return predict


def sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_language: int, most_rows: int, longest: int) -> list:
    """At most per_language learning rows of each language, about most_rows in all: those with the lowest hashes.

    Language counts (one small aggregate, a row for each language) give a hash threshold for each, rows that repeat a
    text and an id count once, and ranking is done in Spark, so no more rows than are wanted leave the executors.  Texts of
    more than ``longest`` characters are taken only where a language has too few others among those rows.
    """
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    each = min(per_language, max(1, most_rows // max(1, len(counts))))
    share = reduce(lambda c, r: c.when(F.col("lang") == r["lang"], min(1.0, 1.3 * (each + 20) / r["count"])), counts, F.when(F.lit(False), 0.0)) if counts else F.lit(0.0)
    picked = rows.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share).groupBy("lang", "h").agg(F.first("text").alias("text"))
    ranked = picked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.char_length("text") > longest, "h")))
    return [(r["text"], r["lang"]) for r in ranked.where(F.col("place") <= each).orderBy("lang", "place").select("text", "lang").collect()]


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, per_language: int = 250, most_rows: int = 2000, longest: int = 50_000) -> DataFrame:
    """Appends lang_pred and score (0 to 1) to the columns ``keep`` (default: all) of every row.

    Learns from rows where ``learn`` holds and text and language aren't null; language, source and id are no inputs
    of a prediction.  Null text, text without a letter, and every text when there is nothing to learn from, is
    ``und`` with score 0.  Rows are independent: repeated rows get the same result.  Columns of docs named
    lang_pred or score are replaced.  ``per_language``, ``most_rows`` and ``longest`` bound the sample that the model is
    fitted on (see ``sample``).
    """
    rows = sample(docs, learn, id_col, text_col, lang_col, per_language, most_rows, longest)
    model = fit([_prepared(t) for t, _ in rows], [x for _, x in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_predict(shared), schema)
