"""Language-model scores by prediction by partial matching, and a smoothed unigram base score.

The PPM model is a byte-context trie of order 5, pretrained on the learning documents: escape estimation by method C
(an escape weighs as many as the context has distinct successors) and symbol exclusion on the way down, where a
lower order's counts and kinds are both reduced by what was excluded.  With fixed counts the cost of a byte depends
on its n-gram only (five predecessors and itself), so a text's code length is a sum over its n-grams.  Byte 255,
which UTF-8 never uses, stands before and after every text.

The trie grows with the corpus and is never in one place.  Documents are dealt into groups; a group sends its
distinct n-grams and words with their numbers, split by hash, and no cell of that exchange gathers more than one
entry of a group for an n-gram.  Summed n-grams are dealt again by their three nearest context bytes, so all contexts of
orders 3 to 5 of an n-gram meet in one task, where its cost is worked out.  Orders 0 to 2 are at most 2**24 counts, which
bounds what is broadcast.  Costs and word counts go back to the groups that asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

EDGE, ORDER, NEAR = 255, 5, 2
#: Text bytes of a group.
GROUP_BYTES = 8 << 20
WORD, GRAM = 0, 1


# ------------------------------------------------------------------------------------------- n-grams
def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all predictions of all texts, and each text's number of them.

    A code holds the context, nearest byte first, and then the byte itself; so a shorter context is a prefix.
    """
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = bytes([EDGE])
    buf = np.frombuffer(b"".join(edge * order + t + edge for t in texts), np.uint8)
    n = len(buf) - order
    codes = np.zeros(n, np.uint64)
    for back in range(1, order + 1):
        codes |= buf[order - back : order - back + n].astype(np.uint64) << np.uint64(8 * (order + 1 - back))
    codes |= buf[order:]
    sizes = np.array([len(t) + 1 for t in texts])
    keep = np.ones(n, bool)
    seams = np.cumsum(sizes + order)[:-1] - order  # windows that would predict the next text's leading edges
    for k in range(order):
        keep[seams + k] = False
    return codes[keep], sizes


def _count(batches):
    """Sparse counts of order-2 n-grams of one partition."""
    size = 1 << (8 * (NEAR + 1))
    total = None
    for batch in batches:
        texts = C.encoded(batch.column(0).to_pylist())
        for a, b in C.in_batches(texts):
            codes, _ = grams(texts[a:b], NEAR)
            codes, n = C.summed(codes, np.ones(len(codes), np.int64))
            total = np.zeros(size, np.int64) if total is None else total
            total[codes.astype(np.int64)] += n
    if total is not None:
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], names=["code", "n"])


# --------------------------------------------------------------------------------------------- model
class _Level:
    """One order of the trie: entries (context and successor) with counts; contexts with totals and kinds."""

    def __init__(self, entries: np.ndarray, n: np.ndarray):
        self.entries, self.n = entries, n.astype(np.float64)
        ctx = entries >> np.uint64(8)
        cut = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.empty(0, np.int64)
        self.contexts = ctx[cut]
        self.total = np.add.reduceat(self.n, cut) if len(cut) else np.empty(0)
        self.kinds = np.diff(np.concatenate((cut, [len(ctx)]))).astype(np.float64)
        self.cut = cut

    def covered(self, longer: _Level) -> np.ndarray:
        """For each context of the next higher order: this order's counts of the successors seen there."""
        e = longer.entries
        at, _ = C.found_in(self.entries, ((e >> np.uint64(16)) << np.uint64(8)) | (e & np.uint64(255)))
        return np.add.reduceat(self.n[at], longer.cut) if len(longer.cut) else np.empty(0)


def ppm_costs(codes: np.ndarray, n: np.ndarray, near_codes: np.ndarray, near_n: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probabilities of n-grams under the model with the given counts.

    ``codes`` may hold n-grams with n = 0, which are asked for but don't count; all with the same NEAR + 1 nearest context
    bytes must be given together.  ``near_codes`` and ``near_n`` are the counts of order NEAR of the whole corpus.
    """
    known = n > 0
    levels: list[_Level] = []
    for j in range(order + 1):
        source, counts, k = (codes[known], n[known], order) if j > NEAR else (near_codes, near_n, NEAR)
        e = ((source >> np.uint64(8 * (k - j + 1))) << np.uint64(8)) | (source & np.uint64(255))
        levels.append(_Level(*C.summed(e, counts)))
    logp, done = np.zeros(len(codes)), np.zeros(len(codes), bool)
    covered, kinds = np.zeros(len(codes)), np.zeros(len(codes))
    for j in range(order, -1, -1):
        level = levels[j]
        ctx = codes >> np.uint64(8 * (order - j + 1))
        at, seen = C.found_in(level.contexts, ctx)
        entry, hit = C.found_in(level.entries, (ctx << np.uint64(8)) | (codes & np.uint64(255)))
        live = seen & ~done
        if live.any():
            left = np.where(live, level.total[at] - covered, 1.0)
            new = np.where(live, level.kinds[at] - kinds, 1.0)
            take = live & hit
            logp[take] += np.log10(level.n[entry[take]] / (left + new)[take])
            done |= take
            skip = live & ~hit & (new > 0)
            logp[skip] += np.log10(new[skip] / (left + new)[skip])
        if j:
            excluded = levels[j - 1].covered(level)
            covered = np.where(seen, excluded[at], 0.0) if len(excluded) else np.zeros(len(codes))
            kinds = np.where(seen, level.kinds[at], 0.0) if len(level.kinds) else np.zeros(len(codes))
        else:
            kinds = np.where(seen, level.kinds[at], 0.0) if len(level.kinds) else np.zeros(len(codes))
    rest = ~done
    logp[rest] -= np.log10(256.0 - kinds[rest])
    return logp


# ----------------------------------------------------------------------------------- corpus exchange
_ASK = pa.schema([("part", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("vals", pa.binary()), ("n", pa.binary())])
_ASK_SQL = "part int, g int, kind int, vals binary, n binary"
_NUMBER = 5  # bytes of a count within one group


def _ask(order: int, groups: int):
    """Distinct n-grams and lower-cased words of a group with their number in its learning documents."""
    bits = C.cell_bits(groups)

    def ask(key, table):
        learn = table.column("learn").to_numpy()
        texts = C.encoded(table.column("text").to_pylist())
        held: dict[int, list] = {WORD: [], GRAM: []}
        for a, b in C.in_batches(texts):
            h, counts = C.word_hashes([t.lower() for t in texts[a:b]])
            codes, sizes = grams(texts[a:b], order)
            for kind, x, each in ((WORD, h, counts), (GRAM, codes, sizes)):
                use = np.repeat(learn[a:b], each)
                for some, one in ((x[use], 1), (x[~use], 0)):
                    some = np.sort(some)
                    cut = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1]))) if len(some) else np.empty(0, np.int64)
                    held[kind].append((some[cut], one * np.diff(np.concatenate((cut, [len(some)])))))
        rows: dict[str, list] = {f.name: [] for f in _ASK}
        for kind, found in held.items():
            if not found:
                continue
            k, n = C.summed(*(np.concatenate(x) for x in zip(*found)))
            for cell, v, c in C.by_part(k, C.cell_of(k, bits), n):
                for name, x in zip(rows, (cell * groups >> bits, key[0].as_py(), kind, C.pack(v, 8), C.pack(c, _NUMBER))):
                    rows[name].append(x)
        return pa.table(rows, schema=_ASK)

    return ask


def _asked(table: pa.Table, kind: int):
    """Values, numbers and asking groups of the rows of one kind."""
    table = table.filter(pc.equal(table.column("kind"), kind))
    vals, sizes = C.unpacked(table.column("vals"), 8)
    n, _ = C.unpacked(table.column("n"), _NUMBER)
    return vals, n.astype(np.int64), np.repeat(table.column("g").to_numpy(), sizes)


_SUMS = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("keys", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
_SUMS_SQL = "bucket long, part int, keys array<long>, n array<long>"


def _sum(order: int, buckets: int):
    """One hash range: n-gram totals, by their nearest context bytes; bucket -1 holds the numbers of known words and of all."""
    def total(key, table):
        rows: dict[str, list] = {f.name: [] for f in _SUMS}
        _, n = C.summed(*_asked(table, WORD)[:2])
        keys, counts = C.summed(*_asked(table, GRAM)[:2])
        out = [(-1, np.empty(0, np.uint64), np.array([(n > 0).sum(), n.sum()]))]
        near = keys >> np.uint64(8 * (order - NEAR))
        out += list(C.by_part(keys, (C.mix(near) % np.uint64(buckets)).astype(np.int64), counts))
        for bucket, k, c in out:
            for name, x in zip(rows, (bucket, key[0].as_py(), k.view(np.int64), c)):
                rows[name].append(x)
        return pa.table(rows, schema=_SUMS)

    return total


def _joined(table, name):
    return np.concatenate([np.empty(0, np.int64), *(x.values.to_numpy() for x in table.column(name) if len(x))])


_COSTS = pa.schema([("part", pa.int32()), ("keys", pa.list_(pa.int64())), ("cost", pa.list_(pa.float32()))])


def _cost(order: int, shared):
    """All n-grams of some nearest contexts: costs, by the hash range that asked."""
    def cost(key, table):
        keys, n = _joined(table, "keys").view(np.uint64), _joined(table, "n")
        part = np.repeat(table.column("part").to_numpy(), [len(x) for x in table.column("keys")])
        values = ppm_costs(keys, n, *shared.value, order)
        rows: dict[str, list] = {f.name: [] for f in _COSTS}
        for p, k, c in C.by_part(keys, part.astype(np.int64), values.astype(np.float32)):
            for name, x in zip(rows, (p, k.view(np.int64), c)):
                rows[name].append(x)
        return pa.table(rows, schema=_COSTS)

    return cost


_REPLY = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("vals", pa.binary()), ("more", pa.binary())])


def _reply(asks, costs):
    """One hash range: corpus counts of words and costs of n-grams, for every group that asked."""
    rows: dict[str, list] = {f.name: [] for f in _REPLY}
    vals, n, g = _asked(asks, WORD)
    keys, sums = C.summed(vals, n)
    at, _ = C.found_in(keys, vals)
    answers = [(WORD, g, vals, sums[at] if len(sums) else n)]
    vals, n, g = _asked(asks, GRAM)
    keys = _joined(costs, "keys").view(np.uint64)
    value = np.concatenate([np.empty(0, np.float32), *(x.values.to_numpy() for x in costs.column("cost") if len(x))])
    order = np.argsort(keys)
    at, _ = C.found_in(keys[order], vals)
    answers.append((GRAM, g, vals, value[order][at] if len(value) else np.zeros(len(vals), np.float32)))
    for kind, g, vals, more in answers:
        for to, v, m in C.by_part(vals, g.astype(np.int64), more):
            for name, x in zip(rows, (to, kind, C.pack(v, 8), m.tobytes())):
                rows[name].append(x)
    return pa.table(rows, schema=_REPLY)


# ----------------------------------------------------------------------------------------- scoring
_OUT = pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64())])
_OUT_SQL = "doc_id long, learn boolean, n_tokens long, n_known long, log_counts double, score double"


def _answers(reply: pa.Table, kind: int, dtype):
    table = reply.filter(pc.equal(reply.column("kind"), kind))
    vals, _ = C.unpacked(table.column("vals"), 8)
    more = np.concatenate([np.empty(0, dtype), *(np.frombuffer(b, dtype) for b in table.column("more").to_pylist())])
    return C.Index(vals), more


def _totals(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, some of which may be empty."""
    ends = np.cumsum(sizes)
    sums = np.concatenate(([0], np.cumsum(x)))
    return sums[ends] - sums[ends - sizes]


def _score(order: int, ends: int):
    def score(docs, reply):
        ids, learn = docs.column("doc_id").combine_chunks(), docs.column("learn").combine_chunks()
        texts = C.encoded(docs.column("text").to_pylist())
        (words, count), (known, cost), out = _answers(reply, WORD, np.int64), _answers(reply, GRAM, np.float32), []
        for a, b in C.in_batches(texts):
            h, counts = C.word_hashes([t.lower() for t in texts[a:b]])
            c = count[words.find(h)] if len(h) else np.empty(0, np.int64)
            logs = np.add.reduceat(np.append(np.log10(c + 1.0), 0.0), np.cumsum(counts) - counts)
            logs[counts == 0] = 0.0
            codes, sizes = grams(texts[a:b], order)
            scores = np.add.reduceat(cost[known.find(codes)].astype(np.float64), np.cumsum(sizes) - sizes)
            out.append(pa.table([ids.slice(a, b - a), learn.slice(a, b - a), pa.array(counts + 1), pa.array(_totals(c > 0, counts) + int(ends > 0)), pa.array(logs + np.log10(ends + 1)), pa.array(scores)], schema=_OUT))
        return pa.concat_tables(out) if out else _OUT.empty_table()

    return score


def near_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of order-2 n-grams of one text column; at most 2**24 rows reach the driver."""
    rows = texts.mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    return rows.column("code").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64)


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row for each row of docs: id, learn, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are ASCII-lower-cased words and one end.  base_score sums log10((c + 1) / (N + V + 1)) over a text's
    tokens, with counts of the rows where ``learn`` holds (null: doesn't); score is the PPM model's log10
    probability of the text and its end.  Null text counts as empty.  With nothing to learn from, all counts are 0
    and bytes are equally likely.  Repeated rows count as often as they occur.  Other columns of docs are ignored.
    ``order``: context bytes, 3 to 6.
    """
    if not NEAR < order <= 6:
        raise ValueError("order must be 3 to 6")
    spark = docs.sparkSession
    marked = docs.withColumn("__learn", F.coalesce(learn, F.lit(False)))
    grouped, groups = C.in_groups(marked, id_col, text_col, GROUP_BYTES, more={"learn": F.col("__learn")})
    ends = marked.where("__learn").count()
    shared = spark.sparkContext.broadcast(near_counts(marked.where("__learn").select(text_col)))
    asks = grouped.groupBy("g").applyInArrow(_ask(order, groups), _ASK_SQL)
    sums = asks.groupBy("part").applyInArrow(_sum(order, groups), _SUMS_SQL)
    costs = sums.where("bucket >= 0").groupBy("bucket").applyInArrow(_cost(order, shared), "part int, keys array<long>, cost array<float>")
    replies = asks.groupBy("part").cogroup(costs.groupBy("part")).applyInArrow(_reply, "g int, kind int, vals binary, more binary")
    out = grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(_score(order, ends), _OUT_SQL)
    seen = sums.where("bucket < 0").agg(F.coalesce(F.sum(F.col("n")[1]), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n")[0]), F.lit(0)).alias("v"))
    n_train = F.lit(ends) + seen.select("n").scalar()
    base = F.col("log_counts") - F.col("n_tokens") * F.log10((n_train + seen.select("v").scalar() + F.lit(int(ends > 0) + 1)).cast("double"))
    return out.select(F.col("doc_id").alias(id_col), "learn", "n_tokens", "n_known", n_train.cast("long").alias("train_tokens"), base.alias("base_score"), "score")
