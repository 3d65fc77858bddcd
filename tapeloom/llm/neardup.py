"""Near-duplicate documents by b-bit MinHash with exact confirmation.

Every document's set holds its distinct five-word shingles (ASCII lower case).  Equal sets form one class.
For class representatives, 64 minima give 16 band keys of four; the low four bits of each minimum are packed
into four longs.  Documents sharing a band bucket are candidates; a candidate pair goes on when its similarity,
estimated from bit counts and corrected for chance collisions, is not far below the threshold, and is then
confirmed on the full sets.

A bucket may hold a third of all rows, so pairs are never expanded within one.  First each member is compared
with the bucket's smallest id.  Then, as long as a bucket holds members of several components, a growing
share of the members outside its largest component is compared with all members of other components, until all
have been.  So every pair that shares a bucket is either compared or already connected.

A node is a document id.  An id that repeats with different texts has several signatures and texts; a pair of ids is linked
if any of their texts are, and the classes that such an id belongs to are linked through it.

Joins on a bucket, on the document that a large bucket is compared with, and on the centre of a large component are
salted by the other side, with salts in proportion to the input, so no task gathers a hot key.  Where the smaller side
is counted as few rows, it is broadcast instead, so small tables don't pass through many shuffles.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MINIMA, ROWS, BITS = 64, 4, 4
BANDS = MINIMA // ROWS
#: An estimate this far (about six standard deviations at 64 minima) below the threshold rules a pair out.
MARGIN = 0.28
#: Members of undecided buckets get a longer signature of two bits a minimum, whose estimate is that much sharper.
SHARP_MINIMA, SHARP_BITS, SHARP_MARGIN = 1024, 2, 0.07
#: Class representatives for each salt of a hot key, and the fewest salts; pairs confirmed by one task at a time.
ROWS_PER_SALT, LEAST_SALTS, PAIRS_PER_SLOT = 20_000, 16, 250
#: Comparisons of packed signatures in one residual round: for each class representative, and at least.
PAIRS_PER_ROW, PAIRS_LEAST = 64, 4_000_000
#: Tasks that counted few rows are packed into after a shuffle.
PACKED = 12
#: Longs of a signature that are compared by an expression each; 32 of them took three times as long so as by one aggregate.
LONGS_IN_LINE = 8

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 2**63, SHARP_MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SHARP_MINIMA, dtype=np.uint64)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, concatenated, and each text's number of them."""
    h, counts = C.word_hashes([t.lower() for t in texts])
    at, each = C.run_starts(counts, n)
    values, owner = C.runs(h, n)[at], np.repeat(np.arange(len(texts)), each)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # a text of fewer words is one shingle
        first = np.cumsum(counts) - counts
        whole = [C.mix(C.runs(h[first[i] : first[i] + counts[i]], int(counts[i])) + np.uint64(counts[i] + 1)) for i in short]
        values, owner = np.concatenate([values, *whole]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
        values, owner = values[new], owner[new]
    return values, np.bincount(owner, minlength=len(texts))


def _minima(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((len(starts), n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(values * _A[k] + _B[k], starts)
    return out


def _packed(minima: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each minimum, packed into longs."""
    low, per = minima & np.uint64(2**bits - 1), 64 // bits
    packed = np.zeros((len(minima), minima.shape[1] // per), np.uint64)
    for j in range(per):
        packed |= low[:, j::per] << np.uint64(bits * j)
    return packed.view(np.int64)


def _set_hash(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.add.reduceat(C.mix(values + np.uint64(1)), starts) + counts.astype(np.uint64)
    return one.view(np.int64), np.add.reduceat(C.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts).view(np.int64)


def _signatures(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts with shingles: set hash (two longs), band keys and packed low bits."""
    starts = np.cumsum(counts) - counts
    minima = _minima(values, starts, MINIMA)
    keys = C.mix(minima[:, 0::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in range(1, ROWS):
        keys = C.mix(keys * np.uint64(3) + minima[:, r::ROWS])
    return *_set_hash(values, starts, counts), keys.view(np.int64), _packed(minima, BITS)


def _sharpen(n: int):
    def sharpen(batches):
        for batch in batches:
            texts = C.encoded(batch.column(1).to_pylist())
            for a, b in C.in_batches(texts, 1 << 20, 1000):
                values, counts = shingle_sets(texts[a:b], n)
                has = counts > 0
                each = counts[has]
                if len(each):
                    starts = np.cumsum(each) - each
                    rows = _packed(_minima(values, starts, SHARP_MINIMA), SHARP_BITS)
                    k1, k2 = _set_hash(values, starts, each)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(pa.array(has)), pa.array(k1), pa.array(k2), _lists(rows, np.ones(len(rows), bool))], names=["id", "k1", "k2", "sharp"])

    return sharpen


_SIG_SCHEMA = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig array<long>"
_SIG_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])


def _lists(rows: np.ndarray, has: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    offsets = np.concatenate(([0], np.cumsum(np.where(has, width, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _sign(n: int):
    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), C.encoded(batch.column(1).to_pylist())
            for a, b in C.in_batches(texts):
                values, counts = shingle_sets(texts[a:b], n)
                has = counts > 0
                one, two, keys, packed = _signatures(values, counts[has]) if has.any() else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BANDS), np.int64), np.empty((0, 4), np.int64))
                k1, k2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                k1[has], k2[has] = one, two
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(k1), pa.array(k2), _lists(keys, has), _lists(packed, has)], schema=_SIG_ARROW)

    return sign


def _confirm(n: int, per_cent: int):
    """Pairs of one slot with each text of the second, and each text of the firsts once: pairs of which any two texts are similar enough."""
    def confirm(pairs, firsts):
        own, index, texts = defaultdict(list), {}, []
        for x, t in zip(firsts.column("a_").to_pylist(), firsts.column("text_").to_pylist()):
            own[x].append(len(texts))
            texts.append(t)
        a, b, right = pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), []
        for key in zip(b, pairs.column("text").to_pylist()):
            if key not in index:
                index[key] = len(texts)
                texts.append(key[1])
            right.append(index[key])
        texts, sets = C.encoded(texts), []
        for x, y in C.in_batches(texts):
            values, counts = shingle_sets(texts[x:y], n)
            sets += np.split(values, np.cumsum(counts)[:-1])

        def alike(p: np.ndarray, q: np.ndarray) -> bool:
            both = np.intersect1d(p, q, assume_unique=True).size
            return both > 0 and 100 * both >= per_cent * (len(p) + len(q) - both)

        ok = [any(alike(sets[i], sets[y]) for i in own[x]) for x, y in zip(a, right)]
        return pa.table({"a": pa.array([x for x, k in zip(a, ok) if k], pa.int64()), "b": pa.array([x for x, k in zip(b, ok) if k], pa.int64())})

    return confirm


def estimated(x: Column, y: Column, minima: int = MINIMA, bits: int = BITS) -> Column:
    """Similarity estimated from two packed signatures: equal lanes, corrected for those that agree by chance."""
    lanes = sum(1 << (bits * j) for j in range(64 // bits))
    lanes -= (1 << 64) if lanes >> 63 else 0

    def unequal(p: Column, q: Column) -> Column:
        d, shift = p.bitwiseXOR(q), 1
        while shift < bits:
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
            shift *= 2
        return F.bit_count(d.bitwiseAND(F.lit(lanes).cast("long")))

    longs = minima * bits // 64
    if longs <= LONGS_IN_LINE:
        differ = reduce(lambda p, q: p + q, (unequal(x[i], y[i]) for i in range(longs)))
    else:
        differ = F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda total, n: total + n)
    chance = 2.0**-bits
    return (1.0 - differ / float(minima) - chance) / (1.0 - chance)


def _packed_rows(df: DataFrame) -> DataFrame:
    """Counted few rows in few tasks, however many partitions the session's shuffles have."""
    return df.coalesce(PACKED)


def components(edges: DataFrame, most_rounds: int = 60, salts: int = LEAST_SALTS) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component_id) with each component's smallest id.

    Alternates large-star and small-star steps until the edges no longer change; the rounds grow with the
    logarithm of the input.  Only two aggregates of a round reach the driver.  No step makes more edges than there were.
    """
    small_side = C.few(edges)
    packed = _packed_rows if small_side else lambda df: df

    def linked(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        both = linked(e)
        least = packed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        return C.spread_join(both, least, "a", "b", salts, small_side).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = packed(down.groupBy("a").agg(F.min("b").alias("m")))
        moved = C.spread_join(down, least, "a", "b", salts, small_side).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return packed(moved.union(least.select("a", F.col("m").alias("b"))).distinct())

    now, mark = C.stored(small(edges), "star"), None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = C.stored(small(large(now)), "star")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct()
    return packed(now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots.select("id", F.col("id").alias("component_id"))))


class _Linker:
    """Candidate rounds over the signatures of class representatives."""

    def __init__(self, docs: DataFrame, reps: DataFrame, n: int, per_cent: int, salts: int):
        self.docs, self.reps, self.n, self.per_cent, self.salts = docs, reps, n, per_cent, salts
        self.floor = per_cent / 100 - MARGIN
        self.sigs = reps.select(F.col("doc_id").alias("id"), "sig")
        members = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")).distinct()
        shared = C.stored(members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1"), "shared")
        self.few_keys = C.few(shared)
        self.members = C.stored(C.spread_join(members, shared, "key", "id", salts, self.few_keys), "buckets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough; a text that has many pairs goes once to each of its slots."""
        pairs = C.stored(pairs, "pairs")
        n = pairs.count()
        slots = max(1, n // PAIRS_PER_SLOT)
        small = n <= C.BROADCAST_ROWS
        narrow = (lambda df: F.broadcast(_packed_rows(df))) if small else lambda df: df
        pairs = pairs.withColumn("slot", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(self.salts))), F.lit(slots)).cast("int"))
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = C.stored(C.only_ids(self.docs, ids, "doc_id").select("doc_id", "text").dropDuplicates(["doc_id", "text"]), "texts")
        second = narrow(pairs).join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
        first = narrow(pairs.select("slot", "a").distinct()).join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
        first = first.select(*(F.col(c).alias(f"{c}_") for c in ("slot", "a", "text")))
        out = second.groupBy("slot").cogroup(first.groupBy("slot_")).applyInArrow(_confirm(self.n, self.per_cent), "a long, b long").distinct()
        return _packed_rows(out) if small else out

    def first(self) -> DataFrame:
        """Every bucket member against the smallest id of its bucket."""
        pairs = self.members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
        a, b = (self.sigs.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
        near = C.spread_join(pairs, a, "a", "b", self.salts).join(b, "b").where(estimated(F.col("sa"), F.col("sb")) >= self.floor)
        return self.confirmed(near.select("a", "b"))

    def labelled(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")

    def mark_odd(self, labels: DataFrame) -> None:
        """Adds ``odd`` to the members, once: outside the largest component that their bucket holds by now."""
        by = self.labelled(self.members, labels).groupBy("key", "comp").agg(F.count("*").alias("n"))
        top = by.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
        rows = C.spread_join(self.labelled(self.members, labels), top.drop("comps"), "key", "id", self.salts, self.few_keys)
        rows = C.stored(rows.select("key", "id", "size", (F.col("comp") != F.col("top")).alias("odd")), "open")
        texts = C.only_ids(self.docs, rows.select(F.col("id").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
        sharp = texts.mapInArrow(_sharpen(self.n), "id long, k1 long, k2 long, sharp array<long>").dropDuplicates(["id", "k1", "k2"])
        self.sigs = C.stored(self.reps.select(F.col("doc_id").alias("id"), "k1", "k2", "sig", "bands").join(sharp, ["id", "k1", "k2"]).drop("k1", "k2"), "sharp")
        self.members = rows

    def still_open(self, labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components."""
        rows = self.labelled(self.members, labels)
        several = rows.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
        return C.spread_join(rows, several, "key", "id", self.salts, self.few_keys)

    def residual(self, open_: DataFrame, low: float, high: float) -> DataFrame:
        """Compares the odd members whose hash lies in [low, high) of all with all members of other components.

        Odd members with a lower hash had their turn before; members that aren't odd are connected to each other.
        A pair that shares several buckets comes from the one with the smallest key.
        """
        rows = open_.join(self.sigs, "id").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20))
        x = rows.where(F.col("odd") & (F.col("turn") >= low) & (F.col("turn") < high)).select("key", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("sig").alias("sx"), F.col("sharp").alias("px"), F.col("bands").alias("bx"))
        y = rows.where(~F.col("odd") | (F.col("turn") >= low)).select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("sig").alias("sy"), F.col("sharp").alias("py"), F.col("bands").alias("by"), (F.col("odd") & (F.col("turn") < high)).alias("also"))
        y = y.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(self.salts)).cast("int"))
        x = x.join(y.select(F.col("key").alias("k"), F.col("salt").alias("xs")).distinct(), F.col("key") == F.col("k")).drop("k")
        near = x.join(y, (x["key"] == y["key"]) & (F.col("xs") == F.col("salt")) & (F.col("cx") != F.col("cy")) & (~F.col("also") | (F.col("x") < F.col("y"))) & (estimated(F.col("sx"), F.col("sy")) >= self.floor) & (estimated(F.col("px"), F.col("py"), SHARP_MINIMA, SHARP_BITS) >= self.per_cent / 100 - SHARP_MARGIN) & (F.array_min(F.array_intersect("bx", "by")) == x["key"]))
        return self.confirmed(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _labels(edges: DataFrame, salts: int) -> DataFrame:
    out = C.stored(components(edges, salts=salts), "labels")
    return F.broadcast(out) if C.few(out) else out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, per_cent: int = 85) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Texts whose shingle sets have 100 * intersection >= per_cent * union are linked; component_id is the smallest
    id reachable.  Null or empty texts and texts of white space have no shingles and are linked with nothing.
    A row with a null id takes part in no link, has a null component and is kept.  Rows repeating an id each get a
    row; an id is linked with whatever any of its texts is, so all rows of an id have one component.  Other columns of docs are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = C.stored(base.mapInArrow(_sign(n), _SIG_SCHEMA), "signatures")
    able = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = C.stored(able.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = C.stored(able.join(classes.select("k1", "k2", "n_shingles", F.col("rep").alias("doc_id")), ["k1", "k2", "n_shingles", "doc_id"]).select("doc_id", "k1", "k2", "bands", "sig").dropDuplicates(["doc_id", "k1", "k2"]), "representatives")
    ids = C.stored(able.select("doc_id", "k1", "k2", "n_shingles").distinct().join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "rep"), "ids")
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    through = ids.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))  # texts of one id are linked
    size = reps.count()
    salts = max(LEAST_SALTS, -(-size // ROWS_PER_SALT))
    linker = _Linker(base, reps, n, per_cent, salts)
    links = C.stored(linker.first().union(through), "links")
    labels = _labels(links, salts)
    budget = max(PAIRS_LEAST, PAIRS_PER_ROW * size)
    linker.mark_odd(labels)
    low = 0.0
    while low < 1.0:
        open_ = C.stored(linker.still_open(labels), "open")
        todo = open_.where("odd").agg(F.sum(F.col("size").cast("double"))).first()[0] or 0.0
        if not todo:
            break
        high = min(1.0, max(low * 4, low + budget / todo))
        high = 1.0 if high > 0.5 else high
        more = C.stored(linker.residual(open_, low, high), "links")
        if more.limit(1).count():
            labels = _labels(labels.select(F.col("id").alias("a"), F.col("component_id").alias("b")).where("a <> b").union(more), salts)
        low = high
    own = ids.join(labels, ids["rep"] == labels["id"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    comp = F.coalesce("component_id", "doc_id")
    return sigs.select("doc_id", "n_shingles").join(own, "doc_id", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept")
    )
