"""Moments of all pairs of many columns in one pass, merged by part: correlations at any number of columns.

A task turns its rows into a matrix and its null mask, and three matrix products give count, sums and products of every pair
over the rows that have both values.  Such blocks add up, whatever the cut into tasks, so only a row for a pair, part and task is
shuffled.  Values are taken relative to a mean of some rows, which keeps the sums of squares from cancelling.

Ranks are made once for each column and set of rows: its values are cut into ranges, whose sizes are counted, and a range's ranks
start where the ranges before it end, so no task sorts more than ranges of one column in one part.  A frequent value is a range
of its own and isn't sorted.

Results are long: part columns, a, b (in the order of the list), method and value.  A pair with fewer than two rows
or with a constant side has a null value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Bytes of sums that a task holds before it gives them out, and tasks that the rows of one part are dealt to.
HELD_BYTES, SALTS = 64 << 20, 8
#: Rows whose mean the values are taken relative to.
SHIFT_ROWS = 1000
#: Ranges that the values of a column are cut into when they are ranked, and tasks that ranges and rows are dealt to.
RANGES, TASKS = 64, 256
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _gram(x: np.ndarray) -> np.ndarray:
    """Stack (n, sum of x, sum of x squared, sum of products) by pair; entry (i, j) is about column i where j is there too."""
    there = ~np.isnan(x)
    x, m = np.where(there, x, 0.0), there.astype(float)
    return np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])


def _blocks(features: list[str], shift: np.ndarray, part: list[str]):
    p = len(features)
    i, j = np.triu_indices(p, 1)
    names = np.array(features)

    def rows(held: dict) -> pa.RecordBatch:
        keys, sums = list(held), np.stack(list(held.values()))
        n, s, q, xy = (sums[:, k] for k in range(4))
        columns = [pa.array(np.repeat(np.arange(len(keys)), len(i)))]
        of_key = [pa.array([k[c] for k in keys], t).take(columns[0]) for c, t in enumerate(kinds)]
        values = (n[:, i, j], s[:, i, j], s[:, j, i], q[:, i, j], q[:, j, i], xy[:, i, j])
        ab = [pa.array(np.tile(names[k], len(keys))) for k in (i, j)]
        return pa.RecordBatch.from_arrays([*of_key, *ab, *(pa.array(v.ravel()) for v in values)], names=[*part, "a", "b", *_SUMS])

    kinds: list[pa.DataType] = []

    def gather(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds[:] = [batch.schema.field(c).type for c in part]
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features]) - shift
            if part:
                coded = [batch.column(c).dictionary_encode() for c in part]
                codes = np.column_stack([np.where(np.asarray(c.indices.is_null()), -1, c.indices.fill_null(0).to_numpy(zero_copy_only=False)) for c in coded])
                found, at = np.unique(codes, axis=0, return_inverse=True)
                order = np.argsort(at.ravel(), kind="stable")
                ends = np.cumsum(np.bincount(at.ravel(), minlength=len(found)))
                groups = [(tuple(None if k < 0 else c.dictionary[int(k)].as_py() for k, c in zip(f, coded)), x[order[a:b]]) for f, a, b in zip(found, (0, *ends[:-1]), ends)]
            else:
                groups = [((), x)]
            for key, values in groups:
                g = _gram(values)
                held[key] = held[key] + g if key in held else g
                if len(held) * g.nbytes > HELD_BYTES:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return gather


def pair_moments(df: DataFrame, features: list[str], part: list[str] | None = None) -> DataFrame:
    """Rows (part, a, b, n, sx, sy, sxx, syy, sxy) over the rows that have both values, for each pair that some row has."""
    part = part or []
    src = df.select(*part, *(F.col(f).cast("double").alias(f) for f in features))
    some = src.limit(SHIFT_ROWS).agg(*(F.avg(F.when(~F.isnan(f), F.col(f))).alias(f) for f in features)).first()
    shift = np.array([0.0 if v is None or not np.isfinite(v) else v for v in some])
    if part:  # rows of a part meet in a few tasks, so that each gives out a part once
        src = src.withColumn("__salt", F.pmod(F.xxhash64(*features), F.lit(SALTS))).repartition(*part, "__salt").drop("__salt")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name in part)
    each = src.mapInArrow(_blocks(features, shift, part), kinds + "a string, b string, " + ", ".join(f"{s} double" for s in _SUMS))
    sums = each.groupBy(*part, "a", "b").agg(*(F.sum(s).alias(s) for s in _SUMS))
    return sums.where("n > 0").withColumn("n", F.col("n").cast("long"))


def _pearson() -> Column:
    vx, vy = (F.col(f"s{c}{c}") / F.col("n") - (F.col(f"s{c}") / F.col("n")) ** 2 for c in "xy")
    spread = F.sqrt(vx) * F.sqrt(vy)
    moves = (F.col("n") >= 2) & (vx > F.col("sxx") / F.col("n") * 1e-12) & (vy > F.col("syy") / F.col("n") * 1e-12) & (spread > 1e-14)
    return F.when(moves, F.least(F.greatest((F.col("sxy") / F.col("n") - F.col("sx") * F.col("sy") / F.col("n") ** 2) / spread, F.lit(-1.0)), F.lit(1.0)))


def correlations(df: DataFrame, features: list[str], part: list[str] | None = None) -> DataFrame:
    """Pearson of all pairs, by part: (part, a, b, n, method, value)."""
    return pair_moments(df, features, part).select(*(part or []), "a", "b", "n", F.lit("pearson").alias("method"), _pearson().alias("value"))


def merged(moments: DataFrame, *by: str) -> DataFrame:
    """Moments of several parts or runs as those of their union (they must share the shift, so come from one call)."""
    return moments.groupBy(*by, "a", "b").agg(*(F.sum(s).alias(s) for s in _SUMS))


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])


def _shared(src: DataFrame, features: list[str]) -> dict:
    """For each part a matrix: how many of its rows have both of two columns."""
    p = len(features)

    def gather(batches):
        held: dict = {}
        for batch in batches:
            there, coded = (~np.isnan(_matrix(batch, features))).astype(float), batch.column("__part").dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            for k, key in enumerate(coded.dictionary.to_pylist()):
                m = there[at == k]
                held[key] = held.get(key, 0) + m.T @ m
        if held:
            kind = coded.dictionary.type
            columns = [pa.array(list(held), kind).take(pa.array(np.repeat(np.arange(len(held)), p * p))), pa.array(np.tile(np.arange(p * p), len(held))), pa.array(np.concatenate([m.ravel() for m in held.values()]))]
            yield pa.RecordBatch.from_arrays(columns, names=["__part", "at", "n"])

    kind = src.schema["__part"].dataType.simpleString()
    out: dict = {}
    for r in src.mapInArrow(gather, f"__part {kind}, at long, n double").groupBy("__part", "at").agg(F.sum("n").alias("n")).collect():  # a row for each part and pair of columns
        out.setdefault(r["__part"], np.zeros(p * p))[r["at"]] = r["n"]
    return {k: v.reshape(p, p) for k, v in out.items()}


@dataclass(frozen=True)
class _Among:
    """Among which rows of a part each column of a pair is ranked.

    Class 0 of a column holds all rows that have it, class c those that also have the column ``also[c]``; ``of[a, b]`` is the
    class of a in its pair with b.
    """

    also: list
    of: np.ndarray

    @staticmethod
    def all(p: int) -> _Among:
        return _Among([None], np.zeros((p, p), int))

    @staticmethod
    def pairs(n: np.ndarray) -> _Among:
        """Ranks among the rows that have both columns; columns that the same rows have share a class."""
        own, also, of = np.diag(n), [None], np.zeros(n.shape, int)
        for b in range(len(n)):
            lacks = n[:, b] < own
            if lacks.any():
                same = [c for c in range(1, len(also)) if n[also[c], b] == own[b] == own[also[c]]]
                if not same:
                    also.append(b)
                of[lacks, b] = same[0] if same else len(also) - 1
        return _Among(also, of)


class _Ranges:
    """Values of (part, class, column) in ranges between cuts; a value that is a cut has a range of its own."""

    def __init__(self, features: list[str], cuts: dict, among: dict):
        self.features, self.parts, self.p = features, list(cuts), len(features)
        self.cuts, self.among = [[np.unique([v for v in c or []]) for c in cuts[k]] for k in self.parts], [among[k] for k in self.parts]
        self.classes, self.slots = max((len(a.also) for a in self.among), default=1), 2 * RANGES
        self.size = len(self.parts) * self.classes * self.p * self.slots

    def placed(self, batch: pa.RecordBatch):
        """(group, range, row of the batch, value) arrays; ranges of one value are odd."""
        x, known = _matrix(batch, self.features), batch.column("__part")
        at = pc.index_in(known, value_set=pa.array(self.parts, known.type)).to_numpy(zero_copy_only=False)
        for k in np.unique(at):
            among, rows = self.among[k], np.flatnonzero(at == k)
            for a in range(self.p):
                has = rows[~np.isnan(x[rows, a])]
                v, cuts = x[has, a], self.cuts[k][a]
                lo = np.searchsorted(cuts, v)
                slot = 2 * lo + (cuts[np.minimum(lo, len(cuts) - 1)] == v if len(cuts) else 0)
                for c in np.unique(np.delete(among.of[a], a)) if self.p > 1 else ():
                    own = slice(None) if c == 0 else ~np.isnan(x[has, among.also[c]])
                    r = has[own]
                    yield np.full(len(r), (k * self.classes + c) * self.p + a, np.int32), slot[own].astype(np.int32), r, v[own]

    def counted(self, batches):
        n = np.zeros(self.size, np.int64)
        for batch in batches:
            for g, slot, _, _ in self.placed(batch):
                if len(g):
                    first = int(g[0]) * self.slots
                    n[first : first + self.slots] += np.bincount(slot, minlength=self.slots)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    def given_out(self, single: np.ndarray | None):
        """Rows (g, slot, id, x): those of ranges of several values, or, with their ranks as x, the others."""

        def gather(batches):
            for batch in batches:
                each, ids = [t for t in self.placed(batch) if len(t[0])], batch.column("__id").to_numpy()
                if each:
                    g, slot, r, v = (np.concatenate(c) for c in zip(*each))
                    mine = slot % 2 == (single is not None)
                    g, slot, r, v = g[mine], slot[mine], r[mine], v[mine]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (g, slot, ids[r], v if single is None else single[g.astype(np.int64) * self.slots + slot])], names=["g", "slot", "id", "x"])

        return gather

    def products(self, before: np.ndarray):
        """Moments (part, pair, sums) of ranks, from rows (id, g, slot, x) that are sorted by id."""
        p, i, j = self.p, *np.triu_indices(self.p, 1)
        steps = [sorted({(int(m.of[a, b]), int(m.of[b, a])) for a, b in zip(i, j)}) for m in self.among]

        def add(held: dict, ids, g, slot, x):
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            at, part = np.cumsum(first) - 1, g[first] // (p * self.classes)
            ranks = np.full((at[-1] + 1, self.classes, p), np.nan)
            ranks[at, g // p % self.classes, g % p] = x + before[g.astype(np.int64) * self.slots + slot]
            for k in np.unique(part):
                mine, of = ranks[part == k], self.among[k].of
                sums = held.setdefault(int(k), np.zeros((6, p, p)))
                for c, d in steps[k]:
                    u, v = mine[:, c], mine[:, d]
                    m, n = (~np.isnan(u)).astype(float), (~np.isnan(v)).astype(float)
                    u, v = np.nan_to_num(u), np.nan_to_num(v)
                    sums += np.stack([m.T @ n, u.T @ n, m.T @ v, (u * u).T @ n, m.T @ (v * v), u.T @ v]) * ((of == c) & (of.T == d))

        def gather(batches):
            held, rest = {}, None
            for batch in batches:
                if batch.num_rows:
                    now = [batch.column(c).to_numpy() for c in ("id", "g", "slot", "x")]
                    now = now if rest is None else [np.concatenate(c) for c in zip(rest, now)]
                    whole = int(np.searchsorted(now[0], now[0][-1]))
                    if whole:
                        add(held, *(c[:whole] for c in now))
                    rest = [c[whole:] for c in now]
            if rest is not None:
                add(held, *rest)
            names = np.array(self.features)
            for k, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k)), pa.array(names[i].tolist()), pa.array(names[j].tolist()), *(pa.array(s[i, j]) for s in sums)], names=["part", "a", "b", *_SUMS])

        return gather


def _rank_moments(src: DataFrame, features: list[str], among: dict | None = None) -> DataFrame:
    """Rows (part, a, b, n, value): Pearson of ranks of a stored table (__part, features); ties share the mean of their places.

    Two shuffles of narrow rows: values meet by ranges of a part, class and column, then the ranks of a row by its id.  What
    lies before a range, and the ranks in a range of one value, follow from the counts of all ranges.
    """
    at = [i / RANGES for i in range(1, RANGES)]
    cuts = {r[0]: r[1:] for r in src.groupBy("__part").agg(*(F.percentile_approx(f, at, F.lit(1000)) for f in features)).collect()}
    ranges = _Ranges(features, cuts, among or {k: _Among.all(len(features)) for k in cuts})
    n = np.zeros(ranges.size, np.int64)
    for r in src.mapInArrow(ranges.counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each range
        n[r["at"]] = r["n"]
    before = (np.cumsum(n.reshape(-1, ranges.slots), axis=1) - n.reshape(-1, ranges.slots)).ravel().astype(float)
    rows, kinds = src.withColumn("__id", F.monotonically_increasing_id()), "g int, slot int, id long, x double"
    values = rows.mapInArrow(ranges.given_out(None), kinds).repartition(TASKS, "g", "slot")
    up_to = Window.partitionBy("g", "slot").orderBy("x")
    ranked = values.select("g", "slot", "id", ((F.rank().over(up_to) + F.count(F.lit(1)).over(up_to)) / 2.0).alias("x"))
    ranked = ranked.unionByName(rows.mapInArrow(ranges.given_out((n + 1) / 2.0), kinds))
    sums = ranked.repartition(TASKS, "id").sortWithinPartitions("id").mapInArrow(ranges.products(before), "part long, a string, b string, " + ", ".join(f"{s} double" for s in _SUMS))
    sums = sums.groupBy("part", "a", "b").agg(*(F.sum(s).alias(s) for s in _SUMS)).where("n > 0")
    return sums.select("part", "a", "b", F.col("n").cast("long").alias("n"), _pearson().alias("value"))


def _kept(df: DataFrame, features: list[str], part: Column) -> DataFrame:
    values = (F.col(f).cast("double") for f in features)
    return stored(df.select(part.alias("__part"), *(F.when(~F.isnan(v), v).alias(f) for f, v in zip(features, values))).where("__part IS NOT NULL"), "ranked")


def rank_correlations(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Spearman with ranks over the whole column, then Pearson over the rows that have both: (a, b, n, method, value).

    Rows are told apart by their place in a stored copy of the columns, so ``keys`` needn't be given.
    """
    out = _rank_moments(_kept(df, features, F.lit(0)), features)
    return out.select("a", "b", "n", F.lit("spearman").alias("method"), "value")


def merged_correlations(df: DataFrame, features: list[str], keys: list[str] | None, part: Column) -> DataFrame:
    """Pearson of all rows, and rank correlations of each part weighted by their rows: (a, b, n, method, value).

    In a part, ranks of a pair are those among the rows that have both values.  A column is ranked once among all rows that
    have it and once for each other set of rows that its pairs need.
    """
    src = _kept(df, features, part)
    each = _rank_moments(src, features, {k: _Among.pairs(n) for k, n in _shared(src, features).items()}).where("value IS NOT NULL")
    spearman = each.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value"))
    return correlations(src, features).unionByName(spearman.withColumn("method", F.lit("spearman")), allowMissingColumns=True)
