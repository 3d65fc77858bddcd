"""Shared pieces of the corpus operators: scratch tables, size-checked joins and word hashing.

Words are hashed 64 bits wide with numpy, many documents at a time.  Sequences of words are hashed
by doubling (1, 2, 4, ... words), so that any length costs a few vector operations.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this number are broadcast in semi and anti joins (8 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 1_000_000
#: Counted rows of a few longs up to which the smaller side of another join is broadcast instead of shuffled.
BROADCAST_ROWS = 100_000
#: Text bytes of one group of documents that is handled as a unit by grouped-map functions.
GROUP_BYTES = 8 << 20


# ---------------------------------------------------------------------------------- scratch tables
def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir; where that is unset, a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a table of ids; broadcast only when their counted number is small."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, id_col, how)


def few(df: DataFrame) -> bool:
    """Whether a stored table has at most BROADCAST_ROWS rows."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def spread_join(rows: DataFrame, values: DataFrame, key: str, by: str, salts: int, small: bool = False) -> DataFrame:
    """rows joined with values, which holds a key once; a key that many rows share is dealt to ``salts`` tasks by ``by``.

    Values are copied only to the salts under which their key has rows.  Values that are counted as few (``small``) are
    broadcast, and rows stay where they are.
    """
    if small:
        return rows.join(F.broadcast(values), key)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    slots = salted.select(key, "__salt").distinct().join(values, key)
    return salted.join(slots, [key, "__salt"]).drop("__salt")


# ------------------------------------------------------------------------------- grouped documents
def text_bytes(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0)


def in_groups(docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES, more: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """Deals documents by a hash of their id and text into groups of about group_bytes of text: column ``g``, one shuffle.

    The number of groups follows the input, so a group's size doesn't, and texts that share an id or lack one are
    dealt apart.  Every later groupBy("g") or cogroup on the result needs no further exchange, and repeated uses in
    one plan share this one.
    """
    n = max(1, math.ceil(text_bytes(docs, text_col) / group_bytes))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    g = F.pmod(key, F.lit(n)).cast("int")
    rows = docs.select(g.alias("g"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in (more or {}).items()))
    width = max(3 * n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # room, so that few tasks get several groups
    return rows.repartition(width, "g"), n


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


# ------------------------------------------------------------------------------------ word hashing
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 1 << 16
_SLICE = 1 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_STEP, 0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def _slice_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one buffer."""
    word = ~_SPACE[buf]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    at = np.arange(first[-1] + lens[-1]) - np.repeat(first, lens)
    vals = buf[word].astype(np.uint64) + np.uint64(1)
    vals *= _POW[at & (_STEP - 1)]
    if lens.max() > _STEP:  # beyond the table: a second factor for each further stretch
        vals *= _powers(int(lens.max() // _STEP) + 1, 0xD6E8FEB86659FD93)[at >> 16]
    return starts, mix(np.add.reduceat(vals, first) + lens.astype(np.uint64) * _MUL)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and each text's number of words."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    found, at, pos = [], [], 0
    while pos < len(whole):
        end = min(len(whole), pos + _SLICE)
        if end < len(whole):  # cut at white space; within a word longer than a slice, after it
            back = np.flatnonzero(_SPACE[whole[pos:end]])
            while not len(back):
                end = min(len(whole), end + _SLICE)
                back = np.flatnonzero(_SPACE[whole[pos:end]])
            end = pos + int(back[-1]) + 1
        starts, hashes = _slice_words(whole[pos:end])
        found.append(hashes)
        at.append(starts + pos)
        pos = end
    where = np.concatenate(at)
    return np.concatenate(found), np.diff(np.searchsorted(where, begins))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive values from every position (length len(h) - n + 1)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            out = power if out is None else mix(out[: len(h) - done - size + 1] * _MUL + power[done : done + len(h) - done - size + 1])
            done += size
            if done == n:
                return out[: len(h) - n + 1]
        power = mix(power[:-size] * _C1 + power[size:])
        size *= 2


def run_starts(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Over concatenated documents: positions from which n words lie in one document, and their number by document."""
    each = np.maximum(counts - n + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.empty(0, np.int64)
    out = np.repeat(first, each)
    inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return out + inner, each


def encoded(texts: list) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def in_batches(texts: list[bytes], most: int = 2 << 20, count: int = 20_000):
    """Index ranges of consecutive texts: about ``most`` bytes together, ``count`` texts at most."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= most or i + 1 - begin >= count:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


# ---------------------------------------------------------------------------- exchanges between groups
def cell_bits(groups: int) -> int:
    """Groups split what they send by this many bits of a hash.

    There are 4096 cells, so the rows sent grow with the groups alone.  Only beyond 4096 groups are cells as many as
    groups; then rows get shorter, and as a group fills only as many cells as it has values, rows stay below values.
    """
    return max(12, (groups - 1).bit_length())


def cell_of(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values * _MUL) >> np.uint64(64 - bits)).astype(np.int64)


def pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value as byte planes; those of sorted or small values compress well."""
    return np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def unpacked(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed rows, and the number in each row."""
    parts = [unpack(b, width) for b in column.to_pylist()]
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.array([len(p) for p in parts], np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[cut], np.add.reduceat(n, cut)


class Index:
    """Positions of distinct values, by open addressing: whole arrays are looked up in a few vector operations."""

    def __init__(self, values: np.ndarray):
        self.bits = max(4, (2 * len(values)).bit_length())
        self.slot = np.full((1 << self.bits) + len(values) + 1, -1, np.int32)
        self.values = values
        left, at = np.arange(len(values), dtype=np.int32), self._begin(values)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            again = self.slot[at] != left
            left, at = left[again], at[again] + 1
        self.held = np.zeros(len(self.slot), np.uint64)
        used = self.slot >= 0
        self.held[used] = values[self.slot[used]]

    def _begin(self, x: np.ndarray) -> np.ndarray:
        return ((x * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The position of each value, -1 where it is absent."""
        at = self._begin(x)
        out = self.slot[at]
        left = np.flatnonzero((out >= 0) & (self.held[at] != x))
        at = at[left]
        while len(left):
            at += 1
            got = self.slot[at]
            out[left] = got
            more = (got >= 0) & (self.held[at] != x[left])
            left, at = left[more], at[more]
        return out


# ------------------------------------------------------------------------------- sorted value chunks
def by_part(values: np.ndarray, part: np.ndarray, *others: np.ndarray):
    """Splits parallel arrays by part, sorted by value inside: yields (part, values, *others)."""
    order = np.lexsort((values, part))
    part, rest = part[order], [x[order] for x in (values, *others)]
    cuts = np.flatnonzero(np.diff(part)) + 1
    if len(part):
        for p, *xs in zip(part[np.concatenate(([0], cuts))], *(np.split(x, cuts) for x in rest)):
            yield int(p), *xs


def found_in(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its index in sorted_values (0 where absent), and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return at, sorted_values[at] == values
