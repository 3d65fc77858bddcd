"""Sequence packing by lexical retrieval.

One pass over the texts gives each document its distinct words and a content key: two minima of its word hashes, so
documents that share much of their words tend to have the same key.  Documents are dealt by ranges of content keys (whose
bounds come from a bounded sample; a key that very many share is split by a hash of id and text) and sorted by them.  Each
run of about SHARD_BYTES of text becomes a shard with a BM25 inverted index: a seed document opens a window, all its words query the index, and its best
unused neighbours greedily fill the window, the last one being cut where the window is full; what is left of it seeds
the next window.  Shards have the same size whatever the input, and hold neighbours in content at every size.  Windows go
on from shard to shard; what remains at the end of a range is cut into powers of two, so no sequence needs padding.

Texts are tokenised where they are read: documents are shuffled as ids and words in few bytes, and reach the packer a range
at a time, so that no Arrow batch holds more than a range's documents.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, END = 1024, 0
#: Text bytes of a shard, and of a range of content keys; most ranges, and sampled keys for each and in all.
SHARD_BYTES, RANGE_BYTES = 1 << 20, 8 << 20
MOST_RANGES, PER_RANGE, MOST_SAMPLED = 50_000, 40, 200_000
K1, B = 1.2, 0.75

_tokenizers: dict = {}


def _tokens(path: str, ranks_path: str | None, texts: list[str]) -> list[np.ndarray]:
    """Ids of the byte-level BPE; by its rank file where that is given, which codes the same vocabulary faster.

    Texts that spell a special token take the tokenizer itself, which reads it as that token.
    """
    if path not in _tokenizers:
        fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        _tokenizers[path] = fast, special
    fast, special = _tokenizers[path]
    whole, out = None, []
    for t in texts:
        if fast is None or any(x in t for x in special):
            if whole is None:  # large, and rarely needed beside the other
                from tokenizers import Tokenizer

                whole = Tokenizer.from_file(path)
            out.append(np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32))
        else:
            out.append(fast.encode_to_numpy(t).astype(np.uint32))
    return out


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of each text, sorted, and how often each occurs, concatenated; and each text's number of them."""
    h, counts = C.word_hashes([t.lower() for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))) if len(texts) <= 1 << 16 else np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))) if len(h) else np.empty(0, np.int64)
    return h[cut], np.diff(np.concatenate((cut, [len(h)]))), np.bincount(owner[cut], minlength=len(texts))


class Bm25:
    """Inverted index over the bags of words of a shard's documents."""

    def __init__(self, h: np.ndarray, tf: np.ndarray, each: np.ndarray):
        self.n = len(each)
        doc = np.repeat(np.arange(self.n), each)
        sizes = np.bincount(doc, tf, minlength=self.n)
        order = np.argsort(h)
        new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.empty(0, bool)
        df = np.diff(np.concatenate((np.flatnonzero(new), [len(h)])))
        term = np.empty(len(h), np.int64)
        term[order] = np.cumsum(new) - 1
        self.first, self.df = np.cumsum(df) - df, df
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if self.n else 0.0))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]
        # a document's query: all its words that another document of the shard has
        shared = df[term] > 1
        ends = np.cumsum(np.bincount(doc[shared], minlength=self.n))[:-1] if self.n else []
        self.query = np.split(term[shared], ends) if self.n else []

    def scores(self, seed: int) -> np.ndarray:
        terms = self.query[seed]
        if not len(terms):
            return np.zeros(self.n)
        size = self.df[terms]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.first[terms] - ends + size, size)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def _order(index: Bm25, sizes: np.ndarray, length: int, filled: int = 0) -> list[int]:
    """The order in which documents enter the windows, of which the first is already filled to some length."""
    unused, out, pos = np.ones(index.n, bool), [], filled
    fresh = 0
    seed = None
    while len(out) < index.n:
        if seed is None:
            while not unused[fresh]:
                fresh += 1
            seed = fresh
            unused[seed] = False
            out.append(seed)
            pos += sizes[seed]
        room = -pos % length
        scores = index.scores(seed) * unused if room else None
        last = seed
        while room > 0 and len(out) < index.n:
            best = int(scores.argmax())
            if scores[best] <= 0:
                break
            scores[best], unused[best] = 0, False
            out.append(best)
            pos += sizes[best]
            room -= sizes[best]
            last = best
        seed = last if room < 0 else None  # a cut document's rest opens the next window
    return out


# ------------------------------------------------------------------------------------- Spark side
_KEYS = [("k1", pa.int64()), ("k2", pa.int64()), ("salt", pa.int64())]
_READ_SQL = "doc_id long, bucket int, k1 long, k2 long, salt long, size long, ids binary, words binary, tf binary"


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes each, after a byte that tells how many."""
    dtype = np.min_scalar_type(x.max(initial=0))
    return bytes([dtype.itemsize]) + x.astype(f"<u{dtype.itemsize}").tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


def _content(texts: list[bytes]):
    """Bags of words and content keys (two minima and a salt) of some texts."""
    h, tf, each = bags(texts)
    starts, has, keys = np.cumsum(each) - each, each > 0, []
    for mixed in (C.mix(h), C.mix(h ^ np.uint64(0x5851F42D4C957F2D))):
        least = np.zeros(len(texts), np.uint64)
        if len(h):
            least[has] = np.minimum.reduceat(mixed, starts[has])
        keys.append((least >> np.uint64(1)).view(np.int64))
    return h, tf, each, *keys


def _slices(batches, text: int, most: int = 1 << 20, count: int = 20_000):
    """Slices of about ``most`` bytes of text, and their texts: only those of a slice are Python objects at a time."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64) + 1)
        begin = 0
        while begin < batch.num_rows:
            n = min(count, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most)) + 1 - begin)
            part = batch.slice(begin, n)
            yield part, C.encoded(part.column(text).to_pylist())
            begin += n


def _sampled(batches):
    for part, texts in _slices(batches, 0):
        *_, k1, k2 = _content(texts)
        yield pa.RecordBatch.from_arrays([pa.array(k1), part.column(1)], names=["k1", "salt"])


def _bucket(bounds: tuple[np.ndarray, np.ndarray], k1: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The range of each (key, salt): the number of bounds below it."""
    low, high = (np.searchsorted(bounds[0], k1, side) for side in ("left", "right"))
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(bounds[1][low[i] : high[i]], salt[i])
    return low


def _read(shared, path: str, ranks_path: str | None):
    """Each document's range, content keys, text bytes, ids, and words with their counts."""
    def read(batches):
        for part, texts in _slices(batches, 1):
            h, tf, each, k1, k2 = _content(texts)
            bucket = _bucket(shared.value, k1, part.column(2).to_numpy())
            ids = (np.append(x, np.uint32(END)) for x in _tokens(path, ranks_path, ["" if t is None else t for t in part.column(1).to_pylist()]))
            ends = np.concatenate(([0], np.cumsum(each)))
            words = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(h.astype("<u8"))])
            counts = (_narrow(tf[a:b]) for a, b in zip(ends[:-1], ends[1:]))
            keys = [pa.array(bucket.astype(np.int32)), pa.array(k1), pa.array(k2), part.column(2), pa.array([len(t) for t in texts], pa.int64())]
            cols = [part.column(0), *keys, pa.array(map(_narrow, ids), pa.binary()), words, pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _READ_SQL.split(", ")])

    return read


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int64()))])


class _Windows:
    """Consecutive windows of one range; pieces are given out when their window is full."""

    def __init__(self, length: int, first: int):
        self.length, self.seq, self.filled, self.open = length, first, 0, []

    def add(self, doc_id, ids: np.ndarray):
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, self.length - self.filled)
            self.open.append((doc_id, start, ids[start : start + n], len(ids)))
            start, self.filled = start + n, self.filled + n
            if self.filled == self.length:
                yield from self._close([self.length])

    def rest(self):
        """The last window, in powers of two."""
        yield from self._close([1 << b for b in range(self.length.bit_length() - 1, -1, -1) if self.filled >> b & 1])

    def _close(self, ends: list[int]):
        left, offset = list(reversed(self.open)), 0
        for end in ends:
            while offset < end:
                doc_id, start, ids, whole = left.pop()
                n = min(len(ids), end - offset)
                if n < len(ids):
                    left.append((doc_id, start + n, ids[n:], whole))
                yield doc_id, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), whole, self.seq, offset, ids[:n]
                offset += n
            self.seq, offset = self.seq + 1, 0
        self.open, self.filled = [], 0


def _pack(length: int, shard_bytes: int, with_ids: bool):
    def batch_of(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 8
        arrays = [pa.array(c, f.type) for c, f in zip(cols[: 8 if with_ids else 7], _PIECES_ARROW)]
        return pa.RecordBatch.from_arrays(arrays, names=_PIECES_ARROW.names[: len(arrays)])

    def shard(windows: _Windows, parts: list[pa.RecordBatch]):
        column = lambda name: [x for p in parts for x in p.column(name).to_pylist()]
        doc_ids, ids, tf = column("doc_id"), [_wide(x) for x in column("ids")], [_wide(x) for x in column("tf")]
        h = np.frombuffer(b"".join(column("words")), "<u8")
        index = Bm25(h, np.concatenate([np.empty(0, np.int64), *tf]), np.array([len(x) for x in tf], np.int64))
        for i in _order(index, np.array([len(x) for x in ids], np.int64), length, windows.filled):
            yield from windows.add(doc_ids[i], ids[i])

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(length, key[0].as_py() << 32)
        parts, held = [], 0
        for batch in batches:
            sizes = batch.column("size").to_numpy() + 1
            begin = 0
            while begin < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[begin:]), shard_bytes - held) + 1
                part = batch.slice(begin, room)
                parts.append(part)
                held += int(sizes[begin : begin + room].sum())
                begin += room
                if held >= shard_bytes:
                    yield batch_of(list(shard(windows, parts)))
                    parts, held = [], 0
        yield batch_of([*shard(windows, parts), *windows.rest()])

    return pack


def pack_sequences(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``length`` is a power of two.  Sequences hold exactly ``length`` tokens, but for the last ones of a range of content
    keys, which hold lower powers of two.  Every document ends with id 0, so null or empty text gives one token.
    Repeated rows are packed as often as they occur; a null id stays null.  Other columns of docs are ignored.
    """
    salt = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), salt.alias("salt"))
    size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    ranges = min(MOST_RANGES, max(1, math.ceil((size[1] or 0) / RANGE_BYTES)))
    share = min(1.0, min(PER_RANGE * ranges, MOST_SAMPLED) / max(1, size[0]))
    some = rows.where(F.pmod(F.xxhash64("salt"), F.lit(1 << 30)) < int(share * (1 << 30))) if ranges > 1 else rows.limit(0)
    keys = sorted((r.k1, r.salt) for r in some.select("text", "salt").mapInArrow(_sampled, "k1 long, salt long").collect())
    bounds = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    shared = docs.sparkSession.sparkContext.broadcast(tuple(np.array([k[i] for k in bounds], np.int64) for i in (0, 1)))
    width = max(2 * ranges, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(_read(shared, tokenizer_path, ranks_path), _READ_SQL).repartition(width, "bucket").sortWithinPartitions("bucket", "k1", "k2", "doc_id", "salt")
    out = dealt.groupBy("bucket").applyInArrow(_pack(length, SHARD_BYTES, with_ids), _PIECES + (", ids array<long>" if with_ids else ""))
    return out.withColumnRenamed("doc_id", id_col)
