"""Repeated passages by fixed-block anchors.

Every document's words are cut into non-overlapping blocks of 25 words, which are indexed; every rolling window
of 25 words probes that index.  Any 50 consecutive words hold a whole indexed block, so a passage of 50 words that
another document repeats shows as a hit inside it.  Hits are extended: all 50-word windows around a hit are
looked up by two hashes of their own, and the union of those that a smaller id also holds is the maximal repeat.

Documents are dealt into groups of bounded text once; that one exchange feeds all three passes.  A group sends
each distinct window hash once, split into cells of the hash range, so a passage that a third of all documents
share costs a few bytes for each group and no task gathers its occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Anchors travel as this many low bits and their cell; they only say where to look, so a chance match does no harm.
_KEY = np.uint64((1 << 38) - 1)
_BYTES = 5
_SALT = np.uint64(0x5851F42D4C957F2D)


def _anchor(h: np.ndarray, bits: int) -> np.ndarray:
    """What an exchanged anchor says of a hash: its highest ``bits`` and lowest 38 bits."""
    low = np.uint64(64 - bits)
    return (h >> low << low) | (h & _KEY)


class _Words:
    """Word hashes of some documents of one group."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.h, self.counts = C.word_hashes(texts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word position, document index and hash of every n-word window; documents without an id have none."""
        at, each = C.run_starts(self.counts, n)
        owner = np.repeat(np.arange(len(self.counts)), each)
        return at, owner, C.runs(self.h, n)[at]

    def second(self, n: int, at: np.ndarray) -> np.ndarray:
        """Another hash (63 bits) of the windows at some positions; both together tell windows apart."""
        return C.runs(C.mix(self.h ^ _SALT), n)[at] & ~np.uint64(1)


def _read(table: pa.Table):
    """A group's documents in parts of a few MB; ids as a masked array."""
    ids = table.column("doc_id").combine_chunks()
    known = np.asarray(ids.is_valid())
    plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
    texts = C.encoded(table.column("text").to_pylist())
    for a, b in C.in_batches(texts):
        yield known[a:b], plain[a:b], texts[a:b]


_CHUNKS = pa.schema([("part", pa.int32()), ("g", pa.int32()), ("cell", pa.int64()), ("vals", pa.binary())])


def _probes(block: int, groups: int):
    bits = C.cell_bits(groups)

    def probes(key, table):
        found = []
        for known, ids, texts in _read(table):
            w = _Words(ids, texts)
            at, owner, h = w.windows(block)
            keep = known[owner]
            first = np.cumsum(w.counts) - w.counts
            is_block = ((at - first[owner]) % block == 0)[keep]
            h, doc = h[keep], ids[owner][keep]
            order = np.lexsort((doc, h))
            found.append(_merge_probes(h[order], doc[order], doc[order], is_block[order]))
        h, lo, hi, blk = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [], [])
        rows = {f.name: [] for f in _CHUNKS}
        if len(h):
            order = np.argsort(h, kind="stable")
            h, lo, hi, blk = _merge_probes(h[order], lo[order], hi[order], blk[order])
            vals = ((h & _KEY) << np.uint64(2)) | ((lo != hi).astype(np.uint64) << np.uint64(1)) | blk.astype(np.uint64)
            for cell, v in C.by_part(vals, (h >> np.uint64(64 - bits)).astype(np.int64)):
                for name, x in zip(rows, (cell * groups >> bits, key[0].as_py(), cell, C.pack(v, _BYTES))):
                    rows[name].append(x)
        return pa.table(rows, schema=_CHUNKS)

    return probes


def _merge_probes(h, lo, hi, blk):
    """One entry for each hash of sorted ones: smallest and largest id, and whether it is an indexed block."""
    if not len(h):
        return h, lo, hi, blk
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[cut], np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.logical_or.reduceat(blk, cut)


_HITS = pa.schema([("g", pa.int32()), ("hits", pa.list_(pa.int64()))])


def _match(groups: int):
    """One hash range: tells every group which of its hashes are indexed blocks that two documents hold."""
    low = np.uint64(64 - C.cell_bits(groups))

    def match(key, table):
        vals, sizes = C.unpacked(table.column("vals"), _BYTES)
        src, cell = (np.repeat(table.column(c).to_numpy(), sizes) for c in ("g", "cell"))
        k, flags = (cell.astype(np.uint64) << low) | (vals >> np.uint64(2)), vals & np.uint64(3)
        order = np.argsort(k, kind="stable")
        k, src, flags = k[order], src[order], flags[order]
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.concatenate((cut, [len(k)])))
        flags = np.bitwise_or.reduceat(flags, cut)
        live = np.repeat(((flags & np.uint64(1)) > 0) & (((flags & np.uint64(2)) > 0) | (size > 1)), size)
        out = {"g": [], "hits": []}
        for s, v in C.by_part(k[live], src[live]):
            out["g"].append(s)
            out["hits"].append(v.view(np.int64))
        return pa.table(out, schema=_HITS)

    return match


def _gathered(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(x.values.to_numpy() for x in table.column(name) if len(x))])


_LISTS = pa.list_(pa.int64())
_LONG = pa.schema([("part", pa.int32()), ("g", pa.int32()), ("keys", _LISTS), ("others", _LISTS), ("docs", _LISTS)])
_LONG_SQL = "part int, g int, keys array<long>, others array<long>, docs array<long>"


def _by_window(h, other, *ids):
    """Sorts windows by both hashes; also where each distinct one begins."""
    order = np.lexsort((other, h))
    h, other = h[order], other[order]
    cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])))) if len(h) else np.empty(0, np.int64)
    return h, other, cut, *(x[order] for x in ids)


def _extend(window: int, block: int, groups: int):
    bits = C.cell_bits(groups)

    def extend(key, table, hits):
        live = C.Index(np.unique(_gathered(hits, "hits").view(np.uint64)))
        found = []
        for known, ids, texts in _read(table) if len(live.values) else ():
            w = _Words(ids, texts)
            at, owner, h = w.windows(block)
            near = np.zeros(len(w.h) + 1, np.int64)
            near[at[(live.find(_anchor(h, bits)) >= 0) & known[owner]] + 1] = 1
            near = np.cumsum(near)
            at, owner, h = w.windows(window)
            reach = near[at + window - block + 1] - near[at] > 0
            if reach.any():
                found.append((h[reach], w.second(window, at[reach]), ids[owner[reach]]))
        rows = {f.name: [] for f in _LONG}
        if found:
            h, other, cut, doc = _by_window(*(np.concatenate(x) for x in zip(*found)))
            least, most = np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut)
            h, other = h[cut], other[cut] | (least != most).astype(np.uint64)  # the low bit: several ids of this group
            for cell, v, o, d in C.by_part(h, (h >> np.uint64(64 - bits)).astype(np.int64), other, least):
                for name, x in zip(rows, (cell * groups >> bits, key[0].as_py(), v.view(np.int64), o.view(np.int64), d)):
                    rows[name].append(x)
        return pa.table(rows, schema=_LONG)

    return extend


_OWNERS = pa.schema([("g", pa.int32()), ("keys", _LISTS), ("others", _LISTS), ("docs", _LISTS)])


def _owners(key, table):
    """One hash range: tells every group the smallest id that holds a window, where another of its ids does."""
    src = np.repeat(table.column("g").to_numpy(), [len(x) for x in table.column("keys")])
    h, other, docs = (_gathered(table, c) for c in ("keys", "others", "docs"))
    other = other.view(np.uint64)
    h, other, cut, docs, several, src = _by_window(h.view(np.uint64), other & ~np.uint64(1), docs, other & np.uint64(1), src)
    out = {f.name: [] for f in _OWNERS}
    if len(h):
        least = np.repeat(np.minimum.reduceat(docs, cut), np.diff(np.concatenate((cut, [len(h)]))))
        told = (least < docs) | (several > 0)
        for s, v, o, d in C.by_part(h[told], src[told], other[told], least[told]):
            for name, x in zip(out, (s, v.view(np.int64), o.view(np.int64), d)):
                out[name].append(x)
    return pa.table(out, schema=_OWNERS)


class _Least:
    """The smallest id of each window that others repeat, looked up by both hashes."""

    def __init__(self, h: np.ndarray, other: np.ndarray, ids: np.ndarray):
        self.h, self.other, _, self.ids = _by_window(h, other, ids)
        self.first = np.flatnonzero(np.concatenate(([True], self.h[1:] != self.h[:-1]))) if len(h) else np.empty(0, np.int64)
        self.index = C.Index(self.h[self.first])

    def earlier(self, w: _Words, window: int, known: np.ndarray) -> np.ndarray:
        """Positions of windows that a document with a smaller id holds."""
        at, owner, h = w.windows(window)
        slot = self.index.find(h)
        use = np.flatnonzero((slot >= 0) & known[owner])
        if not len(use):
            return use
        at, owner, h, slot = at[use], owner[use], h[use], self.first[slot[use]]
        other, left = w.second(window, at), np.arange(len(use))
        hit = np.zeros(len(use), bool)
        while len(left):  # nearly always one step: the next entry has the same first hash only by chance
            s = slot[left]
            same = self.other[s] == other[left]
            hit[left[same]] = self.ids[s[same]] < w.ids[owner[left[same]]]
            left = left[~same]
            slot[left] += 1
            left = left[slot[left] < len(self.h)]
            left = left[self.h[slot[left]] == h[left]]
        return at[hit]


_OUT = "doc_id long, n_words long, n_removed long, kept_text string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _cut(window: int, digest: bool):
    def cut(table, owners):
        least = _Least(_gathered(owners, "keys").view(np.uint64), _gathered(owners, "others").view(np.uint64), _gathered(owners, "docs"))
        out = []
        for known, ids, texts in _read(table):
            w = _Words(ids, texts)
            total = len(w.h)
            gone = np.zeros(total + 1, np.int64)
            if len(least.ids):
                at = least.earlier(w, window, known)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            gone = np.cumsum(gone)[:total] > 0
            first = np.concatenate(([0], np.cumsum(w.counts)))
            removed = np.concatenate(([0], np.cumsum(gone)))
            removed = removed[first[1:]] - removed[first[:-1]]
            kept = []
            for i, t in enumerate(texts):
                words = t.split()
                if removed[i]:
                    flags = gone[first[i] : first[i + 1]]
                    words = [x for x, f in zip(words, flags) if not f]
                text = b" ".join(words)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
            out.append(pa.table([pa.array(ids, mask=~known), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], schema=_OUT_ARROW))
        return pa.concat_tables(out) if out else _OUT_ARROW.empty_table()

    return cut


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, digest: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, and kept_text or with ``digest`` its kept_sha256.

    A word goes when a window of ``window`` consecutive words covers it that also occurs in a document with a
    smaller id.  Null text has no words.  A row with a null id loses nothing and takes nothing from others; rows
    repeating an id don't count against each other.  Other columns of docs are ignored.
    """
    block = window // 2
    grouped, groups = C.in_groups(docs, id_col, text_col)
    probes = grouped.groupBy("g").applyInArrow(_probes(block, groups), "part int, g int, cell long, vals binary")
    hits = probes.groupBy("part").applyInArrow(_match(groups), "g int, hits array<long>")
    longer = grouped.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(_extend(window, block, groups), _LONG_SQL)
    owners = longer.groupBy("part").applyInArrow(_owners, "g int, keys array<long>, others array<long>, docs array<long>")
    out = grouped.groupBy("g").cogroup(owners.groupBy("g")).applyInArrow(_cut(window, digest), _OUT)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", F.col("kept_text").alias("kept_sha256" if digest else "kept_text"))
