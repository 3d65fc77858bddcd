"""Word-piece counts with a linear longest-match automaton.

Greedy longest-match-first tokenisation of a word needs no backtracking when every node of the vocabulary trie has
a failure link: where it goes on when no longer piece fits, and how many pieces that step completes.  These
popped-piece counts are computed with the trie, so a word's number of pieces is a sum over one pass of its bytes
and no piece is ever built.

A vocabulary marks the pieces that end a word.  The trie reads the last byte of such a piece, and of every word, as a
letter of its own, so those match at a word's end only and all others before it only.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_CACHE = 500_000
#: Added to the last byte of a word, and of a piece that ends words.
LAST = 256


def byte_letters() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file as bytes: those inside words, and those marked to end one.

    Special tokens are left out.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    letters, mark = byte_letters(), data["model"].get("end_of_word_suffix") or "</w>"
    inner, final = [], []
    for piece in data["model"]["vocab"]:
        if piece not in special:
            body = piece.removesuffix(mark)
            (final if body != piece else inner).append(bytes(letters[c] for c in body))
    return sorted(inner), sorted(final)


class Automaton:
    """Trie with failure links; nodes are numbers, 0 the root, edges in one dictionary."""

    def __init__(self, inner: list[bytes], final: list[bytes]):
        self.edges: dict[int, int] = {}
        ends, parents = {0: False}, [[(0, 0, 0)]]
        for piece in [*map(list, inner), *([*p[:-1], p[-1] + LAST] for p in final if p)]:
            u = 0
            for depth, c in enumerate(piece):
                k = u << 9 | c
                v = self.edges.get(k)
                if v is None:
                    v = self.edges[k] = len(ends)
                    ends[v] = False
                    if len(parents) <= depth + 1:
                        parents.append([])
                    parents[depth + 1].append((v, u, c))
                u = v
            if piece:
                ends[u] = True
        self.link, self.pops = [-1] * len(ends), [0] * len(ends)
        for level in parents[1:]:  # breadth first: a link leads to a shorter string
            for v, u, c in level:
                if ends[v]:
                    self.link[v], self.pops[v] = 0, 1
                    continue
                z, n = self.link[u], self.pops[u]
                while z >= 0 and (z << 9 | c) not in self.edges:
                    n += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.edges[z << 9 | c], n

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if greedy matching gets stuck."""
        edges, link, pops, u, n = self.edges, self.link, self.pops, 0, 0
        for c in (*word[:-1], *(x + LAST for x in word[-1:])):
            while (v := edges.get(u << 9 | c)) is None:
                if u == 0 or link[u] < 0:
                    return -1
                n += pops[u]
                u = link[u]
            u = v
        while u:
            if link[u] < 0:
                return -1
            n += pops[u]
            u = link[u]
        return n


_built: dict = {}


def _count(path: str):
    def count(batches):
        if path not in _built:
            _built[path] = Automaton(*load_pieces(path)), {}
        automaton, known = _built[path]
        for batch in batches:
            out = [[], [], []]
            for t in C.encoded(batch.column(1).to_pylist()):
                words = t.lower().split()
                if len(known) > _CACHE:
                    known.clear()
                for w in set(words):
                    if w not in known:
                        known[w] = automaton.count(w)
                n = [known[w] for w in words]
                stuck = n.count(-1)
                for col, v in zip(out, (len(n), sum(n) + 2 * stuck, stuck)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return count


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_tokens, n_unknown.

    Words are separated by ASCII white space and ASCII-lower-cased; n_tokens is the number of greedy longest-match
    pieces of all words, the last of each a piece that ends words.  A word that cannot be split into pieces counts as one unknown token.  Null or empty text
    has none.  Rows are independent, ids may be null or repeat, and other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(vocabulary_path), "doc_id long, n_words long, n_tokens long, n_unknown long").withColumnRenamed("doc_id", id_col)
