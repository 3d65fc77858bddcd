"""The corpus pipeline: every stage against brute force on a small table with planted rows, and on awkward tables."""

import re
import zlib
from collections import defaultdict

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"
WORD, TOKEN = re.compile(r"[^ \t-\r]+"), re.compile(r"[^\x00-/:-`{-\x7f]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pipeline")
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet")
    docs = pd.read_parquet(f"{DATA}/documents.parquet").head(70)
    long = next(t for t in docs.text if isinstance(t, str) and len(t) > 1500)
    words = long.split()
    item = next(t for t in bench.text if len(TOKEN.findall(t)) > 15)
    more = [None, "", " \n", "12 3 !", long, long + " tail", " ".join(words[: len(words) // 2]), f"before {item} after", "write to a.b@site.org or b.c@site.org (or c (at) site (dot) org) now", long]
    odd = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(more)), "text": more, "lang": None, "source": "odd"})
    docs = pd.concat([docs[["doc_id", "text", "lang", "source"]], odd], ignore_index=True)
    docs["n_chars"] = docs.text.map(lambda t: len(t) if isinstance(t, str) else None).astype("Int64")
    docs.to_parquet(out / "documents.parquet", coerce_timestamps="us")
    bench.to_parquet(out / "benchmark.parquet")
    return str(out)


def low(t):
    return t.translate(_UPPER)


def sets(t):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def kept_of_groups(texts):
    shingles, root = {i: sets(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(shingles[a] & shingles[b])
            if both and 100 * both >= 85 * len(shingles[a] | shingles[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i for i in ids if find(i) == i}


def clean_of(texts, bench):
    windows = set()
    for t in bench:
        w = TOKEN.findall(low(t or ""))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    out = set()
    for i, t in texts.items():
        w, hit = TOKEN.findall(low(t)), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
        if not hit or 20 * len(hit) < len(w):
            out.add(i)
    return out


def test_stages_against_brute_force(spark, folder):
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), pd.read_parquet(f"{folder}/benchmark.parquet").text
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    text_of = lambda df: {r.doc_id: r.text for r in df.collect()}
    texts = text_of(docs)
    want = {i: t for i, t in texts.items() if t is not None and any(map(str.isalpha, t))}
    assert len(want) < len(texts)
    for name, stage in P.STAGES[:3]:
        docs = P.C.stored(stage(spark, docs, folder), name)
        assert docs.columns == list(P.COLUMNS)
        if name != "language_id":
            keep = kept_of_groups(want) if name == "near_dedup" else clean_of(want, bench)
            assert len(keep) < len(want)
            want = {i: want[i] for i in keep}
        assert text_of(docs) == want, name
    clean = P.C.stored(P.STAGES[3][1](spark, docs, folder), "pii")
    redacted, lengths = text_of(clean), {r.doc_id: r.n_chars for r in clean.collect()}
    assert redacted.keys() == want.keys() and clean.columns == list(P.COLUMNS)
    changed = {i for i in want if redacted[i] != want[i]}
    private = {i for i, t in want.items() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)}
    assert private <= changed and changed < set(want)
    for i in want:
        assert lengths[i] == len(redacted[i]) and not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", redacted[i])
        # what is left of a changed text stands in the old one, in order
        at = 0
        for piece in re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", redacted[i]):
            at = want[i].index(piece, at) + len(piece)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in P.STAGES[4][1](spark, clean, folder).collect():
        pieces[r.doc_id].append(r)
    for i, t in redacted.items():
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


def test_run_ends_in_pieces(spark, folder):
    out = P.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a b c", "en", "s", 5)] * 3 + [(None, "a b c", None, None, 5), (2, None, "de", None, None)]])
def test_awkward_tables(spark, folder, rows):
    """Empty, null and repeated rows pass every stage; clashing columns of results do no harm."""
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, docs.selectExpr("*", "1 AS score", "'x' AS lang_pred", "2 AS kept", "3 AS spans", "4 AS g"), folder)
        n = out.count()
        if name in ("pii", "near_dedup", "decontamination"):
            assert n == len(rows) or name == "near_dedup" and n <= len(rows), name
        if name != "packing":
            assert out.columns == list(P.COLUMNS)
