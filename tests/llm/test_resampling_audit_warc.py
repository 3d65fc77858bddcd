"""Resampling, filter audit and WARC archives against brute force, on tables with awkward rows."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import audit, resampling, warc

LONG = " ".join(f"W{i * 7919 % 3001}" for i in range(9000))
TEXTS = [None, "", "  \n", "one TWO é É", LONG, LONG, LONG + " tail", "x" * 70_000, "a b " * 60, "A$B " * 30, "\U0001f600 日本 kék", "İstanbul Σας"]
LANGS = [None, "", "en", "de", "en", "fr", None, "en", "de", "en", None, "fr"]


def _docs(spark, twice=True):
    """Null and repeated ids, repeated rows, equal texts and columns named like those of results."""
    rows = [(i, t, p) for i, (t, p) in enumerate(zip(TEXTS, LANGS))] + [(100 + i, f"{i} " * 10 + "same words again here " * 4, "en") for i in range(60)]
    rows += [(None, "same words again here " * 9, "en"), (None, "", None), (None, LONG, "de")]
    if twice:
        rows += [(4, LONG, "en"), (4, "another text of four", "en"), (3, None, "fr")] + [(150, "51 50 " * 20, "en")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS id", "3 AS part", "4 AS rank", "5 AS mask", "6 AS digest", "7 AS weight"), rows


def _words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("max_n,percent", [(1, 10), (3, 35), (1, 100)])
def test_resampling_against_brute_force(spark, max_n, percent):
    docs, rows = _docs(spark)
    target_texts = ["same words 7 7", None, "", "w0 w1"]
    target = spark.createDataFrame([(t, 1) for t in target_texts], "text string, doc_id int")
    feats = lambda t: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for w in [_words(t)] for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for r in rows for b in feats(r[1])), Counter(b for x in target_texts for b in feats(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = []
    for i, text, _ in rows:
        f = feats(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text)) >= 20])
    able = sorted((w for w in want if w[4]), key=lambda w: (-w[3], -1 if w[0] is None else w[0], w[1], w[2]))
    most = percent * len(able) // 100
    want = [(*w[:4], None) for w in want if not w[4]] + [(*w[:4], n + 1 if n < most else None) for n, w in enumerate(able)]
    got = resampling.importance_resample(docs, target, max_n=max_n, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 9), (None, None)], "doc_id long, text string")
    assert resampling.importance_resample(none, some).count() == 0
    got = {r.doc_id: r for r in resampling.importance_resample(some, none, percent=100).collect()}
    assert got[1].rank == 1 and got[None].rank is None and got[None].weight == 0


def test_audit_against_brute_force(spark):
    docs, rows = _docs(spark)
    told = [(i, q, t) for i in range(0, 160, 3) for q, t in ((i % 2, i % 5 == 0),)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (6, None, None)]
    labels = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in told], "doc_id long, quality int, toxic int").withColumn("lang", F.lit("zz"))
    good, toxic = {i for i, q, _ in told if q == 1 and i is not None}, {i for i, _, t in told if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, part in rows:
        x = text or ""
        w = re.findall(r"[^ \t-\r]+", x)
        f = ("A" if len(w) < 100 else "") + ("B" if 100 * len(set(w)) < 80 * len(w) else "") + ("C" if 100 * sum("A" <= c <= "Z" for c in x) > 10 * len(x) else "")
        f += ("D" if re.search(r"[#$%&*|]", x) else "") + ("E" if i is not None and i > first[x] else "")
        fails.append((part or "", f, i in good, i in toxic))
    want = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone, before = [f for f in left if c in f[1]], len(mine) - len(left)
                left = [f for f in left if c not in f[1]]
                want[part, order, step] = [len(left), len(gone), sum(c in f[1] for f in mine) - len(gone), sum(f[1] == c for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                assert before >= 0
                total[c] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                want[part, order, step].append(total[c])
    got = audit.filter_audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want and len(got) == len(want)
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert all(r.good_lost == r.toxic_lost == 0 for r in audit.filter_audit(docs, labels.limit(0)).collect())


def _pages(spark):
    rows = [(i, f"http://h/{i} \r\n%41é", f"<p>{'same' if i % 3 == 0 else i}</p>é" * (i % 7 + 1)) for i in range(60)]
    rows += [(60, None, None), (61, "u", ""), (None, "n", "<p>same</p>é"), (None, None, "only without id"), (None, "m", "only without id"), (5, "again", rows[5][2]), (5, "other", "5 again")]
    rows += [(70, "long", "".join(random.Random(3).choices("abcdefgh", k=400_000))), (3, rows[3][1], rows[3][2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS key", "2 AS path", "3 AS first_id"), rows


@pytest.mark.parametrize("least,split,file_bytes", [(0, 1 << 25, 1 << 30), (0, 2500, 3000), (25, 40_000, 1 << 14)])
def test_warc_round_trip(spark, least, split, file_bytes):
    pages, rows = _pages(spark)
    first = {}
    for i, _, html in rows:
        x = html or ""
        if i is not None and len(x.encode()) >= least:
            first[x] = min(i, first.get(x, i))
    want = []
    for i, _, html in rows:
        x, f = html or "", first.get(html or "")
        again = f is not None and (i is None or i > f)
        digest = base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
        want.append((i, len(x.encode()), digest, "revisit" if again else "response", f if again else None))
    manifest = warc.write_warc(pages, least=least, file_bytes=file_bytes)
    records = warc.read_warc(spark, manifest, split_bytes=split)
    assert Counter(tuple(r) for r in warc.resolved(records).collect()) == Counter(want)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == records.count()
    kept = {(r.page_id, r.payload.decode()) for r in records.collect() if r.record_type == "response"}
    assert kept == {(i, html or "") for (i, _, html), w in zip(rows, want) if w[3] == "response"}
    assert {r.url for r in records.collect()} == {u or "" for _, u, _ in rows}


def test_warc_files_are_plain_multi_member_gzip(spark):
    pages, rows = _pages(spark)
    manifest = warc.write_warc(pages)
    raw = b"".join(gzip.decompress(open(r.path.removeprefix("file:"), "rb").read()) for r in manifest.collect())
    assert raw.count(b"WARC/1.1\r\n") == len(rows)


def test_reader_ignores_what_only_looks_like_members(spark, tmp_path):
    """False magic, cut members, foreign gzip and a stored archive inside a record, at every cut of the file."""
    make = lambda i, body, level=6: warc.record_bytes(i, "u", body, None, warc.base32_sha1(body), len(body), level)
    foreign = io.BytesIO()
    with gzip.GzipFile(fileobj=foreign, mode="wb") as f:
        f.write(b"no archive")
    inner = make(7, b"inner") + make(8, b"inner too")
    nested = make(2, b"\x1f\x8b\x08 false" + inner + b"tail", 0)
    data = b"junk\x1f\x8b\x08junk" + make(1, b"first") + foreign.getvalue() + nested + make(3, b"third")[:-3] + make(4, b"fourth") + b"\x1f\x8b"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(f"file://{path}", len(data))], "path string, bytes long")
    for split in (37, 64, 111, 10_000):
        assert sorted(r.page_id for r in warc.read_warc(spark, files, split_bytes=split).collect()) == [1, 2, 4], split
    for begin in range(0, len(data), 5):  # each record is owned by exactly one range
        cuts = [x for a, b in ((0, begin), (begin, len(data))) if a < b for x in warc.records_from(f"file://{path}", len(data), a, b, False)]
        assert Counter(x[1] for x in cuts if x[4] in (1, 2, 4)).most_common(1)[0][1] == 1


def test_warc_of_an_empty_table(spark):
    pages, _ = _pages(spark)
    assert warc.resolved(warc.read_warc(spark, warc.write_warc(pages.limit(0)))).count() == 0


def test_revisit_without_its_response(spark):
    pages, _ = _pages(spark)
    records = warc.read_warc(spark, warc.write_warc(pages))
    got = warc.resolved(records.where("NOT (record_type = 'response' AND page_id = 0)")).where("refers_to = 0").collect()
    assert got and all(r.payload_digest is None and r.payload_bytes is None for r in got)
