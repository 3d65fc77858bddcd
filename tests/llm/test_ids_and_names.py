"""Results of operators on texts alone don't depend on ids, on repeated rows or on columns with clashing names."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import decontam, langid, lm, media, pii, secrets, tokencount

TEXTS = [
    None, None, "", "one two three", "one two three", "Mail a.b@c.de or +44 20 7946 0958 from 10.0.0.1", "token: abcdef123456 deadbeefdeadbeefdeadbeef", "Der schnelle Fuchs springt über den Hund und",
    "le chat est sur la table et il dort", "alpha beta " * 50, "x" * 5000, "one two three",
]
LANGS = [None, "en", "en", "en", "en", "en", "en", "de", "fr", "en", None, "de"]
IDS = [None, None, 3, 3, 4, 4, 5, 6, 7, None, -1, 3]
CLASHING = {"text_": "1", "g": "2", "id": "3", "spans": "'s'", "score": "4", "learn": "'l'", "n_tokens": "5", "words": "6", "n": "7", "media": "8", "kind": "'k'", "part": "9", "start": "10", "value": "11", "h": "12"}
PER_TEXT = {
    "pii": (lambda d, b: pii.personal_data(d), ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]),
    "tokens": (lambda d, b: tokencount.token_counts(d, public_tokenizers.path("word_bpe_49k.json")), None),
    "lm": (lambda d, b: lm.lm_scores(d, F.lit(True)), ["n_tokens", "n_known", "train_tokens", "base_score", "score"]),
    "langid": (lambda d, b: langid.identify(d, F.lit(True)), ["lang_pred", "score"]),
    "decontam": (decontam.contamination, None),
    "secrets": (lambda d, b: secrets.secret_spans(d), None),
    "media": (lambda d, b: media.as_media(d, ("mulaw",)), None),
}


@pytest.mark.parametrize("name", sorted(PER_TEXT))
def test_same_results_for_any_ids(spark, name):
    run, columns = PER_TEXT[name]
    bench = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    plain = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(TEXTS, LANGS), 1)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame(list(zip(IDS, TEXTS, LANGS)), "doc_id long, text string, lang string").withColumns({c: F.expr(v) for c, v in CLASHING.items()})

    def rows(docs):
        out = run(docs, bench)
        out = out.select(*(columns or [c for c in out.columns if c != "doc_id"]))
        return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.collect())

    assert rows(odd) == rows(plain)
    assert Counter(r.doc_id for r in run(odd, bench).collect()) == Counter(IDS)
