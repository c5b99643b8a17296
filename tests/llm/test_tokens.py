import hashlib
import random

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from speechframes.llm import sentencepieces as S

MODEL = S.default_model()
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_matches_the_library():
    rng = random.Random(1)
    letters = "aaabcdeehhilnorstt    \t\n▁é漢字😀.-=_0012éx\x00ﬁ　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [" " * rng.randint(0, 70) + rng.choice(["a", " b", "the"]) * rng.randint(0, 30) + " " * rng.randint(0, 9) for _ in range(500)]
    texts += ["a" * 5000, "-" * 3001, "ab" * 3000, "the" * 2000, "=-" * 999, "", " ", "  ", None]
    v = S.load_vocabulary(MODEL)
    for text, (ids, told) in zip(texts, S.Encoder(v).encode(texts), strict=True):
        want = SP.encode(text or "", num_threads=1)
        assert ids.tolist() == want and told.decode() == ",".join(map(str, want))
        assert S.decode_ids(v, ids).decode() == SP.decode(want)


def test_decodes_any_ids():
    v = S.load_vocabulary(MODEL)
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert S.decode_ids(v, np.array(ids, np.int64)).decode() == SP.decode(ids)


def test_columns_and_odd_rows(spark, odd_docs, no_docs):
    made = S.decode(S.encode(odd_docs.withColumn("ids", F.lit("clash")), MODEL), MODEL)
    for r in made.collect():
        assert r["decoded"] == (r["text"] or "") and r["ids"] == SP.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])
    assert S.encode(no_docs, MODEL).count() == 0 and S.digests(no_docs, MODEL).count() == 0
    for r in S.digests(odd_docs.select("doc_id", "text"), MODEL).where("doc_id = 3").collect():
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, SP.encode("the cat sat"))).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(b"the cat sat").hexdigest()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(S, "CACHE_WORDS", 5)
    monkeypatch.setattr(S, "CHUNK_CHARS", 10)
    texts = [f"w{i} w{i % 3} some words" for i in range(40)]
    for text, (ids, _) in zip(texts, S.Encoder(S.load_vocabulary(MODEL)).encode(texts), strict=True):
        assert ids.tolist() == SP.encode(text)
