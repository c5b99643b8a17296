import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and repeated rows, equal ids, ties."""
    data = [(None, None, None, None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, "the cat sat", "en", None, 11), (3, "the cat sat", "en", None, 11), (4, "the cat sat", None, "s", 11), (4, "le chat est là", "fr", "s", 14), (None, "the cat sat", "en", "s", 11)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages and long words."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [sentence(30) for _ in range(4)]
    texts = []
    for _ in range(80):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            w = rng.choice(texts).split()
            if w:
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        else:
            parts = [sentence(rng.randint(0, 60)), rng.choice(passages) if rng.random() < 0.5 else "", sentence(rng.randint(0, 40))]
            texts.append("\n".join(parts))
    texts += ["", "a" * 450, "ab" * 200]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def corpus_df(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in corpus], DOCS).repartition(5)
