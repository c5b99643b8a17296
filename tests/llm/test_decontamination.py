import random

from pyspark.sql import functions as F

from speechframes.llm import decontamination as D

ITEM = "What is the boiling point of water at sea level, in degrees Celsius, and why does it fall with altitude?"


def distance(pattern, text):
    """Least edit distance to any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(out)), rng.randrange(3)
        out[p : p + (kind < 2)] = [] if kind == 1 else [rng.choice("abc ")]
    return "".join(out)


def test_matches_brute_force():
    rng = random.Random(4)
    items = [(i, D.normal("".join(rng.choice("abcdefgh  ") for _ in range(n)))) for i, n in enumerate([12, 40, 80, 150, 5])]
    searcher = D.Searcher(items, D.ERROR_RATE)
    for _ in range(300):
        i, text = rng.choice(items)
        budget = int(D.ERROR_RATE * len(text))
        around = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(2)]
        doc = D.normal(around[0] + edited(rng, text, rng.randint(0, budget + 3)) + around[1])
        want = distance(text, doc)
        got = [m for m in searcher.search(doc) if m[0] == i]
        assert bool(got) == (want <= budget)
        if got:
            assert min(m[3] for m in got) == want
            assert all(distance(text, doc[a:b]) == d <= e == budget for _, a, b, d, e in got)


def test_two_occurrences_side_by_side():
    searcher = D.Searcher([(1, "abcdefghij" * 3)], D.ERROR_RATE)
    text = "abcdefghij" * 3
    assert len(searcher.search(text + "zz" + text)) == 2 and len(searcher.search(text * 2)) == 2


def test_offsets_in_the_original(spark, rows):
    docs = [(1, f"Intro.\n\n{ITEM.upper()}\nEnd"), (2, "İ " + ITEM.replace(" ", "\n  ")), (3, "clean text"), (4, None), (5, ""), (1, f"Intro.\n\n{ITEM.upper()}\nEnd"), (6, ITEM.replace("boiling", "boilng"))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, None), (13, "  ")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = D.find_matches(df, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(1, 10, 0), (1, 10, 0), (1, 11, 0), (1, 11, 0), (2, 10, 0), (2, 11, 0), (6, 10, 1), (6, 11, 1)]
    for r in got:
        text = dict(docs)[r["doc_id"]]
        assert D.normal(text[r["start"] : r["end"]])[:8] == D.normal(ITEM)[:8] and text[r["end"] - 1] == "?"
    assert rows(D.drop_contaminated(df, bench), "doc_id") == [(3,), (4,), (5,)]


def test_drop_judges_each_row_by_its_own_text(spark, rows, monkeypatch):
    other = "another question that is long enough to count"
    docs = [(None, f"Intro {ITEM}"), (None, "clean without id"), (7, f"{ITEM} end"), (7, "clean with the same id"), (8, other), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s"))
    bench = spark.createDataFrame([(1, ITEM), (2, other)], "item_id long, text string")
    want = sorted([(None, "clean without id", "s"), (7, "clean with the same id", "s"), (9, None, "s")], key=repr)
    assert rows(D.drop_contaminated(df, bench)) == want
    monkeypatch.setattr(D, "BLOCK_CHARS", 10)
    assert rows(D.drop_contaminated(df, bench)) == want


def test_blocks_give_the_same(spark, rows, monkeypatch):
    df = spark.createDataFrame([(1, ITEM), (2, "another question that is long enough to count")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "another question that is long enough to count"), (3, "x" * 30)], "item_id long, text string")
    want = rows(D.find_matches(df, bench))
    monkeypatch.setattr(D, "BLOCK_CHARS", 10)
    assert rows(D.find_matches(df, bench)) == want and len(want) == 2


def test_items_of_one_id_keep_their_own_budgets(spark):
    short = "a question of thirty letters?!"
    df = spark.createDataFrame([(1, f"{ITEM} and {short}"), (2, "x" * 1_500_000 + ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (1, short)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["budget"]) for r in D.find_matches(df, bench).collect())
    assert got == sorted([(1, 1, len(ITEM) // 10), (1, 1, len(short) // 10), (2, 1, len(ITEM) // 10)])


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.find_matches(no_docs, bench).count() == 0
    df = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert D.find_matches(df, bench.limit(0)).count() == 0 and D.drop_contaminated(df, bench.limit(0)).count() == 1
