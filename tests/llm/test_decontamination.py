import random

import duckdb
import pytest

from daygrid.llm.decontamination import OP4, contained_items
from .test_near_duplicates import shingles


@pytest.fixture(scope="module")
def tables(make, spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 16, 60])))) for i in range(30)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rng.choice([0, 5, 400, 3000]))]
        for i in rng.sample(range(30), 2):
            part = [w if rng.random() > 0.03 else "changed" for w in items[i][1].upper().split()]
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((d, "\n ".join(body)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (0, docs[0][1])]
    items += [(50, None), (51, ""), (0, items[0][1]), (0, items[0][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return docs, items, make(docs), frame


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_same_as_brute_force(tables, most_sent):
    docs, items, frame, item_frame = tables
    expected = set()
    for d, text in docs:
        have = shingles(text, 5)
        for i, item in items:
            s = shingles(item, 5)
            few, all_words = (item or "").lower().split(), (text or "").lower().split()
            if 0 < len(few) < 5:
                if any(all_words[k:k + len(few)] == few for k in range(len(all_words))):
                    expected.add((d, i, 1, 1))
            elif s and 5 * len(s & have) >= 4 * len(s):
                expected.add((d, i, len(s), len(s & have)))
    assert expected and {tuple(r) for r in contained_items(frame, item_frame, most_sent=most_sent).collect()} == expected


def test_empty_tables(tables, no_docs, spark):
    assert contained_items(no_docs, tables[3]).count() == 0
    assert contained_items(tables[2], spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_an_item_spread_over_rows_of_one_id_is_in_none(spark, most_sent):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:22])), (1, " ".join(words[18:])), (2, " ".join(["a", *words, "b"])), (None, " ".join(words))],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words)), (None, " ".join(words))], "item_id long, text string")
    got = {tuple(r) for r in contained_items(docs, items, most_sent=most_sent).collect()}
    assert got == {(d, i, 36, 36) for d in (2, None) for i in (7, 8, None)}


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_short_items_inside_long_documents(spark, most_sent):
    """Their words follow one another in one document; a part, another order or two documents do not count."""
    texts = [(1, "a " * 3000 + "Red fox runs " + "b " * 3000), (2, "runs red fox"), (3, "the red"), (4, "fox runs"), (5, "red fox"),
             (None, "red\tfox\n runs fast"), (6, None), (7, ""), (8, "redfox runs")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(1)
    items = spark.createDataFrame([(1, "red fox runs"), (2, " RED "), (None, "fox runs"), (3, "red fox red fox"), (4, None), (5, " ")],
                                  "item_id long, text string")
    got = {tuple(r)[:2] for r in contained_items(docs, items, most_sent=most_sent).collect()}
    assert got == {(1, 1), (None, 1), *((d, 2) for d in (1, 2, 3, 5, None)), (1, None), (4, None), (None, None)}


def test_sql_finds_short_items(spark):
    """No given table has such an item, so the SQL is compared here."""
    docs = [(1, "x red fox y"), (2, "fox red"), (3, "one two three four five six"), (4, None), (5, "RED fox")]
    items = [(1, "red  fox"), (2, "one two three four five six"), (3, "six"), (4, "")]
    db = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        db.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    found = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    wanted = sorted(db.execute(OP4).fetchall())
    assert sorted(tuple(r) for r in found.collect()) == wanted == [(1, 1, 1, 1), (3, 2, 2, 2), (3, 3, 1, 1), (5, 1, 1, 1)]


def test_joined_lookup_has_size_partitions(spark):
    """Beyond the limit, (size partition, value) is the key; items of very different sizes are found alike."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 12, 40, 300, 2000])]
    docs = [(i, " ".join([word(), t, word()])) for i, t in items] + [(9, " ".join(t for _, t in items))]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda most: {tuple(r) for r in contained_items(*tables, most_sent=most).collect()}
    assert pairs(0) == pairs(10**6) and {r[:2] for r in pairs(0)} >= {(i, i) for i in range(6)} | {(9, i) for i in range(6)}
