import random
import re
from itertools import combinations

import pytest

from daygrid.llm.components import components
from daygrid.llm.near_duplicates import near_duplicates

WORDS = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) >= width:
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    """Groups of copies, chains of edits around the threshold, and a passage shared by unrelated texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    rows, n = [], 0
    passage = [word() for _ in range(60)]
    for g in range(8):
        base = [word() for _ in range(rng.choice([3, 12, 80, 300]))]
        for k in range(12):
            base = edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04]))
            rows.append((n, " ".join(base)))
            n += 1
    for k in range(25):
        rows.append((n, " ".join(passage + [word() for _ in range(rng.choice([4, 10, 40]))])))
        n += 1
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_same_components_as_all_pairs(make, corpus, width):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make(corpus), width).collect()}
    assert got == brute(corpus, width)


def test_edge_rows(edge_docs, no_docs):
    rows = sorted(near_duplicates(edge_docs, 4).collect(), key=str)
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i for i in (3, 4, 5))
    assert by[6]["n_shingles"] == by[7]["n_shingles"] == by[8]["n_shingles"] == by[9]["n_shingles"] == 1
    assert all(r["component_id"] is None and not r["kept"] for r in rows if r["doc_id"] is None)
    assert near_duplicates(no_docs, 4).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(10, 40)] + [(100, 1000 + i) for i in range(50)] + [(5, 5), (7, 3), (3, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(found[i] == 10 for i in range(10, 41)) and all(found[1000 + i] == 100 for i in range(50))
    assert found[7] == found[3] == 3 and 5 not in found
