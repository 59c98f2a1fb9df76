import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from daygrid.llm.quality_rules import BUCKETS, quality

WORDS = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_of(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<i" if isinstance(p, int) and abs(p) < 100 else "<q", p)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return signed(seed)


def grams(text):
    w = WORDS.findall(text or "")
    h = [hash_of(x) for x in w]
    pairs = [signed(xxhash.xxh64(struct.pack("<q", b), seed=xxhash.xxh64(struct.pack("<q", a), seed=42).intdigest()).intdigest())
             for a, b in zip(h, h[1:])]
    ends = [hash_of(x[-3:], 3) for x in w]
    return [x & (BUCKETS - 1) for x in [*h, *pairs, *ends]]


@pytest.fixture(scope="module")
def tables(make, spark):
    good = [(i, " ".join(f"w{(i * j) % 37}a word" for j in range(1, 60))) for i in range(40)]
    odd = [(100 + i, " ".join(f"{i}{j}%%% | &&&" for j in range(40))) for i in range(40)]
    rows = good + odd + [(200, None), (201, ""), (202, "a b c " * 30), (203, "x"), (204, "l1\nl1\n \nl2 | #\r\nl1"), (0, good[0][1]),
                         (205, "q " * 9000), (206, " ".join(str(i % 997) for i in range(9000)))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(0, 1, 0), (100, 0, 0), (101, 1, 1), (None, 1, 0), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    return rows, make(rows), labels


def test_base_counts_and_score(tables):
    rows, frame, labels = tables
    corpus, target = Counter(), Counter()
    for i, t in rows:
        corpus.update(grams(t))
        if i < 40:
            target.update(grams(t))
    c, t = sum(corpus.values()), sum(target.values())
    weight = lambda g: (math.log(target[g] + 1) - math.log(t + BUCKETS)) - (math.log(corpus[g] + 1) - math.log(c + BUCKETS))
    texts = dict(rows)
    out = quality(frame.drop("score"), labels).collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text)
        g = grams(text)
        assert r["score"] == pytest.approx(sum(map(weight, g)) / len(g) if g else 0, abs=1e-6)
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert not kept & set(range(100, 140)) and all(r["kept"] != r["base_failed"] for r in out if r["doc_id"] < 40)


def test_filter_on_the_verdict(tables):
    _, frame, labels = tables
    out = quality(frame, labels)
    assert out.where("kept").select("doc_id", "text").count() == out.agg(F.count_if("kept")).first()[0]


def test_without_labels_or_rows(tables, no_docs, edge_docs):
    _, frame, labels = tables
    empty = labels.where("doc_id = -1")
    assert quality(no_docs, labels).count() == 0
    assert {r["kept"] != r["base_failed"] for r in quality(frame, empty).collect()} == {True}
    assert quality(edge_docs, empty).count() == 11
