import collections
import random
import re

import numpy as np
import pytest

from daygrid.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    """The contract with Python's integers, over (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, docs, groups = collections.defaultdict(collections.Counter), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, terms = lang or "", [t.translate(lower) for t in TERM.findall(text or "")]
        groups[lang].add(source or "")
        seen[lang, source or ""].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        counts = {s: [seen[lang, s][t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        p, q = {s: share(c) for s, c in counts.items()}, share([sum(x) for x in zip(*counts.values())])
        ratio = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(o, sum(map(ratio, p[s], p[o]))) for o in sources - {s}]
            terms = [(t, ratio(x, y)) for t, x, y, c in zip(kept, p[s], q, counts[s]) if c and x > y]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, t, v, n) for n, (t, v) in enumerate(items, 1) if part == "pair" or n <= top]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 18, 40])
def test_same_as_brute_force(spark, cells):
    rng = random.Random(3)
    vocabulary = ["the", "The", "fox", "ÄÖ", "äö", "naïve", "internationalization", "internationally", "international", "你好", "a", "ab", "abcdefgh", "abcdefghi",
                  "x" * 40, "x" * 41, "don't", "e-mail", "v2"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice([" ", "\n", "\0", ", "]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 9, 60]))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None]))
            for _ in range(80)]
    rows += [(None, "en", "c"), ("", "fr", "a"), ("once only", "fr", "b"), (None, None, None), ("12 34", "en", "Z"), ("long " * 50000, "en", "a")] + [rows[0]] * 3
    docs = spark.createDataFrame([(*r, 7, [1]) for r in rows], "text string, lang string, source string, n long, cells array<int>").repartition(3)
    got = divergence.divergence(docs, top=5, cells=cells)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 5)


def test_pointers_sort_like_bytes():
    rng = random.Random(4)
    terms = ["".join(rng.choices("aé你", k=rng.choice([1, 2, 5, 8, 9, 30]))) for _ in range(500)] + ["abcdefgh", "abcdefghi", "abcdefgh", "abcdefg"]
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    starts, lengths = divergence.term_pointers(data, np.array([0, len(data)]))
    order, first = divergence.sort_pointers(data, starts, lengths)
    assert [terms[i] for i in order] == sorted(terms, key=str.encode)
    assert first.sum() == len(set(terms)) and all(a < b for a, b, new in zip(order, order[1:], first[1:]) if not new)


def test_shares_are_exact():
    rng = random.Random(6)
    for _ in range(200):
        total = rng.randrange(1, 1 << 52)
        count, v = rng.randrange(0, total + 1), rng.randrange(1, 10**6)
        assert divergence.shares(np.array([count]), np.array([total]), v)[0] == 1 + 10**9 * (count + 1) // (total + v)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence(docs).collect() == []
