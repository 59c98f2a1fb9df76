import random
from collections import Counter

import numpy as np
import pytest

from daygrid.llm.repeats import marked_windows, remove_repeats, suffix_order


def brute(rows, span):
    count = Counter(b[i:i + span] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - span + 1))
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i:i + span]] > 1:
                mark[i:i + span] = b"\1" * span
        runs = [x for x in bytes(mark).split(b"\0") if x]
        out.append((doc, len(b), sum(mark), len(runs), bytes(x for x, m in zip(b, mark) if not m)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(15))
def test_suffix_order_and_marks(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
    groups = np.sort(np.array([rng.randint(0, 3) for _ in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    stops = np.cumsum([len(t) for t in texts])
    which = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ends = stops[which]
    assert suffix_order(data, which, ends, groups[which]).tolist() == sorted(
        range(len(data)), key=lambda p: (groups[which[p]], data[p:ends[p]].tobytes(), which[p]))
    count = Counter((g, t[k:k + 4]) for g, t in zip(groups.tolist(), texts) for k in range(len(t) - 3))
    assert [m.tolist() for m in marked_windows(texts, groups, 4)] == [
        [k for k in range(len(t) - 3) if count[g, t[k:k + 4]] > 1] for g, t in zip(groups.tolist(), texts)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100 + i, t[:rng.randint(0, len(t))] + passage + t[len(t) // 2:]) for i, (_, t) in enumerate(rows[:30])]
    rows += [(200 + i, rows[3][1][:k] + "Z" + rows[3][1][k:]) for i, k in enumerate(range(0, 200, 25))]
    rows += [(300, None), (301, ""), (302, "a" * 3000), (303, "ab" * 150 + "c" * 250), (303, "x"), (0, rows[0][1]), (None, passage), (304, "q" * 199)]
    return rows


@pytest.mark.parametrize("span, most_indexed", [(200, 4096), (200, 2), (50, 4096), (9, 4096), (9, 2)])
def test_same_as_brute_force(make, corpus, span, most_indexed):
    out = remove_repeats(make(corpus), span, most_indexed).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], sum(x["high"] - x["low"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"]))
                  for r in out), key=str)
    assert got == brute(corpus, span)


def test_edge_rows(edge_docs, no_docs):
    assert remove_repeats(edge_docs).count() == 11
    assert remove_repeats(no_docs).count() == 0
