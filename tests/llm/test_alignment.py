import collections
import hashlib
import random

import numpy as np
import pytest

from daygrid.llm import alignment
from daygrid.llm.bpe import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def alphabets():
    with open(A, "rb") as f, open(B, "rb") as g:
        return alignment.Alphabets(f.read(), g.read())


def ends(ids, names):
    return np.cumsum([len(names[i]) for i in ids]).tolist()


def brute(rows, alphabets):
    """Both tokenizers text by text, with every pair of tokens compared by its byte range."""
    done, counts = [], collections.Counter()
    for doc, text in rows:
        text = text or ""
        a, b = alphabets.a.encode(" " + text, add_special_tokens=False).ids, alphabets.b.encode(text)
        raw = (" " + text).encode()
        if not text or any(b"".join(names[i] for i in ids) != raw for names, ids in ((alphabets.a_bytes, a), (alphabets.b_bytes, b))):
            done.append((doc, 0, 0, 0, [], ""))
            continue
        to_a, to_b = ends(a, alphabets.a_bytes), ends(b, alphabets.b_bytes)
        cuts, groups, x, y = sorted(set(to_a) & set(to_b)), [], 0, 0
        for cut in cuts:
            i, j = to_a.index(cut) + 1, to_b.index(cut) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            x, y = i, j
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                 if max(([0] + to_a)[i], ([0] + to_b)[j]) < min(to_a[i], to_b[j])]
        counts.update(links)
        done.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(((d, a, b, g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), sha)
                   for d, a, b, g, ls, sha in done), key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sent", [1 << 18, 12, 0])
def test_same_as_brute_force(make, alphabets, sent):
    rng = random.Random(5)
    pieces = ["the", " fox", "ing ", "über", "你好吗", "😀", "\n\n", "  ", "<|endoftext|>", "<s>", "\x00", "12345", "▁", "é", " \t", "zzzz"]
    rows = [(i, "".join(rng.choice(pieces[:13] if i % 4 else pieces) for _ in range(rng.choice([1, 3, 40])))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " "), (None, "no id here"), (3, rows[3][1]), (3, "other text"), (104, "a▁b"), (105, "ab " * 300), (106, "x" * 700)]
    found, base = alignment.digests(make(rows), A, B)
    got = alignment.with_pair_counts(alignment.stage(found), base, sent).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, alphabets)


def test_shared_groups_and_overlaps(make, alphabets):
    rows = [(1, "internationalization of straightforwardness"), (2, "你好 world"), (3, None)]
    for r in alignment.alignments(make(rows), A, B).collect():
        one = alignment.Aligned(alphabets, [dict(rows)[r["doc_id"]] or ""])
        assert sum(x["bytes"] for x in r["links"]) == sum(len(alphabets.a_bytes[i]) for i in r["a_ids"])
        i, j = one.shared()
        assert (one.a_group[i] == one.b_group[j]).all() and len(i) == one.shared_counts()[0] >= len(r["links"])
        assert {(x["a"], x["b"]) for x in r["links"]} <= set(zip(i.tolist(), j.tolist()))
        assert not r["groups"] or (r["groups"][-1]["a_to"], r["groups"][-1]["b_to"]) == (len(r["a_ids"]), len(r["b_ids"]))


def test_row_products():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, (7, 9)), rng.integers(0, 2, (9, 5))
    sparse = lambda m: alignment.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
    i, j, n = alignment.row_products(sparse(a), sparse(b))
    out = np.zeros((7, 5), int)
    out[i, j] = n
    assert (out == a @ b).all() and (np.diff(i * 5 + j) > 0).all()
    back = sparse(b).transposed(5)
    assert (back.columns == np.nonzero(b.T)[1]).all()


def test_edge_tables(edge_docs, no_docs, alphabets):
    run = lambda docs: (lambda found, base: alignment.with_pair_counts(alignment.stage(found), base))(*alignment.digests(docs, A, B))
    assert run(edge_docs).count() == edge_docs.count()
    assert run(no_docs).collect() == []
