import random
import re

import pytest

from daygrid.llm import pii
from daygrid.llm.pii import (
    KINDS, added_spans, base_spans, best_path, find_spans, luhn, marginals, masked, redact, train, windows)

#: The base patterns as given.
GIVEN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def given(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(GIVEN[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))) or (
                    kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))) or (
                    kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for letters, size in (("ab@@.._-+%(( ))001234567 é", 40), ("0123456789 -", 300), ("a.@_", 12)):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, size)))
            assert base_spans(text) == given(text)


def test_long_runs_take_linear_time():
    assert base_spans("0" * 300000 + "a" * 300000 + "@" + "1." * 50000 + "+1" + " " * 100000) is not None


SAMPLE = [f"call +1 (40{i}) 555-77{10 + i} or a{i}.b@mail.example.com from 10.0.{i}.7 card 411111111111111{1} token 9f{i}a77 on 2024-05-{10 + i}"
          for i in range(10)] * 5


@pytest.fixture(scope="module")
def weights():
    return train([p for t in SAMPLE for _, p in windows(t)])


def test_field_adds_other_forms_and_leaves_numbers_alone(weights):
    find = lambda t: added_spans(t, base_spans(t), weights)
    assert find("ring 408-555-7715 now") == [("phone", 5, 17)]
    assert find("write jo @ mail.example.com now") == [("email", 6, 27)]
    for clean in ("on 2024-05-06 at 10:11", 'token = "908038b7daaf91e730d2f64001c5293"', "v1.2.3 and 3.14159", "", "id 12345678", "1,234,567"):
        assert find(clean) == []
    assert train(["nothing here", "42"]) == {} and added_spans("408-555-7715", [], {}) == []


def test_dynamic_programming_against_all_segmentations():
    rng = random.Random(1)
    for _ in range(100):
        n = 6
        segments = [(i, j, "x", 0, 0, []) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.5]
        scores = [rng.uniform(-2, 2) for _ in segments]

        def paths(at):
            if at == n:
                yield ()
                return
            yield from paths(at + 1)
            for k, s in enumerate(segments):
                if s[0] == at:
                    for rest in paths(s[1]):
                        yield (k, *rest)

        from math import exp
        every = [(p, sum(scores[k] for k in p)) for p in paths(0)]
        assert sum(scores[k] for k in best_path(n, segments, scores)) == pytest.approx(max(v for _, v in every))
        z = sum(exp(v) for _, v in every)
        for k, m in enumerate(marginals(n, segments, scores)):
            assert m == pytest.approx(sum(exp(v) for p, v in every if k in p) / z)


def test_tables(make, edge_docs, no_docs, weights):
    rows = [(i, t) for i, t in enumerate(SAMPLE[:10])] + [(90, None), (91, "é😀 1.2.3.4"), (0, SAMPLE[0])]
    for r in find_spans(make(rows), weights).collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert [(s["kind"], s["low"], s["high"]) for s in r["base"]] == sorted(given(text), key=lambda s: (KINDS.index(s[0]), s[1]))
    assert find_spans(edge_docs, weights).where("size(base) + size(added) > 0").count() == 0
    assert find_spans(no_docs, weights).count() == 0 == redact(no_docs, weights).count()
    clean = redact(make(rows), weights)
    assert clean.columns == make(rows).columns
    out = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert out[90] is None and out[91] == "é😀 <IP>" and "@" not in out[3] and "<CARD>" in out[3]
    assert masked("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a<IP>f"


def test_dense_spans_take_linear_time(weights):
    """Texts full of base spans: ten times the text, about ten times the time; a 2 MB log takes seconds."""
    import time

    line = lambda i: f"10.{i % 200}.{i * 7 % 250}.{i % 99} visited by user{i}@mail.example.org on line {i}\n"
    took = []
    for n in (3_000, 30_000):
        text = "".join(map(line, range(n)))
        start = time.process_time()
        base = base_spans(text)
        pii.added_spans(text, base, weights)
        took.append(time.process_time() - start)
        assert len(base) == 2 * n
    assert took[1] < 40 and took[1] < 25 * max(took[0], 0.2)


def test_closed_ranges(weights):
    rng = random.Random(9)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        tokens, at = [], 0
        while at < 70:
            end = at + rng.randint(1, 4)
            tokens.append((at, end, "x"))
            at = end
        assert pii._outside(tokens, pii.union_of(spans)) == [not any(a < e and s < b for a, b in spans) for s, e, _ in tokens]
