"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  The
field looks at windows around digits and at-signs.  Its segments are whole
candidate spans, scored by features of the span as a whole (digit count, Luhn
sum, grouping, separators, neighbours, shape of the domain).  Dynamic
programming over segments of at most ``LONGEST`` tokens chooses boundaries and
kinds together; tokens of base spans are closed to it.  A chosen segment is
added when its marginal probability reaches ``SURE``.

The weights are trained here, by the likelihood of base spans in at most
``MOST_WINDOWS`` short windows (those with the smallest hashes) and in variants of
them that the patterns do not reach: no country code, other separators.
Windows without a base span are examples of what is not personal data.

Texts without a digit or at-sign never leave the JVM.  Defined results: null and
empty texts have no spans; a span kind's matches do not overlap, different
kinds' may; repeated rows get equal answers; without examples nothing is
added; an empty table gives no rows; other columns are ignored by
:func:`find_spans` and kept by :func:`redact`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from math import exp, inf, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daygrid.llm.catalog import query, table

KINDS = ("email", "ip", "card", "phone")
TRIGGER = "[0-9@]"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Possessive forms of the base patterns: no text makes them go back over long runs.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")

LONGEST = 40  # tokens of a segment
AROUND = 24  # characters of a window on both sides of a trigger
MOST_WINDOWS = 1500
SURE = 0.95


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    before = 0  # first character after the last at-sign or match
    while at >= 0:
        domain = DOMAIN.match(text, at + 1) if at >= end else None
        if domain:
            local = text[max(before, end):at]
            start = max(before, end) + len(local.rstrip(LOCAL))
            if start < at:
                yield start, domain.end()
                end = domain.end()
        before, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans, kinds in order, then by start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g[-9:]) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(DIGITS.findall(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- the field -------------------------------------------------------------------------------

TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
SEPARATORS = {" ", "-", ".", "(", ")", "+"}


def windows(text: str) -> Iterator[tuple[int, str]]:
    """(offset, text) of the merged surroundings of all triggers."""
    low = high = None
    for m in re.finditer(TRIGGER + "+", text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if low is None:
            low, high = a, b
        elif a <= high:
            high = b
        else:
            yield low, text[low:high]
            low, high = a, b
    if low is not None:
        yield low, text[low:high]


def _neighbour(c: str) -> str:
    return "none" if not c else "digit" if c in "0123456789" else "letter" if c.isalnum() else "space" if c.isspace() else "mark"


def _number_features(kind: str, span: str, groups: list[int], left: str, right: str) -> list[str]:
    digits = sum(groups)
    marks = "".join(sorted(set(span) - set("0123456789")))
    out = [kind, f"{kind} digits {digits}", f"{kind} marks {marks!r}", f"{kind} groups {'-'.join(map(str, groups)) if len(groups) < 6 else 'many'}",
           f"{kind} left {_neighbour(left)}", f"{kind} right {_neighbour(right)}", f"{kind} begins {span[0] if span[0] in '+(' else '0'}"]
    if kind == "card":
        out.append(f"card sum {luhn(''.join(c for c in span if c.isdigit()))}")
    return out


def union_of(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges that cover the same characters."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _outside(tokens: list[tuple[int, int, str]], closed: list[tuple[int, int]]) -> list[bool]:
    """Whether each token lies outside the closed ranges; both are sorted, so one walk does."""
    out, k = [], 0
    for start, end, _ in tokens:
        while k < len(closed) and closed[k][1] <= start:
            k += 1
        out.append(k == len(closed) or closed[k][0] >= end)
    return out


def candidates(text: str, closed: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int, str, int, int, list[str]]]]:
    """Number of tokens, and the candidate segments (token range, kind, character range, features) of a window.

    ``closed`` are sorted disjoint ranges that no segment may touch.
    """
    tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    open_ = _outside(tokens, closed)
    out = []
    for i, (start, _, first) in enumerate(tokens):
        if not open_[i] or not (first.isdigit() or first in ("+", "(")):
            continue
        groups: list[int] = []
        for j in range(i, min(len(tokens), i + LONGEST)):
            _, end, word = tokens[j]
            if not open_[j]:
                break
            if word.isascii() and word.isdigit():
                groups.append(len(word))
            elif word not in SEPARATORS or (word == "+" and j > i):
                break
            else:
                continue
            digits, span = sum(groups), text[start:end]
            left, right = text[start - 1:start], text[end:end + 1]
            if digits > 19:
                break
            if span.count("(") != span.count(")") or "  " in span:
                continue
            kinds = []
            if 8 <= digits <= 15 and len(groups) > 1:
                kinds.append("phone")
            if digits >= 13 and span[0] not in "+(":
                kinds.append("card")
            if len(groups) == 4 and max(groups) <= 3 and span.count(".") == 3 and len(span) == digits + 3:
                kinds.append("ip")
            out.extend((i, j + 1, k, start, end, _number_features(k, span, groups, left, right)) for k in kinds)
    for at, (s, e, word) in enumerate(tokens):
        if word != "@" or not open_[at]:
            continue
        spaced = at > 0 and tokens[at - 1][2] == " " and at + 1 < len(tokens) and tokens[at + 1][2] == " "
        i = at - 1 - spaced
        while i > max(-1, at - LONGEST // 2) and open_[i] and all(c in LOCAL for c in tokens[i][2]):
            i -= 1
        first, dots = i + 1, 0
        if first >= at - spaced or not tokens[first][2].isalnum():
            continue
        for j in range(at + 1 + spaced, min(len(tokens), at + LONGEST // 2)):
            word = tokens[j][2]
            if not open_[j] or not (word.isascii() and (word.isalnum() or word in ".-")):
                break
            dots += word == "."
            if word.isalpha() and dots:
                start, end = tokens[first][0], tokens[j][1]
                out.append((first, j + 1, "email", start, end, [
                    "email", f"email dots {min(dots, 4)}", f"email spaced {spaced}", f"email last {min(len(word), 7)}",
                    f"email left {_neighbour(text[start - 1:start])}", f"email right {_neighbour(text[end:end + 1])}"]))
    return len(tokens), out


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top if top == -inf else top + log(sum(exp(v - top) for v in values))


def marginals(n: int, segments: list, scores: list[float]) -> list[float]:
    """Probability of each segment, by the forward and backward sums of the semi-Markov chain."""
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for k, s in enumerate(segments):
        ending.setdefault(s[1], []).append(k)
        starting.setdefault(s[0], []).append(k)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = forward[j - 1]
        if j in ending:
            forward[j] = _logsum([forward[j - 1], *(forward[segments[k][0]] + scores[k] for k in ending[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = backward[i + 1]
        if i in starting:
            backward[i] = _logsum([backward[i + 1], *(backward[segments[k][1]] + scores[k] for k in starting[i])])
    return [exp(min(0.0, forward[s[0]] + scores[k] + backward[s[1]] - forward[n])) for k, s in enumerate(segments)]


def best_path(n: int, segments: list, scores: list[float]) -> list[int]:
    """The best segmentation: indices of the chosen segments; a token outside costs nothing."""
    ending: dict[int, list[int]] = {}
    for k, s in enumerate(segments):
        ending.setdefault(s[1], []).append(k)
    best, via = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            value = best[segments[k][0]] + scores[k]
            if value > best[j]:
                best[j], via[j] = value, k
    out, j = [], n
    while j > 0:
        if via[j] < 0:
            j -= 1
        else:
            out.append(via[j])
            j = segments[via[j]][0]
    return out


def _score(features: list[str], weights: dict[str, float]) -> float:
    return sum(weights.get(f, -1.0) for f in features)  # what training never saw speaks against a span


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    if not weights:
        return []
    out, taken = [], union_of((a, b) for _, a, b in base)
    for at, part in windows(text):
        first = bisect_right(taken, at, key=lambda span: span[1])
        closed = [(a - at, b - at) for a, b in taken[first:bisect_left(taken, at + len(part), key=lambda span: span[0])]]
        n, segments = candidates(part, closed)
        if not segments:
            continue
        scores = [_score(s[5], weights) for s in segments]
        chosen = best_path(n, segments, scores)
        if chosen:
            sure = marginals(n, segments, scores)
            out.extend((segments[k][2], at + segments[k][3], at + segments[k][4]) for k in chosen if sure[k] >= SURE)
    return out


def examples(texts: list[str]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Windows with their gold spans, and variants with personal data in forms the patterns do not reach."""
    for text in texts:
        spans = base_spans(text)
        yield text, spans
        for kind, a, b in spans:
            word = text[a:b]
            if kind == "phone":
                digits = "".join(c for c in word if c.isdigit())
                forms = [word.split(" ", 1)[1]] if " " in word else []
                if len(digits) >= 10:
                    d = digits[-10:]
                    forms += [f"{d[:3]}-{d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"]
            elif kind == "card":
                d = "".join(c for c in word if c.isdigit())
                forms = [f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"]
            elif kind == "email":
                forms = [word.replace("@", " @ ")]
            else:
                forms = []
            yield from ((text[:a] + f + text[b:], [(kind, a, a + len(f))]) for f in forms)


def train(texts: list[str], rounds: int = 60, rate: float = 0.5, pull: float = 0.01) -> dict[str, float]:
    """Weights by gradient ascent on the likelihood of the gold segmentations."""
    data = []
    for text, gold in examples(texts):
        n, segments = candidates(text, [])
        right = {k for k, s in enumerate(segments) if (s[2], s[3], s[4]) in set(gold)}
        if segments:
            data.append((n, segments, right))
    if not any(right for _, _, right in data):
        return {}
    weights = {f: 0.0 for _, segments, _ in data for s in segments for f in s[5]}
    squares = dict.fromkeys(weights, 1e-6)
    for _ in range(rounds):
        slope = {f: -pull * len(data) * w / 100 for f, w in weights.items()}
        for n, segments, right in data:
            chance = marginals(n, segments, [sum(weights[f] for f in s[5]) for s in segments])
            for k, s in enumerate(segments):
                off = (k in right) - chance[k]
                if abs(off) > 1e-6:
                    for f in s[5]:
                        slope[f] += off
        for f, g in slope.items():
            squares[f] += g * g
            weights[f] += rate * g / squares[f] ** 0.5
    return weights


# --- Spark -----------------------------------------------------------------------------------


def labelled_windows(docs: DataFrame, most: int = MOST_WINDOWS) -> list[str]:
    """At most ``most`` windows of at most 200 characters, those with the smallest hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [part for text in batch.column(0).to_pylist() for _, part in windows(text) if len(part) <= 200]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], ["part"])

    parts = docs.where(F.col("text").rlike(TRIGGER)).select("text").mapInArrow(build, "part string").distinct()
    return [r["part"] for r in parts.orderBy(F.xxhash64("part"), "part").limit(most).collect()]


def _spans(text: str, weights: dict[str, float]) -> tuple[list, list]:
    base = base_spans(text)
    more = added_spans(text, base, weights)
    return base, more


def find_spans(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, low, high) in code points, end exclusive, by kind as listed, then start."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("low", pa.int64()), ("high", pa.int64())]))
        listed = lambda spans: [{"kind": k, "low": a, "high": b} for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:]))]
        for batch in batches:
            found = [_spans(t, weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([listed(b) for b, _ in found], span),
                                              pa.array([listed(m) for _, m in found], span)], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,low:bigint,high:bigint>>"
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    none = F.expr(f"cast(array() as {kind})")
    return rows.where(F.col("text").rlike(TRIGGER)).mapInArrow(build, f"doc_id long, base {kind}, added {kind}").unionByName(
        rows.where(~F.col("text").rlike(TRIGGER)).select("doc_id", none.alias("base"), none.alias("added")))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in capitals; overlapping spans become the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with all columns; texts with spans are masked and ``n_chars``, where there is one, is counted again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(names.index("text")).to_pylist():
                base, more = _spans(text, weights)
                texts.append(masked(text, base + more) if base or more else text)
            columns = [pa.array(texts, pa.string()) if n == "text" else pa.array([len(t) for t in texts], pa.int64()).cast(c.type)
                       if n == "n_chars" else c for n, c in zip(names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    hit = F.coalesce(F.col("text").rlike(TRIGGER), F.lit(False))
    return docs.where(hit).mapInArrow(build, docs.schema).unionByName(docs.where(~hit))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["low"].cast("string"), s["high"].cast("string"))), ",")


@query("op2_pii")
def op2(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_spans(docs, train(labelled_windows(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        F.array_position(order, s["kind"]).alias("place"), s["low"].alias("low"), s["high"].alias("high"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["low"].alias("low"), s["high"].alias("high")))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(every).alias("spans"))
