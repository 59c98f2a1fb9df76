"""Byte-level BPE with a lexicon of frequent words, and exact merges for the rest.

All words of the corpus are counted in Spark; the most frequent ones are merged
once and compiled into a minimal acyclic transducer: states share suffixes, and
the numbers on a word's arcs add up to its rank, which points at its ids.  The
arrays (arcs, ids, merge table, token bytes) form one file that Spark sends to
the executors, where workers map it into memory.  Words outside the lexicon are
merged exactly, a whole batch of distinct words at a time.

Defined results: null is an empty text with no ids; the special token's string
inside a text is its id, as the tokenizer file says; repeated rows are encoded
alike; an empty table gives no rows; other columns are ignored.  Ids depend on
the tokenizer file alone, never on the lexicon.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from daygrid.llm.catalog import query, table
from daygrid.stage import stage

#: The pattern that cuts a text into words before merging: a fixed value of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = 1 << 16  # words compiled into the lexicon
CACHED = 1 << 17  # words whose ids a task remembers; beyond it, it goes on with those of the lexicon
ROWS = 256  # rows encoded together


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the tokenizer file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Merges:
    """Token bytes, special tokens and the merge table of a tokenizer file, as arrays."""

    SLOTS = 18  # 2^18 slots for some 50,000 merges

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = stored["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        size = max(*vocab.values(), *self.special.values(), 0) + 1
        tokens = [b""] * size
        for word, i in vocab.items():
            tokens[i] = word.encode() if word in self.special else bytes(letters[c] for c in word)
        for word, i in self.special.items():
            tokens[i] = word.encode()
        self.tokens = tokens
        self.first = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        keys, ranks, made = [], [], []
        for rank, pair in enumerate(stored["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[left] << 20 | vocab[right])
            ranks.append(rank)
            made.append(vocab[left + right])
        self.keys, self.ranks, self.made = hashed_table(np.array(keys, np.int64), np.array(ranks, np.int32),
                                                        np.array(made, np.int32), self.SLOTS)


NO_RANK = np.int32(2**31 - 1)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def hashed_table(keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, bits: int):
    """Open addressing: a key lies in its slot or in the next free one."""
    table_keys = np.full(1 << bits, -1, np.int64)
    table_ranks, table_made = np.full(1 << bits, NO_RANK, np.int32), np.zeros(1 << bits, np.int32)
    for slot, key, rank, to in zip(_slot(keys, bits).tolist(), keys.tolist(), ranks.tolist(), made.tolist()):
        while table_keys[slot] >= 0:
            slot = (slot + 1) & ((1 << bits) - 1)
        table_keys[slot], table_ranks[slot], table_made[slot] = key, rank, to
    return table_keys, table_ranks, table_made


def find_merges(keys: np.ndarray, stored: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rank, merged id) of each pair key; no merge has the largest rank."""
    table_keys, table_ranks, table_made = stored
    last = len(table_keys) - 1
    slots = _slot(keys, last.bit_length())
    there = table_keys[slots]
    astray = np.flatnonzero((there != keys) & (there >= 0))
    while len(astray):
        slots[astray] = (slots[astray] + 1) & last
        there = table_keys[slots[astray]]
        astray = astray[(there != keys[astray]) & (there >= 0)]
    hit = table_keys[slots] == keys
    return np.where(hit, table_ranks[slots], NO_RANK), table_made[slots]


def merge_words(words: list[bytes], first: np.ndarray, stored) -> list[list[int]]:
    """Exact merges of many words side by side: in each round every word applies its lowest-ranked pair."""
    out: list[list[int]] = [[] for _ in words]
    lengths = np.array([len(w) for w in words], np.int64)
    ids = first[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    which = np.repeat(np.arange(len(words)), lengths)
    while len(ids):
        head = np.flatnonzero(np.diff(which, prepend=-1))
        ranks = np.full(len(ids), NO_RANK, np.int32)
        made = np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(which[:-1] == which[1:])
        ranks[inner], made[inner] = find_merges(ids[inner] << 20 | ids[inner + 1], stored)
        best = np.minimum.reduceat(ranks, head)
        sizes = np.diff(np.append(head, len(ids)))
        ended = best == NO_RANK
        if ended.any():
            for a, n, w in zip(head[ended].tolist(), sizes[ended].tolist(), which[head[ended]].tolist()):
                out[w] = ids[a:a + n].tolist()
        lowest = np.repeat(best, sizes)
        apply = (ranks == lowest) & (lowest != NO_RANK)
        at = np.flatnonzero(apply)
        if len(at):  # of overlapping pairs, every second one from the left
            starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            turn = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            apply[at[turn % 2 == 1]] = False
        at = np.flatnonzero(apply)
        ids[at] = made[at]
        keep = np.repeat(~ended, sizes)
        keep[at + 1] = False
        ids, which = ids[keep], which[keep]
    return out


def build_transducer(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimal acyclic transducer of sorted distinct words: arc keys (state * 256 + byte), targets, added ranks, final states.

    Equal suffixes are registered once.  An arc adds the number of words that
    sort before those behind it, so the sum along a word is its position.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...)), targets first
    counts: list[int] = []

    def close(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(int(final) + sum(counts[t] for _, t in arcs))
        return register[key]

    path: list[list] = [[False, []]]  # open states of the last word
    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        while len(path) - 1 > common:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], close(final, arcs)))
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        final, arcs = path.pop()
        path[-1][1].append((last[len(path) - 1], close(final, arcs)))
    root = close(*path[0])
    number = {s: i for i, s in enumerate([root, *(s for s in range(len(states)) if s != root)])}
    arcs = []
    for s, (final, out) in enumerate(states):
        before = int(final)
        for byte, target in out:
            arcs.append((number[s] * 256 + byte, number[target], before))
            before += counts[target]
    arcs.sort()
    final = np.zeros(len(states), np.int64)
    for s, (is_final, _) in enumerate(states):
        final[number[s]] = is_final
    columns = np.array(arcs, np.int64).reshape(-1, 3)
    return columns[:, 0].copy(), columns[:, 1].copy(), columns[:, 2].copy(), final


def look_up(words: list[bytes], keys: np.ndarray, targets: np.ndarray, adds: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Rank of each word in the lexicon or -1; all words walk the automaton together."""
    rank = np.full(len(words), -1, np.int64)
    if not len(keys) or not words:
        return rank
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    live, state, total, depth = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
    while len(live):
        done = lengths[live] == depth
        ended = live[done & (final[state] == 1)]
        rank[ended] = total[done & (final[state] == 1)]
        live, state, total = live[~done], state[~done], total[~done]
        want = state * 256 + data[begin[live] + depth]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        found = keys[at] == want
        live, state, total = live[found], targets[at[found]], total[found] + adds[at[found]]
        depth += 1
    return rank


SECTIONS = ("arc_keys", "arc_targets", "arc_adds", "final", "id_offsets", "ids", "first", "merge_keys", "merge_ranks",
            "merge_made", "token_offsets", "token_bytes")


def write_lexicon(path: str, words: list[bytes], merges: Merges) -> None:
    """One file: a JSON line with the place of every array, then the arrays."""
    words = sorted(set(words) - {b""})
    ids = merge_words(words, merges.first, (merges.keys, merges.ranks, merges.made))
    arrays = [*build_transducer(words), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64),
              np.array([i for word in ids for i in word], np.int32), merges.first, merges.keys, merges.ranks, merges.made,
              np.concatenate([[0], np.cumsum([len(t) for t in merges.tokens])]).astype(np.int64),
              np.frombuffer(b"".join(merges.tokens), np.uint8)]
    places, at = {}, 0
    for name, a in zip(SECTIONS, arrays):
        places[name] = [str(a.dtype), len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"special": merges.special, "places": places}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))


class Lexicon:
    """The mapped file and the ids of the words met so far."""

    def __init__(self, path: str):
        import regex

        mapped = np.memmap(path, np.uint8, "r")
        with open(path, "rb") as f:
            head = f.readline()
        stored = json.loads(head)
        for name, (kind, n, at) in stored["places"].items():
            start = len(head) + at
            setattr(self, name, np.frombuffer(mapped[start:start + n * np.dtype(kind).itemsize], kind))
        self.special: dict[str, int] = stored["special"]
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find_words = regex.compile(PATTERN).findall
        data = self.token_bytes.tobytes()
        ends = self.token_offsets.tolist()
        self.tokens = [data[a:b] for a, b in zip(ends, ends[1:])]
        self.known: dict[str, list[int]] = {}
        self.listed: dict[str, list[int]] = {}  # the known words of the lexicon

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > CACHED:
            self.known = dict(self.listed)
            new = [w for w in words if w not in self.known]
        spelled = [w.encode() for w in new]
        rank = look_up(spelled, self.arc_keys, self.arc_targets, self.arc_adds, self.final)
        unseen = np.flatnonzero(rank < 0).tolist()
        merged = merge_words([spelled[i] for i in unseen], self.first, (self.merge_keys, self.merge_ranks, self.merge_made))
        for i, ids in zip(unseen, merged):
            self.known[new[i]] = ids
        for i in np.flatnonzero(rank >= 0).tolist():
            a, b = self.id_offsets[rank[i]], self.id_offsets[rank[i] + 1]
            self.known[new[i]] = self.listed[new[i]] = self.ids[a:b].tolist()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the words of all texts are looked up together."""
        cut = []
        for text in texts:
            pieces = self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else [text]
            cut.append([self.special[p] if i % 2 else self.find_words(p) for i, p in enumerate(pieces)])
        self.learn({w for pieces in cut for p in pieces if type(p) is list for w in p})
        known, out = self.known, []
        for pieces in cut:
            ids: list[int] = []
            for p in pieces:
                if type(p) is list:
                    for w in p:
                        ids += known[w]
                else:
                    ids.append(p)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, n: int = WORDS) -> list[str]:
    """The most frequent words of all texts: the highest frequency classes that hold at most ``n`` words together.

    A class is a sixteenth of a power of two, so the classes are few; only they
    and at most ``n`` words reach the driver, however many partitions there are.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("word"))
    counts = stage(words.groupBy("word").agg(F.count("*").alias("times")).where("times > 1").select(
        "word", F.floor(F.log2("times") * 16).alias("class")))
    room, lowest = n, None
    for r in counts.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect():
        room -= r["n"]
        if room < 0:
            break
        lowest = r["class"]
    return [] if lowest is None else [r["word"] for r in counts.where(F.col("class") >= lowest).select("word").collect()]


def send_lexicon(docs: DataFrame, tokenizer: str, words: int = WORDS) -> str:
    """Compile the lexicon of ``docs`` and give the file to Spark; returns the name workers find it by."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(os.path.realpath(tempfile.gettempdir()), name)
    write_lexicon(path, [w.encode() for w in frequent_words(docs, words)], Merges(tokenizer))
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, lexicon: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text, and the text read back from them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Lexicon(SparkFiles.get(lexicon))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([coder.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        build, "doc_id long, ids array<int>, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of the ids and of the text read back."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_bpe")
def op9(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_digests(encode(docs, send_lexicon(docs, tokenizer_path())))
