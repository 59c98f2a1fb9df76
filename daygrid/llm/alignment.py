"""Alignment of two tokenizations of the same bytes, and corpus-wide counts of the id pairs it links.

Tokenizer A encodes a space and the text, tokenizer B the text, to which it adds the space
itself.  A token's row in an incidence matrix names its bytes; the matrices are compressed
sparse rows made here.  Gustavson's row products give A.B^T: the tokens that overlap, and in
how many bytes.  Bytes where tokens of both end cut the texts into groups; the products of
the token-group matrices link the tokens that share a group.

Documents leave a task with their distinct id pairs.  Pairs are counted over the corpus;
the most frequent ones, ``SENT`` at most, are broadcast back, so that a pair that every
document holds is never shuffled; the others are joined by a shuffle.

Defined results: null and empty texts, and those whose tokens of A or B do not join to space
and text, have no tokens: zeros, no links and '' for the digest; special tokens' strings are
plain text; repeated rows are aligned alike and all count; a null id is carried along; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from daygrid.llm.bpe import PATTERN, byte_letters, tokenizer_path
from daygrid.llm.catalog import query, table
from daygrid.stage import stage

SENT = 1 << 18  # id pairs broadcast
CHUNK_BYTES = 1 << 20  # text aligned at once
LONG_GAP = re.compile(r"\s{1000}")  # the ranks' regular expression engine backtracks over white space on its stack


class Csr:
    """A sparse matrix of ones as compressed rows."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray):
        self.starts, self.columns = starts, columns

    @classmethod
    def intervals(cls, lengths: np.ndarray) -> Csr:
        """Rows that name neighbouring columns, one row after the other."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return cls(starts, np.arange(starts[-1], dtype=np.int32))

    @classmethod
    def members(cls, columns: np.ndarray) -> Csr:
        """Rows that name one column each."""
        return cls(np.arange(len(columns) + 1), columns)

    def transposed(self, n: int) -> Csr:
        """The matrix with its ``n`` columns as rows."""
        rows = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
        turn = np.argsort(self.columns, kind="stable") if (np.diff(self.columns) < 0).any() else slice(None)
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=n))]), rows[turn])


def row_products(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of a.b: a row is the sum of the rows of ``b`` that the same row of ``a`` names."""
    rows = np.repeat(np.arange(len(a.starts) - 1, dtype=np.int32), np.diff(a.starts))
    all_sizes = np.diff(b.starts)
    if (all_sizes == 1).all():
        columns = b.columns[a.columns]
    else:
        first, sizes = b.starts[a.columns], all_sizes[a.columns]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows, columns = np.repeat(rows, sizes), b.columns[np.repeat(first, sizes) + inner]
    if len(rows) and ((np.diff(columns) < 0) & (np.diff(rows) == 0)).any():
        turn = np.lexsort((columns, rows))
        rows, columns = rows[turn], columns[turn]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
    heads = np.flatnonzero(new)
    return rows[heads], columns[heads], np.diff(np.append(heads, len(rows)))


def spelled_numbers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters, widths): the decimal digits of the numbers below ``n``, filled up with zero bytes, and one free place."""
    words = np.arange(n).astype(bytes)
    letters = np.zeros((n, words.itemsize + 1), np.uint8)
    letters[:, :-1] = words.view(np.uint8).reshape(n, -1)
    return letters, (letters > 0).sum(1)


def ranked_words(stored: dict) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level tokenizer file whose ids are in order of its merges; None for other files."""
    model, cut = stored["model"], stored.get("pre_tokenizer") or {}
    plain = (not stored.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
             and not model.get("ignore_merges") and not model.get("dropout"))
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]] if plain else []
    if not plain or made != sorted(made):
        return None
    letters, special = byte_letters(), {t["content"] for t in stored["added_tokens"]}
    return {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}


class Alphabets:
    """Both tokenizers and the bytes of their tokens.

    Where ids follow merges, the ids of the file's tokenizer are those of its words as ranks, which takes a third of the time.
    """

    def __init__(self, a: bytes, b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        ranks = ranked_words(json.loads(a))
        if ranks:
            from tiktoken import Encoding

            words = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.a_encode = lambda text: self.by_file(text) if LONG_GAP.search(text) else words(text)
        else:
            self.a_encode = self.by_file
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        self.b_bytes = [
            bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i in range(self.b.get_piece_size()) for piece in [self.b.id_to_piece(i)]]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.digits, self.widths = spelled_numbers(max(len(self.a_bytes), len(self.b_bytes)))

    def by_file(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B of each text; none where a tokenizer loses or changes a byte."""
        spaced = [" " + t for t in texts]
        a = [self.a_encode(t) for t in spaced]
        b = self.b.encode(texts, num_threads=1)
        for i, (text, whole) in enumerate(zip(texts, spaced)):
            raw = whole.encode()
            if not text or any(b"".join(map(names.__getitem__, ids)) != raw for names, ids in ((self.a_bytes, a[i]), (self.b_bytes, b[i]))):
                a[i], b[i] = [], []
        return a, b


class Aligned:
    """Links and groups of a chunk of texts; tokens are numbered over the chunk."""

    def __init__(self, alphabets: Alphabets, texts: list[str]):
        self.alphabets = alphabets
        a, b = alphabets.encode(texts)
        self.a_counts, self.b_counts = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        a_sizes, b_sizes = alphabets.a_sizes[self.a], alphabets.b_sizes[self.b]
        total = int(a_sizes.sum())
        self.links = row_products(Csr.intervals(a_sizes), Csr.intervals(b_sizes).transposed(total))
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        ends = np.zeros(total + 1, bool)
        ends[a_ends] = True
        self.ends = b_ends[ends[b_ends]]  # a text's last byte ends tokens of both
        self.a_group, self.b_group = np.searchsorted(self.ends, a_ends), np.searchsorted(self.ends, b_ends)
        self.a_owner, self.b_owner = (np.repeat(np.arange(len(texts)), n) for n in (self.a_counts, self.b_counts))

    def by_text(self, owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights, minlength=len(self.a_counts)).astype(np.int64)

    def group_counts(self) -> np.ndarray:
        """Groups of each text."""
        last = np.flatnonzero(np.diff(self.a_group, append=-1))
        return self.by_text(self.a_owner[last])

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): tokens of A and B in one group, by products of the group matrices."""
        return row_products(Csr.members(self.a_group), Csr.members(self.b_group).transposed(len(self.ends)))[:2]

    def shared_counts(self) -> np.ndarray:
        """Links between tokens that share a group, counted per text without listing them: the product with ones."""
        return self.by_text(self.a_owner, np.bincount(self.b_group, minlength=len(self.ends))[self.a_group])

    def group_strings(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids of A and B, group by group."""
        sizes = [np.bincount(g, minlength=len(self.ends)) for g in (self.a_group, self.b_group)]
        begin = np.cumsum(sizes[0] + sizes[1]) - sizes[0] - sizes[1]
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        for side, (tokens, group) in enumerate(((self.a, self.a_group), (self.b, self.b_group))):
            inner = np.arange(len(tokens)) - (np.cumsum(sizes[side]) - sizes[side])[group]
            ids[begin[group] + side * sizes[0][group] + inner] = tokens
        after[begin + sizes[0] - 1], after[begin + sizes[0] + sizes[1] - 1] = ord("|"), ord(";")
        digits, widths = self.alphabets.digits, self.alphabets.widths
        letters = digits[ids]
        letters[np.arange(len(ids)), widths[ids]] = after
        data = letters[letters > 0].tobytes()
        owner = np.concatenate([self.a_owner, self.b_owner])
        sizes = np.bincount(owner, np.concatenate([widths[self.a], widths[self.b]]) + 1, minlength=len(self.a_counts)).astype(np.int64)
        last = np.cumsum(sizes)
        return [data[e - n:e - 1] if n else b"" for e, n in zip(last.tolist(), sizes.tolist())]

    def pairs(self, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, times, texts' limits): distinct linked id pairs a * base + b of each text and how many links hold them."""
        i, j, _ = self.links
        owner, keys = self.a_owner[i], self.a[i] * base + self.b[j]
        turn = np.lexsort((keys, owner))
        owner, keys = owner[turn], keys[turn]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        limits = np.concatenate([[0], np.cumsum(self.by_text(owner[heads]))])
        return keys[heads], np.diff(np.append(heads, len(keys))), limits


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about ``CHUNK_BYTES``; null is empty."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield held


def _sent(docs: DataFrame, a: str, b: str):
    """Both tokenizer files for the tasks."""
    with open(a, "rb") as f, open(b, "rb") as g:
        return docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, links, groups): links (a, b, bytes) by token numbers, groups (a_to, b_to) by the tokens before their ends."""
    files = _sent(docs, a, b)
    link, group = (pa.list_(pa.struct([(n, pa.int32()) for n in names])) for names in (("a", "b", "bytes"), ("a_to", "b_to")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabets = Alphabets(*files.value)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1).to_pylist()):
                for i, text in enumerate(texts):
                    one = Aligned(alphabets, [text])
                    n = np.arange(len(one.ends))
                    cuts = np.stack([np.searchsorted(one.a_group, n, "right"), np.searchsorted(one.b_group, n, "right")], 1)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(at + i, 1), *(pa.array([x.tolist()], pa.list_(pa.int32())) for x in (one.a, one.b)),
                        pa.array([[dict(zip(("a", "b", "bytes"), x)) for x in np.stack(one.links, 1).tolist()]], link),
                        pa.array([[dict(zip(("a_to", "b_to"), x)) for x in cuts.tolist()]], group)],
                        ["doc_id", "a_ids", "b_ids", "links", "groups"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        build, "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int,bytes:int>>, groups array<struct<a_to:int,b_to:int>>")


def digests(docs: DataFrame, a: str, b: str) -> tuple[DataFrame, int]:
    """One row per document: counts, digest of the groups, distinct id pairs (a * base + b) with their links; and the base."""
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    files = _sent(docs, a, b)
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_shared")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabets, row = Alphabets(*files.value), TaskContext.get().partitionId() << 36
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1).to_pylist()):
                one, n = Aligned(alphabets, texts), len(texts)
                keys, times, limits = one.pairs(base)
                offsets = pa.array(limits, pa.int32())
                numbers = (one.a_counts, one.b_counts, one.group_counts(), one.by_text(one.a_owner[one.links[0]]), one.shared_counts())
                shas = [hashlib.sha256(s).hexdigest() if s else "" for s in one.group_strings()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), batch.column(0).slice(at, n), *(pa.array(c, pa.int64()) for c in numbers),
                    pa.array(shas, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                    ["row", "doc_id", *counts, "groups_sha256", "pairs", "times"])
                at, row = at + n, row + n

    kind = "row long, doc_id long, " + "".join(f"{c} long, " for c in counts) + "groups_sha256 string, pairs array<long>, times array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, kind), base


def pair_counts(found: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): links that hold a pair over all documents, and whether none of its B id has more."""
    counts = stage(found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")))
    b = F.pmod(F.col("pair"), F.lit(base))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most the vocabulary of B
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int = SENT) -> DataFrame:
    """The pairs of the highest frequency classes (sixteenths of a power of two) that hold at most ``most`` together."""
    kind = F.floor(F.log2("n") * 16)
    room, lowest = most, None
    for r in counts.groupBy(kind.alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect():
        room -= r["n"]
        if room < 0:
            break
        lowest = r["class"]
    return counts.where(kind >= lowest if lowest is not None else F.lit(False))


def with_pair_counts(found: DataFrame, base: int, most: int = SENT) -> DataFrame:
    """Stored digests with n_best, the links whose pair is the most frequent of its B id, and count_sum, the counts of all links."""
    counts = stage(pair_counts(found, base))
    often = stage(frequent(counts, most))
    each = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    looked_up = each.join(F.broadcast(often), "pair", "left")
    rest = looked_up.where("n is null").drop("n", "best").join(counts, "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    parts = looked_up.where("n is not null").groupBy("row").agg(*sums).unionByName(rest.groupBy("row").agg(*sums))
    totals = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    own = [c for c in found.columns if c not in ("row", "pairs", "times")]
    return found.select("row", *own).join(totals, "row", "left").select(
        *own, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")))


@query("op13_alignment")
def op13(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found, base = digests(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return with_pair_counts(stage(found), base)
