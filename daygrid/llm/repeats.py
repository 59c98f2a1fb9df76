"""Removal of every byte inside a 200-byte string that also starts elsewhere.

1. Every 200-byte window has one content-defined anchor.  Windows that are equal
   have equal anchors at equal offsets, so only windows under one anchor hash are
   compared.  An anchor with the windows it owns is an *occurrence*: a context of
   269 bytes on average.
2. Anchors seen once are dropped by a count.  Occurrences whose whole context is
   seen twice are covered as a whole; what is left are the edges of repeats.
3. Edges of an anchor meet in one group.  Groups are indexed together in batches:
   a suffix array of their contexts gives the Burrows-Wheeler transform, which is
   kept as runs.  The longest match with the neighbour is computed only at the
   sampled run ends; along the text matching statistics then follow by
   streaming, as a match loses one byte with every step.  Windows whose
   statistic reaches 200 are marked.
4. Groups above ``MOST_INDEXED`` contexts are not indexed in one task: their windows
   are hashed and counted one by one, with map-side sums.

Lengths and offsets are bytes of UTF-8; matches never cross rows.

Defined results: null is an empty text; rows shorter than the string keep
everything; equal rows remove each other when long enough; an empty table gives
no rows; rows without a ``doc_id`` are handled like others; other columns are
ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daygrid.llm.anchors import anchors, span_hash
from daygrid.llm.catalog import query, table
from daygrid.llm.cells import cell, listed_cells
from daygrid.llm.shingles import running_hash, text_chunks
from daygrid.stage import stage

SPAN = 200
MOST_INDEXED = 4096  # contexts of one group that a task may index
BATCH_BYTES = 1 << 20  # contexts indexed together


def with_row_key(docs: DataFrame) -> DataFrame:
    """(id, mark, text): ``mark`` tells rows with one id and different texts apart; a null id is the smallest number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.hash(text).alias("mark"), text.alias("text"))


def occurrences(rows: DataFrame, span: int) -> DataFrame:
    """(id, mark, first, last, place, h, c) of every anchor of every row; ``c`` is the hash of its whole context."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(2)):
                places, first, last, hashes, sums = anchors(data, offsets, span)
                owner = np.searchsorted(offsets, places, "right") - 1
                with np.errstate(over="ignore"):
                    whole = span_hash(sums, first, last + span) ^ (places - first).astype(np.uint64)
                base = offsets[owner]
                take = pa.array(at + owner)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take),
                    *(pa.array((x - base).astype(np.int32)) for x in (first, last, places)),
                    pa.array(hashes.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["id", "mark", "first", "last", "place", "h", "c"])

    return rows.mapInArrow(build, "id long, mark int, first int, last int, place int, h long, c long")


def contexts(rows: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(h, id, mark, first, shift, context): the bytes of the wanted occurrences; ``shift`` is the anchor's place in them."""
    per_row = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("first", "last", "place", "h")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                out: list[tuple] = []
                for id_, mark, text, spans in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in range(4))):
                    data = text.encode()
                    out.extend((s["h"], id_, mark, s["first"], s["place"] - s["first"], data[s["first"]:s["last"] + span])
                               for s in spans)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["h", "id", "mark", "first", "shift", "context"])

    found = rows.join(listed_cells(wanted, "id", "mark"), cell("id", "mark") == F.col("cell"), "left_semi").join(per_row, ["id", "mark"])
    return found.select("id", "mark", "text", "spans").mapInArrow(
        cut, "h long, id long, mark int, first int, shift int, context binary")


# --- the run-length index of a batch of groups -------------------------------------------------


def suffix_order(data: np.ndarray, which: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """All positions sorted by group, then by the bytes up to their context's end; shorter first, then by context.

    Prefix doubling; only positions that still tie are sorted again.
    """
    n, places = len(data), np.arange(len(data))
    contexts_count = int(which[-1]) + 1 if n else 0
    key = group.astype(np.int64)
    for j in range(3):  # three symbols of nine bits; 0 stands for the end
        key <<= 9
        inside = places + j < ends
        key[inside] |= data[places[inside] + j].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.diff(key[order], prepend=-1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    step, tied = 3, _tied(rank, order)
    while len(tied):
        onward = tied + step
        inside = onward < ends[tied]
        second = which[tied]  # both ended: the order of contexts
        second[inside] = rank[onward[inside]] + contexts_count
        key = rank[tied] * np.int64(n + contexts_count) + second
        inner = np.argsort(key, kind="stable")
        moved, key = tied[inner], key[inner]
        old = rank[moved]
        begin = np.flatnonzero(np.diff(old, prepend=-1))
        slot = old + np.arange(len(moved)) - np.repeat(begin, np.diff(np.append(begin, len(moved))))
        order[slot] = moved
        new = np.flatnonzero(np.diff(key, prepend=-1))
        rank[moved] = np.repeat(slot[new], np.diff(np.append(new, len(moved))))
        step *= 2
        tied = _tied(rank, moved)
    return order


def _tied(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of positions in sorted order, those that share their rank with a neighbour."""
    r = rank[among]
    same = np.zeros(len(r), bool)
    if len(r) > 1:
        equal = r[1:] == r[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    return among[same]


def common_lengths(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes at a and b, at most ``most``, by binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        middle = (low + high + 1) >> 1
        if not len(a) or not (low < high).any():
            return low
        equal = span_hash(sums, a, a + middle) == span_hash(sums, b, b + middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)


def marked_windows(texts: list[bytes], groups: np.ndarray, span: int) -> list[np.ndarray]:
    """For each context, the window starts that another context of its group also has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    stops = np.cumsum(sizes)
    which = np.repeat(np.arange(len(texts)), sizes)
    ends = stops[which]
    order = suffix_order(data, which, ends, groups[which])
    order = order[order + span <= ends[order]]  # the suffixes that begin a window
    before = np.where(np.diff(which, prepend=-1) != 0, -1 - which, np.roll(data, 1).astype(np.int64))
    bwt = before[order]
    one, two = order[:-1], order[1:]
    run_end = (bwt[:-1] != bwt[1:]) & (groups[which[one]] == groups[which[two]])
    one, two = one[run_end], two[run_end]  # sampled: the last of a run and the first of the next
    sums = running_hash(data)
    match = common_lengths(sums, one, two, np.minimum(ends[one] - one, ends[two] - two))
    reach = np.zeros(len(data), np.int64)
    np.maximum.at(reach, one, one + match)
    np.maximum.at(reach, two, two + match)
    reach = np.maximum.accumulate(reach)  # a match ends inside its context, so none runs into the next
    places = np.arange(len(data))
    marked = (reach - places >= span) & (places + span <= ends)
    begins = stops - sizes
    hits = np.flatnonzero(marked)
    cuts = np.searchsorted(hits, np.append(begins, len(data)))
    return [hits[a:b] - begins[i] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def as_spans(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Window starts as runs [first, end) of covered bytes."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts, prepend=starts[0] - 2) > 1)
    return [(int(starts[a]), int(starts[b - 1]) + span) for a, b in zip(cut, np.append(cut[1:], len(starts)))]


def indexed_spans(small: DataFrame, span: int) -> DataFrame:
    """(id, mark, low, high): repeated bytes of contexts, one index per batch of whole groups."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BATCH_BYTES and row[0] != last:
                    yield solve(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[5])
                last = row[0]
        if waiting:
            yield solve(waiting)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[0] for r in rows])
        groups = np.cumsum(np.diff(keys, prepend=keys[0]) != 0)
        out = []
        for row, starts in zip(rows, marked_windows([r[5] for r in rows], groups, span)):
            out.extend((row[1], row[2], row[3] + low, row[3] + high) for low, high in as_spans(starts, span))
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "mark", "low", "high"])

    grouped = small.repartition("h").sortWithinPartitions("h")
    return grouped.select("h", "id", "mark", "first", "shift", "context").mapInArrow(
        build, "id long, mark int, low long, high long")


def counted_spans(large: DataFrame, span: int) -> DataFrame:
    """The same for groups of any size: every window's hash is counted."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(5)):
                sums = running_hash(data)
                counts = np.maximum(np.diff(offsets) - span + 1, 0)
                owner = np.repeat(np.arange(len(counts)), counts)
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = offsets[owner] + inner
                take = pa.array(at + owner)
                shift = np.asarray(batch.column(4).take(take))
                first = np.asarray(batch.column(3).take(take))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                    pa.array((first + inner).astype(np.int64)), pa.array((shift - inner).astype(np.int32)),
                    pa.array(span_hash(sums, start, start + span).view(np.int64))], ["h", "id", "mark", "low", "turn", "w"])

    windows = large.select("h", "id", "mark", "first", "shift", "context").mapInArrow(
        build, "h long, id long, mark int, low long, turn int, w long")
    twice = windows.groupBy("h", "turn", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(twice, ["h", "turn", "w"]).select("id", "mark", "low", (F.col("low") + span).alias("high"))


def repeated_spans(rows: DataFrame, span: int = SPAN, most_indexed: int = MOST_INDEXED) -> DataFrame:
    """(id, mark, low, high): byte spans of ``rows`` (id, mark, text) whose union is what repeats."""
    seen = occurrences(rows, span)
    often = seen.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).where("n > 1")
    # Stored first: joined straight to its own sums, a hot anchor could not be split over tasks.
    often = stage(often.select("h", (F.col("least") == F.col("most")).alias("alike")))
    found = stage(seen.join(often, "h"))
    mixed = found.where("not alike")
    same = stage(mixed.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "first", "last", "place")).alias("one")))
    twice = same.where("n > 1")
    covered = found.where("alike").select("id", "mark", "first", "last").unionByName(
        mixed.join(twice.select("h", "c"), ["h", "c"]).select("id", "mark", "first", "last"))
    # One occurrence of every different context is compared; those seen twice need no answer.
    groups = same.groupBy("h").agg(F.count("*").alias("kinds"))
    wanted = same.select("h", "one.*").join(groups, "h")
    cut = stage(contexts(rows, wanted.select("h", "id", "mark", "first", "last", "place"), span).join(
        groups.where(F.col("kinds") > most_indexed).select("h", F.lit(True).alias("large")), "h", "left"))
    edges = indexed_spans(cut.where("large is null"), span).unionByName(counted_spans(cut.where("large"), span))
    whole = covered.select("id", "mark", F.col("first").cast("long").alias("low"), (F.col("last") + span).cast("long").alias("high"))
    return whole.unionByName(edges)


def remove_repeats(docs: DataFrame, span: int = SPAN, most_indexed: int = MOST_INDEXED) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): per row the removed runs and the bytes that remain."""
    rows = with_row_key(docs)
    spans = stage(repeated_spans(rows, span, most_indexed).groupBy("id", "mark").agg(
        F.collect_set(F.struct("low", "high")).alias("spans")))  # a row's own spans

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                sizes, removed, kept = [], [], []
                for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data, runs, pieces, at = text.encode(), [], [], 0
                    for low, high in sorted((s["low"], s["high"]) for s in own):
                        if runs and low <= runs[-1]["high"]:
                            runs[-1]["high"] = max(runs[-1]["high"], high)
                        else:
                            runs.append({"low": low, "high": high})
                    for r in runs:
                        pieces.append(data[at:r["low"]])
                        at = r["high"]
                    sizes.append(len(data))
                    removed.append(runs)
                    kept.append(b"".join([*pieces, data[at:]]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
                    pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    kind = "id long, n_bytes long, removed array<struct<low:bigint,high:bigint>>, kept binary"
    marked = rows.join(listed_cells(spans, "id", "mark"), cell("id", "mark") == F.col("cell"), "left")
    touched = marked.where("cell is not null").drop("cell").join(spans, ["id", "mark"], "left")
    clean = marked.where("cell is null").unionByName(
        touched.where("spans is null").drop("spans").withColumn("cell", F.lit(None).cast("long")))
    empty = F.expr("cast(array() as array<struct<low:bigint,high:bigint>>)")
    out = touched.where("spans is not null").select("id", "text", "spans").mapInArrow(strip, kind).unionByName(
        clean.select("id", F.octet_length("text").cast("long").alias("n_bytes"), empty.alias("removed"),
                     F.col("text").cast("binary").alias("kept")))
    return out.withColumn("doc_id", F.when(F.col("id") != -(1 << 63), F.col("id"))).drop("id")


@query("op8_repeats")
def op8(spark, sf_dir) -> DataFrame:
    """Digest of what remains of every document."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["high"] - r["low"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
