"""Source divergence audit: which sources of a language differ, and by which terms.

Counting sorts pointers to the starts of terms, not the terms: a shard is some MB
of Arrow text whose rows stand in order of their group, and a multikey quicksort
over characters of eight bytes sorts its pointers, slice by slice.  Equal terms are
then runs of neighbours, and a run read from left to right gives the occurrences
of every group and the documents that hold the term.  Only one row per term, group
and shard leaves a task.

A language's kept terms are dealt to chunks of at most ``CELLS`` cells (terms times
sources), a dense block each; exact integer shares and ratios are computed there, and a
chunk sends one sum per pair of sources and its first ``TOP`` terms per source.

Defined results: a null text, language or source is ''; a text without terms counts
as a document of its group; repeated rows are documents of their own; a group without
terms has the shares of zero counts; a language that keeps no term has pairs of value
0 and no terms; an empty table gives no rows; other columns are ignored.  A language's
sources are one row, as every pair of them is in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrid.llm.catalog import query, table
from daygrid.llm.shingles import text_chunks
from daygrid.stage import stage

LEAST_DOCUMENTS = 3  # documents of a language that hold a kept term
SCALE = 1_000_000_000  # shares are whole numbers of this many parts
TOP = 200  # terms reported per group
SHARD_BYTES = 8 << 20  # text sorted at once
CELLS = 1 << 18  # terms times sources of a chunk

_INSIDE = np.ones(256, bool)
for _first, _last in ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _INSIDE[_first:_last + 1] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def term_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all terms of a shard; a row's end ends a term."""
    inside = _INSIDE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1 - starts


def sort_pointers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): pointers in order of their terms' bytes, and where a run of equal terms begins.

    Terms hold no zero byte, so zeros stand for the end.  Pointers of equal terms keep their order.
    """
    eight = np.ndarray((len(data),), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    order, first = np.arange(len(starts)), np.zeros(len(starts), bool)
    places, slices, depth = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
    while len(places):
        which = order[places]
        rest = np.clip(lengths[which] - depth, 0, 8)
        keys = eight[np.minimum(starts[which] + depth, len(data) - 1)].astype(np.uint64)
        unused = (np.uint64(8) - np.maximum(rest, 1).astype(np.uint64)) * np.uint64(8)
        keys = np.where(rest > 0, keys >> unused << unused, np.uint64(0))
        turn = np.lexsort((keys, slices)) if depth else np.argsort(keys, kind="stable")
        which, keys = which[turn], keys[turn]
        order[places] = which
        new = np.ones(len(places), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])
        first[places[new]] = True
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(places)))
        depth += 8
        unequal = (np.maximum.reduceat(lengths[which], heads) > depth) & (sizes > 1)
        go_on = np.repeat(unequal, sizes)
        places, slices = places[go_on], np.repeat(heads, sizes)[go_on]
    return order, first


def spelled(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """The bytes at the pointers as a string column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    letters = data[np.repeat(starts, lengths) + inner]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters.tobytes()))


def shard_counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows (lang, source, text) of a batch."""
    lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
    groups = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    turn = np.argsort(groups, kind="stable")
    batch, groups = batch.take(pa.array(turn)), groups[turn]
    for row, data, offsets in text_chunks(batch.column(2), SHARD_BYTES):
        starts, lengths = term_pointers(data, offsets)
        if not len(starts):
            continue
        low = _LOWERED[data]
        order, run = sort_pointers(low, starts, lengths)
        owner = row + np.searchsorted(offsets, starts[order], "right") - 1
        cell = run.copy()
        cell[1:] |= groups[owner[1:]] != groups[owner[:-1]]
        document = run.copy()
        document[1:] |= owner[1:] != owner[:-1]
        heads = np.flatnonzero(cell)
        found, rows = order[heads], pa.array(owner[heads])
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(rows), batch.column(1).take(rows), spelled(low, starts[found], lengths[found]),
            pa.array(np.diff(np.append(heads, len(order))), pa.int64()),
            pa.array(np.add.reduceat(document.astype(np.int64), heads), pa.int64())], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from shard_counts(batch)

    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = rows.mapInArrow(build, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, n, cells): terms in at least ``least`` documents of the language, with their count in each source."""
    return counts.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells")
    ).where(F.col("docs") >= least).select("lang", "term", "n", "cells")


def languages(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, v, total, members): kept terms of each language, their occurrences, and (source, total) by source."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    members = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")))).alias("members"))
    return members.join(sizes, "lang", "left").select(
        "lang", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "total")), "members")


def shares(counts: np.ndarray, totals: np.ndarray, v: int, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + v)), exact while totals are below 2^53: long division, three digits at a time."""
    over = totals + v
    whole, rest = np.divmod(counts + 1, over)
    while scale > 1:
        more, rest = np.divmod(rest * 1000, over)
        whole, scale = whole * 1000 + more, scale // 1000
    return 1 + whole


def ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def chunk_values(lang: str, v: int, total: int, members: pa.Array, terms: pa.Array, top: int) -> Iterator[tuple]:
    """(source, part, item, value) of one chunk: a sum for every two sources, and each source's first terms."""
    sources, totals = members.field(0).to_pylist(), members.field(1).to_numpy()
    number = {s: i for i, s in enumerate(sources)}
    names = terms.field(0).to_pylist()
    cells = terms.field(2)
    sizes, flat = np.diff(cells.offsets.to_numpy()), cells.flatten()
    counts = np.zeros((len(names), len(sources)), np.int64)
    found = flat.field(0).dictionary_encode()
    column = np.array([number[s] for s in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]
    counts[np.repeat(np.arange(len(names)), sizes), column] = flat.field(1).to_numpy()
    p = shares(counts, totals[None, :], v)
    q = shares(terms.field(1).to_numpy(), np.int64(total), v)
    for s, source in enumerate(sources):
        sums = ratio(p[:, s:s + 1], p).sum(0)
        for item, value in zip(sources, sums.tolist()):
            if item != source:
                yield source, "pair", item, value
        more = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
        values = ratio(p[more, s], q[more])
        for i in np.argsort(-values, kind="stable")[:top].tolist():  # the chunk's terms are in order
            yield source, "term", names[more[i]], int(values[i])


def _ranked(rows: DataFrame) -> DataFrame:
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(by_value))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by divergence, and the terms a source overuses.

    ``docs`` has text, lang and source; ``top`` limits the terms alone.
    """
    terms = stage(kept_terms(stage(term_counts(docs)), least))
    by_lang = stage(languages(docs, terms))
    slices: Column = F.ceil(F.col("v") * F.size("members") / cells)
    dealt = terms.join(by_lang.select("lang", slices.alias("slices")), "lang")
    chunks = dealt.groupBy("lang", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice")).agg(
        F.sort_array(F.collect_list(F.struct("term", "n", "cells"))).alias("terms"))
    kind = "lang string, source string, part string, item string, value long"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                lang, v, total = (one.column(c)[0].as_py() for c in range(3))
                rows = list(chunk_values(lang, v, total, one.column(3).flatten(), one.column(4).flatten(), top))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(rows), pa.string()), *(pa.array([r[c] for r in rows], pa.string()) for c in range(3)),
                    pa.array([r[3] for r in rows], pa.int64())], ["lang", "source", "part", "item", "value"])

    found = stage(chunks.join(by_lang, "lang").select("lang", "v", "total", "members", "terms").mapInArrow(build, kind))
    names = by_lang.select("lang", F.col("members.source").alias("names"))
    pairs = names.select("lang", "names", F.explode("names").alias("source")).select(
        "lang", "source", F.explode("names").alias("item")).where("item <> source")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    leading = _ranked(found.where("part = 'term'")).where(F.col("rank") <= top)
    return _ranked(pairs).unionByName(leading)


SQL = r"""
WITH words AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
shares AS (
  SELECT k.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + s.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v) AS q
  FROM kept k JOIN sizes s ON k.lang = s.lang JOIN totals t ON k.lang = t.lang
  LEFT JOIN counts c ON c.lang = k.lang AND c.source = t.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 200
"""


@query("op11_divergence", SQL)
def op11(spark, sf_dir) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))
