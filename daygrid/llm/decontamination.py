"""Benchmark items hidden inside documents, by size-partitioned MinHash containment.

An item with ``n`` shingles counts as contained when a document has at least
80 % of them.  Whatever fifth is missing, one of the item's
``n - ceil(0.8 n) + 1`` smallest shingle hashes must be in the document, so that
many are its sketch.  Items are partitioned by size; all sketches of a partition
have the length its largest item needs, and a document is looked up only in the
partitions whose items could fit into it.  No contained item escapes, however
long the document is.  Candidates are verified by exact shingle containment.

The sketches travel to the tasks only while the counted shingles of all items
stay below ``MOST_SENT``; beyond it the lookup is a shuffled join on (size
partition, value of a sketch), and only the pairs it finds are verified.

An item with fewer words than a shingle is contained where its words follow one
another anywhere in a document: it has one shingle, the whole sequence, which is
looked up among the sequences of as many words.  Only lengths that items have are formed.

Defined results: an item without words is in no document; null texts are empty; repeated items or documents give the same pairs once; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daygrid.llm.catalog import query, table
from daygrid.llm.cells import cell, listed_cells
from daygrid.llm.near_duplicates import sets_sql, words_sql
from daygrid.llm.shingles import long_lists, shingle_sets, text_pieces, word_sequences
from daygrid.stage import stage

WIDTH = 5
CONTAINED = (4, 5)  # a leak needs 5 * shared >= 4 * shingles of the item
MOST_SENT = 4_000_000  # shingles of all items that may travel to every task: 32 MB


def _needed(n: int, share=CONTAINED) -> int:
    return -(-share[0] * n // share[1])


def _long_sets(df: DataFrame, key: str, width: int) -> DataFrame:
    """(key, n, hashes) of every row with a word."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, 1):
            sets = list(shingle_sets(batch.column(1), width))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), long_lists(sets)], ["key", "n", "hashes"])
            yield out.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return df.select(F.col(key).cast("long"), "text").mapInArrow(build, "key long, n long, hashes array<long>")


class Partitions:
    """Sketches of items, partitioned by the number of shingles (powers of two)."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], share=CONTAINED):
        self.ids, self.sets, self.share = ids, sets, share
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            groups.setdefault(len(s).bit_length(), []).append(i)
        self.parts = []
        for members in groups.values():
            most = max(len(sets[i]) - _needed(len(sets[i]), share) + 1 for i in members)
            values = np.concatenate([sets[i][:most] for i in members])
            owners = np.repeat(np.array(members), [len(sets[i][:most]) for i in members])
            order = np.argsort(values, kind="stable")
            least = min(_needed(len(sets[i]), share) for i in members)
            self.parts.append((least, values[order], owners[order]))

    def inside(self, have: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles, shared shingles) of the items contained in a document's sorted set."""
        for least, values, owners in self.parts:
            if len(have) < least:
                continue
            if len(values) < len(have):
                at = np.minimum(np.searchsorted(have, values), len(have) - 1)
                hit = owners[have[at] == values]
            else:
                low, high = np.searchsorted(values, have, "left"), np.searchsorted(values, have, "right")
                found = np.flatnonzero(high > low)
                hit = np.concatenate([owners[low[i]:high[i]] for i in found]) if len(found) else owners[:0]
            for i in np.unique(hit):
                item = self.sets[i]
                at = np.minimum(np.searchsorted(have, item), len(have) - 1)
                shared = int(np.count_nonzero(have[at] == item))
                if self.share[1] * shared >= self.share[0] * len(item):
                    yield self.ids[i], len(item), shared


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, share=CONTAINED,
                    most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of every item that is inside a document."""
    known = stage(_long_sets(items, "item_id", width).distinct())
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= most_sent:
        pairs = _sent(docs, known, width, share)
    else:
        pairs = _joined(docs, known, width, share)
    short = stage(_short_items(items, width).distinct())
    lengths = sorted(r["m"] for r in short.select("m").distinct().collect())  # fewer than ``width`` numbers
    if lengths:
        pairs = pairs.unionByName(_short_pairs(docs, short, lengths, most_sent))
    return pairs.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_shared", "n_item")).alias("best")).select(
        "doc_id", "item_id", F.col("best.n_item").alias("n_item"), F.col("best.n_shared").alias("n_shared"))


def _short_items(items: DataFrame, width: int) -> DataFrame:
    """(key, m, h) of every item with m words, fewer than a shingle; ``h`` is the hash of its whole sequence."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, found in zip(batch.column(0).to_pylist(), word_sequences(batch.column(1), list(range(1, width + 1)))):
                m = sum(len(s) > 0 for s in found)  # a text has sequences of every length up to its own
                if 0 < m < width:
                    out.append((key, m, found[m - 1].view(np.int64)[0].item()))
            keys, sizes, hashes = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], ["key", "m", "h"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(build, "key long, m int, h long")


def _sequences(docs: DataFrame, lengths: list[int], wanted=None) -> DataFrame:
    """(doc_id, m, h): the distinct sequences of m words of every document; with ``wanted``, a broadcast of sorted hashes
    by length, only those listed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for i, found in enumerate(word_sequences(batch.column(1), lengths)):
                for m, s in zip(lengths, found):
                    s = s if wanted is None else s[_listed(s, wanted.value[m])]
                    rows.append(np.full(len(s), i))
                    sizes.append(np.full(len(s), m, np.int32))
                    hashes.append(s)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sizes)),
                pa.array(np.concatenate(hashes).view(np.int64))], ["doc_id", "m", "h"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "doc_id long, m int, h long")


def _listed(s: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``s`` are in the sorted, non-empty ``among``."""
    return among[np.minimum(np.searchsorted(among, s), len(among) - 1)] == s


def _short_pairs(docs: DataFrame, short: DataFrame, lengths: list[int], most_sent: int) -> DataFrame:
    """Items of fewer words than a shingle, wherever their words follow one another."""
    kinds = stage(short.select("m", "h").distinct())
    wanted = None
    if kinds.count() <= most_sent:
        sent = kinds.toArrow()  # at most MOST_SENT numbers
        sizes, hashes = sent["m"].to_numpy(), sent["h"].to_numpy().view(np.uint64)
        wanted = docs.sparkSession.sparkContext.broadcast({m: np.sort(hashes[sizes == m]) for m in lengths})
    found = _sequences(docs, lengths, wanted)
    one = F.lit(1).cast("long")
    return found.join(short.withColumnRenamed("key", "item_id"), ["m", "h"]).select(
        "doc_id", "item_id", one.alias("n_item"), one.alias("n_shared"))


def _sent(docs: DataFrame, known: DataFrame, width: int, share) -> DataFrame:
    rows = known.toArrow()  # at most MOST_SENT hashes, counted above
    flat = np.concatenate([*[c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in rows["hashes"].chunks], np.zeros(0, np.uint64)])
    ends = np.cumsum(rows["n"].to_numpy())
    lookup = docs.sparkSession.sparkContext.broadcast(
        [(k, flat[b - n:b]) for k, n, b in zip(rows["key"].to_pylist(), rows["n"].to_pylist(), ends.tolist())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Partitions([k for k, _ in lookup.value], [np.sort(s) for _, s in lookup.value], share)
        for batch in batches:
            found = [(doc, *hit) for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width))
                     if len(s) for hit in parts.inside(s)]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns],
                                             ["doc_id", "item_id", "n_item", "n_shared"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        search, "doc_id long, item_id long, n_item long, n_shared long")


def _joined(docs: DataFrame, known: DataFrame, width: int, share) -> DataFrame:
    """Any number of items: document shingles meet sketch values of the size partitions that could fit, and only the pairs found are verified."""
    numbered = stage(known.withColumn("text_key", F.xxhash64(F.array_sort("hashes"))))
    bodies = numbered.dropDuplicates(["text_key"]).select("text_key", "n", "hashes")
    most = F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1
    unsigned = F.transform("hashes", lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))  # the order of unsigned hashes
    sketches = bodies.select("text_key", F.col("n").alias("n_item"), F.explode(
        F.slice(F.array_sort(unsigned), F.lit(1), most.cast("int"))).alias("u"))
    size_class = lambda n: F.length(F.bin(n))  # powers of two
    sketches = stage(sketches.select("text_key", "n_item", size_class(F.col("n_item")).alias("size_class"),
                                     F.col("u").bitwiseXOR(F.lit(-(1 << 63))).alias("h")))
    sets = stage(_long_sets(docs, "doc_id", width))
    least = bodies.groupBy(size_class(F.col("n")).alias("c")).agg(F.min("n").alias("n")).collect()  # at most 64 rows
    classes = F.array(*[F.struct(F.lit(r["c"]).alias("c"), F.lit(_needed(r["n"], share)).alias("least")) for r in least])
    could_fit = F.transform(F.filter(classes, lambda x: x["least"] <= F.col("n")), lambda x: x["c"])
    in_class = sets.select(F.col("key").alias("doc_id"), F.col("n").alias("n_doc"), F.explode("hashes").alias("h"), could_fit.alias("cs"))
    long_docs = in_class.select("doc_id", "n_doc", "h", F.explode("cs").alias("size_class"))
    long_docs = long_docs.join(listed_cells(sketches, "size_class", "h"), cell("size_class", "h") == F.col("cell"), "left_semi")
    fits = F.col("n_doc") * share[1] >= F.col("n_item") * share[0]
    pairs = stage(long_docs.join(sketches, ["size_class", "h"]).where(fits).select("doc_id", "text_key").distinct())
    whole = pairs.join(bodies.select("text_key", F.col("n").alias("n_item"), F.col("hashes").alias("item")), "text_key")
    both = whole.join(sets.select("key", "hashes"), F.col("doc_id").eqNullSafe(F.col("key")))
    found = (both.select("doc_id", "text_key", "n_item", F.size(F.array_intersect("hashes", "item")).cast("long").alias("n_shared"))
             .where(F.col("n_shared") * share[1] >= F.col("n_item") * share[0]))
    return found.join(numbered.select("text_key", F.col("key").alias("item_id")), "text_key").select(
        "doc_id", "item_id", "n_item", "n_shared")


OP4 = f"""
WITH d AS ({sets_sql('documents', 'doc_id', WIDTH)}), i AS ({sets_sql('benchmark', 'item_id', WIDTH)}),
sizes AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1),
short AS (SELECT DISTINCT item_id, len(w) AS m, array_to_string(w, ' ') AS g FROM ({words_sql('benchmark', 'item_id')}) WHERE len(w) BETWEEN 1 AND {WIDTH - 1}),
parts AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
          FROM ({words_sql('documents', 'doc_id')}) JOIN (SELECT DISTINCT m FROM short) ON len(w) >= m)
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared
FROM d JOIN i USING (g) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(n_item)
UNION SELECT doc_id, item_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM parts JOIN short USING (m, g)"""


@query("op4_decontaminate", OP4)
def op4(spark, sf_dir) -> DataFrame:
    """Every benchmark item found in any document."""
    return contained_items(table(spark, sf_dir, "documents", "doc_id", "text"),
                           table(spark, sf_dir, "benchmark", "item_id", "text"))
