"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Every document's set of word shingles (64-bit hashes) gives a set fingerprint
   and its ``k`` smallest hashes, the sketch.  Equal sets become one class.
2. Inverted lists hold, for each retained value, the classes that retain it.
   Two sets with similarity >= 0.8 share at least half of the ``k`` smallest
   hashes of their union, but for a chance below 1e-6.  So a class is listed only
   under its rarest values: if half of a sketch must be shared, one of the
   rarest ``s - ceil(s/2) + 1`` must be.  Values with one class cost nothing and
   passages that many documents share are listed only by texts made of them.
   Lists are also cut by set size, as similar sets differ by less than 1.25.
3. Each list compares its members with its hub, the class with the most shared
   values: linear in the list, and a group of copies becomes one component.
4. Classes whose lists still hold several components are listed again, exactly:
   by the rarest values of their whole sets, as many as the two sizes of a pair
   demand.  Pairs across components of such a list are the only ones formed.
5. A pair's similarity is first estimated on the union of both sketches and then
   verified on the full sets.  Linked classes are joined to components.

Defined results: null and empty texts have no shingles and are linked with
nothing; texts with fewer words than a shingle are equal or not linked; equal
rows are one class; a class without a ``doc_id`` is not compared and its
component is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daygrid.llm.catalog import query, table
from daygrid.llm.cells import only_listed
from daygrid.llm.components import components
from daygrid.llm.shingles import long_lists, mix, shingle_sets, text_pieces
from daygrid.stage import stage

SKETCH = 48  # retained values of a set
SIMILAR = (80, 100)  # a link needs 100 * intersection >= 80 * union
SIZE_STEP = 1.26  # a little over 1.25: similar sets are at most one size class apart


def set_facts(docs: DataFrame, width: int, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, sketch) of every row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, 1):
            sizes, one, two, sketches = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column(1), width):
                    sizes.append(len(s))
                    one.append(s.sum(dtype=np.uint64))
                    two.append(mix(s).sum(dtype=np.uint64))
                    sketches.append(s[:k].copy())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)),
                pa.array(np.array(two, np.uint64).view(np.int64)), long_lists(sketches)],
                ["doc_id", "n_shingles", "fp1", "fp2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        build, "doc_id long, n_shingles long, fp1 long, fp2 long, sketch array<long>")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, hashes): the whole sorted set of every row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), long_lists(list(shingle_sets(batch.column(1), width)))],
                                             ["id", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "id long, hashes array<long>")


def inverted_lists(classes: DataFrame, k: int = SKETCH) -> DataFrame:
    """(v, size_class, id, n, shared): the classes under each of their rarest shared values."""
    retained = classes.where("id is not null and n_shingles > 1").select(
        "id", F.col("n_shingles").alias("n"), F.explode("sketch").alias("v"))
    often = stage(retained.groupBy("v").agg(F.count("*").alias("often")).where("often > 1"))  # so that a hot value can be split
    per_class = retained.join(often, "v").groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("often", "v"))).alias("vs"))  # at most k entries
    size = F.least("n", F.lit(k))
    rarest = size - F.ceil(size / 2) + 1 - (size - F.size("vs"))  # without the values of one class only
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(SIZE_STEP)))).cast("int")
    return (per_class.where(rarest > 0)
            .select("id", "n", F.size("vs").alias("shared"), F.explode(F.slice("vs", F.lit(1), rarest.cast("int"))).alias("e"))
            .select(F.col("e.v").alias("v"), F.explode(F.array(step, step + 1)).alias("size_class"), "id", "n", "shared"))


def _sizes_fit(a, b, similar):
    return F.least(a, b) * similar[1] >= F.greatest(a, b) * similar[0]


def hub_pairs(lists: DataFrame, similar=SIMILAR) -> DataFrame:
    """(a, b) of every member and its list's hub, unless both are in one component already."""
    rank = F.struct("shared", "n", (-F.col("id")).alias("minus_id"), F.col("component").alias("component"))
    hubs = lists.groupBy("v", "size_class").agg(F.max(rank).alias("hub"), F.min("component").alias("low"),
                                                F.max("component").alias("high"))
    hubs = stage(hubs.where("low <> high").select(
        "v", "size_class", (-F.col("hub.minus_id")).alias("b"), F.col("hub.n").alias("bn"), F.col("hub.component").alias("bc")))
    return (lists.join(hubs, ["v", "size_class"])
            .where((F.col("component") != F.col("bc")) & _sizes_fit(F.col("n"), F.col("bn"), similar))
            .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())


def open_members(lists: DataFrame) -> DataFrame:
    """Ids in lists whose members are still in different components."""
    mixed = lists.groupBy("v", "size_class").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return lists.join(stage(mixed.where("low <> high").select("v", "size_class")), ["v", "size_class"]).select("id").distinct()


def exact_lists(sets: DataFrame, similar=SIMILAR) -> DataFrame:
    """Inverted lists over whole sets: (v, size_class, id, n, place), ``place`` being the value's rank by rarity.

    A pair of sizes x and y must share ``o = 0.8 / 1.8 * (x + y)`` values, so one
    of them is among the rarest ``x - o + 1`` of one and ``y - o + 1`` of the other.
    """
    values = sets.select("id", F.size("hashes").alias("n"), F.explode("hashes").alias("v"))
    often = stage(values.groupBy("v").agg(F.count("*").alias("often")).where("often > 1"))
    per_set = values.join(often, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("vs"))
    alone = F.col("n") - F.size("vs")
    longest = F.col("n") - F.ceil(F.col("n") * similar[0] / similar[1]) + 1  # beside any other size
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(SIZE_STEP)))).cast("int")
    return (per_set.where(longest > alone)
            .select("id", "n", alone.alias("alone"), F.posexplode(F.slice("vs", F.lit(1), (longest - alone).cast("int"))).alias("at", "e"))
            .select(F.col("e.v").alias("v"), F.explode(F.array(step, step + 1)).alias("size_class"), "id", "n",
                    (F.col("alone") + F.col("at") + 1).alias("place")))


def remaining_pairs(lists: DataFrame, similar=SIMILAR) -> DataFrame:
    """Pairs of members in different components whose common value is rare enough in both.

    Only the members outside a list's commonest component look for partners.
    """
    sizes = lists.groupBy("v", "size_class", "component").agg(F.count("*").alias("members"))
    main = sizes.groupBy("v", "size_class").agg(F.max(F.struct("members", "component")).alias("main"), F.count("*").alias("groups"))
    main = stage(main.where("groups > 1").select("v", "size_class", F.col("main.component").alias("main")))
    members = stage(lists.join(main, ["v", "size_class"]))
    left = members.where("component <> main").drop("main")
    right = members.select("v", "size_class", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("component").alias("bc"),
                           F.col("place").alias("b_place"))
    shared = F.ceil((F.col("n") + F.col("bn")) * similar[0] / (similar[0] + similar[1]))
    pairs = left.join(right, ["v", "size_class"]).where(
        (F.col("component") != F.col("bc")) & _sizes_fit(F.col("n"), F.col("bn"), similar)
        & (F.col("place") <= F.col("n") - shared + 1) & (F.col("b_place") <= F.col("bn") - shared + 1))
    return pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def _hash_lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return (flat[a:b] for a, b in zip([0, *ends], ends))


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, similar=SIMILAR, k: int = SKETCH) -> DataFrame:
    """The pairs that the union sketch lets through and the full sets confirm."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_hash_lists(batch.column(2)), _hash_lists(batch.column(3))):
                union = np.union1d(x, y)[:k]
                keep.append(2 * _common(_upto(x, union), _upto(y, union)) >= len(union))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_hash_lists(batch.column(2)), _hash_lists(batch.column(3))):
                both = _common(x, y)
                keep.append(similar[1] * both >= similar[0] * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def with_both(left: DataFrame, facts: DataFrame, value: str) -> DataFrame:
        first = only_listed(facts, "id", left, "a").select(F.col("id").alias("a"), F.col(value).alias("x"))
        second = only_listed(facts, "id", left, "b").select(F.col("id").alias("b"), F.col(value).alias("y"))
        return left.join(first, "a").join(second, "b").select("a", "b", "x", "y")

    through = with_both(pairs, sketches, "sketch").mapInArrow(likely, "a long, b long")
    return with_both(stage(through), sets, "hashes").mapInArrow(exact, "a long, b long")


def _upto(x: np.ndarray, union: np.ndarray) -> np.ndarray:
    """The part of a sorted sketch within the union's retained values."""
    return x[:np.searchsorted(x, union[-1], "right")] if len(union) else x


def near_duplicates(docs: DataFrame, width: int = 5, similar=SIMILAR, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    facts = stage(set_facts(docs, width, k))
    smallest = F.min(F.struct("doc_id", "sketch"))  # a group of copies combines before the shuffle
    classes = stage(facts.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles")
                    .agg(smallest.alias("s"), F.count("*").alias("rows"))
                    .select("fp1", "fp2", "n_shingles", "rows", F.col("s.doc_id").alias("id"), F.col("s.sketch").alias("sketch")))
    lists = stage(inverted_lists(classes, k))
    listed = stage(lists.select(F.col("id").alias("doc_id")).distinct())
    sets = stage(whole_sets(only_listed(docs.select("doc_id", "text"), "doc_id", listed, "doc_id").join(
        listed, "doc_id", "left_semi"), width))

    def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
        labelled = rows.join(groups.withColumnRenamed("node", "id"), "id", "left")
        return labelled.withColumn("component", F.coalesce("component", "id"))

    found, links = lists.withColumn("component", F.col("id")), None
    for _ in range(2):
        more = stage(verified(stage(hub_pairs(found, similar)), classes, sets, similar, k))
        links = more if links is None else links.union(more)
        groups = stage(components(links))
        found = grouped(lists, groups)
    still = stage(open_members(found))
    exact = stage(exact_lists(sets.join(still, "id", "left_semi"), similar))
    rest = stage(remaining_pairs(grouped(exact, groups), similar))
    groups = stage(components(links.union(stage(verified(rest, classes, sets, similar, k)))))

    heads = (classes.select("fp1", "fp2", "n_shingles", "rows", "id")
             .join(groups.withColumnRenamed("node", "id"), "id", "left")
             .where("rows > 1 or component is not null")
             .select("fp1", "fp2", "n_shingles", F.coalesce("component", "id").alias("component_id")))
    return (facts.select("doc_id", "n_shingles", "fp1", "fp2").join(heads, ["fp1", "fp2", "n_shingles"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_sql(source: str, key: str) -> str:
    """(key, w): the words of a table's texts."""
    return f"""SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS w FROM {source}"""


def sets_sql(source: str, key: str, width: int) -> str:
    """(key, n_words, g): the distinct shingles of a table, as text."""
    return f"""SELECT DISTINCT {key}, unnest(CASE
    WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM ({words_sql(source, key)})"""


def components_sql(width: int, source: str = "documents") -> str:
    """CTEs ``sets``, ``sizes`` and ``found`` (doc_id, component_id) over all pairs with a common shingle."""
    return f"""sets AS ({sets_sql(source, 'doc_id', width)}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM pairs JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM {source} UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)"""


OP5 = f"""
WITH RECURSIVE {components_sql(4)}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN found USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


@query("op5_near_duplicates", OP5)
def op5(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=4)
