"""WARC archives written and read back by Spark, with boundary-chain verification.

Writing: one record per page, as text whose lines end in the two line ends that
close a WARC record.  Of equal payloads of at least 1000 bytes the page with the
largest id is a ``response`` and the others are ``revisit`` records without a
body that name it; short payloads are always responses.

Reading: the archives are split at every occurrence of the record magic, also
inside payloads.  Each piece is a candidate with a byte offset (sums of lengths
within a file block, carried over the blocks of the file) and, if its header can
be read, a successor offset.  Runs of candidates of a block that lead to each other are
one step; pointer jumping from each file's start over the runs then marks what
is reachable.  Candidates that no chain reaches are payload bytes: they are put
back into the record they belong to.

Defined results: null html is an empty payload; a null url has no header line,
line ends in a url are percent-encoded; pages equal in id and payload are all
responses or all revisits; a null page_id never refers and is only referred to
when all pages of the payload have none; an empty table writes no record; other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from daygrid.llm.catalog import query, table
from daygrid.llm.cells import cell, listed_cells
from daygrid.stage import checkpoint_root, stage

MAGIC = "WARC/1.1\r\n"
CLOSE = "\r\n\r\n"
LEAST_SHARED = 1000  # bytes of a payload that may be replaced by a revisit
PARTS = 32  # sub-groups of pages with one payload


def with_originals(pages: DataFrame) -> DataFrame:
    """Add payload, payload_bytes, payload_digest and ``refers_to`` (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload.cast("binary")).alias("payload_digest"))
    shared = stage(rows.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest", "payload_bytes")
                   .agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # Only payloads that occur twice have anything to look up: the others skip the shuffle, hot ones are dealt to sub-groups.
    marked = rows.join(listed_cells(shared, "payload_digest"), cell("payload_digest") == F.col("cell"), "left")
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")
    spread = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    looked_up = marked.where("cell is not null").drop("cell").withColumn("part", part).join(
        spread, ["payload_digest", "payload_bytes", "part"], "left")
    alone = marked.where("cell is null").withColumn("original", F.lit(None).cast("long"))
    found = looked_up.select(*rows.columns, "original").unionByName(alone.select(*rows.columns, "original"))
    return found.withColumn("refers_to", F.when(F.col("page_id") != F.col("original"), F.col("original"))).drop("original")


def _record_id(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))


def record_text(rows: DataFrame) -> Column:
    """A record without its magic's successor: header, empty line, body (none for a revisit)."""
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), F.lit(CLOSE))
    return F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives in the folder ``path``, one per task."""
    rows = with_originals(pages)
    rows.select(record_text(rows).alias("value")).write.option("lineSep", CLOSE).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, size, body): the bytes after each magic, in file order within (file, block)."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.octet_length("value").cast("long").alias("size"),
        F.col("value").alias("body"))


def _header(body: Column, name: str) -> Column:
    head = F.concat(F.lit("\r\n"), F.substring_index(body, CLOSE, 1), F.lit("\r\n"))
    return F.regexp_extract(head, f"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1)


def candidates(found: DataFrame) -> DataFrame:
    """Header facts of every piece; the digest is that of a body that lies in the piece as a whole."""
    whole_head = F.instr("body", CLOSE) > 0
    head_size = F.octet_length(F.substring_index("body", CLOSE, 1)).cast("long")
    length = F.expr("try_cast(_length AS BIGINT)")
    df = found.withColumn("_length", F.when(whole_head, _header(F.col("body"), "Content-Length")))
    df = df.withColumn("head_size", head_size).withColumn("length", F.when(length >= 0, length))
    span = F.col("head_size") + len(CLOSE) * 2 + F.col("length")  # after the magic
    payload = F.substring(F.col("body").cast("binary"), F.col("head_size").cast("int") + len(CLOSE) + 1, F.col("length").cast("int"))
    df = df.withColumn("span", span)
    return df.select(
        "file", "block", "row", "size", "head_size", "length", "span",
        _header(F.col("body"), "WARC-Type").alias("record_type"), _header(F.col("body"), "WARC-Record-ID").alias("record_id"),
        _header(F.col("body"), "WARC-Refers-To").alias("refers"), _header(F.col("body"), "WARC-Payload-Digest").alias("said_digest"),
        _header(F.col("body"), "WARC-Payload-Length").alias("said_bytes"),
        F.when(F.col("span") == F.col("size"), F.sha1(payload)).alias("digest"))


def with_offsets(facts: DataFrame) -> DataFrame:
    """Add ``start``: the offset of the piece's magic (of its bytes, for what stands before the first magic).

    A piece is followed by a magic, so starts are running sums; a block's sum is
    carried to the later blocks of its file, one small row per block.
    """
    step = F.col("size") + len(MAGIC)
    blocks = facts.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("carried"))
    inside = F.sum(step).over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return facts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(carried, ["file", "block"]).withColumn(
        "start", F.col("carried") + F.col("inside") - len(MAGIC)).drop("inside", "carried")


def reachable(placed: DataFrame) -> DataFrame:
    """(file, block, row, start) of the candidates on the chain from each file's start.

    Runs of candidates in a block, each leading to the next, hang together:
    whoever enters a run leaves it at its end.  So runs are the nodes, and
    pointer jumping doubles the reach of every pointer in each round.
    """
    order = Window.partitionBy("file", "block").orderBy("start")
    linked = F.lag("next").over(order) == F.col("start")
    nodes = placed.withColumn("next", F.col("start") + len(MAGIC) + F.col("span"))
    nodes = nodes.withColumn("run", F.sum(F.when(linked, F.lit(0)).otherwise(F.lit(1))).over(order))
    nodes = stage(nodes.select("file", "block", "row", "start", "next", "run"))
    ends = nodes.groupBy("file", "block", "run").agg(F.min("start").alias("head"), F.max_by("next", "start").alias("target"))
    entry = nodes.join(ends.select("file", "block", "run", "head"), ["file", "block", "run"]).select(
        "file", F.col("start").alias("target"), F.col("head").alias("to"))
    jumps = stage(ends.join(entry, ["file", "target"], "left").select("file", "head", "to", "target"))
    pointer = jumps.select("file", F.col("head").alias("at"), "to")
    reached = stage(jumps.where("head = 0").select("file", F.col("head").alias("at")))
    known = reached.count()
    while known:
        onward = reached.join(pointer, ["file", "at"]).where("to is not null").select("file", F.col("to").alias("at"))
        reached = stage(reached.union(onward).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        second = pointer.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        pointer = stage(pointer.where("to is not null").join(second, ["file", "to"]).select("file", "at", F.col("further").alias("to")))
    # A run is entered once, at its predecessor's target, and followed to its end.
    entered = jumps.join(reached.withColumnRenamed("at", "head"), ["file", "head"]).where("to is not null").select(
        "file", F.col("to").alias("head"), F.col("target").alias("from"))
    begun = reached.where("at = 0").select("file", F.col("at").alias("head"), F.lit(0).cast("long").alias("from"))
    runs = entered.unionByName(begun).join(ends.select("file", "block", "run", "head"), ["file", "head"])
    return nodes.join(runs.select("file", "block", "run", "from"), ["file", "block", "run"]).where(
        F.col("start") >= F.col("from")).select("file", "block", "row", "start", "next")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, record_type, record_id, refers, said_digest, said_bytes, length, digest) of every record."""
    placed = stage(with_offsets(candidates(pieces(spark, path))))
    chain = stage(reachable(placed).where("next is not null"))
    records = placed.join(chain.select("file", "block", "row", "next"), ["file", "block", "row"])
    whole = records.where("span = size or digest is not null")
    torn = stage(records.where("span <> size and digest is null").select(*[c for c in records.columns if c != "digest"]))
    return whole.select(*_RECORD).unionByName(_joined(spark, path, placed, torn).select(*_RECORD))


_RECORD = ("file", "start", "record_type", "record_id", "refers", "said_digest", "said_bytes", "length", "digest")


def _joined(spark: SparkSession, path: str, placed: DataFrame, torn: DataFrame) -> DataFrame:
    """Records with a magic inside their payload: their pieces are read again and put together."""
    spans = torn.select("file", F.col("start").alias("record"), "next")
    # A record meets the pieces of the blocks it touches; blocks carry their own limits.
    limits = placed.groupBy("file", "block").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    touched = spans.join(limits, "file").where("low < next and high >= record").select("file", "block", "record", "next")
    inner = stage(placed.select("file", "block", "row", "start").join(touched, ["file", "block"]).where("start >= record and start < next"))
    wanted = pieces(spark, path).join(listed_cells(inner, "file", "block", "row"), cell("file", "block", "row") == F.col("cell"), "left_semi")
    texts = wanted.join(inner, ["file", "block", "row"])
    bodies = texts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "body"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["body"]), MAGIC)
    together = bodies.select("file", F.col("record").alias("start"), body.alias("body"))
    payload = F.substring(F.col("body").cast("binary"), F.col("head_size").cast("int") + len(CLOSE) + 1, F.col("length").cast("int"))
    return torn.join(together, ["file", "start"]).withColumn("digest", F.sha1(payload))


def page_records(records: DataFrame) -> DataFrame:
    """The page rows of an archive; a response's size and digest are those of the bytes read."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:([^>]*)>', 1) AS BIGINT)")
    own = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(own, F.col("length")).otherwise(F.expr("try_cast(said_bytes AS BIGINT)")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.regexp_replace("said_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", number("refers").alias("refers_to"))


OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload, max(page_id) AS original FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM p JOIN o USING (payload)"""


@query("op3_warc", OP3)
def op3(spark, sf_dir) -> DataFrame:
    """All pages written as archives and read back."""
    path = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return page_records(read_warc(spark, path))
