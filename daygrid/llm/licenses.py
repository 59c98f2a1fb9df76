"""Licence notices by TF-IDF cosine to templates, and inheritance from the nearest directory.

Whole texts are cut into sentences (line ends, and spaces after ``.!?;``).  A
sentence with a licence word is compared with every template: terms are runs of
``[a-z0-9.]`` without outer dots, weights are count * idf, and idf comes from
the templates, so that a result depends on the text alone.  The best template
of a sentence counts from a cosine of ``LEAST_COSINE``; of a text's sentences the
best one decides (ties: the first name).  Each different sentence is scored once,
however many texts have it.  Tags, wrapped notices, whole headers and whole licence
texts count as well (``notices.py``); the best score of all decides.

A file without a notice takes the licence of the nearest directory above it that
has a licence file: files are joined to licence directories on each of their
ancestor paths, and the deepest match wins.

Defined results: null texts have no notice; a null path has no directory; of
several licence files in a directory the best cosine, then the first name
counts; repeated rows get equal answers; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from daygrid.llm.catalog import query, table
from daygrid.llm.notices import whole_notices
from daygrid.stage import stage

LEAST_COSINE = 0.8
WORD = "(?i)licen[cs]e|spdx|public domain|copying"

#: Usual notices by licence: fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def template_terms(templates=TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, normed weight) rows, the idf of known terms and that of any other."""
    import re

    bags = []
    for name, text in templates:
        counts: dict[str, int] = {}
        for raw in re.split(r"[^a-z0-9.]+", text.lower()):
            if term := raw.strip("."):
                counts[term] = counts.get(term, 0) + 1
        bags.append((name, counts))
    spread: dict[str, int] = {}
    for _, counts in bags:
        for t in counts:
            spread[t] = spread.get(t, 0) + 1
    idf = {t: log((1 + len(bags)) / (1 + n)) + 1 for t, n in spread.items()}
    rows = []
    for i, (name, counts) in enumerate(bags):
        norm = sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        rows += [(i, name, t, n * idf[t] / norm) for t, n in counts.items()]
    return rows, idf, log(1 + len(bags)) + 1


def sentences(text: Column) -> Column:
    """Sentences of a text that hold a licence word."""
    return F.filter(F.split(text, r"\n|(?<=[.!?;])\s+"), lambda s: s.rlike(WORD))


def notices(files: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(path, license, score): the best notice of every text that has one."""
    spark = files.sparkSession
    rows, idf, other = template_terms(templates)
    known = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight double"))
    idf_rows = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    said = files.where(F.col("text").rlike(WORD)).select("path", F.explode_outer(F.array_distinct(sentences(F.col("text")))).alias("sentence"))
    said = stage(said.where("sentence is not null"))
    raw = F.transform(F.split(F.lower("sentence"), "[^a-z0-9.]+"), lambda t: F.btrim(t, F.lit(".")))
    terms = (said.select("sentence").distinct()
             .select("sentence", F.explode_outer(F.filter(raw, lambda t: t != "")).alias("term"))
             .groupBy("sentence", "term").agg(F.count("*").alias("n"))
             .join(idf_rows, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other))))
    norms = terms.groupBy("sentence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(known, "term").groupBy("sentence", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "sentence").select(
        "sentence", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = _best(scored, "sentence")
    lines = said.join(best, "sentence").select("path", "license", "score")
    return _best(lines.unionByName(whole_notices(files, template_terms, templates, least)), "path")


def _best(df: DataFrame, key: str) -> DataFrame:
    """The row of each key with the largest score, then the first licence."""
    top = F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("top")
    return df.groupBy(key).agg(top).select(key, F.col("top.license").alias("license"), (-F.col("top.minus")).alias("score"))


def ancestors(path: Column) -> Column:
    """All directories above a path, the root being the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def license_scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(path, license, origin, score, directory) for files (path, text, is_license_file).

    ``origin`` is file, header, inherited or none; ``directory`` is where an inherited licence lies.
    """
    own = stage(notices(files, templates, least))
    facts = files.select("path", F.coalesce("is_license_file", F.lit(False)).alias("is_license_file")).join(own, "path", "left")
    facts = stage(facts)
    held = facts.where("is_license_file and license is not null and path is not null").select(
        F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), "license", "score")
    # Stored first: joined straight to its own aggregate, a directory that holds many files could not be split over tasks.
    held = stage(_best(held, "directory"))
    bare = facts.where("license is null and path is not null").select("path").distinct()
    above = bare.select("path", F.explode_outer(ancestors(F.col("path"))).alias("directory"))
    nearest = (above.join(held, "directory").groupBy("path")
               .agg(F.max(F.struct(F.length("directory").alias("depth"), "directory", "license", "score")).alias("up")))
    joined = facts.join(nearest, "path", "left")
    origin = (F.when(F.col("license").isNotNull() & F.col("is_license_file"), "file").when(F.col("license").isNotNull(), "header")
              .when(F.col("up").isNotNull(), "inherited").otherwise("none"))
    return joined.select("path", F.coalesce("license", F.col("up.license")).alias("license"), origin.alias("origin"),
                         F.coalesce("score", F.col("up.score")).alias("score"), F.col("up.directory").alias("directory"))


SHORT_FILE = 60  # words: a text that is little more than a notice


def _values() -> tuple[str, str]:
    rows, idf, _ = template_terms()
    return (", ".join(f"({i}, '{n}', '{t}', {w!r}::DOUBLE)" for i, n, t, w in rows),
            ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in idf.items()))


OP10 = f"""
WITH known(template, license, term, weight) AS (VALUES {_values()[0]}), idfs(term, idf) AS (VALUES {_values()[1]}),
docs AS (SELECT doc_id, source || '/' || lang AS directory,
                len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) <= {SHORT_FILE} AS short, text FROM documents),
said AS (SELECT DISTINCT doc_id, trim(s, chr(13)) AS s FROM (SELECT doc_id, unnest(string_split_regex(
           regexp_replace(text, '([.!?;])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM docs) WHERE regexp_matches(s, '{WORD}')),
terms AS (SELECT s, t.term, count(*) * coalesce(any_value(idf), {template_terms()[2]!r}) AS w
          FROM (SELECT s, trim(unnest(string_split_regex(lower(s), '[^a-z0-9.]+')), '.') AS term FROM (SELECT DISTINCT s FROM said)) t
          LEFT JOIN idfs USING (term) WHERE t.term <> '' GROUP BY 1, 2),
norms AS (SELECT s, sqrt(sum(w * w)) AS norm FROM terms GROUP BY 1),
scored AS (SELECT s, license, round(sum(w * weight) / any_value(norm), 6) AS score
           FROM terms JOIN known USING (term) JOIN norms USING (s) GROUP BY s, template, license),
own AS (SELECT doc_id, first(license ORDER BY score DESC, license) AS license, max(score) AS score
        FROM said JOIN scored USING (s) WHERE score >= {LEAST_COSINE} GROUP BY 1),
held AS (SELECT directory, first(license ORDER BY score DESC, license) AS license, max(score) AS score
         FROM own JOIN docs USING (doc_id) WHERE short GROUP BY 1)
SELECT doc_id, coalesce(o.license, h.license) AS license,
       CASE WHEN o.license IS NOT NULL THEN CASE WHEN short THEN 'file' ELSE 'header' END
            WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(o.score, h.score) AS score
FROM docs LEFT JOIN own o USING (doc_id) LEFT JOIN held h USING (directory)"""


@query("op10_licenses", OP10)
def op10(spark, sf_dir) -> DataFrame:
    """Licences of all documents; a document is the file source/lang/doc_id, and a short one with a notice is a licence file."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    few = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")) <= SHORT_FILE
    files = docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text",
                        few.alias("is_license_file"))
    found = license_scan(files)
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "license", "origin", "score")
