"""Quality rules: simple counts, and a hashed n-gram log-likelihood ratio, all in DataFrame expressions.

Word unigrams, word bigrams and the last three characters of each word are
hashed into ``BUCKETS`` cells.  Two smoothed multinomials over the cells are
estimated, one from trusted documents and one from every word of the corpus.
A document's score is the sum of log(p_trusted / p_corpus) over its n-grams,
divided by their number.  A document is kept when it passes the base rule and
its score is at least ``LEAST_SCORE``; nothing is drawn at random.

Trusted documents are those labelled quality 1 and not toxic; of more than
``MOST_TRUSTED`` the ones with the smallest hash of their id are taken, so the
list that travels to the tasks is bounded.  The corpus side covers all rows.

Defined results: null texts are empty: no words, base rule failed, not kept;
without trusted documents every weight is 0 and the base rule decides;
repeated rows get equal answers (a label that occurs twice counts once); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from daygrid.llm.catalog import query, table
from daygrid.stage import stage

BUCKETS = 1 << 14
MOST_TRUSTED = 20_000
LEAST_SCORE = -0.6  # nats per n-gram
FEW_WORDS = 50
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text``, ``_words`` (separators at the ends do not count) and ``_hashes``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return (docs.withColumn("_text", text).withColumn("_words", words)
            .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))))


def repeated_words(words: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside 3-word windows that occur twice or more.

    Window hashes are sorted; only texts that have equal neighbours look at positions.
    """
    n = F.size("_hashes")
    windows = F.when(n < 3, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(
        F.slice("_hashes", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.col("_hashes")[i + 1], F.col("_hashes")[i + 2])))
    df = words.withColumn("_windows", windows).withColumn("_sorted", F.sort_array("_windows"))
    df = df.withColumn("_twice", F.array_distinct(F.filter(
        "_sorted", lambda x, i: (i > 0) & (x == F.col("_sorted")[F.greatest(i - 1, F.lit(0))]))))
    few = F.filter(F.transform("_windows", lambda x, i: F.when(F.array_contains(F.col("_twice"), x), i)),
                   lambda i: i.isNotNull())
    df = df.withColumn("_placed", F.when(F.size("_twice") > 16, F.sort_array(
        F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    last = F.size("_placed") - 1
    many = F.sort_array(F.transform(F.filter("_placed", lambda p, i: (
        ((i > 0) & (p["x"] == F.col("_placed")[F.greatest(i - 1, F.lit(0))]["x"])) |
        ((i < last) & (p["x"] == F.col("_placed")[F.least(i + 1, last)]["x"])))), lambda p: p["i"]))
    places = F.when(F.size("_twice") == 0, F.expr("cast(array() as array<int>)")).when(
        F.size("_twice") <= 16, few).otherwise(many)
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
                          lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total")),
                          lambda acc: acc["total"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_windows", "_sorted", "_twice", "_placed")


def _without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def base_counts(words: DataFrame) -> DataFrame:
    """Add the counts of the base rule and ``base_failed``."""
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = repeated_words(words.withColumn("_lines", lines))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", SPACES, "")).cast("long"),
        "n_symbols": _without(F.col("_text"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    return df.withColumn("base_failed", (F.col("n_words") < FEW_WORDS) |
                         (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).drop("_lines")


def with_grams(words: DataFrame) -> DataFrame:
    """Add ``_grams``: the cell of every unigram, bigram and word ending."""
    low = F.lit(BUCKETS - 1)
    cell = lambda h: h.bitwiseAND(low).cast("int")
    singles = F.transform("_hashes", cell)
    doubles = F.transform(F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - 1, F.lit(0))),
                          lambda h, i: cell(F.xxhash64(h, F.col("_hashes")[i + 1])))
    endings = F.transform("_words", lambda w: cell(F.xxhash64(F.right(w, F.lit(3)), F.lit(3))))
    return words.withColumn("_grams", F.concat(singles, doubles, endings))


def trusted_documents(labels: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """Ids of trusted documents, at most ``most``."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def gram_weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The log-ratio of every cell, from the counts of all documents and of the trusted ones: ``BUCKETS`` numbers."""
    trusted = F.broadcast(trusted_documents(labels).withColumn("_trusted", F.lit(1)))
    marked = docs.select("doc_id", "text").join(trusted, "doc_id", "left")
    # The outer form: a plain explode makes the optimizer filter on the size of the whole expression first.
    cells = with_grams(with_words(marked)).select("_trusted", F.explode_outer("_grams").alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("corpus"), F.count("_trusted").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("cell"))
    filled = stage(every.join(counts, "cell", "left").na.fill(0, ["corpus", "target"]))
    total = filled.agg(F.sum("corpus").alias("c"), F.sum("target").alias("t")).first()
    if not total["t"]:
        return [0.0] * BUCKETS
    share = lambda c, n: F.log(F.col(c) + 1.0) - F.log(F.lit(float(n + BUCKETS)))
    ratio = F.round(share("target", total["t"]) - share("corpus", total["c"]), 9)
    return [r["w"] for r in filled.select("cell", ratio.alias("w")).orderBy("cell").collect()]


def quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with the base counts, ``score`` and ``kept``."""
    listed = ",".join(f"{w:.9f}" for w in gram_weights(docs, labels))
    weights = F.split(F.lit(listed), ",").cast("array<double>")  # folded into one constant
    rows = base_counts(with_grams(with_words(docs)))
    total = F.aggregate("_grams", F.lit(0.0), lambda acc, g: acc + weights[g])
    score = F.when(F.size("_grams") == 0, F.lit(0.0)).otherwise(total / F.size("_grams"))
    rows = rows.withColumn("score", score)
    # Always true, but not deterministic to the optimizer: without it a filter on ``kept`` is pushed below the
    # projections, and the arrays are computed anew inside every lambda.
    here = F.monotonically_increasing_id() >= 0
    rows = rows.withColumn("kept", here & ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
    return rows.drop("_text", "_words", "_hashes", "_grams")


@query("op7_quality_rules")
def op7(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rated = quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", F.round("score", 6).alias("score"))
