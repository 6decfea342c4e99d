"""Line dedup by a log-template tree, in DataFrame expressions.

The tree has a fixed depth: the number of words of a line, then its leading words, where words with a
digit count as the variable <*>. Below, in a leaf, a word is constant at its place if half of the
leaf's lines have it there; the others are variable fields. Lines that have enough constant words take
the template so generalised, others their own. Templates that recur across documents are dropped.

Supports are counts of documents: of each distinct masked line the number of documents that hold it, of
a leaf or a place the sum over its distinct lines, of a template the number of documents that hold any of
its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import common as K
from factline.sources import scratch

LEADING = 3
MIN_WORDS = 4
MIN_DOCS = 3
#: Lines of more words than this are passages: they recur as soon as they stand in two documents.
LONG_WORDS = 50
LONG_DOCS = 2
CONSTANT = 0.5
SIMILAR = 0.6
VARIABLE = "<*>"


def masked(text) -> F.Column:
    """A text's lines, each of words with one space between them, those with a digit as the variable."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\r\f\x0b":
        odd = odd | F.contains(text, F.lit(c))
    spaced = F.when(odd, F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")).otherwise(text)
    # Functions of a line are evaluated as often as they are named, so white space is settled before, on the whole text.
    digits = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", VARIABLE)).otherwise(x)
    return F.transform(F.split(spaced, "\n"), lambda x: F.trim(digits(x)))


def occurrences(m, part: str) -> F.Column:
    return (F.length(m) - F.length(F.replace(m, F.lit(part), F.lit("")))) / len(part)


def lines(docs: DataFrame, text: str) -> DataFrame:
    """(key, line, m, words): the lines that may be templates; `key` stands for id and text, `m` is masked."""
    # Masked before they become rows: a filter on a column of rows would mask them once more.
    rows = docs.select(F.xxhash64(F.col("doc_id"), F.col(text)).alias("key"), F.posexplode(masked(F.col(text))).alias("line", "m"))
    return rows.withColumn("words", (occurrences(F.col("m"), " ") + 1).cast("int")).where(F.col("words") >= MIN_WORDS)


def hashed(rows: DataFrame) -> DataFrame:
    """With `id` for the masked line, `leaf` for number of words and leading words, and `own`: whether
    the masked line may be a template by itself."""
    own = F.when(F.contains("m", F.lit(VARIABLE)), 2 * occurrences(F.col("m"), VARIABLE) <= F.col("words")).otherwise(True)
    long = F.col("words") > LONG_WORDS
    return rows.select("key", "line", own.alias("own"), long.alias("long"), F.xxhash64("m").alias("id"), F.xxhash64("words", F.substring_index("m", " ", LEADING)).alias("leaf"), "m")


def recurring(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lines (key, line, id), ids of masked lines whose template recurs in `min_docs` documents or more).

    Of lines of more than LONG_WORDS words, which hardly meet by chance, LONG_DOCS documents are enough.
    All lines of a leaf have one number of words, so one bound holds for a leaf.
    """
    enough = F.when(F.col("long"), LONG_DOCS).otherwise(min_docs)
    every = hashed(lines(docs, text))
    thin = scratch.written(every.drop("m"), "lines")
    # A document counts once for a line, however often and in whatever rows it holds it.
    support = scratch.written(thin.select("key", "id", "leaf", "own", "long").distinct().groupBy("id", "leaf", "own", "long").agg(F.count("*").alias("docs")), "support")
    leaves = support.groupBy("leaf").agg(F.sum("docs").alias("all"), F.count("*").alias("kinds"), F.max("long").alias("long"))
    # Only leaves that hold several lines in enough documents can generalise further; their words are counted.
    # Written first, so that where they are few no text has to move to meet them.
    wide = scratch.written(leaves.where((F.col("kinds") > 1) & (F.col("all") >= enough)).select("leaf", "all"), "leaves")
    texts = every.select("id", "leaf", "m").join(wide.select("leaf"), "leaf", "left_semi").groupBy("id", "leaf").agg(F.first("m").alias("m"))
    kinds = scratch.written(texts.join(support, ["id", "leaf"]), "kinds")
    words = kinds.select("id", "leaf", "docs", "long", F.posexplode(F.split("m", " ")).alias("at", "word"))
    common = words.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("n")).join(wide, "leaf").where(F.col("n") >= CONSTANT * F.col("all"))
    fields = words.join(common.select("leaf", "at", "word", F.lit(True).alias("same")), ["leaf", "at", "word"], "left")
    shape = F.transform(F.sort_array(F.collect_list(F.struct("at", F.when(F.col("same"), F.col("word")).otherwise(VARIABLE).alias("w")))), lambda x: x["w"])
    shapes = fields.groupBy("id", "leaf", "docs", "long").agg(F.array_join(shape, " ").alias("shape"), F.avg(F.when(F.col("same") & (F.col("word") != VARIABLE), 1.0).otherwise(0.0)).alias("share"))
    general = scratch.written(shapes.where(F.col("share") >= SIMILAR).select("leaf", "id", F.xxhash64("shape").alias("template"), "docs", "long"), "general")
    sums = general.groupBy("leaf", "template").agg(F.sum("docs").alias("docs"), F.max("docs").alias("most"), F.max("long").alias("long")).where(F.col("docs") >= enough)
    # Lines of a template may be of the same documents: unless one line alone is in enough, distinct documents are counted.
    open_ids = general.join(sums.where(F.col("most") < enough), ["leaf", "template"], "left_semi").select("id", "leaf", "template", "long")
    held = thin.select("key", "id").join(open_ids, "id").select("leaf", "template", "long", "key").distinct()
    counted = held.groupBy("leaf", "template", "long").agg(F.count("*").alias("docs")).where(F.col("docs") >= enough)
    again = sums.where(F.col("most") >= enough).select("leaf", "template").union(counted.select("leaf", "template"))
    ids = support.where(F.col("own") & (F.col("docs") >= enough)).select("id").union(general.join(again, ["leaf", "template"], "left_semi").select("id"))
    return thin.select("key", "line", "id"), ids.distinct()


def cleaned(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, dropped: str = "dropped_lines") -> DataFrame:
    """`docs` with recurring lines taken out of `text`, and how many went in a column `dropped`.

    Lines end at a newline; lines of fewer than MIN_WORDS words are kept. Null texts stay null. Equal
    rows are one document for the counts and each lose the same lines. A column of that name is replaced.
    """
    rows, ids = recurring(docs, text, min_docs)
    gone = rows.join(ids, "id", "left_semi").groupBy("key").agg(F.collect_set("line").alias("gone"))
    key, out = K.free_name(docs, "_key"), K.free_name(docs, "_gone")
    own = docs.drop(dropped).withColumn(key, F.xxhash64(F.col("doc_id"), F.col(text)))
    own = own.join(gone.select(F.col("key").alias(key), F.col("gone").alias(out)), key, "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(out), i)), "\n")
    own = own.withColumn(dropped, F.coalesce(F.size(out), F.lit(0)).cast("long")).withColumn(text, F.when(F.col(out).isNull(), F.col(text)).otherwise(left))
    return own.drop(key, out)
