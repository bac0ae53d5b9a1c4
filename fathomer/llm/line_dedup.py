"""Line dedup: lines that many documents share stay in one of them.

Native: DataFrame functions only.  Lines travel as 128-bit hashes, never as
text; the text meets its decisions once, as a run-length keep bitmap.

1.  One scan turns each document into the hashes of its long lines, written to
    the work folder (16 bytes a line).
2.  The hashes are range-partitioned with a slice of the documents as second
    key, so that a line found in a third of all documents is spread over
    as many ranges as there are; within a range they are sorted by hash, document and
    position, and a window streams over them, marking the first line of each
    document.  Each slice gives one row, and the slices of a hash are combined.
3.  Hashes of enough documents are joined with the lines again (a sort-merge
    join, whose skewed side Spark splits), and the positions of a document's
    dropped lines become its keep bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomer.functions.text import let
from fathomer.workspace import written

#: White space as the contracts of this package define it: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Slices of the documents, over which one line may be spread; as many as there are ranges, if these are more.
SLICES = 32


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is.

    ``lower`` also maps other alphabets, so it serves only texts of one byte
    a code point; ``translate``, which is slower, takes the rest.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_keys(text: Column, min_chars: int) -> Column:
    """An array of (pos, h1, h2), one for each line whose key is long enough."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    trimmed = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(WHITE)).alias("key")))
    long = F.filter(trimmed, lambda x: F.length(x["key"]) >= min_chars)
    lowered = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), ascii_lower(x["key"]).alias("key")))
    return F.transform(
        lowered,
        lambda x: F.struct(
            x["pos"].alias("pos"),
            F.xxhash64(x["key"]).alias("h1"),
            F.xxhash64(F.lit(1), x["key"]).alias("h2"),
        ),
    )


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The keep bitmap of every document that loses lines.

    Returns ``doc_id, text_hash, keep``, one row for each different text of a
    document; ``keep`` is a run-length bitmap, an array of (start, length) of
    the line runs that stay.  ``text_hash`` is ``xxhash64`` of the text.
    """
    scanned = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("n_lines"),
        line_keys(F.col(text_col), min_chars).alias("keys"),
    ).where(F.col("doc_id").isNotNull() & (F.size("keys") > 0))
    scanned = written(scanned, "line-keys")
    lines = scanned.select("doc_id", "text_hash", "n_lines", F.inline("keys"))

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slice_of = F.pmod(F.xxhash64("doc_id"), F.lit(max(SLICES, parts))).cast("int")
    ranged = lines.select("h1", "h2", slice_of.alias("slice"), "doc_id", "pos").repartitionByRange(parts, "h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc("doc_id"), "pos")
    opens = F.lag("doc_id").over(stream)
    first = ranged.withColumn("opens", (opens.isNull() | (opens != F.col("doc_id"))).cast("long"))
    sliced = first.groupBy("h1", "h2", "slice").agg(F.max("doc_id").alias("keeper"), F.sum("opens").alias("n_docs"))
    shared = (
        sliced.groupBy("h1", "h2")
        .agg(F.max("keeper").alias("keeper"), F.sum("n_docs").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # Written, so that its size is known and a skewed side of the join can be split.
    shared = written(shared, "shared-lines")
    dropped = lines.join(shared, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    found = dropped.groupBy("doc_id", "text_hash").agg(
        F.first("n_lines").alias("n_lines"),
        F.array_sort(F.collect_set("pos")).alias("gone"),
    )
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array("n_lines"))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return found.select("doc_id", "text_hash", F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def with_kept_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``keep`` and ``kept_text`` added.

    A text is split at ``\\n``; a null or empty one is one empty line.  A
    line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z
    lower-cased.  Keys of ``min_chars`` code points or more that are found in
    ``min_docs`` documents or more lose their lines in all documents but the
    one of the largest id; other lines stay, in order.

    Rows that repeat a document id count as one document, and each keeps or
    loses the lines of its own text.  Rows without an id are counted nowhere
    and lose nothing.  An empty table gives an empty one.  Columns of ``docs``
    that have the names added here are replaced.
    """
    added = ("n_lines", "n_dropped", "keep", "kept_text")
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    bitmaps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("keep").alias("__keep"))
    docs = docs.drop(*added)
    text = F.coalesce(docs[text_col], F.lit(""))
    joined = docs.join(bitmaps, (docs[id_col].cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    lines = F.split(text, "\n", -1)
    kept = let(lines, lambda x: F.flatten(F.transform("__keep", lambda r: F.slice(x, r["start"] + 1, r["length"]))))
    n_lines = F.size(lines).cast("long")
    n_kept = F.aggregate("__keep", F.lit(0), lambda n, r: n + r["length"]).cast("long")
    whole = F.array(F.struct(F.lit(0).alias("start"), n_lines.cast("int").alias("length")))
    changed = F.col("__keep").isNotNull()
    return joined.select(
        *[docs[c] for c in docs.columns],
        n_lines.alias("n_lines"),
        F.when(changed, n_lines - n_kept).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("__keep", whole).alias("keep"),
        F.when(changed, F.array_join(kept, "\n")).otherwise(text).alias("kept_text"),
    )
