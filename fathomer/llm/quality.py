"""Quality rules: base counts, then a log-likelihood ratio of hashed n-grams.

Native: DataFrame functions only.  Words and pairs of words are hashed into
``BUCKETS`` buckets.  Two multinomials over the buckets are counted, one over
trusted documents and one over the whole corpus, and a document's score is the
mean log ratio of its n-grams under the two; a document is kept from
``threshold`` on.  Every document is decided by its own score, so a rerun
decides alike.

One scan writes each document's counts and buckets (two bytes a word or so) to
the work folder; counting and scoring read only those.  The corpus is counted
whole.  The trusted side is fitted on at most ``max_trusted`` documents, taken in
the order of a hash of their ids, so that their ids can be broadcast with a
fixed bound; the table of ratios has ``BUCKETS`` numbers at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomer.functions.text import let
from fathomer.llm.line_dedup import WHITE
from fathomer.workspace import written

BUCKETS = 1 << 16
MAX_TRUSTED = 20_000
#: Counts added to both sides of a ratio.
SHRINK = 20.0
#: Mean log ratio, in nats, from which a document is kept.
THRESHOLD = -0.08
_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def words_of(text: Column) -> Column:
    """The runs of characters other than ``[\\x20\\x09-\\x0D]``; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT, -1), lambda w: w != "")


def _covered(windows: Column) -> Column:
    """How many words lie in windows that stand at least twice in the array of window hashes."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(placed, lambda s: F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"])))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    gaps = let(starts, lambda s: F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g)


def base_counts(text: Column) -> Column:
    """A struct of the base counts of a text and the hashes of its words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
        )

    return let(words_of(text), of_words)


def n_repeat_words(hashes: Column) -> Column:
    """Words in windows of ``WINDOW`` words found twice or more, the first included."""
    window = lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)])
    count = F.size(hashes) - (WINDOW - 1)
    windows = F.transform(F.slice(hashes, F.lit(1), F.greatest(count, F.lit(0))), window)
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0).cast("long")))
    return F.when(count > 1, found).otherwise(F.lit(0).cast("long"))


def buckets_of(hashes: Column) -> Column:
    """The buckets of a document's words and of its pairs of neighbouring words."""
    fold = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: fold(F.xxhash64(h, F.get(hashes, i + 1))))
    return F.concat(F.transform(hashes, fold), pairs)


def log_ratios(features: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with ``ratios``, the array of log ratios by bucket.

    With ``t`` and ``r`` the counts of a bucket among trusted documents and in
    the corpus and ``T`` and ``R`` their sums, the trusted count that the
    corpus multinomial expects is ``e = T r / R``, and the ratio is
    ``ln((t + SHRINK) / (e + SHRINK))``: buckets with little evidence count
    little, so that trusted documents gain nothing from having been counted.
    Without trusted documents all ratios are 0.
    """
    flagged = features.join(F.broadcast(trusted.withColumn("is_trusted", F.lit(1))), "doc_id", "left")
    grams = flagged.select(F.coalesce("is_trusted", F.lit(0)).alias("t"), F.explode("buckets").alias("bucket"))
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("r"), F.sum("t").alias("t")), "gram-counts")
    sums = counts.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r_all"), F.coalesce(F.sum("t"), F.lit(0)).alias("t_all"))
    every = features.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    r, t = F.coalesce("r", F.lit(0)), F.coalesce("t", F.lit(0))
    expected = F.coalesce(F.try_divide(sums.select("t_all").scalar() * r, sums.select("r_all").scalar()), F.lit(0.0))
    ratio = F.log((t + SHRINK) / (expected + SHRINK))
    pairs = every.select(F.struct("bucket", ratio.alias("ratio")).alias("pair"))
    return pairs.agg(F.transform(F.sort_array(F.collect_list("pair")), lambda p: p["ratio"]).alias("ratios"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_trusted: int = MAX_TRUSTED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The base counts, score and verdict of every document.

    ``labels`` has ``doc_id`` and ``quality``; rows of quality 1 are trusted.
    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept``.  A document fails the base
    rules with fewer than 20 words or with over 30 % of its words repeated in
    windows of 8, and is kept if it does not fail and its score reaches the
    threshold.  A null text has no words and so fails.  Each row is a document
    of its own: repeated and null ids stay as they are, and an empty table
    gives an empty one.
    """
    scan = docs.select(F.col(id_col).cast("long").alias("doc_id"), base_counts(F.col(text_col)).alias("base")).select("doc_id", "base.*")
    features = written(
        scan.select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            let(F.col("hashes"), n_repeat_words).alias("n_repeat_words"),
            let(F.col("hashes"), buckets_of).alias("buckets"),
        ),
        "quality-features",
    )
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    ratios = written(log_ratios(features, trusted), "gram-ratios")
    total = F.aggregate("buckets", F.lit(0.0), lambda s, b: s + F.get(F.col("ratios"), b))
    # Catalyst folds the two projections into one, where the table is one value for all rows.
    scored = features.withColumn("ratios", ratios.scalar()).withColumn("score", F.when(F.size("buckets") > 0, total / F.size("buckets")).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "score",
        (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
