"""Language ID: evidence of text, markup, address and host, fused by Bayes' rule.

Text likelihoods come from hashed byte trigrams, one multinomial for each
language, fitted on a bounded sample of rows whose language is declared (one row
for each of at most ``SAMPLE`` ids a language, in the order of a hash of the
ids), whose trigrams workers count.  All else covers the whole corpus: the text
posteriors of all rows are summed by host and by address suffix with grouped
aggregation, and the prior of a host is smoothed towards its suffix, and that of
a suffix towards the corpus.  Each text is scored once.

The table of host priors has a row a host.  It is written out and joined on the
host; Spark broadcasts it only if the written size is below its threshold, and
splits the partition of a hot host otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomer.llm.arrow import give_back, tidy
from fathomer.llm.html_text import main_texts
from fathomer.workspace import bounded_batches, written

LANGUAGES = ("en", "fr", "de", "es")
UNKNOWN = "und"
#: Rows a language that the trigram model is fitted on, at most.
SAMPLE = 400
BUCKETS = 1 << 16
#: Tasks that count the trigrams of the sample.
COUNTERS = 4
#: Trigrams overlap, so their log-likelihoods count only in part.
TEXT_WEIGHT = 0.2
#: How often declared languages and address suffixes are right.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Pseudo-counts with which hosts are drawn to suffixes, and suffixes to the corpus.
HOST_PRIOR, SUFFIX_PRIOR = 10.0, 50.0
#: Posterior below which the language is not told.
LEAST_POSTERIOR = 0.5

# The language that an address suffix suggests.
SUFFIX_LANGUAGE = {
    "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "fr": "fr", "de": "de", "at": "de", "es": "es",
    "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es",
}

_HTML_LANG = r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)


def trigrams(text: str) -> np.ndarray:
    """The buckets of a text's byte trigrams; what is no letter is one space."""
    data = _FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    if not len(data):
        return np.zeros(0, np.int64)
    data = data[np.append(True, (data[1:] != 32) | (data[:-1] != 32))]
    if not (data != 32).any():
        return np.zeros(0, np.int64)
    data = np.concatenate([[32], data, [32]]).astype(np.uint32)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    """Log probabilities by bucket, a column for each language."""

    languages: tuple[str, ...]
    table: np.ndarray

    def scores(self, text: str | None) -> list[float]:
        """Mean log-likelihood of a trigram by language, then the number of trigrams."""
        codes = trigrams(text or "")
        total = np.zeros(len(self.languages))
        for at in range(0, len(codes), 1 << 18):
            total += self.table[codes[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return [*(total / max(1, len(codes))), float(len(codes))]


def fit(rows: DataFrame, *, id_col: str, text_col: str, declared_col: str, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> Model:
    """A model from one row for each of at most ``sample`` ids of each declared language.

    Of an id's rows the one of the least text counts.  The driver gets counts
    alone, at most ``COUNTERS`` tables of them.
    """
    bounded_batches(rows.sparkSession)
    base = rows.select(F.col(id_col).alias("id"), primary(F.col(declared_col)).alias("lang")).where(F.col("lang").isin(*languages) & F.col("id").isNotNull())
    found = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    # Only hashes low enough for some four samples of a language are compared at all.
    low = F.lit(False)
    for lang, n in found.items():
        most = min(2**63 - 1, (4 * sample << 64) // n - 2**63)
        low = low | ((F.col("lang") == lang) & (F.col("hash") <= most))
    few = base.withColumn("hash", F.xxhash64("id")).where(low).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    picked = few.withColumn("n", first).where(F.col("n") <= sample).select("lang", "id")
    texts = rows.select(F.col(id_col).alias("id"), primary(F.col(declared_col)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(picked), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))
    order = list(languages)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((BUCKETS, len(order)), np.uint32)
        for part in parts:
            for lang, text in zip(part.column(0), part.column(1), strict=True):
                np.add.at(table[:, order.index(lang.as_py())], trigrams(text.as_py() or ""), 1)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["table"])

    counts = np.full((BUCKETS, len(order)), 0.5)
    for row in texts.select("lang", "text").coalesce(COUNTERS).mapInArrow(tidy(count), "table binary").collect():
        counts += np.frombuffer(row["table"], np.uint32).reshape(counts.shape)
    return Model(tuple(languages), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def primary(tag: Column) -> Column:
    """The primary part of a language tag, in lower case: ``en-US`` gives ``en``."""
    return F.lower(F.regexp_extract(F.coalesce(tag.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host; empty if it has one label only."""
    return F.regexp_extract(host, r"\.([a-z]{2,})\.?$", 1)


def _log_evidence(name: Column, languages: Sequence[str], right: float) -> list[Column]:
    """log P(evidence | language); nothing is said by what names no language."""
    wrong = math.log((1 - right) / max(1, len(languages) - 1))
    return [F.when(~name.isin(*languages), 0.0).when(name == x, math.log(right)).otherwise(wrong) for x in languages]


def _soft(logs: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, p: s + p)
    return F.transform(powers, lambda p: p / total)


def _scores(rows: DataFrame, model: Model, text: Column) -> Column:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS * languages floats, at any input
    bounded_batches(rows.sparkSession)

    @F.arrow_udf("array<double>")
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in parts:
            yield pa.array([own.scores(text.as_py()) for text in texts], pa.list_(pa.float64()))
        give_back()

    return scores(text.cast("string"))


def _with_evidence(rows: DataFrame, model: Model, text: Column, declared: Column, host: Column) -> DataFrame:
    """Adds ``_host, _suffix, _size, _mean`` (mean log-likelihoods of a trigram), ``_text`` (weighted sums) and ``_said`` (log evidence of markup and address)."""
    n = len(model.languages)
    hints = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    hinted = F.coalesce(F.try_element_at(hints, F.col("_suffix")), F.lit(""))
    said = zip(_log_evidence(primary(declared), model.languages, DECLARED_RIGHT), _log_evidence(hinted, model.languages, SUFFIX_RIGHT), strict=True)
    scored = rows.withColumn("_scores", _scores(rows, model, text)).withColumn("_host", host).withColumn("_suffix", suffix_of(F.col("_host")))
    size = F.element_at("_scores", n + 1)
    return scored.withColumns(
        {
            "_size": size,
            "_mean": F.slice("_scores", 1, n),
            "_text": F.transform(F.slice("_scores", 1, n), lambda x: x * size * TEXT_WEIGHT),
            "_said": F.array(*[a + b for a, b in said]),
        }
    ).drop("_scores")


def host_priors(scored: DataFrame, languages: Sequence[str]) -> DataFrame:
    """``_host, _suffix, _prior``: the log prior of each host, from all rows.

    Posteriors of text and markup are summed by host, hosts by suffix, and
    suffixes over the corpus; each level is smoothed by the one above it.
    """
    n = len(languages)
    soft = scored.where("_size > 0").select("_host", "_suffix", _soft(F.zip_with("_text", "_said", lambda a, b: a + b)).alias("p"))
    sums = [F.sum(F.col("p")[i]).alias(f"h{i}") for i in range(n)]
    hosts = written(soft.groupBy("_suffix", "_host").agg(*sums), "host-counts")
    suffixes = hosts.groupBy("_suffix").agg(*[F.sum(f"h{i}").alias(f"s{i}") for i in range(n)])
    corpus = hosts.agg(*[F.sum(f"h{i}").alias(f"c{i}") for i in range(n)]).first()
    everything = [float(corpus[i] or 0.0) + 1.0 for i in range(n)]
    whole = [x / sum(everything) for x in everything]
    joined = hosts.join(suffixes, "_suffix")
    add = lambda names: sum((F.col(x) for x in names[1:]), F.col(names[0]))
    of_suffix = [(F.col(f"s{i}") + SUFFIX_PRIOR * whole[i]) / (add([f"s{j}" for j in range(n)]) + SUFFIX_PRIOR) for i in range(n)]
    of_host = [(F.col(f"h{i}") + HOST_PRIOR * of_suffix[i]) / (add([f"h{j}" for j in range(n)]) + HOST_PRIOR) for i in range(n)]
    return joined.select("_host", "_suffix", F.array(*[F.log(p) for p in of_host]).alias("_prior"))


def _fused(scored: DataFrame, priors: DataFrame, languages: Sequence[str], least: float) -> DataFrame:
    """Adds ``predicted``, ``posterior`` and ``kept``."""
    joined = scored.join(priors, ["_host", "_suffix"], "left")
    even = F.array(*[F.lit(-math.log(len(languages)))] * len(languages))
    logs = F.zip_with(F.zip_with("_text", "_said", lambda a, b: a + b), F.coalesce("_prior", even), lambda a, b: a + b)
    posteriors = joined.withColumn("_p", _soft(logs)).withColumn("posterior", F.array_max("_p"))
    best = F.array_position("_p", F.col("posterior")).cast("int")
    told = (F.col("_size") > 0) & (F.element_at("_mean", best) >= -math.log(BUCKETS)) & (F.col("posterior") >= least)
    named = F.element_at(F.array(*map(F.lit, languages)), best)
    out = posteriors.withColumn("predicted", F.when(told, named).otherwise(UNKNOWN))
    return out.withColumn("kept", told).drop("_p", "_prior", "_host", "_suffix", "_size", "_mean", "_text", "_said")


def identify(
    rows: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str = "lang",
    host: Column | None = None,
    languages: Sequence[str] = LANGUAGES,
    sample: int = SAMPLE,
    least: float = LEAST_POSTERIOR,
) -> DataFrame:
    """``doc_id, declared, predicted, posterior, kept`` for every row.

    ``host`` is the expression of a row's host (default: its ``source``).  A
    language is not told (``und``, not kept) where a text has no letter, reads
    like none of the languages (its trigrams are less likely than if all were
    equally so), or leaves the posterior below ``least``.  A null text is
    empty, a null or unknown declared language says nothing, and rows without
    a host share one.  Each row stands for itself: repeated and null ids stay
    as they are, and an empty table gives an empty one.  Rows without an id are
    never in the model's sample.
    """
    host = F.coalesce(F.col("source").cast("string"), F.lit("")) if host is None else host
    model = fit(rows, id_col=id_col, text_col=text_col, declared_col=declared_col, languages=languages, sample=sample)
    narrow = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(declared_col).alias("declared"), F.col(text_col).alias("text"), host.alias("host"))
    scored = written(_with_evidence(narrow, model, F.col("text"), F.col("declared"), F.col("host")).drop("text", "host"), "language-scores")
    priors = written(host_priors(scored, languages), "host-priors")
    return _fused(scored, priors, languages, least).select("doc_id", "declared", "predicted", "posterior", "kept")


def of_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``page_id, declared, predicted, posterior, kept`` for every page.

    The text is the page's main text, the declared language that of its
    ``html`` element, and the host that of its address.  Rows are taken one by
    one: repeated and null ids stay as they are, other columns are not read, a
    null page has no text, and an empty table gives an empty one.
    """
    bounded_batches(pages.sparkSession)
    declared = F.nullif(F.regexp_extract(html_col, _HTML_LANG, 1), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), declared.alias("markup"), F.col(url_col).alias("url"), main_texts(F.col(html_col)).alias("text"))
    rows = written(rows, "page-texts")  # extracted once
    out = identify(rows, id_col="page_id", declared_col="markup", host=host_of(F.col("url")), sample=sample)
    return out.withColumnRenamed("doc_id", "page_id")


def keep_told(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str = "lang",
    source_col: str = "source",
    languages: Sequence[str] = LANGUAGES,
    sample: int = SAMPLE,
    least: float = LEAST_POSTERIOR,
) -> DataFrame:
    """The rows of ``docs`` whose language is told, with the columns of ``docs``.

    The decisions are those of ``identify``.  Rows are written once with their
    scores, so that no text is scored twice or shuffled.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, declared_col=declared_col, languages=languages, sample=sample)
    # The row travels as one column, so that its names meet no others.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    own = lambda name: F.col("row")[name]
    host = F.coalesce(own(source_col).cast("string"), F.lit(""))
    scored = written(_with_evidence(rows, model, own(text_col), own(declared_col), host), "language-scores")
    priors = written(host_priors(scored, languages), "host-priors")
    return _fused(scored, priors, languages, least).where("kept").select("row.*")
