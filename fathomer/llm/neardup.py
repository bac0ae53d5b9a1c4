"""MinHash near-dedup: links of documents whose shingle sets are alike, exactly.

1.  Each document becomes the 128-bit digest of its set of word shingles and a
    min-max signature: under each of ``PERMUTATIONS`` permutations both the
    minimum and the maximum are kept, which halves the hash evaluations for a
    signature of a given length.  Documents of equal sets are one class, and
    only classes go on, so copies are never paired.
2.  The signature is cut into ``BANDS`` bands of ``ROWS`` values.  Two sets of
    similarity 0.8 agree in no band with a probability of 3e-6.  Classes that
    agree in a band share a bucket.
3.  Every class of a bucket is paired with one class drawn from the bucket; in
    small buckets all are paired.  Pairs whose signatures are too far apart for
    the similarity (by six standard deviations) are dropped.  The full sets
    confirm first the most alike pair of each class, and then the pairs whose
    ends are still in different components.
4.  Links make components.  In a large bucket that still has several, members
    outside its main component are paired with the bucket's hub, the member of
    most links: what a group was copied from.  Those still outside are compared
    with all members, block by block, by their signatures and then by their
    sets, without listing the pairs of a group.  So every pair that shares a
    bucket is linked, found unlike, or already in one component.  Blocks are
    bounded in members and in the size of their sets.

Buckets, links and components stay in tables; nothing of them reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomer.llm.arrow import give_back, tidy
from fathomer.llm.hashing import mixed, randoms, shingles, word_hashes
from fathomer.workspace import bounded_batches, written

BANDS, ROWS = 32, 5
PERMUTATIONS = BANDS * ROWS // 2
#: Buckets of up to so many classes have all pairs compared.
SMALL = 8
#: Members of a large bucket compared at a time, and shingles in their sets, on average (one set is never split).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20

_FACTORS, _ADDENDS = randoms(PERMUTATIONS, 101) | np.uint64(1), randoms(PERMUTATIONS, 202)
_BAND_SEEDS = randoms(BANDS, 303)
_ROW_FACTORS = randoms(ROWS, 404) | np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles.

    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingles(words, min(size, len(words))) if len(words) >= size else mixed(shingles(words, len(words)) + np.uint64(len(words))))


def signature(members: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(members), 1 << 10):
        # Odd factors make permutations of the 64-bit numbers; the sets' hashes are random already.
        hashed = members[at : at + (1 << 10)] * _FACTORS[:, None] + _ADDENDS[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands_of(values: np.ndarray) -> np.ndarray:
    """A hash for each band of a signature; bands differ also where their values do not."""
    return mixed((values.reshape(BANDS, ROWS) * _ROW_FACTORS).sum(axis=1, dtype=np.uint64) + _BAND_SEEDS)


def sketch_of(values: np.ndarray) -> bytes:
    """A byte of each value, to compare signatures by."""
    return mixed(values).astype(np.uint8).tobytes()


def least_agreement(similarity: float) -> int:
    """How many bytes of two sketches agree at least, six deviations below the mean."""
    n = BANDS * ROWS
    return int(n * similarity - 6 * (n * similarity * (1 - similarity)) ** 0.5)


_SKETCHED = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary, bands array<long>"


def _digest(members: np.ndarray) -> tuple[int, int]:
    halves = [np.bitwise_xor.reduce(mixed(members + seed)) ^ (members * factor).sum(dtype=np.uint64) for seed, factor in zip(*_SET_SEEDS, strict=True)]
    return tuple(int(x) for x in np.array(halves, np.uint64).view(np.int64))


_SET_SEEDS = (randoms(2, 505), randoms(2, 606) | np.uint64(1))


def sketches(docs: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """Set size, set digest, sketch and band hashes of every document."""
    names = ["doc_id", "n_shingles", "h1", "h2", "sketch", "bands"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, h1, h2, marks, bands = [], [], [], [], []
            for text in part.column(1):
                members = shingle_set(text.as_py(), size)
                values = signature(members) if len(members) else None
                one, two = _digest(members) if len(members) else (0, 0)
                counts.append(len(members))
                h1.append(one)
                h2.append(two)
                marks.append(sketch_of(values) if values is not None else None)
                bands.append(bands_of(values).view(np.int64) if values is not None else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=names,
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    return texts.mapInArrow(tidy(batches), _SKETCHED)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins and the last ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    edges = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[edges[0] : edges[-1]], edges - edges[0]


def _members(column: pa.Array) -> list[np.ndarray]:
    """A column of sets as arrays of hashes."""
    data, edges = _values(column)
    return [data[a:b].view(np.uint64) if (a & 7) == 0 else np.frombuffer(data[a:b].tobytes(), np.uint64) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


@F.arrow_udf(T.IntegerType())
def _agreement(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """How many bytes of two sketches agree."""
    for a, b in parts:
        left, right = (_values(x)[0].reshape(len(x), -1) if len(x) else np.zeros((0, 1), np.uint8) for x in (a, b))
        yield pa.array((left == right).sum(axis=1).astype(np.int32))
    give_back()


def _alike(pairs: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """``a, b, agree``: the pairs whose sketches agree enough; ``marks`` has (class, sketch)."""
    left = marks.select(F.col("class").alias("a"), F.col("sketch").alias("sketch_a"))
    right = marks.select(F.col("class").alias("b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("agree", _agreement("sketch_a", "sketch_b"))
    return joined.where(F.col("agree") >= least).select("a", "b", "agree")


def _sets(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """``class, members``: the full sets of the classes that may have links.  Texts are shuffled here, once."""

    @F.arrow_udf("binary")
    def as_set(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([shingle_set(text.as_py(), size).tobytes() for text in texts], pa.binary())
        give_back()

    texts = docs.select(F.col(id_col).cast("long").alias("class"), F.col(text_col).cast("string").alias("text"))
    return texts.join(wanted, "class", "left_semi").select("class", as_set("text").alias("members"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough: 100 * shared >= percent * union."""

    @F.arrow_udf("boolean")
    def similar(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            out = []
            for x, y in zip(_members(a), _members(b), strict=True):
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                out.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.array(out, pa.bool_())
        give_back()

    left = sets.select(F.col("class").alias("a"), F.col("members").alias("members_a"))
    right = sets.select(F.col("class").alias("b"), F.col("members").alias("members_b"))
    return pairs.join(left, "a").join(right, "b").where(similar("members_a", "members_b")).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``class, component``: the least class that links (a, b) reach, for linked classes.

    Each round takes the least label among neighbours and then the label of
    that label, so that chains shorten by half or more a round.  Labels are
    written each round; the driver sees only how many changed.
    """
    both = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.col("class")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["class"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["class"] == near["a"]).select("class", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        far = labels.select(F.col("class").alias("component"), F.col("component").alias("far"))
        labels = lower.join(far, "component", "left").select("class", "old", F.least("component", F.coalesce("far", "component")).alias("component"))
        labels = written(labels, "labels")
        changed = labels.where("old <> component").limit(1).count()
        labels = labels.select("class", "component")
        if not changed:
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (class, component) after further links; only components that links name are worked on."""
    ends = _apart(links, labels).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    joined = components(written(ends, "component-links")).select(F.col("class").alias("component"), F.col("component").alias("lower"))
    out = labels.join(joined, "component", "left")
    return written(out.select("class", F.coalesce("lower", "component").alias("component")), "labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of different components, with these as ``of_a`` and ``of_b``."""
    left = labels.select(F.col("class").alias("a"), F.col("component").alias("of_a"))
    right = labels.select(F.col("class").alias("b"), F.col("component").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").where("of_a <> of_b")


def _loose(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The large buckets that have several components.

    Returns their members (``bucket, class, size, component, main, ...``), and
    a row for each with ``main``, its largest component, and in how many blocks
    the other members (``xs``) and all (``ys``) are taken.
    """
    members = written(buckets.where(F.col("n") > SMALL).select("bucket", "class", "size").join(labels, "class"), "bucket-members")
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    most = F.max(F.struct("m", "component", "s"))
    mains = parts.groupBy("bucket").agg(most.alias("most"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.count("*").alias("c")).where("c > 1")
    blocks = lambda rows, size: F.ceil(F.greatest(rows / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    xs = blocks(F.col("n") - F.col("most.m"), F.col("s") - F.col("most.s"))
    mains = written(mains.select("bucket", F.col("most.component").alias("main"), xs.alias("xs"), blocks(F.col("n"), F.col("s")).alias("ys")), "bucket-mains")
    return members.join(mains, "bucket"), mains


def _hub_pairs(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b``: each member outside its bucket's main component with the bucket's member of most links."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    known = written(degrees, "link-counts")
    hubs = placed.select("bucket", "class").join(known, "class").groupBy("bucket").agg(F.max_by("class", F.struct("links", "class")).alias("hub"))
    loose = placed.where("component <> main").select("bucket", "class").join(written(hubs, "bucket-hubs"), "bucket").where("class <> hub")
    return loose.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()


def _rest(placed: DataFrame, details: DataFrame, least: int, percent: int) -> DataFrame:
    """The links (a, b) between components that large buckets still have.

    A bucket's members outside its main component are compared with all its
    members, a block of each at a time, on sketches and then on full sets.  A
    pair that shares several buckets is compared in the one of the first band.
    ``details`` has (class, sketch, bands, members).
    """
    block = lambda count: F.pmod(F.xxhash64("class"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    # Members are repeated for each block of loose ones only, so a bucket with few of these stays small.
    loose = placed.where("component <> main").select(F.lit(True).alias("loose"), "bucket", block("xs").alias("x"), every("ys").alias("y"), "class", "component")
    rest = placed.select(F.lit(False).alias("loose"), "bucket", every("xs").alias("x"), block("ys").alias("y"), "class", "component")

    def compared(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_loose = group["loose"].to_numpy()
        found = _links_within(key[0].as_py(), _Members(group, is_loose), _Members(group, ~is_loose), least, percent) if is_loose.any() and not is_loose.all() else []
        give_back()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    both = loose.union(rest).join(details, "class")
    return both.groupBy("bucket", "x", "y").applyInArrow(compared, "a long, b long").distinct()


class _Members:
    """Some rows of a block as arrays."""

    def __init__(self, group: pa.Table, wanted: np.ndarray) -> None:
        rows = group.filter(pa.array(wanted)).combine_chunks()
        one = lambda name: c.chunk(0) if (c := rows[name]).num_chunks else pa.array([], c.type)
        self.classes, self.parts = one("class").to_numpy(), one("component").to_numpy()
        self.marks = _values(one("sketch"))[0].reshape(len(self.classes), -1)
        self.bands = one("bands").flatten().to_numpy().reshape(len(self.classes), -1)
        self.sets = _members(one("members"))
        self.sizes = np.array([len(m) for m in self.sets])


def _links_within(bucket: int, one: _Members, two: _Members, least: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows of ``one`` and of ``two`` that are in different components."""
    band = int(np.argwhere(two.bands == bucket)[0, 1])
    found = []
    for key, part, mark, own, mine in zip(one.classes.tolist(), one.parts, one.marks, one.bands, one.sets, strict=True):
        near = (two.parts != part) & (100 * np.minimum(two.sizes, len(mine)) >= percent * np.maximum(two.sizes, len(mine)))
        near &= ~(two.bands[:, :band] == own[:band]).any(axis=1)
        near = np.flatnonzero(near)
        near = near[(two.marks[near] == mark).sum(axis=1) >= least]
        for i in near.tolist():
            theirs = two.sets[i]
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            shared = int((mine[place] == theirs).sum())
            if 100 * shared >= percent * (len(theirs) + len(mine) - shared):
                other = int(two.classes[i])
                found.append((min(key, other), max(key, other)))
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    A document's set holds its different shingles of ``size`` words, hashed to
    64 bits; words have A-Z lower-cased.  Documents are linked where ``100 *
    shared >= percent * union``; a document without words is linked with none.
    ``component_id`` is the least document id that links reach, and the
    document of that id is ``kept``.

    Each row is placed by its own text.  A class of equal sets goes by its
    least id, so of rows that repeat an id with other texts those that are the
    first of their classes count as linked.  Rows without an id are linked
    with none and are kept, with a null component.  Empty tables give empty
    ones.
    """
    least = least_agreement(percent / 100)
    found = written(sketches(docs, id_col=id_col, text_col=text_col, size=size), "sketches")
    worded = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("class")), "classes")
    heads = worded.join(classes.select("h1", "h2", F.col("class").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
    marks = heads.select(F.col("doc_id").alias("class"), "sketch")

    banded = heads.select(F.col("doc_id").alias("class"), F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    # The first of a bucket is drawn by a hash, so that the buckets of a large group have different firsts.
    drawn = F.struct(F.xxhash64("bucket", "class"), "class")
    shared = banded.groupBy("bucket").agg(F.min(drawn)["class"].alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = written(banded.join(written(shared, "shared-buckets"), "bucket"), "buckets")
    star = buckets.where("class <> first").select(F.least("first", "class").alias("a"), F.greatest("first", "class").alias("b"))
    few = buckets.where(F.col("n").between(3, SMALL)).groupBy("bucket").agg(F.sort_array(F.collect_set("class")).alias("c"))
    within = few.select(F.explode(F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    pairs = written(_alike(star.union(within).distinct(), marks, least), "pairs")

    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(buckets.where(F.col("n") > SMALL).select("class")).distinct()
    sets = written(_sets(docs, wanted, id_col=id_col, text_col=text_col, size=size), "shingle-sets")
    labels = classes.select("class", F.col("class").alias("component")).distinct()
    # First the most alike partner of each class; then only what is still apart.
    best = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")), "pairs")
    links = written(_confirmed(best, sets, percent), "links")
    labels = _merged(labels, links)
    apart = _apart(pairs.join(best, ["a", "b"], "left_anti"), labels)
    more = written(_confirmed(written(apart, "pairs"), sets, percent), "links")
    labels = _merged(labels, more)
    # Large buckets that are still in parts: with their hubs, and then block by block.
    placed, mains = _loose(buckets, labels)
    if not mains.isEmpty():
        hubs = _alike(_hub_pairs(placed, links.union(more)).join(pairs, ["a", "b"], "left_anti"), marks, least)
        hubs = written(_confirmed(written(hubs, "pairs"), sets, percent), "links")
        if not hubs.isEmpty():
            labels = _merged(labels, hubs)
            placed, mains = _loose(buckets, labels)
        details = heads.select(F.col("doc_id").alias("class"), "sketch", "bands").join(sets, "class")
        rest = written(_rest(placed, details, least, percent), "links")
        if not rest.isEmpty():
            labels = _merged(labels, rest)

    # Every row's class, the class's component, and for a repeated id the least of its rows'.
    of_class = classes.join(labels, "class").select("h1", "h2", "component")
    of_class = written(of_class, "class-components")
    out = found.join(of_class, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``.

    All rows of an id stay if one of them is kept.
    """
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col, size=size, percent=percent)
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    gone = written(gone, "near-duplicates")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
