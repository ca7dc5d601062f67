"""Near duplicates by MinHash with tensored banding.

A document's set is its distinct word shingles. Instead of independent minhashes for every table, a few collections
of minhashes are computed, and every pair of collections is the key of one table: ``COLLECTIONS`` collections of
``PER_COLLECTION`` hashes make COLLECTIONS * (COLLECTIONS - 1) / 2 tables, so a document costs about the square root of the
minhashes that its tables would otherwise need. At the threshold, a pair misses all tables only if at most one of its
collections agrees: 2e-5 for 11 collections of 2 and a similarity of 0.85, less above it.

Documents with equal sets are one class, named by its least id, before any key is made. Within a bucket every class is
first compared with the least one, then, where components are still apart, with the most central one; this links the great
groups in a linear number of comparisons. Buckets that still hold several components are compared across them, pair by pair,
so no candidate is left out; ``open_members`` and ``open_links`` say which pairs their sizes and shingles rule out beforehand.
Every link is confirmed on the full sets.

Defined cases: a text without words (or null) has an empty set and links with nothing; a text with fewer words than a
shingle has its whole sequence as its one shingle; rows with one id are one document; a row without an id stays alone, with
a null component, and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx
from tideline.llm.components import components
from tideline.llm.shared import small_batches, written

SHINGLE = 3
COLLECTIONS = 11
PER_COLLECTION = 2
PERCENT = 85

_U = np.uint64


def block_shingles(block: tx.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's documents, document by document in rising order, and where each one's begin."""
    lower = tx.LOWER[block.data]
    w = tx.words(block, lower, tx.SPACED)
    hashes = tx.span_hash(tx.running(lower), w.start, w.end)
    inside = tx.within(w.doc, n)
    grams, docs = [tx.gram_hash(hashes, n)[inside]], [w.doc[: inside.size][inside]]
    for fewer in range(1, n):
        alone = np.flatnonzero(w.counts == fewer)
        if alone.size:
            grams.append(tx.gram_hash(hashes, fewer)[w.bounds[alone]])
            docs.append(alone)
    gram, doc = np.concatenate(grams), np.concatenate(docs)
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    first = np.ones(gram.size, bool)
    first[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[first], doc[first]
    return gram, np.searchsorted(doc, np.arange(block.size + 1))


def minhashes(grams: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` minhashes per document; documents without shingles get zeros."""
    seeds = tx.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _U(0x8CB92BA72F3D8DD7))
    held = np.diff(bounds) > 0
    out = np.zeros((held.size, count), np.uint64)
    if not held.any():
        return out
    begins = bounds[:-1][held]
    for k in range(count):
        mixed = (grams ^ seeds[2 * k]) * (seeds[2 * k + 1] | _U(1))
        mixed ^= mixed >> _U(32)
        out[held, k] = np.minimum.reduceat(mixed * _U(0x9FB21C651E98DF25), begins)
    return out


def _sketcher(shingle: int, collections: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tx.blocks(batch.column(1)):
                grams, bounds = block_shingles(block, shingle)
                mins = minhashes(grams, bounds, collections * per)
                parts = np.stack([tx.gram_hash(mins[:, c * per: (c + 1) * per].ravel(), per)[::per] for c in range(collections)], axis=1)
                one, two = (np.append(_U(0), np.cumsum(tx.mix(grams + _U(s)))) for s in (1, 2))
                # a set's digest: its size and two sums over its shingles
                digest = [np.diff(bounds).astype(np.uint64), *(x[bounds[1:]] - x[bounds[:-1]] for x in (one, two))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.size),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([d.tobytes() for d in np.stack(digest, axis=1)], pa.binary()),
                        pa.array(list(parts.astype(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["doc", "n_shingles", "digest", "parts"],
                )

    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, collections: int = COLLECTIONS, per: int = PER_COLLECTION) -> DataFrame:
    """(doc, n_shingles, digest of the set, one hash per collection) of every document."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return base.mapInArrow(_sketcher(shingle, collections, per), f"doc {dict(base.dtypes)['doc']}, n_shingles long, digest binary, parts array<long>")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, shingles) with the full set of hashes of every document."""
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tx.blocks(batch.column(1)):
                grams, bounds = block_shingles(block, shingle)
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(grams.astype(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.size), sets], names=["doc", "shingles"])

    return base.mapInArrow(run, f"doc {dict(base.dtypes)['doc']}, shingles array<long>")


def table_keys(parts: str, collections: int) -> Column:
    """One key per pair of collections."""
    return F.array(*[F.xxhash64(F.lit(i * collections + j), F.col(parts)[i], F.col(parts)[j]) for i, j in combinations(range(collections), 2)])


def bucket_members(classes: DataFrame, collections: int) -> DataFrame:
    """(key, node, least) of every bucket with several nodes; ``least`` is the least of them.

    Spark sizes the exploded keys by the file of the classes, some hundred times too low, and would send all of them through
    the driver while that is under its limit; the hint keeps this join a shuffle at any size.
    """
    keyed = classes.select("node", F.explode(table_keys("parts", collections)).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    return keyed.hint("merge").join(buckets.select("key", "least"), "key")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets have at least ``percent`` of their union in common."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    # the sizes alone rule a pair out where even the smaller set whole would not do
    sized = 100 * F.least(F.size("of_a"), F.size("of_b")) >= percent * F.greatest(F.size("of_a"), F.size("of_b"))
    return (
        pairs.join(right, "b").join(left, "a").where(sized)
        .select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
        .where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both")))
        .select("a", "b")
    )


def open_members(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of buckets that still hold several components, with their component, size, reach and alive.

    Of a node's shingles only those that also stand in another open component can be common to a pair across
    components. With s of them a node of n shingles reaches partners of at most s * (100 + percent) / percent - n
    shingles. Two nodes that both fail to reach their own size cannot reach each other: one side of a pair is alive.
    """
    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    members = written(labelled.join(mixed, "key"), "mixed-members")
    nodes = members.select("node", "component").distinct()
    rows = sets.join(nodes, F.col("doc") == F.col("node")).select("node", "component", F.explode("shingles").alias("shingle"))
    foreign = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    shared = rows.select("node", "shingle").join(foreign, "shingle").groupBy("node").agg(F.count("*").alias("shared"))
    sized = (
        sets.select(F.col("doc").alias("node"), F.size("shingles").alias("size")).groupBy("node").agg(F.max("size").alias("size"))
        .join(shared, "node")
        .withColumn("reach", F.floor(F.col("shared") * (100 + percent) / percent) - F.col("size"))
        .withColumn("alive", F.col("reach") >= F.col("size"))
    )
    # their file is small for what the members take in memory, so they are not to be sent through the driver by its size
    return members.hint("merge").join(sized, "node")


def around_centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Every open bucket's members beside its most central one, the node with the fewest shingles of its own.

    Buckets with one centre are one group. ``apart`` holds the shingles that only one of node and centre has.
    """
    own = F.struct((F.col("reach") - F.col("size")).alias("room"), (-F.col("node")).alias("order"))
    centre = members.groupBy("key").agg(F.max_by("node", own).alias("centre"))
    groups = members.join(centre, "key").select("centre", "node", "component", "size", "reach", "alive").distinct()
    mine = sets.select(F.col("doc").alias("node"), F.col("shingles").alias("mine"))
    theirs = sets.select(F.col("doc").alias("centre"), F.col("shingles").alias("theirs"))
    apart = F.concat(F.array_except("mine", "theirs"), F.array_except("theirs", "mine"))
    return (
        groups.join(mine, "node").join(theirs, "centre")
        .select("centre", "node", "component", "size", "reach", "alive", apart.alias("apart"), F.size("theirs").alias("centre_size"))
    )


def _enough(common: Column, sizes: Column, percent: int) -> Column:
    """Whether twice the common shingles of two sets, whose sizes add up to ``sizes``, are enough."""
    return 100 * common >= percent * (2 * sizes - common)


def central_links(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between centres and the nodes around them."""
    sizes = F.col("size") + F.col("centre_size")
    linked = groups.where("node <> centre").where(_enough(sizes - F.size("apart"), sizes, percent))
    return linked.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def open_links(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components between the nodes around one centre.

    A component one of whose nodes is linked to the centre has joined it. Two sets differ in what they have apart from the
    centre, less what they have apart from it in common; so the small differences decide, exactly. One side of every pair
    has not joined. Sizes, reaches and the numbers of shingles apart rule most pairs out before their differences
    are compared.
    """
    both_sizes = F.col("size") + F.col("centre_size")
    linked = (F.col("node") == F.col("centre")) | _enough(both_sizes - F.size("apart"), both_sizes, percent)
    joined = groups.groupBy("centre", "component").agg(F.bool_or(linked).alias("joined"), F.min(F.when(F.col("alive"), F.col("size"))).alias("least"))
    # groups all of whose components have joined are done
    floors = joined.groupBy("centre").agg(F.min("least").alias("floor"), F.bool_and("joined").alias("done")).where("not done").select("centre", "floor")
    kept = groups.join(joined.drop("least").join(floors, "centre"), ["centre", "component"]).where("alive or reach >= floor")
    kept = written(kept.select("centre", "joined", "node", "component", "size", "reach", "alive", "apart", F.size("apart").alias("n")), "open-members")
    columns = ("joined", "node", "component", "size", "reach", "alive", "apart", "n")
    one = kept.where("not joined").select("centre", *[F.col(c).alias(f"{c}_a") for c in columns])
    two = kept.select("centre", *[F.col(c).alias(f"{c}_b") for c in columns])
    sizes = F.col("size_a") + F.col("size_b")
    inside = sizes - F.col("n_a") - F.col("n_b")
    return (
        one.join(
            two,
            (one["centre"] == two["centre"])
            & (F.col("joined_b") | ((F.col("component_a") != F.col("component_b")) & (F.col("node_a") < F.col("node_b"))))
            & (F.col("alive_a") | F.col("alive_b")) & (F.col("size_a") <= F.col("reach_b")) & (F.col("size_b") <= F.col("reach_a"))
            & _enough(inside + 2 * F.least("n_a", "n_b"), sizes, percent)
            & _enough(inside + 2 * F.size(F.array_intersect("apart_a", "apart_b")), sizes, percent),
        )
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    collections: int = COLLECTIONS, per: int = PER_COLLECTION,
) -> DataFrame:
    """Per document: id, n_shingles, component_id (least id reachable through links) and kept (id = component_id)."""
    sketched = written(sketches(docs, id_col, text_col, shingle, collections, per), "sketches")
    worded = sketched.where("n_shingles > 0 and doc is not null")
    # equal sets are one class; its sketch is that of any member
    classes = written(worded.groupBy("digest").agg(F.min("doc").alias("node"), F.first("parts").alias("parts")), "classes")
    members = written(bucket_members(classes, collections), "members")
    near = members.select(F.col("node").alias("doc")).distinct()
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(near, "doc", "left_semi")
    # the sets of near copies fill a file many times smaller than themselves, so its size must not decide to broadcast them
    sets = written(shingle_sets(texts, "doc", "text", shingle), "sets").hint("merge")
    pairs = members.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = written(confirmed(pairs, sets, percent), "links")
    found = components(links)
    # buckets that still hold several components meet the node most like the others, then what is still open: all pairs
    groups = written(around_centres(open_members(members.drop("least"), found, sets, percent), sets), "groups")
    more = open_links(groups, percent).unionByName(central_links(groups, percent))
    found = components(links.unionByName(more))
    linked = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    # a text without words belongs to no class; its own id as a key spreads such rows over the tasks
    by = F.when(F.col("n_shingles") > 0, F.col("digest")).otherwise(F.col("doc").cast("string").cast("binary"))
    out = sketched.withColumn("digest", by).join(linked, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("component")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
