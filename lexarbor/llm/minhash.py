"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets and star-shaped candidate edges.

Words are runs of other characters than ASCII whitespace after lower-casing A-Z; a document's set holds the 64-bit hashes of its
shingles of three words (a text of one or two words is one shingle). Equal sets, told by 128 bits of hash, are one node.

One hash of each shingle deals it to one of bands x rows bins, and the least hash of a bin is its value. An empty bin takes the value
of the first bin that isn't empty in an order of all bins that is drawn for it once, the same for every set: so each bin agrees
with the sets' similarity as its probability, however small the sets are. `rows` bins in turn are a band, and nodes that agree in a whole band share a bucket.

A bucket's smallest node is its pivot, and its candidate edges are the star from the pivot to the others: one fewer than nodes.
Each edge is verified on the full sets. That leaves pairs of a bucket that aren't with the pivot. Those of one component need no look;
of the others the triangle inequality of Jaccard's distance rules out all whose distances to the pivot differ by more than a link's, so
only nodes of the same or neighbouring rings around the pivot, and of different components, are compared, by counting common shingles, in cells of
bounded size (pairs of blocks where a ring is larger). Rings that hold the same nodes in several buckets are compared once. No pairs are
written, nothing is capped: every pair that shares a bucket and is a link joins its components.

A pair of similarity s shares a bucket with probability 1 - (1 - s^rows)^bands: at 0.85, with 6 rows and 32 bands, all but 2.7e-7.

Null and empty texts, and those of whitespace only, have an empty set and no links. A null doc_id is a document like any other but can't name a
component unless it is alone; rows that repeat a doc_id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.llm import common, jaccard
from lexarbor.llm.kernels import SPACED, U64, mix, pieces

#: A bin that no shingle fell into.
EMPTY = np.uint32(0xFFFFFFFF)
#: Up to so many bins with a value a row's empty bins are filled by ranks, beyond by trying one after the other.
SPARSE = 16
#: Edges of a star, and shingles of their sets, that are verified beside one copy of the pivot's set.
SPOKES, SPOKE_SHINGLES = 128, 1_000_000


def one_permutation(values: np.ndarray, offsets: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """(rows x bins): the least hash in each bin of each row's set, EMPTY where there is none."""
    h = mix(values ^ mix(np.array([seed], U64)))
    n = len(offsets) - 1
    out = np.full(n * bins, EMPTY, np.uint32)
    at = np.repeat(np.arange(n), np.diff(offsets)) * bins + ((h >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    np.minimum.at(out, at, np.minimum(h & U64(0xFFFFFFFF), U64(0xFFFFFFFE)).astype(np.uint32))
    return out.reshape(n, bins)


def densified(bins: np.ndarray, order: np.ndarray) -> np.ndarray:
    """bins with each EMPTY replaced by the first value in that bin's row of `order` (a permutation of all bins); rows without any stay."""
    out, filled = bins.copy(), bins != EMPTY
    have, rank = filled.sum(1), np.argsort(order, axis=1)
    for m in range(1, SPARSE + 1):
        rows = np.flatnonzero(have == m)
        if len(rows):
            held = np.nonzero(filled[rows])[1].reshape(-1, m)
            donor = np.take_along_axis(held, rank[:, held].argmin(2).T, 1)
            out[rows] = np.where(filled[rows], bins[rows], np.take_along_axis(bins[rows], donor, 1))
    r, b = np.nonzero(~filled & (have > SPARSE)[:, None])
    for t in range(order.shape[1]):
        if not len(r):
            break
        value = bins[r, order[b, t]]
        hit = value != EMPTY
        out[r[hit], b[hit]] = value[hit]
        r, b = r[~hit], b[~hit]
    return out


def orders(bins: int, seed: int) -> np.ndarray:
    """For each bin the order in which others are asked for a value."""
    return np.random.default_rng(seed).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)


def signer(k: int, bins: int, seed: int, prints):
    """(doc_id, text) to (doc_id, raw, check, n, signature): two bytes a bin; raw is null without words."""
    order = orders(bins, seed)

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(1)):
                values, offsets = jaccard.shingles(data, rows, k, SPACED)
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                (raw, check), signature = prints(values, offsets), np.zeros((len(n), bins), ">u2")
                if len(some):
                    signature[some] = mix(densified(one_permutation(values, offsets, bins, seed)[some], order).astype(U64)) >> U64(48)
                flat = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * 2 * bins).astype(np.int32)), pa.py_buffer(signature.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(raw.view(np.int64), mask=n == 0), pa.array(check.view(np.int64)), pa.array(n.astype(np.int64)), flat], names=["doc_id", "raw", "check", "n", "signature"])

    return run


def set_views(column: pa.Array) -> list[np.ndarray]:
    """The sets in a column of bytes, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    data = column.buffers()[2]
    values = np.frombuffer(data, U64, data.size // 8) if data is not None and data.size >= 8 else np.zeros(0, U64)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def cells_of(batches, width: int):
    """(columns, sets) of each run of equal first `width` columns, of batches sorted by these whose last column holds sets."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, sets = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], set_views(batch.columns[-1])
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:width]], axis=0)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            part = [c[a:b] for c in columns], sets[a:b]
            if held is not None and all(x[0] == y[0] for x, y in zip(held[0][:width], part[0], strict=False)):
                held = [np.concatenate(x) for x in zip(held[0], part[0], strict=True)], held[1] + part[1]
                continue
            if held is not None:
                yield held
            held = part
        # what the next batch may go on with outlives this one
        held = [c.copy() for c in held[0]], [s.copy() for s in held[1]]
    if held is not None:
        yield held


def star(batches):
    """Rows (pivot, block, node, shingles) sorted by the first two to (pivot, node, common, united): sizes of intersection and union of the sets of pivot and node."""
    for (pivot, _, node), sets in cells_of(batches, 2):
        _, first = np.unique(node, return_index=True)  # a repeated document stands there twice
        centre = sets[int(np.flatnonzero(node == pivot)[0])]
        first = first[node[first] != pivot[0]]
        shared = np.zeros(len(first), np.int64)
        for i, at in enumerate(first):
            few, many = (sets[at], centre) if len(sets[at]) < len(centre) else (centre, sets[at])
            shared[i] = (many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()
        united = np.array([len(sets[at]) + len(centre) for at in first], np.int64) - shared
        yield pa.RecordBatch.from_arrays([pa.array(pivot[first]), pa.array(node[first]), pa.array(shared), pa.array(united)], names=["pivot", "node", "common", "united"])


def crosser(threshold: float):
    """Rows (cell, left, right, node, root, shingles) sorted by the first three to (a, b): a spanning forest of the links between nodes of different roots."""

    def run(batches):
        for (_, _, _, node, root), sets in cells_of(batches, 3):
            node, first = np.unique(node, return_index=True)
            root = root[first]
            if (root == root[0]).all():
                continue
            link, _ = jaccard.linked([sets[i] for i in first], threshold)
            link &= root[:, None] != root[None, :]
            least = jaccard.least_linked(link)
            some = np.flatnonzero(least != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[least[some]])], names=["a", "b"])

    return run


def near_components(docs: DataFrame, percent: int = 85, k: int = 3, bands: int = 32, rows: int = 6, seed: int = 11, spokes: int = SPOKES, spoke_shingles: int = SPOKE_SHINGLES, cell_nodes: int = jaccard.CELL_NODES, cell_shingles: int = jaccard.CELL_SHINGLES, prints: Callable = jaccard.fingerprints, told: dict | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents with 100 * intersection >= percent * union. component_id: the smallest doc_id that chains of links reach. told, if given,
    gets the numbers of nodes, candidate edges, links among them, and of nodes in rings that were compared beside.
    """
    texts = common.text_of(docs, "doc_id")
    signed = common.saved(texts.mapInArrow(signer(k, bands * rows, seed, prints), "doc_id long, raw long, check long, n long, signature binary"), "signed")
    signed = jaccard.noded(signed)
    some = signed.filter("node is not null")
    # one document stands for each node
    held = some.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("raw").alias("raw"), F.min("check").alias("check"), F.min(common.id_key(F.col("doc_id"))).alias("_k"), F.min("signature").alias("signature"))
    held = common.saved(held, "nodes")
    met = held.select("node", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), t -> xxhash64(t, substring(signature, {2 * rows} * t + 1, {2 * rows})))")).alias("bucket"))
    held = held.drop("signature")
    pivots = common.saved(met.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("in_bucket")).filter("in_bucket > 1"), "pivots")
    met = common.saved(common.lookup(met, pivots, "bucket", "in_bucket").filter("node <> pivot"), "met")
    edges = common.saved(met.select("pivot", "node").distinct(), "edges")

    def with_sets(cells: DataFrame) -> DataFrame:
        """cells (with a column node) and the sets of their nodes, taken from one document of each."""
        cells = common.saved(cells.join(held.select("node", "_k", "raw", "check"), "node"), "cells")
        sets = common.maybe(texts.select(common.id_key(F.col("doc_id")).alias("_k"), "text"), cells.select("_k").distinct()).mapInArrow(jaccard.setter(k, prints, SPACED), "_k long, raw long, check long, shingles binary")
        return cells.join(sets, ["_k", "raw", "check"])

    # the stars, each in blocks that hold the pivot's set once
    sized = edges.join(held.select("node", "n"), "node").groupBy("pivot").agg(F.count("*").alias("edges"), F.sum("n").alias("weight"))
    sized = common.saved(sized.select("pivot", "edges", F.ceil(F.greatest(F.col("edges") / spokes, F.col("weight") / spoke_shingles)).cast("int").alias("blocks")), "sized")
    out = common.lookup(edges, sized, "pivot", "edges").select("pivot", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    centres = sized.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("node"))
    dealt = with_sets(out.unionByName(centres)).select("pivot", "block", "node", "shingles").repartition("pivot", "block").sortWithinPartitions("pivot", "block")
    stars = common.saved(dealt.mapInArrow(star, "pivot long, node long, common long, united long"), "stars")
    links = stars.filter(100 * F.col("common") >= percent * F.col("united")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    roots = common.saved(common.components(links), "roots")

    # rings of width 1 - percent / 100 around the pivots, a hair wider for the rounding
    ring = F.floor((F.col("united") - F.col("common")) / F.col("united") / ((100 - percent) / 100 + 1e-9)).cast("int")
    members = met.filter("in_bucket > 2").join(stars.withColumn("ring", ring).select("pivot", "node", "ring"), ["pivot", "node"])
    members = members.join(roots, "node", "left").join(held.select("node", "n"), "node").select("bucket", "node", F.coalesce("root", "node").alias("root"), "n", F.explode(F.array_distinct(F.array(F.greatest(F.col("ring") - 1, F.lit(0)), "ring"))).alias("ring"))
    members = common.saved(members.withColumn("cell", F.xxhash64("bucket", "ring")), "members")
    rings = members.groupBy("cell").agg(F.count("*").alias("nodes"), F.sum("n").alias("weight"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    open_ = rings.filter("low <> high").groupBy("nodes", "weight", "x", "y").agg(F.min("cell").alias("cell"))
    open_ = common.saved(open_.select("cell", "nodes", F.greatest(F.ceil(F.col("nodes") / cell_nodes * 2), F.ceil(F.col("weight") / cell_shingles * 2)).cast("int").alias("blocks")).withColumn("blocks", F.when((F.col("blocks") <= 2), 1).otherwise(F.col("blocks"))), "rings")
    if told is not None:
        told |= {"nodes": held.count(), "edges": edges.count(), "links": links.count(), "ring_nodes": open_.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]}
    if not open_.isEmpty():
        block = F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int")
        split = common.lookup(members.select("cell", "node", "root"), open_, "cell", "nodes").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.select("cell", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node", "root")
        dealt = with_sets(split).select("cell", "left", "right", "node", "root", "shingles").repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right")
        crossed = common.saved(dealt.mapInArrow(crosser(percent / 100), "a long, b long"), "crossed")
        roots = common.saved(common.components(links.unionByName(crossed)), "roots")

    known = held.join(roots, "node", "left").filter("copies > 1 or root is not null")
    known = common.saved(known.select("node", F.coalesce("root", "node").alias("root"), "first", "copies"), "known")
    classes = common.saved(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("in_class")), "classes")
    named = common.saved(common.lookup(known, classes, "root", "in_class").select("node", "component_id", "copies"), "named")
    rows_ = common.lookup(some.select("doc_id", "n", "node"), named, "node", "copies").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = signed.select("doc_id", "n", "node").join(named.select("node"), "node", "left_anti").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return rows_.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
