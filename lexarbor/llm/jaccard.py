"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Words are runs of [0-9a-z and all beyond ASCII] after lower-casing A-Z; a document's set holds the 64-bit hashes of its
shingles of five words (a text of one to four words is one shingle). Equal sets are one node with so many copies.

Each tree of the forest gives a node a path of max_depth MinHash values (16 bits of each). The paths of a tree are sorted, over
all partitions, which is its trie: the longest prefix that a node shares with a neighbour says from which depth on it meets others,
and nodes that meet none above the least depth are left out from there on. Matching begins at the full paths. Nodes whose
prefixes match form candidate components; within a component all pairs not compared before are compared exactly, by counting
common shingles in one task. The similarities of the links found so far say how many more there are: a link of similarity s is
met at depth d in one of the trees with probability 1 - (1 - s^d)^trees. The prefixes are shortened to the depth that these figures
ask for, and measured again, until the recall reaches target, or the depth at which even links right at the threshold are met that surely (prefix_depth).

Components beyond CELL_NODES nodes or CELL_SHINGLES shingles are dealt out by trie node instead, and a trie node
beyond these limits in pairs of blocks, where a pair counts in the first tree it shares: nothing is left out, and no
task ever holds more than a pair of blocks. Tasks return counts, similarities in bins and a spanning forest, never all pairs of a group.

Results are exact for all pairs that meet; equal sets are told by 128 bits of hash. Texts without a word link to nothing. A null doc_id is a document like any
other, but can't name a class unless it is alone. Rows that repeat a doc_id are documents of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarbor.llm import common
from lexarbor.llm.kernels import LOWER, U64, grams, mix, pieces, window_starts, words

#: Limits of what one task compares at once.
CELL_NODES = 2048
CELL_SHINGLES = 4_000_000


def prefix_depth(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """The longest prefix that meets a link at the threshold with probability target in one of the trees."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingles(data: np.ndarray, rows: np.ndarray, k: int, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and offsets of the rows in them."""
    h, _, _, first = words(data, rows, table)
    n_words = np.diff(first)
    values, owner = grams(h, k), np.repeat(np.arange(len(n_words)), np.maximum(n_words - k + 1, 0))
    values = values[window_starts(first, k)] if len(values) else values
    for short in range(1, k):
        at = np.flatnonzero(n_words == short)
        if len(at):
            values, owner = np.concatenate([values, grams(h, short)[first[at]]]), np.concatenate([owner, at])
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    offsets = np.searchsorted(owner, np.arange(len(n_words) + 1))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(n_words) + 1))


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set; rows without shingles get 0."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((2, len(offsets) - 1), U64)
    if len(some):
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
            out[i, some] = mix(np.add.reduceat(mix(values ^ U64(salt)), offsets[some]) + np.diff(offsets)[some].astype(U64))
    return out[0], out[1]


def signer(k: int, trees: int, depth: int, seed: int, prints):
    """(who, text) to (who, raw, check, n, paths): each tree's path, two bytes a value; raw is null without words."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, trees * depth, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(1)):
                values, offsets = shingles(data, rows, k)
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                (raw, check), paths = prints(values, offsets), np.zeros((len(n), trees * depth), ">u2")
                if len(some):
                    x, at = (values >> U64(32)).astype(np.uint32), offsets[some]
                    for i in range(trees * depth):
                        paths[some, i] = mix(np.minimum.reduceat(x * a[i] + b[i], at).astype(U64)) >> U64(48)
                size = 2 * trees * depth
                flat = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * size).astype(np.int32)), pa.py_buffer(paths.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(raw.view(np.int64), mask=n == 0), pa.array(check.view(np.int64)), pa.array(n.astype(np.int64)), flat], names=["who", "raw", "check", "n", "paths"])

    return run


def setter(k: int, prints, table: np.ndarray = LOWER):
    """(id, text) to (_k, raw, check, shingles): the sets themselves, as bytes."""

    def run(batches):
        for batch in batches:
            for row, data, rows in pieces(batch.column(1)):
                values, offsets = shingles(data, rows, k, table)
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), *(pa.array(f.view(np.int64)) for f in prints(values, offsets)), sets], names=["_k", "raw", "check", "shingles"])

    return run


def walker(depth: int, least: int):
    """Sorted (tree, path, node) to those that share `least` values with a neighbour or more, and how many (deep).

    What a partition's first and last row share with the next partition isn't known here, so these count as matched.
    """

    def told(tree, paths, node, before, last):
        same = np.cumprod(np.c_[tree[1:] == tree[:-1], paths[1:] == paths[:-1]], axis=1)[:, 1:].sum(1) if len(tree) > 1 else np.zeros(0, np.int64)
        deep = np.maximum(np.r_[before, same], np.r_[same, depth])
        n = len(tree) if last else len(tree) - 1
        kept = np.flatnonzero(deep[:n] >= least)
        raw = paths[kept].astype(">u2").tobytes()  # numpy joins batches in the machine's byte order
        flat = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer((np.arange(len(kept) + 1) * 2 * depth).astype(np.int32)), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([pa.array(tree[kept]), flat, pa.array(node[kept]), pa.array(deep[kept].astype(np.int32))], names=["tree", "path", "node", "deep"]), (same[-1] if len(same) else before)

    def run(batches):
        held, before = None, depth
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1)
            start = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
            paths = np.frombuffer(raw.buffers()[2], ">u2")[start // 2 : start // 2 + depth * len(raw)].reshape(-1, depth)
            now = [batch.column(0).to_numpy(), paths, batch.column(2).to_numpy()]
            if held is not None:
                now = [np.concatenate(c) for c in zip(held, now, strict=True)]
            out, before = told(*now, before, False)
            held = [c[-1:] for c in now]
            yield out
        if held is not None:
            yield told(*held, before, True)[0]

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common values of every two sets: rare values pair by pair, frequent ones by a matrix product."""
    m = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    size = np.diff(np.r_[head, len(values)])
    inter = np.zeros(m * m, np.float32)
    often = size > max(8, min(64, m // 8))
    rare = np.repeat(~often & (size > 1), size)
    v, o = values[rare], owner[rare]
    for shift in range(1, int(size[~often].max(initial=1))):
        same = v[shift:] == v[:-shift]
        inter += np.bincount(o[:-shift][same] * m + o[shift:][same], minlength=m * m)
    inter = inter.reshape(m, m)
    inter += inter.T.copy()
    for at in range(0, int(often.sum()), 4096):
        heads, sizes = head[often][at : at + 4096], size[often][at : at + 4096]
        dense = np.zeros((m, len(heads)), np.float32)
        column = np.repeat(np.arange(len(heads)), sizes)
        entry = np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(heads, sizes)
        dense[owner[entry], column] = 1
        inter += dense @ dense.T
    return inter


def linked(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which sets are as similar as the threshold, and how similar (about)."""
    inter = common_counts(sets)
    n = np.array([len(s) for s in sets], np.float32)
    union = n[:, None] + n[None, :] - inter
    link = inter >= threshold * union - 1e-3
    # near the threshold in float32: decide with integers
    for i, j in np.argwhere(np.triu(link & (inter < threshold * union + 1e-2), 1)):
        link[i, j] = link[j, i] = round(float(inter[i, j])) >= threshold * (len(sets[i]) + len(sets[j]) - round(float(inter[i, j]))) - 1e-9
    np.fill_diagonal(link, False)
    return link, inter / union


def least_linked(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row that chains of them reach."""
    root = np.arange(len(link))
    while True:
        low = np.minimum(root, np.where(link, root[None, :], len(link)).min(1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def comparer(threshold: float):
    """Rows (cell, left, right, block, node, copies, done, prefixes, earlier, shingles) sorted by cell to (node, links, root).

    done: nodes with the same one have been compared. prefixes: the trie nodes at this depth, earlier: at the one before. Rows
    without a node say how many links (links) have a similarity of so many hundredths (root).
    """

    def compare(rows: list) -> tuple | None:
        rows = list({r[4]: r for r in rows}.values())
        if len(rows) < 2:
            return None
        cell, left, right = rows[0][0], rows[0][1], rows[0][2]
        nodes, copies = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        link, similarity = linked([np.frombuffer(r[9], dtype=U64) for r in rows], threshold)
        done = np.array([-1 if r[6] is None else r[6] for r in rows], np.int64)
        known = np.array([r[6] is not None for r in rows])
        link &= ~((done[:, None] == done[None, :]) & known[:, None] & known[None, :])
        if left is not None:
            block = np.array([r[3] for r in rows])
            link &= ((block[:, None] == left) & (block[None, :] == right)) | ((block[:, None] == right) & (block[None, :] == left))
            prefixes, earlier = (np.array([r[c] for r in rows], np.int64) for c in (7, 8))
            for i in range(len(rows)):
                js = np.flatnonzero(link[i, i + 1 :]) + i + 1
                if len(js):
                    same = prefixes[js] == prefixes[i]
                    first = prefixes[i][same.argmax(1)]
                    link[i, js] = link[js, i] = (first == cell) & ~(earlier[js] == earlier[i]).any(1)
        count, root = link @ copies, least_linked(link)
        some = count > 0
        bins = np.bincount((similarity[np.triu(link, 1)] * 100 + 1e-3).astype(np.int64), minlength=101)
        return nodes[some], count[some], nodes[root[some]], bins

    def batch(out: list) -> pa.RecordBatch:
        nodes, links, roots = (np.concatenate([x[i] for x in out]).astype(np.int64) for i in range(3))
        bins = np.sum([x[3] for x in out], axis=0)
        at = np.flatnonzero(bins)
        none = np.r_[np.zeros(len(nodes), bool), np.ones(len(at), bool)]
        return pa.RecordBatch.from_arrays([pa.array(np.r_[nodes, at], mask=none), pa.array(np.r_[links, bins[at]]), pa.array(np.r_[roots, at])], names=["node", "links", "root"])

    def run(batches):
        held, out, key = [], [], None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for r in zip(*columns, strict=True):
                if r[:3] != key:
                    if x := compare(held):
                        out.append(x)
                    held, key = [], r[:3]
                    if len(out) >= 500:
                        yield batch(out)
                        out = []
                held.append(r)
        if x := compare(held):
            out.append(x)
        if out:
            yield batch(out)

    return run


def measured_recall(found: dict[int, int], depth: int, trees: int, at: int | None = None) -> float:
    """From the links found down to a depth (by hundredths of similarity, each met with its probability) the share that they are
    of all; or the share that is to be expected `at` another depth."""
    met = lambda s, d: 1 - (1 - (s / 100) ** d) ** trees
    total = sum(n / met(s, depth) for s, n in found.items())
    return sum(n * (met(s, at) / met(s, depth) if at else 1) for s, n in found.items()) / total if total else 0.0


def noded(signed: DataFrame) -> DataFrame:
    """signed with a column node: one long for each set, null without words. Sets of one hash that the other hash tells apart are nodes of their own."""
    twins = common.saved(signed.filter("raw is not null").groupBy("raw").agg(F.min("check").alias("one"), F.max("check").alias("other")).filter("one <> other").select("raw", "one"), "twins")
    if twins.isEmpty():
        return signed.withColumn("node", F.col("raw"))
    return signed.join(twins, "raw", "left").withColumn("node", F.when(F.col("check") != F.col("one"), F.xxhash64("raw", "check")).otherwise(F.col("raw"))).drop("one")


def join(docs: DataFrame, threshold: float = 0.8, k: int = 5, trees: int = 24, max_depth: int = 8, target: float = 0.9999, seed: int = 7, cell_nodes: int = CELL_NODES, cell_shingles: int = CELL_SHINGLES, prints: Callable = fingerprints, depths: list | None = None, keys: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, n_links; with keys also k1 and k2 of common.row_keys, and class, a number for the class (null: no links).

    n_links: how many other documents have a similarity of threshold or more with it. class_id: the smallest doc_id
    that chains of such links reach. prints: two 64-bit hashes of a set. depths, if given, gets (depth, links found so far, measured recall) of each round.
    """
    least = prefix_depth(threshold, trees, max_depth, target)
    texts = common.text_of(docs, "doc_id")
    who, named = (("doc_id", "k1", "k2"), common.row_keys(texts)) if keys else (("doc_id",), texts)
    signed = named.select(F.struct(*who).alias("who"), "text").mapInArrow(signer(k, trees, max_depth, seed, prints), f"who struct<{', '.join(f'{c}:long' for c in who)}>, raw long, check long, n long, paths binary")
    signed = common.saved(signed.select("who.*", "raw", "check", "n", "paths"), "signed")
    signed = noded(signed)
    some = signed.filter("node is not null")
    # one document stands for each node
    held = some.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("raw").alias("raw"), F.min("check").alias("check"), F.min(common.id_key(F.col("doc_id"))).alias("_k"), F.min("paths").alias("paths"))
    held = common.saved(held, "nodes")
    size = 2 * max_depth
    paths = held.select("node", "paths", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("tree", F.expr(f"substring(paths, {size} * tree + 1, {size})").alias("path"), "node")
    trie = common.saved(paths.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node").mapInArrow(walker(max_depth, least), "tree int, path binary, node long, deep int"), "trie")
    trie, held = common.narrow(trie, trie.count()), held.drop("paths")

    depth, before, done, rounds, bins = max_depth, None, None, [], {}
    while True:
        met = trie.filter(F.col("deep") >= depth).select("node", F.expr(f"xxhash64(tree, substring(path, 1, {2 * depth}))").alias("bucket"))
        shared = common.saved(met.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("in_bucket")).filter("in_bucket > 1"), "shared")
        met = common.saved(common.lookup(met, shared, "bucket", "in_bucket"), "met")
        parts = common.saved(common.components(met.select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "parts")
        sized = parts.join(held, "node")
        sized = common.saved(sized.withColumn("done", F.lit(None).cast("long")) if done is None else sized.join(done, "node", "left"), "sized")
        whole = sized.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n").alias("weight"), (F.count("done") < F.count("*")).alias("some"), F.min("done").alias("low"), F.max("done").alias("high"))
        whole = common.saved(whole.select("root", "nodes", (F.col("some") | (F.col("low") < F.col("high"))).alias("fresh"), ((F.col("nodes") <= cell_nodes) & (F.col("weight") <= cell_shingles)).alias("fits")), "whole")
        routed = common.saved(common.lookup(sized, whole, "root", "nodes"), "routed")
        found = common.saved(_compared(texts, signed, met, routed, threshold, trees, max_depth, depth, before, cell_nodes, cell_shingles, setter(k, prints)), "found")
        rounds.append(found.filter("node is not null"))
        for r in found.filter("node is null").groupBy("root").agg(F.sum("links").alias("n")).collect():
            bins[r.root] = bins.get(r.root, 0) + r.n
        recall = measured_recall(bins, depth, trees)
        if depths is not None:
            depths.append((depth, sum(bins.values()), recall))
        common.dropped(shared, met, parts, sized, whole)
        if recall >= target or depth <= least:
            break
        done = common.saved(routed.select("node", F.when(F.col("fits"), F.col("root")).otherwise(F.col("done")).alias("done")), "done")
        before = depth
        # the longest prefix at which the recall is to be expected; what is met there tells whether that was right
        depth = next((d for d in range(depth - 1, least, -1) if measured_recall(bins, depth, trees, d) >= target), least) if bins else depth - 1

    found = functools.reduce(DataFrame.unionByName, rounds)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = held.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).filter("copies > 1 or links is not null")
    known = common.saved(known.select("node", "root", "first", "copies", "links"), "known")
    classes = common.saved(known.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("n")), "classes")
    told = common.lookup(known, classes, "root").select("node", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("root").alias("class"))
    told = common.saved(told, "told")
    out = [*who, "class_id", "n_links", *(["class"] if keys else [])]
    linked_ = common.lookup(some.select(*who, "node"), told, "node", "copies").withColumns({"class_id": F.coalesce("class_id", "doc_id"), "n_links": F.col("n_links").cast("long")})
    alone = signed.select(*who, "node").join(told.select("node"), "node", "left_anti").withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "class": F.lit(None).cast("long")})
    return linked_.select(*out).unionByName(alone.select(*out))


def _compared(texts: DataFrame, signed: DataFrame, met: DataFrame, routed: DataFrame, threshold: float, trees: int, max_depth: int, depth: int, before: int | None, cell_nodes: int, cell_shingles: int, sets_of: Callable) -> DataFrame:
    """comparer()'s rows for the candidates that meet at this depth and haven't been compared."""
    none, ids = F.lit(None).cast("int"), ["node", "_k", "raw", "check", "copies", "done"]
    one = routed.filter("fits and fresh").select(*ids, F.col("root").alias("cell"), none.alias("left"), none.alias("right"), F.lit(0).alias("block"))
    cells = one
    if not routed.filter("not fits").isEmpty():
        dealt = met.select("node", "bucket").join(routed.filter("not fits").select(*ids, "n"), "node")
        loads = dealt.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / (cell_nodes / 2)), F.ceil(F.sum("n") / (cell_shingles / 2))).cast("int").alias("blocks"), F.count("*").alias("in_bucket"))
        loads, dealt = common.saved(loads, "loads"), common.saved(dealt, "dealt")
        block = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
        pairs = common.lookup(dealt, loads, "bucket", "in_bucket").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        many = pairs.select(*ids, F.col("bucket").alias("cell"), F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block")
        cells = one.unionByName(many)
    cells = common.saved(cells, "cells")
    at = lambda d: F.expr(f"transform(sequence(0, {trees - 1}), t -> xxhash64(t, substring(paths, {2 * max_depth} * t + 1, {2 * d})))")
    earlier = at(before) if before else F.expr(f"transform(sequence(0, {trees - 1}), t -> cast(node as long))")
    big = cells.filter("left is not null").select("node", "_k").distinct()
    tries = signed.select("node", common.id_key(F.col("doc_id")).alias("_k"), "paths").join(big, ["node", "_k"]).groupBy("node", "_k").agg(F.min("paths").alias("paths")).select("node", at(depth).alias("prefixes"), earlier.alias("earlier"))
    carriers = cells.select("_k").distinct()
    sets = common.maybe(texts.select(common.id_key(F.col("doc_id")).alias("_k"), "text"), carriers).mapInArrow(sets_of, "_k long, raw long, check long, shingles binary")
    # rows that repeat a doc_id and its set would be there twice; comparer() takes a node once
    full = cells.join(tries, "node", "left").join(sets, ["_k", "raw", "check"])
    full = full.select("cell", "left", "right", "block", "node", "copies", "done", "prefixes", "earlier", "shingles").repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right")
    return full.mapInArrow(comparer(threshold), "node long, links long, root long")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay: of each class the one of smallest doc_id (null last; of rows that share it the one of smallest hash, of equal rows any one), and all
    that have no links."""
    told = common.saved(join(docs, keys=True, **how).filter("class is not null").select("class", F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"), "linked")
    rank = F.struct("none", "doc_id", "k1", "k2")
    best = common.saved(told.groupBy("class").agg(F.min(rank).alias("best"), F.count("*").alias("n")), "best")
    ranked = common.saved(common.lookup(told, best, "class").select("k1", "k2", (rank == F.col("best")).alias("stays")), "ranked")
    gone = common.saved(ranked.filter("not stays").select("k1", "k2").distinct(), "near")
    once = common.saved(ranked.filter("stays").groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2"), "equal")
    return common.without_rows(docs, gone, once)
