import random
import re

import pytest
from pyspark.sql import functions as F

from lexarbor.llm import exact_dedup, jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _k long, digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, "y") for i, t, s in rows], DOCS)


def brute_exact(rows):
    groups = {}
    for n, (i, t, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for n, (i, t, _) in enumerate(rows):
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        best = min(g)[3]
        out.append((i, rows[best][0], len(g), n == best))
    return sorted(out, key=str)


ROWS = [(1, "a b", "s"), (2, "a  b", "s"), (3, "ab", None), (4, None, "s"), (5, "", "s"), (6, " \t", "s"), (7, "c" * 200_000, "s"), (8, "A b", "s"), (None, "ab", "s"), (9, "z", "s"), (9, "z", "s"), (10, "ä\u00a0", "s"), (11, "ä", "s")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.crc32(t.cast("binary")).cast("string").substr(1, 1).cast("binary")])
def test_exact_groups_with_strong_and_weak_digests(spark, digest):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.report(table(spark, ROWS), digest).collect()), key=str)
    assert got == brute_exact(ROWS)


def test_exact_filters_skip_runs(spark):
    rows = [(i, f"text {i % 350}", "s") for i in range(400)]
    entries = table(spark, rows).selectExpr("unhex(sha2(text, 256)) as digest", "doc_id", "length(text) as size", "doc_id as row")
    index = exact_dedup.LsmIndex(fanout=3, counted=True)
    for part in range(5):
        index.flush(entries.filter(F.col("doc_id") % 5 == part))
    # three of level 0 became one of level 1, two are left
    assert [r.level for r in index.runs] == [1, 0, 0]
    told = index.lookup(entries).collect()
    assert sorted((r.stays.doc_id, r.n) for r in told) == [(i, 1 + (i < 50)) for i in range(350)]
    # every digest is in one run or two, and the filters keep it from nearly all others
    held = sum(r.table.count() for r in index.runs)
    assert held <= sum(r.asked for r in told) <= held + 10
    passed = index.merged[1]
    index.compact()
    assert len(index.runs) == 1 and index.merged[1] > passed and index.runs[0].table.agg(F.sum("n")).first()[0] == 400


def test_exact_keeps_rows_and_columns(spark):
    kept = exact_dedup.deduplicate(table(spark, ROWS))
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 7, 8, 9, 10, 11]


def test_exact_same_id_other_text(spark):
    kept = exact_dedup.deduplicate(table(spark, [(1, "a", "s"), (1, "b b", "s"), (2, "bb", "s"), (3, "q", "s")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (1, "b b"), (3, "q")]


def test_empty_tables(spark):
    none = table(spark, [])
    assert exact_dedup.report(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    assert jaccard.join(none).count() == 0 and jaccard.representatives(none).count() == 0


def near_rows(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for size in (1, 2, 5, 40):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy).title() if i % 3 else " ".join(copy), "s"))
            i += 1
    return rows + [(100, None, "s"), (101, "", "s"), (102, "one two", "s"), (103, "ONE, two!", "s"), (104, "x " * 50_000, "s"), (105, "x x x x x x", "s"), (106, "?!", "s")]


def brute_near(rows, threshold=0.8):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = {i: [j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


@pytest.mark.parametrize("cell_nodes", [2048, 8])
def test_jaccard_join_is_brute_force(spark, cell_nodes):
    rows = near_rows()
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table(spark, rows), cell_nodes=cell_nodes).collect()}
    assert got == brute_near(rows)


def test_jaccard_paths_keep_their_bytes_over_batches(spark):
    """from a task's second batch on, paths had their bytes swapped, so blocks of large groups lost their links."""
    rows, key = near_rows(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table(spark, rows), cell_nodes=8).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == brute_near(rows)


def test_jaccard_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(table(spark, [(None, text, "s"), (4, text, "s"), (4, text, "s"), (None, "other words here", "s")])).collect()), key=str)
    assert got == sorted([(None, 4, 2), (4, 4, 2), (4, 4, 2), (None, None, 0)], key=str)


def test_depth_shortens_until_the_recall_is_met():
    assert jaccard.prefix_depth(0.8, 24, 8, 0.9999) == 5
    assert jaccard.prefix_depth(0.8, 24, 8, 0.5) == 8
    assert jaccard.prefix_depth(0.8, 1, 8, 0.9999) == 1


def edited_copies(rng, groups, n_words, edits):
    """Documents with copies of which so many single words are replaced, far apart."""
    rows = []
    for _ in range(groups):
        base = [f"v{rng.randrange(10**6)}" for _ in range(n_words)]
        for e in edits:
            copy = list(base)
            for i in range(e):
                copy[(i * n_words // max(1, e)) + 5] = f"q{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy), "s"))
    return rows


def test_prefixes_shorten_until_the_measured_recall_is_reached(spark):
    rng = random.Random(1)
    ended = {}
    for name, edits in (("alike", (0, 1)), ("at the threshold", (0, 4))):
        rows, depths = edited_copies(rng, 60, 200, edits), []
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table(spark, rows), target=0.9995, depths=depths).collect()}
        assert got == brute_near(rows), name
        ended[name] = depths[-1][0]
        steps = [d for d, _, _ in depths]
        assert steps[0] == 8 and steps == sorted(set(steps), reverse=True) and depths[-1][2] >= 0.9995
        assert all(recall < 0.9995 for _, _, recall in depths[:-1])
    assert ended["alike"] == 8 and ended["at the threshold"] < 8


def test_sets_of_one_hash_are_told_apart(spark):
    def prints(values, offsets):
        import numpy as np

        return np.where(np.diff(offsets) > 0, np.uint64(7), np.uint64(0)), jaccard.fingerprints(values, offsets)[1]

    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "u v w x y z", "s"), (4, "U v w x y z", "s"), (5, "g h i", "s")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table(spark, rows), prints=prints).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}
