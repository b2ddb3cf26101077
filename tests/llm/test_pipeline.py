import random

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_are_consistent_and_their_decisions_hold(spark):
    from lexarbor.llm import common, decontaminate, exact_dedup, jaccard, toxicity

    docs = common.read(spark, SF, "documents").withColumnRenamed("n_chars", "_row")
    columns, seen = docs.columns, [set(r.doc_id for r in docs.select("doc_id").collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, SF), "test")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen[-1], name
        assert docs.columns == columns + (["copies"] if name == "mix" else []), name
        if name == "exact_dedup":
            assert exact_dedup.report(docs).filter("not kept").isEmpty()
        if name == "near_dedup":
            assert jaccard.join(docs).filter("n_links > 0").isEmpty()
        if name == "decontaminate":
            assert decontaminate.report(docs, common.read(spark, SF, "benchmark")).filter("contaminated").isEmpty()
        seen.append(set(ids))
    assert len(seen[-1]) > 0
    toxic = {r.doc_id for r in toxicity.score(common.read(spark, SF, "documents"), common.read(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert seen[0] - seen[1] == toxic


def test_exact_sql(spark):
    from lexarbor.llm import queries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.SQL["op4_exact_dedup"]).fetchall())
    got = queries.QUERIES["op4_exact_dedup"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_rows_with_null_and_repeated_ids_stand_for_themselves(spark):
    from lexarbor.llm import decontaminate, jaccard, toxicity

    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base, item = say(60), say(40)
    near = base.rsplit(" ", 1)[0] + " end"
    others = [say(50) for _ in range(6)]
    rows = [(1, base, "a"), (None, base, "b"), (None, near, "c"), (7, near, "d"), (7, near, "e"), (None, others[0], "f"), (7, others[1], "g"), (1, others[2], "h"), (7, item + " " + others[3], "i"), (7, None, "j"), (None, "", "k"), (7, "", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    stays = {r.k1 for r in jaccard.representatives(docs).collect()}
    assert stays == {"a", "f", "g", "h", "i", "j", "k", "l"}
    # without the document of smallest id, of the equal rows d and e one stays
    assert len(few := {r.k1 for r in jaccard.representatives(docs.filter("k1 <> 'a'")).collect()} & {"b", "c", "d", "e"}) == 1 and few < {"d", "e"}
    kept = {r.k1 for r in decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert kept == {r[2] for r in rows} - {"i"}
    bad = [(i, f"{say(8)}. you {rng.choice(['scum', 'fool'])}. {say(5)}") for i in range(100, 200)]
    good = [(i, f"{say(8)}. {say(5)}") for i in range(200, 400)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in bad + good], "doc_id long, toxic int")
    mixed = spark.createDataFrame([*bad, *good, (None, "you scum. you fool."), (None, say(20)), (150, say(20)), (150, None)], "doc_id long, text string")
    left = sorted(map(tuple, toxicity.reject(mixed, labels).collect()), key=str)
    told = {r.text: r.predicted for r in toxicity.score(mixed, labels, keys=True).join(common_keys(mixed), ["k1", "k2"]).collect()}
    assert left == sorted((r for r in map(tuple, mixed.collect()) if not told[r[1]]), key=str)
    assert (None, "you scum. you fool.") not in left and len([r for r in left if r[0] is None]) == 1 and len([r for r in left if r[0] == 150 and not (r[1] or "").count("you")]) >= 2


def common_keys(docs):
    from lexarbor.llm import common

    return common.row_keys(docs).select("k1", "k2", "text").distinct()


def test_stages_lose_nothing_unrelated_and_take_empty_tables(spark, tmp_path):
    from lexarbor.llm import common

    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(rng.choice([None, 1, 2, i]), say(30), rng.choice(["x", "y", None])) for i in range(120)]
    rows += rows[:10] + [(5, None, "x"), (6, "", "x"), (None, " ", "x")]
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of these words is there at all in any of the texts here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, str(tmp_path)), "test")
        left = {r.text for r in docs.collect() if r.text}
        assert left >= {r[1] for r in rows if r[1] and r[1].strip()}, name
    assert docs.count() == 121  # equal texts once, whatever their ids, and the empty ones
    assert sum(r.copies for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) > 100
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.select("doc_id", "text", "source").limit(0), str(tmp_path)).count() == 0, name


def test_driver_of_the_pipeline_components_of_odd_graphs_and_few_shuffles(spark):
    """The pipeline's driver memory: plans of few shuffles. Stars that are told apart take one look; paths, hubs and negative nodes are right, too."""
    from lexarbor.llm import common

    star = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(-7, 50), (-7, -7)], "a long, b long")
    runs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = runs()
    assert {(r.node, r.root) for r in common.components(star).collect()} == {(i, 1) for i in range(1, 40)} | {(-7, -7), (50, -7)}
    assert runs() - before <= 12, runs() - before
    rng = random.Random(4)
    for edges in ([(i, i + 1) for i in rng.sample(range(60), 60)], [(5000, i) for i in range(300)] + [(5000 + i, i) for i in range(1, 200)] + [(-3, 9001)], [(4, 4)]):
        root = {}
        for a, b in edges:
            if a != b:
                old, new = sorted((root.setdefault(a, a), root.setdefault(b, b)), reverse=True)
                root = {x: new if r == old else r for x, r in root.items()}
        assert {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == root
