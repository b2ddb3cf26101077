import json
import random

import pytest
from pyspark.sql import functions as F

from lexarbor.operators import lemmas, prompts, sampling
from lexarbor.sources import readers, sinks


def test_json_array_is_one_file_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"é {i}\n\"x\"", None if i % 2 else {"a": [i]}) for i in range(1000)], "id long, text string, more map<string, array<int>>").coalesce(1).repartitionByRange(7, "id").sortWithinPartitions("id")
    path = str(tmp_path / "a.json")
    sinks.json_array(rows, path)
    whole = open(path, encoding="utf-8").read()
    assert json.loads(whole) == [{"id": i, "text": f"é {i}\n\"x\"", "more": None if i % 2 else {"a": [i]}} for i in range(1000)]
    assert whole == json.dumps(json.loads(whole), ensure_ascii=False, indent=4) + "\n"
    assert readers.json_array(spark, path, rows.schema).count() == 1000
    sinks.json_array(rows.limit(0), path)
    assert json.load(open(path)) == []
    sinks.json_array(spark.range(2).coalesce(1), f"file://{tmp_path}/b.json", indent=2)
    assert json.load(open(tmp_path / "b.json")) == [{"id": 0}, {"id": 1}]
    with pytest.raises(Exception, match="a.json"):
        sinks.json_array(rows, path, overwrite=False)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"]


def test_json_array_of_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.json_array(bad, str(tmp_path / "c.json"))
    assert list(tmp_path.iterdir()) == []


def test_grammar_alternatives_conditions_and_loops(spark):
    g = prompts.Grammar("{a}|{a}|{c}|{n}|{s}", {"a": ["x{b}", "y"], "b": ["1", "2"], "c": prompts.When("a", {"y": "why {b}"}, "else"), "n": prompts.Number(1, 3, 10), "s": prompts.Several(["p", "q", "r"], 2, "+")})
    seen = set()
    for r in spark.range(300).select(g.column(5, F.col("id")).alias("t")).collect():
        a, again, c, n, s = r.t.split("|")
        assert a == again and (c in ("why 1", "why 2") if a == "y" else c == "else") and int(n) in (10, 20, 30) and len(set(s.split("+"))) == 2
        seen |= {a, c, n}
    assert seen == {"x1", "x2", "y", "why 1", "why 2", "else", "10", "20", "30"}
    with pytest.raises(ValueError):
        prompts.Grammar("{a}", {"a": ["{b}"], "b": ["{a}"]}).column(1, F.col("id"))


def test_suffix_rules_guess_held_out_words(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(600)]
    make = [lambda s: (s + "ka", s + "k"), lambda s: (s + "ies", s + "y"), lambda s: (s + "ing", s + "e"), lambda s: (s + "n", s + "n")]
    pairs = [rng.choice(make)(s) for s in dict.fromkeys(stems)]
    df = spark.createDataFrame([*pairs, (None, "x"), ("x", None)], "word string, lemma string").withColumn("u", sampling.uniform(1, F.coalesce("word", F.lit(""))))
    table = lemmas.rules(df.filter("u < 0.8"))
    told = lemmas.guessed(df.filter("u >= 0.8 and word is not null").select("word", F.lit(1).alias("lemma")), table)
    want = dict(pairs)
    rows = told.collect()
    assert len(rows) > 80 and sum(r.lemma == want[r.word] for r in rows) >= 0.97 * len(rows)
    assert {(r.ending, r.cut, r.put) for r in table.filter("ending in ('ies', 'ing', 'ka')").collect()} == {("ies", 3, "y"), ("ing", 3, "e"), ("ka", 1, "")}
    plain = lemmas.guessed(spark.createDataFrame([("q",), ("",), (None,), ("zzies",), ("zzies",)], "word string"), table).collect()
    assert sorted((r.word or "-", r.lemma or "-") for r in plain) == [("-", "-"), ("-", "-"), ("q", "q"), ("zzies", "zzy"), ("zzies", "zzy")]
    assert lemmas.guessed(told.limit(0), table).count() == 0 and lemmas.rules(df.limit(0)).count() == 0
