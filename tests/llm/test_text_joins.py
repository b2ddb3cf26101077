import random
import re

import duckdb

from lexarbor.llm import decontaminate, passages, queries

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def oracle(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.toPandas())
    return sorted(con.sql(queries.SQL[name]).fetchall(), key=str)


def test_decontamination_is_sql(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 4, 8, 12, 13, 14, 20, 40])] + [(20, None), (21, ""), (22, "..."), (4, say(30))]
    docs = []
    for i in range(60):
        item = rng.choice(items)[1] or ""
        docs.append((i, f"{say(rng.randrange(40))}, {item.upper() if i % 2 else item}! {say(rng.randrange(300))}"))
    docs += [(100, None), (101, ""), (102, say(5)), (103, ("Ünï x " * 3000) + say(40))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(d, b)
    order = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == oracle("op7_winnowing_decontamination", documents=d, benchmark=b)


def test_decontamination_empty_sides(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(d, b).collect()] == [0]
    assert decontaminate.report(d.limit(0), b).count() == 0
    wide = d.selectExpr("*", "1 as row", "2 as key", "'z' as hits")
    assert decontaminate.clean(wide, b).columns == wide.columns


def planted(seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "e", "ir", "on", "ul")] + [f"x{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, fuzzy, short = say(70), say(90), say(30)
    edited = list(fuzzy)
    for at in (20, 45, 70):
        edited[at] = "changed"
    docs = {i: say(rng.randrange(80, 400)) for i in range(12)}
    for i, part in ((1, passage), (4, passage), (9, passage), (2, fuzzy), (6, edited), (3, short), (7, short)):
        at = rng.randrange(len(docs[i]))
        docs[i][at:at] = part
    return {i: " ".join(w) for i, w in docs.items()}


def test_passages_finds_long_and_fuzzy_ones_only(spark):
    texts = planted()
    rows = [*texts.items(), (50, None), (51, ""), (52, "a b c"), (None, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as row", "'s' as seeds")
    found = passages.shared(docs).collect()
    assert {(r.doc_id, r.other_id) for r in found} in ({(4, 1), (9, 1), (6, 2)}, {(4, 1), (9, 1), (9, 4), (6, 2)})
    assert all(r.end_word - r.start_word >= 50 and r.similarity >= 0.8 for r in found)
    left = {r.doc_id: r.text for r in passages.excise(docs, passages.shared(docs)).collect()}
    assert left[1] == texts[1] and len(left[4].split()) <= len(texts[4].split()) - 69 and left[50] is None


def test_passages_periodic_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one is " * 400), (2, "other words " + "one is " * 300), (3, "quite different")], "doc_id long, text string")
    assert {(r.doc_id, r.other_id) for r in passages.shared(docs).collect()} == {(2, 1)}
    assert passages.shared(docs.limit(0)).count() == 0


def test_chain_follows_order_and_breaks_at_gaps():
    import numpy as np

    x, y = np.array([0, 8, 16, 24, 200, 208]), np.array([5, 13, 99, 29, 300, 308])
    chains = passages.chain(x, y, np.full(6, 5), 0.05, 40, 20)
    assert sorted(map(tuple, chains)) == [(0, 1, 3), (2,), (4, 5)]


def test_passages_of_common_lines_are_found(spark):
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(5)]
    say = lambda i, n: " ".join(f"d{i}x{j}" for j in range(n))
    # every line and every two in a row have a first holder and many near ones that have no more of the run
    rows = [(i, f"{say(i, 30)} {lines[i % 4]} {lines[i % 4 + 1]} end{i}") for i in range(300)]
    for i in (200, 260):
        rows[i] = (i, f"{say(i, 40)} {' '.join(lines)} end{i}")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = [(r.doc_id, r.other_id, r.start_word, r.end_word) for r in passages.shared(docs).collect()]
    assert found == [(260, 200, 40, 100)]


def test_passages_with_many_edits_are_found(spark):
    rng = random.Random(2)
    rows, edits = [], {}
    for i in range(120):
        n, every = rng.choice([51, 60, 80, 100]), rng.choice([6, 8, 10, 20])
        passage = [f"w{rng.randrange(50000)}" for _ in range(n)]
        changed = [f"c{i}x{j}" if j % every == every - 1 else w for j, w in enumerate(passage)]
        edits[1000 + i] = i
        for doc, part in ((i, passage), (1000 + i, changed)):
            rows.append((doc, " ".join([f"a{doc}x{j}" for j in range(40)] + part + [f"b{doc}x{j}" for j in range(40)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = passages.shared(docs).collect()
    assert {(r.doc_id, r.other_id) for r in found} == set(edits.items())
    assert all(r.similarity >= 0.8 and r.start_word == 40 for r in found)


def test_a_passage_is_kept_where_its_chain_goes_on():
    # 60 equal words, 30 others, 5 equal ones: too few agree in all, enough in the first stretch
    assert passages.stretches([(0, 3, 60), (90, 93, 5)], [0, 0], 50, 0.8) == [(0, 60, 3, 63, 60)]


def edited(rng, passage, rate, indels):
    """The passage with a share of its words replaced, or else inserted and dropped too, and how many words stay."""
    out, same = [], 0
    for w in passage:
        how = rng.choice("sid" if indels else "s") if rng.random() < rate else ""
        same += how in ("", "i")
        out += {"": [w], "s": [f"z{rng.randrange(10**9)}"], "i": [w, f"z{rng.randrange(10**9)}"], "d": []}[how]
    return out, same


def test_passages_recall_of_edited_passages(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    # common words are common: chance 4-grams have other first holders
    say = lambda n: rng.choices(words, [1 / (i + 3) for i in range(2000)], k=n)
    rows, planted_, doc = [], {}, iter(range(100_000))
    put = lambda part: rows.append((next(doc), " ".join(say(rng.randrange(20, 200)) + part + say(rng.randrange(20, 200))))) or rows[-1][0]
    for rate in (0, 0.05, 0.1, 0.15):
        for i in range(80):
            passage = say(rng.choice([51, 60, 80, 100]))
            other, same = edited(rng, passage, rate, i % 2)
            if len(other) >= 50 and same >= 0.8 * max(len(passage), len(other)):
                planted_[put(passage), put(other)] = rate
    for _ in range(300):
        put([])
    found = {tuple(sorted((r.doc_id, r.other_id))) for r in passages.shared(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found <= set(planted_)
    for rate in (0, 0.05, 0.1, 0.15):
        of = [p for p in planted_ if planted_[p] == rate]
        assert sum(p in found for p in of) >= (1 if rate == 0 else 0.9) * len(of), rate


def test_equal_runs_of_parts_that_all_have_earlier_holders_are_found(spark):
    rng = random.Random(8)
    say = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    parts = [say(14) for _ in range(5)]
    whole = [w for p in parts for w in p]
    single = lambda i: (i, " ".join(say(60) + parts[i % 5] + say(60)))
    rows = [*map(single, range(5)), (5, " ".join(say(60) + whole + say(60))), *map(single, range(6, 42)), (42, " ".join(say(60) + whole + say(60)))]
    found = passages.shared(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.other_id, r.start_word, r.end_word, r.similarity) for r in found] == [(42, 5, 60, 130, 1.0)]


def test_passages_of_repeated_rows_nulls_and_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(30000)}" for _ in range(30_000))
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, long), (5, "x " * 30 + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("*", "1 as words", "2 as key")
    found = sorted(((r.doc_id, r.other_id, r.start_word, r.end_word) for r in passages.shared(docs).collect()), key=str)
    assert found == sorted([(1, 1, 0, 60), (None, 1, 0, 60), (5, 4, 30, 30_030)], key=str)


def test_seeds_meet_their_first_over_batches_and_partitions():
    """op9's disk: one shuffle by range tells matches; a key may go on in the next batch or partition."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted({(key, rng.randrange(40), rng.randrange(50)) for key in range(12) for _ in range(60 if key in (4, 5) else rng.randrange(1, 9))})
    seeds = [(*r, rng.choice([None, 3]), rng.getrandbits(63), rng.getrandbits(63)) for r in rows]
    first = {}
    for s in seeds:
        first.setdefault(s[0], s)
    odd = lambda a, b: sum((a ^ b) >> 2 * j & 3 > 0 for j in range(32))
    expected = sorted((row, (p := first[key])[1], pos, p[2], 64 - odd(c1, p[4]) - odd(c2, p[5]), pair or -1) for key, row, pos, pair, c1, c2 in seeds if row != first[key][1])
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=["key", "row", "pos", "pair", "c1", "c2"])
    for size, step in ((len(seeds), 7), (25, 4), (11, 100)):
        out = [r for a in range(0, len(seeds), size) for b in passages.matcher()(batch(seeds[a : a + size][i : i + step]) for i in range(0, len(seeds[a : a + size]), step)) for r in b.to_pylist()]
        edge = {}
        for r in out:
            if r["kind"]:
                edge[r["key"]] = min(edge.get(r["key"], (99,)), (r["row"], r["pos"], r["c1"], r["c2"]))
        got = [(r["row"], r["pivot"], r["pos"], r["at"], r["agree"], r["pair"] or -1) for r in out if r["kind"] == 0]
        for r in out:
            if r["kind"] == 1 and r["row"] != (p := edge[r["key"]])[0]:
                got.append((r["row"], p[0], r["pos"], p[1], 64 - odd(r["c1"], p[2]) - odd(r["c2"], p[3]), r["pair"] or -1))
        assert sorted(got) == expected
        assert len(edge) <= 2 * -(-len(seeds) // size) and np.unique([r["kind"] for r in out]).size >= 2


def test_op9_disk_only_seeds_near_a_span_meet_the_join(spark):
    seeds = [(r, p, 1000 * r + p) for r in range(6) for p in range(0, 200, 3)]
    spans = {1: [(0, 50), (90, 141)], 3: [(31, 97)], 9: [(0, 60)]}
    table = spark.createDataFrame([(r, s) for r, s in spans.items()], "row long, spans array<struct<start:long,end:long>>")
    got = passages.uncovered(spark.createDataFrame(seeds, "row long, pos int, key long"), table)
    assert sorted(map(tuple, got.collect())) == [s for s in seeds if not any(a <= s[1] < b for a, b in spans.get(s[0], ()))]
    assert "_maybe" in got._jdf.queryExecution().analyzed().toString()


def test_op9_disk_seeds_inside_a_span_meet_no_join(spark):
    seeds = [(r, p, 1000 * r + p) for r in range(6) for p in range(0, 400, 3)]
    spans = {1: [(0, 50), (90, 341)], 3: [(31, 397), (64, 200)], 9: [(0, 60)]}
    table = spark.createDataFrame([(r, s) for r, s in spans.items()], "row long, spans array<struct<start:long,end:long>>")
    lengths = spark.createDataFrame([(r, 403) for r in range(6)] + [(9, 60), (10, 0)], "row long, n int")
    frame = spark.createDataFrame(seeds, "row long, pos int, key long")
    got = passages.uncovered(frame, table, lengths)
    assert sorted(map(tuple, got.collect())) == [s for s in seeds if not any(a <= s[1] < b for a, b in spans.get(s[0], ()))]
    assert got._jdf.queryExecution().analyzed().toString().count("_maybe") > passages.uncovered(frame, table)._jdf.queryExecution().analyzed().toString().count("_maybe")


def test_op9_disk_only_blocks_near_a_chain_are_moved(spark):
    import numpy as np

    size, rng = passages.BLOCK, np.random.default_rng(3)
    rows = {r: rng.integers(0, 1 << 32, n, dtype=np.uint32) for r, n in ((0, 40 * size + 7), (3, 5), (1 << 33, 3 * size), (7, 0), (8, 30 * size))}
    held = spark.createDataFrame([(r, bytearray(w.tobytes())) for r, w in rows.items()], "row long, words binary")
    asked = [(0, 70, 300), (0, 39 * size + 1, 41 * size), (3, 0, 100), (1 << 33, size, 2 * size)]
    got = passages._blocks(spark.createDataFrame(asked, "row long, low long, high long"), held).collect()
    got = {r.row: (list(r.blocks), np.frombuffer(bytes(r.words), np.uint32)) for r in got}
    for row, low, high in asked:
        blocks, words = got[row]
        at = blocks.index(low // size) * size + low % size
        assert (words[at : at + high - low][: len(rows[row]) - low] == rows[row][low:high]).all()
    assert sum(len(w) for _, w in got.values()) < 12 * size and 7 not in got


def test_f5_passages_whose_seeds_all_have_earlier_holders_are_found(spark):
    rng = random.Random(4)
    say = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    rows, expected = [], set()
    for i in range(20):
        passage = say(80)
        # every seed and pair of seeds stands in an earlier text that holds nothing else of the passage
        for at in range(0, 80, 8):
            rows.append((1000 * i + at, " ".join(say(40) + passage[at : at + 24] + say(40))))
        changed = [f"c{i}x{j}" if j % 9 == 8 else w for j, w in enumerate(passage)]
        rows += [(1000 * i + 500, " ".join(say(40) + passage + say(40))), (1000 * i + 600, " ".join(say(40) + changed + say(40)))]
        expected.add((1000 * i + 600, 1000 * i + 500))
    found = {(r.doc_id, r.other_id) for r in passages.shared(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert len(expected - found) == 0 and found <= expected


def test_f7_seeds_meet_all_holders_of_their_key_wherever_they_lie(spark, monkeypatch):
    monkeypatch.setattr(passages, "CELL", 64)
    rng = random.Random(11)
    seeds, context = [], {}
    for key, n in ((1, 700), (2, 3), (3, 1), (4, 60), (5, 20)):
        for i in range(n):
            now = (rng.getrandbits(63), rng.getrandbits(63))
            if i > 5 and rng.random() < 0.3:
                # a few words differ from those around some earlier seed
                now = tuple(c ^ (rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63)) for c in context[key, rng.choice([0, i // 2, i - 1])])
            context[key, i] = now
            seeds.append((key, i // 2, i % 2, None, *now))
    same = lambda a, b: 64 - sum((x ^ y) >> 2 * j & 3 > 0 for x, y in zip(a[4:], b[4:], strict=True) for j in range(32))
    expected = set()
    for key in range(1, 6):
        held = sorted(s for s in seeds if s[0] == key)
        for i, s in enumerate(held):
            if s[1] != held[0][1] and (least := same(s, held[0]) + 1) <= passages.ASK:
                close = [(-a, o[1], o[2]) for o in held[1:i] if o[1] != s[1] and (a := same(s, o)) >= max(least, passages.CLOSE)]
                expected |= {(s[1], o[1], s[2], o[2], -o[0]) for o in ([min(close), min(close, key=lambda o: o[1:])] if close else [])}
    assert len(expected) > 100
    rows = spark.createDataFrame(seeds, "key long, row long, pos int, pair long, c1 long, c2 long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 6):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            matched, others = passages._matches(rows)
            assert {tuple(r) for r in others.select("row", "pivot", "pos", "at", "agree").collect()} == expected
            assert matched.count() == sum(s[1] > 0 for s in seeds)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
