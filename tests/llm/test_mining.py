import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from lexarbor.llm import collocations, jaccard, minhash, queries, spelling


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def oracle(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.toArrow())
    return sorted(con.sql(queries.SQL[name]).fetchall(), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


# near components


def sets_of(rows):
    out = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        out.append({tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set())
    return out


def plain_components(rows):
    """All pairs, chains of links by repeated minima."""
    sets, ids = sets_of(rows), [i for i, _ in rows]
    linked = [[j for j in range(len(rows)) if j != i and a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j])] for i, a in enumerate(sets)]
    low = [float("inf") if i is None else i for i in ids]
    while (new := [min([low[i], *(low[j] for j in linked[i])]) for i in range(len(rows))]) != low:
        low = new
    name = [None if x == float("inf") else x for x in low]
    return sorted([(i, len(s), c, i == c) for i, s, c in zip(ids, sets, name, strict=True)], key=str)


def near_rows(seed=3):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = []
    for size in (4, 7, 9, 30, 120):
        base = say(size)
        for _ in range(14):  # a drift: chains of links between texts that aren't linked themselves
            rows.append(" ".join(base))
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(["new", "other", "w1"])
    rows += [" ".join(say(rng.randrange(1, 40))) for _ in range(60)]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


def test_near_components_are_all_pairs(spark):
    rows = near_rows() + [(2000, None), (2001, ""), (2002, " \t"), (2003, "One"), (2004, "one"), (2005, "one two"), (None, "A lone text without an id"), (None, "x y z a b c d e f g"), (7000, "x y z a b c d e f g"), (7000, "x y z a b c d e f g"), (7001, "\x00 nul\x00 x"), (7002, "nul x"), (7003, "é è ê"), (7004, "É è ê")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert got(minhash.near_components(docs.selectExpr("*", "1 as node", "'r' as root", "2 as n"))) == want
    assert oracle("op11_minhash_star_components", documents=docs) == want


def test_near_components_in_small_cells(spark):
    rows = near_rows(4)
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), {}
    # few values in a band: nearly everything meets, so stars and rings are large and many pairs are no links
    assert got(minhash.near_components(docs, bands=24, rows=1, spokes=3, cell_nodes=6, told=told)) == plain_components(rows)
    assert told["ring_nodes"] > 0 and told["edges"] > told["links"] > 0
    # sets that share one of their hashes stay apart
    weak = lambda values, offsets: (np.where(np.diff(offsets) > 0, np.uint64(5), np.uint64(0)), jaccard.fingerprints(values, offsets)[1])
    assert got(minhash.near_components(docs, prints=weak)) == plain_components(rows)


def test_near_components_empty_and_long(spark):
    rng = random.Random(1)
    long = [f"v{rng.randrange(20000)}" for _ in range(40_000)]
    other = [w if i % 60 else "changed" for i, w in enumerate(long)]
    docs = spark.createDataFrame([(5, " ".join(long)), (3, " ".join(other)), (4, "short text here")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_components(docs).collect()} == {5: 3, 3: 3, 4: 4}
    assert minhash.near_components(docs.limit(0)).count() == 0


def test_densified_bins_agree_like_the_sets():
    rng = np.random.default_rng(0)
    bins, order = 192, minhash.orders(192, 5)
    for size, same in ((7, 6), (40, 34), (2000, 1700)):
        agree = []
        for seed in range(30):
            values = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            a, b = values[:size], np.r_[values[:same], values[size : 2 * size - same]]
            both = minhash.densified(minhash.one_permutation(np.r_[a, b], np.array([0, size, 2 * size]), bins, seed), order)
            assert (both != minhash.EMPTY).all()
            agree.append((both[0] == both[1]).mean())
        assert abs(np.mean(agree) - same / (2 * size - same)) < 0.06, size


# spelling variants


def plain_vocabulary(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    v = plain_vocabulary(rows)
    near = {w: [x for x in v if one_edit(w, x)] for w in v}
    form = {w: best for w in v if near[w] and v[best := min(near[w], key=lambda x: (-v[x], x))] >= 5 * v[w]}
    out = []
    for w in v:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, v[w], len(near[w]), v[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_variants_are_plain_ones(spark):
    rng = random.Random(2)
    words = ["lettre", "lettres", "étrange", "ÉTRANGE", "aaaaaa", "aaaaaaa", "aaabaaa", "balloon", "baloon", "ballon", "abcdefghij", "Straße", "x×y÷zz", "commune", "communes", "Comunes"]
    rows = [(i if i % 50 else None, " ".join(rng.choices(words, [1 / (j + 1) ** 2 for j in range(len(words))], k=rng.randrange(60))) + rng.choice(["", "! abcdefghij7abcdefghi", "_commune-"])) for i in range(500)]
    rows += [(1, None), (2, ""), (3, "q" * 3000 + " " + "q" * 3001), (3, "q" * 3000)] + [(i, "q" * 3000 + " " + "q" * 3001) for i in range(10, 14)]
    rows += [(10_000 + i, "abcdefgh " * 200 + "abcdefgi " * 30 + "abcdefii " * 5) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(rows)
    assert any(f and r != f for _, f, r, *_ in want)  # a path of two steps
    assert got(spelling.variants(docs.selectExpr("*", "1 as n", "'w' as word", "'r' as run", "0 as h"))) == want
    assert spelling.variants(docs.limit(0)).count() == 0
    few = docs.filter("length(text) < 1000")
    assert oracle("op12_spelling_neighbourhoods", documents=few) == got(spelling.variants(few))


def test_neighbourhoods_are_whole_and_distinct():
    rng = random.Random(4)
    letters = b"abc\xe9"
    words = [bytes(rng.choice(letters) for _ in range(n)) for n in (1, 2, 3, 5, 7, 7, 7)]
    for size in {len(w) for w in words}:
        same = [w for w in words if len(w) == size]
        made = [[] for _ in same]
        for at_once in (1, 50, 10**6):
            for how, row, at, c, h in spelling.neighbours(np.frombuffer(b"".join(same), np.uint8).reshape(-1, size), np.frombuffer(letters, np.uint8), at_once):
                for i in range(len(row)):
                    w, p = same[row[i]], at[i]
                    text = w[:p] + (b"" if c is None else letters[c[i] : c[i] + 1]) + w[p + (how != "i") :]
                    assert spelling.hashes([text])[0] == h[i]
                    made[row[i]].append(text)
            for w, texts in zip(same, made, strict=True):
                want = {w[:i] + w[i + 1 :] for i in range(size)} | {w[:i] + bytes([c]) + w[i + 1 :] for i in range(size) for c in letters} | {w[:i] + bytes([c]) + w[i:] for i in range(size + 1) for c in letters}
                assert len(texts) == len(set(texts)) and set(texts) == want - {w}
            made = [[] for _ in same]


# collocations


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in found.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank, told = Counter(), []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            told.append((lang, rank[lang], *rest))
    return sorted(told, key=str)


def phrase_rows(seed=6, docs=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Été", "\U0001f600", "\x00z", "-"]
    fixed = ["New York City", "as well as", "a a a a", "one of the most x", "in the end of it"]
    rows = []
    for i in range(docs):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(50))]
        rows.append((["en", "fr", None, ""][min(3, rng.randrange(8) // 2)] if i % 3 else "en", "".join(p + rng.choice([" ", "  ", "\t ", " ", ", ", ".\n"]) for p in parts)))
    return rows + [("de", None), ("de", ""), ("xx", " . ,\n"), ("de", "New York")]


def test_collocations_are_plain_ones(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    wide = docs.selectExpr("*", "1 as f", "'p' as phrase", "2 as k")
    for least, top in ((5, 40), (3, 10_000), (10**6, 5)):
        assert got(collocations.collocations(wide, least=least, top=top)) == plain_collocations(rows, least, top)
    assert collocations.collocations(docs.limit(0)).count() == 0
    docs = docs.unionByName(docs).unionByName(docs)
    assert oracle("op13_collocations", documents=docs) == got(collocations.collocations(docs)) != []


def test_sketch_keeps_what_is_frequent_and_drops_what_cannot_be(spark):
    rng = random.Random(9)
    rare = [f"r{i}" for i in range(200)]
    rows = [("en", " ".join(["the the", "of the"] * rng.randrange(1, 9) + rng.choices(rare, k=30))) for _ in range(2000)] + [("fr", "a b " * 60), ("fr", "a b. " * 40)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    assert got(collocations.collocations(docs)) == plain_collocations(rows, 100, 2000)
    # pairs in buckets of their own: one 300 times in a batch, one 60 times in each of two, one 99 times
    small = spark.createDataFrame([("x", "p q. " * 300)] + [("x", "s t. " * 30)] * 4 + [("x", "u v. " * 99)], "lang string, text string").repartition(2)
    every = type("All", (), {"__call__": lambda self, h: np.ones(len(h), bool)})()
    passes = collocations.often(small.selectExpr("lang", "text || chr(10) as text"), 2, 1, every, 10_000_000, 100)
    hashes = lambda p: collocations.gram_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]), np.array([collocations._salt("x")], np.uint64))
    assert [bool(passes(hashes(p))[0]) for p in (b"p q", b"s t", b"u v", b"q p")] == [True, True, False, False]


def test_collocations_of_large_counts_are_exact(spark):
    big = [("en", p, f) for p, f in (("a b", 9_007_199_254_740_993), ("a", 9_007_199_254_740_995), ("b", 9_007_199_254_740_997))]
    one = spark.createDataFrame([(x, p, f) for x, p, f in big if " " not in p] + [("en", None, 99_999_999_999_999_999)], "lang string, phrase string, f long")
    two = spark.createDataFrame([big[0]], "lang string, phrase string, f long")
    # 1000 a must stay below 10^18 here
    row = collocations.scored([one.withColumn("f", one.f), two.withColumn("f", (two.f / 10).cast("long"))]).first()
    assert row.score == 1000 * row.a * 99_999_999_999_999_999 // (big[1][2] * big[2][2])
