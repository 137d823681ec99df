"""Operators that compare documents, against brute force and on awkward tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import DOCS, awkward, empty, table

from screenlake.llm import mixing, mtree, neardup, repeats, reputation

SPACE = " \t\n\v\f\r"


def words(text):
    return [w for w in (text or "").translate(str.maketrans(SPACE, " " * 6)).split(" ") if w]


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghijklm", k=r.randint(2, 8))) for _ in range(n))


# M-trees


def brute_neighbours(ids, x, k):
    out = []
    for i, q in zip(ids, x):
        d = np.sqrt(np.square(q - x).sum(1))
        out += [(i, r + 1, j, round(dist, 6)) for r, (dist, j) in enumerate(sorted((dist, j) for dist, j in zip(d.tolist(), ids) if j != i)[:k])]
    return out


SMALL = mtree.Shape(cell=60, fan=4, page=8, batch=40)


@pytest.mark.parametrize("kind", ["clusters", "ties", "even", "copies"])
def test_neighbours_are_exact(spark, kind):
    r = np.random.default_rng(1)
    x = {"clusters": r.normal(size=(8, 6))[r.integers(0, 8, 300)] + 0.05 * r.normal(size=(300, 6)), "ties": r.integers(0, 3, (300, 3)).astype(float), "even": r.normal(size=(300, 8)), "copies": np.where(r.random((300, 1)) < 0.4, 1.0, r.normal(size=(300, 3)))}[kind]
    ids = list(range(300))
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, x.tolist())], "vec_id long, embedding array<double>, distance string, node int")
    got = sorted(tuple(q) for q in mtree.neighbours(df, 5, every=3, shape=SMALL).collect())
    assert got == sorted(q for q in brute_neighbours(ids, x, 5) if q[0] % 3 == 0)


def test_the_tree_has_levels_and_bounds_hold(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(12, 4))[r.integers(0, 12, 600)] + 0.05 * r.normal(size=(600, 4))
    had, _, n, width = mtree.points(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"))
    forest = mtree.Forest(had, width, SMALL)
    nodes = {q.node: q for q in forest.nodes.collect()}
    home = {q.vec_id: q.node for q in forest.home.collect()}
    assert n == 600 and len(home) == 600 and any(q.inner for q in nodes.values())
    size = Counter(home.values())
    assert all(not nodes[c].inner and k <= SMALL.cell for c, k in size.items())
    for i, c in home.items():
        while c:
            assert np.linalg.norm(x[i] - nodes[c].embedding) <= nodes[c].radius + 1e-9
            c = nodes[c].parent
    for q in nodes.values():
        if q.parent:
            assert abs(np.linalg.norm(np.array(q.embedding) - nodes[q.parent].embedding) - q.to_parent) < 1e-9
    assert Counter(q.node for q in forest.pages.where("radius < 0").collect()) == size
    near = forest.reached(had.where("vec_id % 20 = 0").selectExpr("vec_id", "embedding", "0.3D AS reach")).count()
    assert near < 0.6 * 30 * len(size)  # most cells are ruled out


def test_bounds_save_comparisons():
    r = np.random.default_rng(2)
    x = r.normal(size=(20, 4))[r.integers(0, 20, 2000)] * 10 + 0.1 * r.normal(size=(2000, 4))
    ids, to = np.arange(2000), mtree.distance(x, x[0][None, :])
    t = mtree.Tree.build(ids, x, to, 64)
    t.search(ids, x, to, np.full(2000, np.inf), 10)
    assert t.compared < 0.25 * 2000 * 2000


def test_neighbours_of_awkward_tables(spark):
    rows = [(1, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [0.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(q) for q in mtree.neighbours(df, 10, every=1).collect())
    assert got == [(1, 1, 3, 0.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 1, 1, 0.0), (3, 2, 2, 1.0)]
    assert mtree.neighbours(df.limit(0)).count() == 0 and mtree.neighbours(df.where("vec_id = 1"), every=1).count() == 0
    text = df.selectExpr("concat('v.', vec_id) AS vec_id", "embedding", "1 AS `a.b`", "2 AS __node")
    got = {(q.vec_id, q.neighbour, q.distance) for q in mtree.neighbours(text, every=1).collect()}
    assert got == {("v.1", "v.3", 0.0), ("v.1", "v.2", 1.0), ("v.2", "v.1", 1.0), ("v.2", "v.3", 1.0), ("v.3", "v.1", 0.0), ("v.3", "v.2", 1.0)}


# Host reputation


def test_reputation(spark):
    pages, told = [], []
    n = 0
    for host, count, good in (("http://good.example.co.uk/a", 40, 39), ("https://u:p@BAD.example.org:80/x", 60, 3), ("http://once.example.org", 1, 0), ("http://new.example.org/", 1, None), ("//10.0.0.1/x", 5, 5)):
        for i in range(count):
            pages.append((n, host, "x"))
            if good is not None:
                told.append((n, int(i < good)))
            n += 1
    pages += [(n, None, "x"), (n + 1, "nonsense", "x"), (n + 2, "", "x"), (0, pages[0][1], "x")]
    p = spark.createDataFrame(pages, "page_id long, url string, host string")
    o = spark.createDataFrame([*told, (0, 1), (0, None), (1, 7), (99999, 0), (None, 1)], "page_id long, good int")
    got = {(r.page_id, r.host): r for r in reputation.score(p, o).collect()}
    assert reputation.score(p, o).count() == len(pages)
    by = {r.host: r for r in got.values()}
    assert (by["good.example.co.uk"].domain, by["good.example.co.uk"].suffix) == ("example.co.uk", "co.uk") and by["10.0.0.1"].suffix == "" and by["bad.example.org"].domain == "example.org"
    assert by["good.example.co.uk"].keep and not by["bad.example.org"].keep
    assert by["bad.example.org"].mean < by["new.example.org"].mean + 0.01 and by["once.example.org"].mean < by["good.example.co.uk"].mean
    assert by["once.example.org"].bound - by["once.example.org"].mean > by["bad.example.org"].bound - by["bad.example.org"].mean
    assert by[None].keep and by[None].mean is None
    odd = p.selectExpr("concat('p', page_id) AS page_id", "url", "host AS __host", "1 AS `a.b`")
    assert reputation.keep(odd, o.selectExpr("concat('p', page_id) AS page_id", "good")).columns == odd.columns
    kept = reputation.keep(p, o)
    assert kept.columns == p.columns and kept.count() == len(pages) - sum(not r.keep for r in reputation.score(p, o).collect())
    none = reputation.score(p, o.limit(0)).where("host IS NOT NULL").collect()
    assert all(r.keep and r.mean == 0.5 for r in none) and reputation.score(p.limit(0), o).count() == 0


def test_public_suffixes(spark):
    want = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com": ("com", "example.com"), "a.b.c.ck": ("c.ck", "b.c.ck"), "www.ck": ("ck", "www.ck"), "q.www.ck": ("ck", "www.ck"), "h.city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "h.x.kobe.jp": ("x.kobe.jp", "h.x.kobe.jp"), "user.github.io": ("github.io", "user.github.io"), "localhost": ("localhost", "localhost"), "b.s3.amazonaws.com": ("s3.amazonaws.com", "b.s3.amazonaws.com"), "10.1.2.3": ("", "10.1.2.3")}
    from pyspark.sql import functions as F

    h = spark.createDataFrame([(k,) for k in want], "h string").withColumn("s", reputation.suffix_of(F.col("h")))
    assert {r.h: (r.s, r.d) for r in h.withColumn("d", reputation.domain_of(F.col("h"), F.col("s"))).collect()} == want
    own = h.select("h", reputation.suffix_of(F.col("h"), "uk // no more\n").alias("s")).collect()
    assert {r.h: r.s for r in own}["a.b.co.uk"] == "uk"


# Near copies


def shingle_set(text):
    w = [x.encode().lower() for x in words(text)]  # bytes: ASCII letters only
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_copies(rows, e=neardup.Ensemble()):
    sets = {i: shingle_set(t) for i, t in rows}
    rank = lambda i: (-len(sets[i]), i)
    return {a for a in sets if sets[a] and any(rank(b) < rank(a) and len(sets[a] & sets[b]) >= e.threshold * len(sets[a]) for b in sets)}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    rows = [(i, prose(r, r.randint(5, 200))) for i in range(n)]
    shared = prose(r, 70)
    for k in range(n):
        base = words(r.choice(rows[:n])[1])
        kind = k % 6
        if kind == 0:
            new = base
        elif kind == 1:
            new = [prose(r, 1) if r.random() < 0.03 else w for w in base]
        elif kind == 2:
            new = base[: max(1, int(len(base) * 0.8))]
        elif kind == 3:
            new = [w.upper() for w in base]
        elif kind == 4:
            new = words(prose(r, 90)) + words(shared) + words(prose(r, 60))
        else:
            new = [prose(r, 1) if r.random() < 0.3 else w for w in base]
        rows.append((n + k, " ".join(new)))
    return rows


def test_near_copies_are_found(spark):
    rows = corpus()
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    got = neardup.copies(docs).collect()
    want = brute_copies(rows)
    have = {r.doc_id for r in got}
    assert have <= want and len(have) >= 0.9 * len(want) and len(got) == len(have)
    sets = {i: shingle_set(t) for i, t in rows}
    for r in got:
        assert abs(r.containment - len(sets[r.doc_id] & sets[r.copy_of]) / len(sets[r.doc_id])) < 1e-5 and r.containment >= 0.7
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - have


def test_copies_in_far_larger_documents_are_found(spark):
    r = random.Random(5)
    rows, want = [], set()
    for i in range(40):
        part = words(prose(r, r.choice([4, 6, 12, 30, 60, 200])))
        ratio = r.choice([3, 5, 20, 60])
        rows.append((2 * i, " ".join([prose(r, len(part) * (ratio - 1)), *part, prose(r, 9)])))
        rows.append((2 * i + 1, " ".join(part)))
        want.add(2 * i + 1)
    # Common passages: most of one document, half of the other.
    line = prose(r, 40)
    rows += [(100 + i, f"{prose(r, 200)} {line} {prose(r, 200)}") for i in range(30)]
    rows += [(200, f"{line} {prose(r, 8)}"), (201, f"{line} {prose(r, 40)}")]
    want.add(200)
    assert brute_copies(rows) == want
    got = {c.doc_id: c.containment for c in neardup.copies(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert set(got) == want and all(got[i] == 1.0 for i in want - {200})


def test_banding_follows_the_threshold():
    e = neardup.Ensemble()
    tuned, layout = e.tuned(), e.layout()
    for gap, (lo, hi) in enumerate(tuned.tolist()):
        j, n, rows = e.jaccard(2 ** ((gap + 1) / neardup.PARTS)), hi - lo, layout[lo]
        assert rows > 1 and set(layout[lo:hi]) == {rows} and n * rows <= e.hashes
        assert 1 - (1 - j**rows) ** n >= e.recall > 1 - (1 - j**rows) ** (n - 1)
    assert list(tuned[:, 1]) == sorted(tuned[:, 1]) and sum(layout) <= neardup.SKETCH


def test_passages_of_many_documents_lose_no_copy(spark):
    """Hubs: a passage in most documents, alone in some, and two halves of one document in different others."""
    r = random.Random(9)
    one, two = prose(r, 60), prose(r, 60)
    rows = [(i, f"{prose(r, 150)} {one if i % 2 else two} {prose(r, 150)}") for i in range(60)]
    rows += [(100 + i, f"{prose(r, 3 * i)} {one}") for i in range(14)]
    rows += [(200 + i, f"{one} {two} {prose(r, i)}") for i in range(6)] + [(300, f"{prose(r, 400)} {one} {two} {prose(r, 400)}")]
    got = {c.doc_id for c in neardup.copies(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    want = brute_copies(rows)
    assert got <= want and len(got) >= 0.95 * len(want) and {100, 200} <= got


def test_near_copies_of_awkward_tables(spark):
    got = {r.doc_id: r.copy_of for r in neardup.copies(awkward(spark)).collect()}
    assert set(got) == {None, 7, 2} or set(got) <= {None, 1, 2, 6, 7}
    kept = neardup.deduplicate(awkward(spark)).collect()
    assert sum(r.doc_id in (3, 4, 5) for r in kept) == 3 and sum(r.doc_id == 1 for r in kept) <= 1
    assert neardup.copies(empty(spark)).count() == 0 and neardup.deduplicate(empty(spark)).count() == 0
    same = table(spark, [(i, "one two", "en", "a") for i in range(5)])
    assert sorted((r.doc_id, r.copy_of) for r in neardup.copies(same).collect()) == [(i, 0) for i in range(1, 5)]


def test_copies_are_told_by_id_and_text(spark):
    r = random.Random(12)
    a, b, c = prose(r, 60), prose(r, 60), prose(r, 60)
    rows = [(1, a), (1, b), (2, a), (2, a), (None, a), (None, c), (None, c), (3, b + " " + prose(r, 3)), (4, None), (4, None), (5, ""), (5, "")]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(None if i is None else i if kind == "long" else f"id.{i}", t, 1, 2) for i, t in rows], f"doc_id {kind}, text string, `meta.url` int, row int")
        kept = neardup.deduplicate(df)
        assert kept.columns == df.columns
        have = Counter(q.text for q in kept.collect())
        assert have == {a: 1, c: 1, rows[7][1]: 1, None: 2, "": 2}  # b is in the longer text
        told = neardup.copies(df).collect()
        n = lambda i: i if kind == "long" else f"id.{i}"
        assert {(n(1), n(3))} <= {(q.doc_id, q.copy_of) for q in told} and len(told) == 3 and {q.copy_of for q in told} <= {n(1), n(2), n(3), None}


# Repeated passages


def brute_repeats(rows, n=repeats.WORDS):
    first, hits = {}, []
    for i, t in sorted(rows):
        w = words(t)
        for p in range(len(w) - n + 1):
            f = first.setdefault(tuple(w[p : p + n]), (i, p))
            if f != (i, p):
                hits.append((i, f[0], f[1] - p, p))
    out = []
    for i, f, shift, p in sorted(hits):
        if out and out[-1][:3] == [i, f, shift] and out[-1][3] + out[-1][4] == p:
            out[-1][4] += 1
        else:
            out.append([i, f, shift, p, 1])
    return sorted((i, p, m + n - 1, f, p + shift) for i, f, shift, p, m in out)


def test_repeats_are_exact(spark):
    rows = corpus(3, 40)
    rows += [(200, "a b c " * 60), (201, "x " * 130), (202, "x " * 49), (203, rows[0][1] + " " + rows[0][1])]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    assert sorted(tuple(r) for r in repeats.find(docs).collect()) == brute_repeats(rows)
    assert sorted(tuple(r) for r in repeats.find(docs, words=12, shards=3).collect()) == brute_repeats(rows, 12)
    cut = {r.doc_id: r for r in repeats.deduplicate(docs).collect()}
    gone = {}
    for i, p, m, *_ in brute_repeats(rows):
        gone.setdefault(i, set()).update(range(p, p + m))
    for i, t in rows:
        assert words(cut[i].text) == [w for k, w in enumerate(words(t)) if k not in gone.get(i, ())] and cut[i].n_chars == len(cut[i].text)
    assert repeats.deduplicate(docs).columns == docs.columns


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=0, max_size=40), min_size=1, max_size=9), st.integers(2, 6))
def test_merged_transforms_find_every_repeat(texts, n):
    ids, pointer = np.array([x for t in texts for x in t], np.int64), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    place, interval = repeats.equal_windows(ids, pointer, n) if len(ids) else (np.zeros(0), np.zeros(0))
    got = {}
    for p, i in zip(place.tolist(), interval.tolist()):
        got.setdefault(i, set()).add(p)
    want = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            want.setdefault(tuple(t[p : p + n]), set()).add(int(pointer[k]) + p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=25), min_size=1, max_size=4), st.integers(1, 5))
def test_interleave_sorts_all_suffixes(texts, depth):
    made = [repeats.shard_transform(np.array(t), depth) for t in texts]
    shard, common = repeats.merge_transforms([m[1] for m in made], depth)
    turn = [0] * len(texts)
    keys = []
    for s in shard.tolist():
        at = int(made[s][0][turn[s]])
        turn[s] += 1
        keys.append(tuple((texts[s] * (depth + 1))[at : at + depth]))
    assert keys == sorted(keys)
    for i in range(1, len(keys)):
        same = next((k for k in range(depth) if keys[i][k] != keys[i - 1][k]), depth)
        assert common[i] == same


def test_repeats_of_awkward_tables(spark):
    p = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [(1, p, "en", "a"), (1, p, "en", "a"), (1, "other " + p, "en", "a"), (2, p.replace(" ", "\n"), None, None), (3, None, None, None), (4, "", None, None), (None, p, None, None)])
    got = sorted(tuple(r) for r in repeats.find(docs).collect())
    assert (2, 0, 60, 1, 0) in got and {g[0] for g in got} == {1, 2} and len(got) == 2
    cut = repeats.deduplicate(docs).collect()
    assert len(cut) == 7 and sorted(r.text for r in cut if r.doc_id == 2) == [""] and [r.text for r in cut if r.doc_id is None] == [p] and [r.text for r in cut if r.doc_id == 3] == [None]
    assert repeats.find(empty(spark)).count() == 0 and repeats.deduplicate(empty(spark)).count() == 0
    text = docs.selectExpr("concat('d.', doc_id) AS doc_id", "text", "1 AS `a.b`", "2 AS __1")
    assert {(r.doc_id, r.first_doc, r.n_words) for r in repeats.find(text).collect()} >= {("d.2", "d.1", 60)} or {r.first_doc for r in repeats.find(text).collect()} == {"d.2"}
    # Which id comes first goes by its hash: d.2 is cut, or both equal rows of d.1 are.
    assert repeats.deduplicate(text).columns == text.columns and sum(r.text == "" for r in repeats.deduplicate(text).collect()) in (2, 3)
    long = "a b c d e " * 40_000
    assert sorted(len(r.text) for r in repeats.deduplicate(table(spark, [(1, long, "en", "a"), (2, long, "en", "a")])).collect())[0] == 0
    with pytest.raises(ValueError):
        repeats.find(docs, words=2)


# Mixing


def test_mixture_is_exact(spark):
    r = random.Random(7)
    rows = [(i, prose(r, r.randint(1, 30)), "en", "abc"[min(2, i % 5)]) for i in range(200)] + [(900, None, "en", "a"), (901, "", "en", "b"), (902, "one two", "en", None), (None, "x y z", "en", "a")]
    docs = table(spark, rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s or ""] += len(words(t))
    for how in ({}, {"weights": {"a": 3.0, "b": 1.0}, "total": 5000}, {"weights": {"c": 1.0}, "total": 10}):
        got = mixing.schedule(docs, **how).collect()
        total = how.get("total", sum(size.values()))
        raw = {s: math.sqrt(n) for s, n in size.items()} if "weights" not in how else how["weights"]
        every = sum(raw[s] for s in raw)
        want = {s: total * math.floor(raw[s] / every * 1_000_000) // 1_000_000 for s in raw}
        have = Counter()
        for x in got:
            have[x.source] += x.taken
            assert 0 < x.taken <= x.n_tokens
        assert {s: n for s, n in want.items() if n} == dict(have)
        mixed = mixing.mix(docs, **how)
        out = mixed.collect()
        assert mixed.columns == docs.columns and Counter(q.doc_id for q in out) == Counter(q.doc_id for q in got)
        made = Counter()
        for q in out:
            made[q.source or ""] += len(words(q.text))
            assert q.n_chars == len(q.text)
        assert made == have  # to the token
    assert mixing.schedule(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    assert mixing.schedule(docs, weights={"none": 1.0}).count() == 0


def test_mixture_of_awkward_tables(spark):
    r = random.Random(8)
    rows = [(f"d.{i % 20}", prose(r, 9), "abc"[i % 3], i, i) for i in range(60)] + [("same", "one two three", "a", 0, 0)] * 9 + [(None, "x y", None, 1, 1), ("e", "", "a", 1, 1), ("n", None, "b", 1, 1), ("long", "w " * 90_000, "c", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, `meta.url` int, __0 int")
    for total in (50, 300, 90_500):
        out, plan = mixing.mix(docs, total=total), mixing.schedule(docs, total=total)
        assert out.columns == docs.columns and plan.schema["doc_id"].dataType.simpleString() == "string"
        want, made = Counter(), Counter()
        for q in plan.collect():
            want[q.source] += q.taken
        for q in out.collect():
            made[q.source or ""] += len(words(q.text))
        assert made == want and total - 5 <= sum(want.values()) <= total


def test_mixture_prefix_sums(spark):
    docs = table(spark, [(i, "w " * (i % 7 + 1), "en", "a" if i % 3 else "b") for i in range(300)])
    rows = sorted(mixing.schedule(docs, weights={"a": 1.0, "b": 1.0}, total=5000).where("epoch = 0").collect(), key=lambda q: (q.source, q.start))
    for a, b in zip(rows, rows[1:]):
        assert a.source != b.source or (a.start + a.n_tokens == b.start and a.key <= b.key)
