"""Operators that look at one document at a time, on awkward tables."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from screenlake.llm import bpe, langmix, pseudolikelihood, syncmers, toxicity
from screenlake.llm.textcols import LOWER, blocks, range_hash, sliding_min, word_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, size int"
EN = "the ship of the line was in the harbour and the men were on the shore with them this evening "
DE = "das schiff lag nicht mehr im hafen und die leute waren schon alle an land gegangen heute abend "


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1) for i, t, lang, s in rows], DOCS)


def awkward(spark):
    long = " ".join(random.Random(1).choices((EN + DE).split(), k=60_000))
    return table(spark, [(1, EN * 3, "en", "a"), (2, DE * 3, "de", "a"), (3, None, "en", None), (4, "", None, "b"), (None, EN, "en", "b"), (1, EN * 3, "en", "a"), (5, "   \n\t ", "fr", "b"), (6, long, None, "c"), (7, EN * 4 + DE * 4, None, "c")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_spans_and_windows():
    for b in blocks(pa.array(["ab  c\n", None, "", "dé f"])):
        s, e, p = word_spans(b.data, b.offsets)
        assert [bytes(b.data[x:y]).decode() for x, y in zip(s, e)] == ["ab", "c", "dé", "f"] and p.tolist() == [0, 2, 2, 2, 4]
    x = np.random.default_rng(0).integers(0, 99, 50)
    for w in (1, 2, 3, 7, 50):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(51 - w)]


# Language mixtures


def test_language_mixture(spark):
    got = [r for r in langmix.identify(awkward(spark)).collect()]
    assert len(got) == 9
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].language, by[1].n_languages, by[2].language) == ("en", 1, "de")
    for i in (3, 4, 5):
        assert (by[i].language, by[i].n_languages, by[i].shares, by[i].log_likelihood) == (None, 0, [], None)
    assert by[7].n_languages == 2 and {s.language for s in by[7].shares} == {"en", "de"} and abs(sum(s.share for s in by[7].shares) - 1) < 1e-5
    assert all(abs(s.share - 0.5) < 0.15 for s in by[7].shares)
    assert langmix.identify(empty(spark)).count() == 0
    none = langmix.identify(table(spark, [(1, EN, None, "a")])).first()
    assert (none.language, none.n_languages, none.shares) == (None, 0, [])


def test_mixture_never_falls():
    r = np.random.default_rng(3)
    like = r.random((40, 3)).astype(np.float32) + 1e-3
    ptr, ok = np.array([0, 40]), np.ones((1, 3), bool)
    values = [langmix.mixture(like, np.zeros(40), ptr, ok, n)[1][0] for n in range(1, 9)]
    assert all(b >= a - 1e-4 for a, b in zip(values, values[1:]))


def test_language_sets_are_those_of_an_exhaustive_search():
    """All sets of four languages, each fitted by slow EM: the chosen one has the highest penalised likelihood."""
    from itertools import combinations

    r = np.random.default_rng(6)
    logp = langmix.model(r.gamma(0.2, 20, (4, langmix.CELLS)))
    bag = [["".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(40)] for _ in range(4)]
    table = np.zeros((4, langmix.CELLS))
    for k in range(4):
        for b in blocks(pa.array([" ".join(bag[k]) + " "])):
            np.add.at(table[k], langmix.trigrams(b.data, b.offsets), 5)
    logp = langmix.model(table)
    texts = [" ".join(w for k, n in enumerate(mix) for w in r.choice(bag[k], n)) for mix in ((20, 0, 0, 0), (12, 9, 0, 0), (5, 0, 30, 0), (9, 9, 9, 0), (6, 7, 8, 9), (25, 1, 0, 0), (2, 0, 0, 2))]
    for b in blocks(pa.array(texts)):
        share, like = langmix.infer(logp, b.data, b.offsets)
        start, end, pointer = word_spans(b.data, b.offsets)
        cells = langmix.trigrams(b.data, b.offsets)
        for i in range(len(texts)):
            w = np.array([[logp[k][cells[start[j] : end[j]]].sum() for k in range(4)] for j in range(pointer[i], pointer[i + 1])], float)
            best = (-np.inf, None)
            for size in range(1, 5):
                for own in combinations(range(4), size):
                    p, s = np.exp(w[:, own] - w.max(1)[:, None]), np.full(size, 1 / size)
                    for _ in range(500):
                        s = (p * s / np.maximum((p * s).sum(1, keepdims=True), 1e-300)).mean(0)
                    value = np.log(np.maximum((p * s).sum(1), 1e-300)).sum() + w.max(1).sum() - langmix.PENALTY * np.log(max(2, len(w))) * (size - 1)
                    best = max(best, (value, own))
            assert set(np.flatnonzero(share[i])) == set(best[1])
            assert abs(like[i] - langmix.PENALTY * np.log(max(2, len(w))) * (len(best[1]) - 1) - best[0]) < 0.05


# Closed syncmers


def slow_anchors(text, k, s):
    low = LOWER[np.frombuffer(text.encode(), np.uint8)]
    one = lambda i, n: int(range_hash(low, np.array([i]), np.array([i + n]))[0])
    out = []
    for i in range(len(low) - k + 1):
        inner = [one(j, s) >> 32 for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, one(i, k)))
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab Cé", max_size=60), min_size=1, max_size=5))
def test_syncmers_are_brute_force(texts):
    for b in blocks(pa.array(texts)):
        doc, at, h = syncmers.anchors(b.data, b.offsets, 9, 4)
        for i, t in enumerate(texts[b.lo : b.hi]):
            assert list(zip(at[doc == i].tolist(), h[doc == i].tolist())) == slow_anchors(t, 9, 4)


def test_syncmers_are_context_free_and_dense():
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(60))
    sets = []
    for _ in range(2):
        text = " ".join(word() for _ in range(30)) + " " + passage + " " + word()
        for b in blocks(pa.array([text])):
            _, at, h = syncmers.anchors(b.data, b.offsets)
            lo = text.index(passage)
            inside = (at >= lo) & (at + syncmers.K <= lo + len(passage))
            sets.append([(a - lo, x) for a, x in zip(at[inside].tolist(), h[inside].tolist())])
            assert np.diff(at).max() <= syncmers.K - syncmers.S + 1
    assert sets[0] == sets[1] and sets[0]


def test_equal_and_lightly_edited_texts_share_anchors(spark):
    r = np.random.default_rng(4)
    words = lambda n: ["".join(r.choice(list("abcdefghij"), r.integers(3, 9))) for _ in range(n)]
    texts = {}
    for n in range(1, 131):
        texts[n] = texts[1000 + n] = " ".join(words(40))[:n]
    for i in range(20):
        own = words(60)
        texts[2000 + i] = " ".join(own)
        texts[3000 + i] = " ".join("zz" if j % 10 == 9 else w for j, w in enumerate(own))
    got = {x.doc_id: x.hashes for x in syncmers.fingerprint(table(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert all(got[n] and got[n] == got[1000 + n] for n in range(1, 131))
    assert all(len(set(got[2000 + i]) & set(got[3000 + i])) >= 3 for i in range(20))


def test_fingerprints_are_matched_by_position(spark):
    r = random.Random(8)
    word = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    passage = word(50)
    texts = {"a": f"{word(20)} {passage} {word(5)}", "b": f"{word(90)} {passage}", "c": word(60), "e": ""}
    texts["d"] = texts["a"]
    prints = syncmers.fingerprint(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("a", "d"), ("a", "e"), ("a", "none"), (None, "a")]
    got = {(q.a, q.b): (q.shared, q.shift, q.aligned) for q in syncmers.align(prints, spark.createDataFrame(pairs, "a string, b string")).collect()}
    own = {q.doc_id: dict(zip(q.positions, q.hashes)) for q in prints.collect()}
    assert set(got) == set(pairs[:5])
    for (x, y), (shared, shift, aligned) in got.items():
        near = {}
        for i, h in own[x].items():
            for j, g in own[y].items():
                if h == g:
                    near[j - i] = near.get(j - i, 0) + 1
        assert shared == sum(h in own[y].values() for h in own[x].values()) and aligned == max(near.values(), default=0)
        assert shift == (min(k for k, n in near.items() if n == aligned) if near else None)
    assert got["a", "b"][1] == texts["b"].index(passage) - texts["a"].index(passage) and got["a", "b"][2] > 10 and got["a", "d"][1:] == (0, len(own["a"])) and got["a", "e"] == (0, None, 0)


def test_syncmers_of_awkward_tables(spark):
    got = {r.doc_id: r for r in syncmers.fingerprint(awkward(spark)).collect()}
    assert got[3].n_anchors == got[4].n_anchors == 0 and got[6].n_anchors == len(got[6].positions) == len(got[6].hashes) > 1000
    assert syncmers.fingerprint(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        syncmers.fingerprint(awkward(spark), k=4, s=4)


# Byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(os.path.join(bpe.VOCABULARY_DIR, bpe.VOCABULARY), 24)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab1 .'\n\té中\U0001f600ſ's \x1c  "), max_size=300))
def test_bpe_by_halves_is_that_of_the_whole(coder, text):
    t = coder.encode(text)
    assert t.tolist() == coder.encoding.encode_ordinary(text)
    assert coder.decode(t) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "the", "é", "中文", "1", "12", "-", "=", "'s", " ", "\n", "\t ", "x y"]), st.integers(1, 900)), min_size=1, max_size=4), st.sampled_from([40, 600]))
def test_long_runs_are_joined_inside(parts, leaf):
    own = bpe.coder(os.path.join(bpe.VOCABULARY_DIR, bpe.VOCABULARY), leaf)
    text = "".join(piece * n for piece, n in parts)
    assert own.encode(text).tolist() == own.encoding.encode_ordinary(text)


def test_random_runs_take_windows_and_not_whole_sides():
    own = bpe.Coder(os.path.join(bpe.VOCABULARY_DIR, bpe.VOCABULARY))
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    want = own.encoding.encode_ordinary(text)
    sizes, real = [], own.encoding.encode_ordinary
    own.encoding.encode_ordinary = lambda t: sizes.append(len(t)) or real(t)
    assert own.encode(text).tolist() == want and max(sizes) <= 2 * bpe.LEAF


def test_bpe_of_awkward_tables(spark):
    got = {r.doc_id: r for r in bpe.encode(awkward(spark)).collect()}
    assert got[3].tokens is None and got[3].round_trip is None and got[4].tokens == [] and got[4].round_trip
    assert got[6].round_trip and got[6].n_tokens == len(got[6].tokens) > 50_000
    assert bpe.encode(empty(spark)).count() == 0


# Pseudo-likelihood


def slow_score(net, text):
    """Byte by byte, from the definition."""
    raw = [pseudolikelihood.OUTSIDE] * net.side + list(text.encode()) + [pseudolikelihood.OUTSIDE] * net.side
    total = 0.0
    for t in range(net.side, len(raw) - net.side):
        around = raw[t - net.side : t] + raw[t + 1 : t + 1 + net.side]
        h = np.maximum(net.inner.astype(float) @ np.concatenate([net.embedding[:, c] for c in around]) + net.bias, 0)
        for z, at in ((net.high @ h + net.high_bias, raw[t] >> 4), (net.low[raw[t] >> 4] @ h + net.low_bias[raw[t] >> 4], raw[t] & 15)):
            total += z[at] - np.log(np.exp(z).sum())
    return total


def some_network(seed=0, **shape):
    net = pseudolikelihood.Network.start(np.ones(256), seed, **shape)
    net.theta[:] = np.random.default_rng(seed).normal(0, 0.4, len(net.theta))
    return net


def test_scores_are_sums_of_conditional_log_probabilities():
    net = some_network(1)
    texts = ["ab", "", "a", "Été 1.", None, "hello  world " * 700, "漢字かな交じり文", "x" * 3]
    for b in blocks(pa.array(texts)):
        got = pseudolikelihood.log_likelihoods(net, b)
        want = [slow_score(net, t or "") for t in texts[b.lo : b.hi]]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_the_masked_byte_is_not_seen_and_probabilities_add_up():
    net = some_network(2)
    piece = np.random.default_rng(0).integers(0, 257, (1, 2 * net.side + 1)).astype(np.uint16)
    p = []
    for c in range(256):
        piece[0, net.side] = c
        p.append(float(np.exp(net.forward(piece)[0][0])))
    assert abs(sum(p) - 1) < 1e-4


def test_gradient_is_the_slope():
    net = some_network(3, side=2, width=3, hidden=5)
    piece = np.random.default_rng(1).choice([0, 65, 66, 97, 200, 255, pseudolikelihood.OUTSIDE], (3, 24)).astype(np.uint16)
    real = (piece[:, 2:-2] < pseudolikelihood.OUTSIDE).sum()
    loss = lambda: -net.forward(piece)[0].astype(np.float64).sum() / real
    g = net.gradient(net.forward(piece)[1])
    for at in np.argsort(-np.abs(g))[::37][:20]:
        old = net.theta[at]
        net.theta[at] = old + 1e-3
        up = loss()
        net.theta[at] = old - 1e-3
        down = loss()
        net.theta[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 0.03 * abs(g[at]) + 2e-4


def test_windows_are_not_copied():
    """Training goes without a matrix of 4,096 windows of ten embeddings and without one of what comes back to them, of 1.3 MB each."""
    import tracemalloc

    net = some_network(4)
    piece = np.random.default_rng(2).choice([10, 32, 65, 97, 101, 116], (64, 64 + 2 * net.side)).astype(np.uint16)
    tracemalloc.start()
    try:
        net.gradient(net.forward(piece)[1])
        assert tracemalloc.get_traced_memory()[1] < 3.2e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("scale", [0.4, 4.0, 40.0])
def test_pairs_of_symbols_score_as_windows_do(scale):
    """Also where exponentials of logits leave the range of their type, and for any number of symbols on either side."""
    for shape in ({}, {"side": 1, "width": 1, "hidden": 1}, {"side": 2, "width": 3, "hidden": 5}):
        net = some_network(5, **shape)
        net.theta *= scale / 0.4
        pairs = net.pairs()
        for n in (1, 7, 300):
            x = np.random.default_rng(n).choice([0, 10, 97, 101, 195, 255, pseudolikelihood.OUTSIDE], n + 2 * net.side).astype(np.uint16)
            got, want = net.tell(x, pairs), net.forward(x[None])[0]
            assert np.isfinite(want).all() and np.allclose(got, want, rtol=1e-4, atol=1e-3 * max(1.0, scale**2))
            assert np.isfinite(net.gradient(net.forward(x[None])[1])).all()


def slow_slopes(net, piece):
    """Of the mean negative log-probability, window by window."""
    out = pseudolikelihood.Network(np.zeros(len(net.theta)), net.side, net.width, net.hidden)
    inner, n = net.inner.astype(float), 0
    for line in piece.astype(int):
        for t in range(net.side, len(line) - net.side):
            if line[t] == pseudolikelihood.OUTSIDE:
                continue
            n += 1
            around = np.concatenate((line[t - net.side : t], line[t + 1 : t + 1 + net.side]))
            x = net.embedding[:, around].astype(float).T.ravel()
            h = np.maximum(inner @ x + net.bias, 0)
            back = np.zeros(net.hidden)
            u, v = line[t] >> 4, line[t] & 15
            for w, b, dw, db, own in ((net.high, net.high_bias, out.high, out.high_bias, u), (net.low[u], net.low_bias[u], out.low[u], out.low_bias[u], v)):
                z = w.astype(float) @ h + b
                d = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                d[own] -= 1
                dw += np.outer(d, h)
                db += d
                back += w.T @ d
            back *= h > 0
            out.bias += back
            out.inner += np.outer(back, x)
            np.add.at(out.embedding.T, around, (inner.T @ back).reshape(-1, net.width))
    return out.theta / max(1, n)


@pytest.mark.parametrize("shape", [{}, {"side": 1, "width": 1, "hidden": 1}, {"side": 2, "width": 3, "hidden": 5}])
def test_training_has_slopes_without_log_probabilities(shape):
    """For any number of windows and rows, the slopes are those of single windows, and log-probabilities, which a step doesn't need, aren't made."""
    net = some_network(6, **shape)
    for rows, windows in ((1, 1), (1, 2), (2, 3), (3, 4), (1, 31), (5, 13)):
        piece = np.random.default_rng(windows).choice([0, 10, 97, 101, 195, 255, pseudolikelihood.OUTSIDE], (rows, windows + 2 * net.side)).astype(np.uint16)
        logp, kept = net.forward(piece, told=False)
        assert logp is None and np.allclose(net.gradient(kept), slow_slopes(net, piece), rtol=1e-3, atol=1e-5)
    nothing = np.full((2, 3 + 2 * net.side), pseudolikelihood.OUTSIDE, np.uint16)
    assert not net.gradient(net.forward(nothing, told=False)[1]).any()


def test_every_window_is_trained_on():
    r = random.Random(3)
    texts = ["".join(r.choices("abc", k=r.randint(0, 90))) for _ in range(40)]
    for b in blocks(pa.array(texts)):
        for batch in (32, 64, 256, 4096):
            x, start = pseudolikelihood.symbols(b, 5)
            assert [bytes(x[s : s + n].astype(np.uint8)).decode() for s, n in zip(start, np.diff(b.offsets))] == texts[b.lo : b.hi]
            seen = []
            for piece in pseudolikelihood.pieces(x, 5, batch):
                assert piece[:, 5:-5].size <= batch
                w = np.lib.stride_tricks.sliding_window_view(piece, 11, axis=1).reshape(-1, 11)
                seen += [tuple(q) for q in w.tolist() if q[5] < 256]
            wide = np.concatenate((np.full(5, 256), x, np.full(5, 256)))
            assert sorted(seen) == sorted(tuple(q) for q in np.lib.stride_tricks.sliding_window_view(wide, 11).tolist() if q[5] < 256)


def test_pseudo_likelihood(spark):
    docs = table(spark, [(i, (EN if i % 2 else DE) * 30, "en", "a") for i in range(8)] + [(90, None, "en", "a"), (91, "", "en", "a"), (92, "zqxj kvvq wpzx " * 20, "en", "a"), (None, "漢字の文 " * 20, "ja", "a"), (93, "文漢のじ " * 20, "ja", "a")])
    got = {r.doc_id: r for r in pseudolikelihood.score(docs, batch=128, epochs=4).collect()}
    assert (got[90].n_tokens, got[90].log_likelihood) == (None, None) and (got[91].n_tokens, got[91].log_likelihood, got[91].mean_log_likelihood) == (0, 0.0, None)
    assert got[92].mean_log_likelihood < got[1].mean_log_likelihood and got[1].mean_log_likelihood > -2.0
    assert got[None].n_tokens == len(("漢字の文 " * 20).encode()) and got[None].log_likelihood != got[93].log_likelihood
    assert pseudolikelihood.score(empty(spark), rounds=1).count() == 0
    text = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS `a.b`", "2 AS i").limit(3)
    assert pseudolikelihood.score(text, rounds=1, batch=512).count() == 3


def test_held_out_likelihood_beats_bigrams():
    """Trained on one half of a corpus, on the other half it is better than counts of pairs of bytes from both sides."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    known, new = texts.slice(0, 300), texts.slice(500, 150)
    net = pseudolikelihood.Network.start(np.zeros(256))
    adam = pseudolikelihood.Adam(net, 0.02)
    pair = np.ones((256, 256))
    for b in blocks(known):
        x, _ = pseudolikelihood.symbols(b, net.side)
        for piece in pseudolikelihood.pieces(x, net.side, 2048):
            adam.step(piece)
        np.add.at(pair, (b.data[:-1], b.data[1:]), 1)
    logp = np.log(pair / pair.sum(1, keepdims=True))
    own = two = n = 0.0
    for b in blocks(new):
        own, n = own + pseudolikelihood.log_likelihoods(net, b).sum(), n + len(b.data)
        two += logp[b.data[:-1], b.data[1:]].sum()
    assert own / n > two / n + 0.3


# Toxicity


def labelled(spark, n=240):
    r = random.Random(4)
    calm, bad = "house river walk green bread table window paper".split(), "grumble snarlz vilefoe".split()
    rows, labels = [], []
    for i in range(n):
        words = r.choices(calm, k=40)
        toxic = i % 3 == 0
        if toxic:
            for j in range(0, 40, 7):
                words[j : j + 2] = ["you", r.choice(bad)]
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(toxic), "x"))
    return table(spark, rows), spark.createDataFrame([*labels, (0, 1, 1, "again"), (5, 1, None, "null"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string"), rows


def test_toxicity(spark):
    docs, labels, rows = labelled(spark)
    more = docs.unionByName(table(spark, [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "walk you snarlz house vilefoe you", None, None), (1002, "walk you snarlz house vilefoe you", None, None)]))
    got = toxicity.score(more, labels).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    right = sum(by[i].toxic == (i % 3 == 0) for i, *_ in rows)
    assert right >= 0.97 * len(rows) and by[1002].toxic and not by[1000].toxic and by[1000].p_toxic == by[1001].p_toxic
    kept = toxicity.reject(more, labels)
    assert kept.columns == more.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.toxic}
    one_kind = toxicity.score(docs, labels.where("toxic = 0")).collect()
    assert all(r.p_toxic is None and not r.toxic for r in one_kind)
    assert toxicity.score(empty(spark), labels).count() == 0 and toxicity.reject(empty(spark), labels).count() == 0


def test_disguised_words_are_read():
    plain, hidden = "vilefoe", ["v1lef0e", "vile-foe", "v.i.l.e.f.o.e", "v_i_l_e_foe", "vile*foe", "v!lefoe"]
    for b in blocks(pa.array([plain, *hidden, "house-boat"])):
        u = toxicity.units(b.data, b.offsets)
        assert all(u.plain[0] in (u.masked[i], u.bare[i]) for i in range(1, 7)) and u.plain[0] not in (u.masked[7], u.bare[7]) and u.bare[0] == 0


def test_isotonic_is_monotone_and_trees_learn():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.Trees(rounds=60).fit(x, y)
    assert ((trees.margin(x) > 0) == y).mean() > 0.95
    knots, values = toxicity.isotonic(trees.margin(x), y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all()


def key(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return range_hash(raw, np.array([0]), np.array([len(raw)]))[0]


def slow_features(text, lexicon):
    """From the definitions, for ASCII."""
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    mark = lambda c: not c.isalnum()
    leet = dict(zip("013457@$!|", "oieastasil"))
    weight, you, odd_, hid = [], [], [], []
    for w in words:
        core = w.lower()
        while core and mark(core[0]):
            core = core[1:]
        while core and mark(core[-1]):
            core = core[:-1]
        odd = any(mark(c) or c.isdigit() for c in core)
        masked, bare = "".join(leet.get(c, c) for c in core), "".join(c for c in core if c.isalpha())
        plain = lexicon.get(core, 0)
        hidden = max(lexicon.get(masked, 0), lexicon.get(bare, 0) if bare else 0) if odd else 0
        weight.append((plain, max(plain, hidden))), you.append(core in toxicity.SECOND_PERSON), odd_.append(odd), hid.append(hidden > 0)
    n = max(1, len(words))
    near = [max([1 / (1 + abs(i - j)) for j, y in enumerate(you) if y], default=0) if w[1] > 0 else 0 for i, w in enumerate(weight)]
    low = text
    twice = sum(low[i] == low[i - 1] == low[i - 2] and low[i].isalpha() for i in range(2, len(low)))
    size = max(1, len(text))
    return {0: sum(p > 0 for p, _ in weight) / n, 2: sum(b > 2.5 for _, b in weight) / n, 3: sum(b for _, b in weight) / n, 4: max([b for _, b in weight], default=0), 5: sum(p > 0 for p, _ in weight), 6: sum(b > 1.5 for _, b in weight), 7: sum(near) / n, 8: sum(you) / n, 9: sum(c.isupper() for c in text) / size, 10: sum(mark(c) and c not in " \n" for c in text) / size, 11: sum(hid) / n + sum(odd_) / n, 12: twice / size, 13: np.log1p(n)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["you", "YOUR", "vile", "v1le", "v-i-l-e", "(vile)", "foe!", "f0e", "house", "3", "...", "x", "aaa", "Vile,", "a1b"]), max_size=12), min_size=1, max_size=4))
def test_features_are_brute_force(texts):
    words = {"vile": 3.0, "foe": 1.75}
    keys = np.array([key(w) for w in words], np.uint64)
    order = np.argsort(keys)
    lexicon = toxicity.Lexicon(keys[order], np.array(list(words.values()), np.float32)[order])
    texts = [" ".join(t) for t in texts]
    for b in blocks(pa.array(texts)):
        got = toxicity.features(b.data, b.offsets, lexicon)
        for i, t in enumerate(texts[b.lo : b.hi]):
            for j, v in slow_features(t, words).items():
                assert abs(got[i, j] - v) < 1e-4, (t, j)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1)), min_size=1, max_size=25))
def test_isotonic_is_the_max_min_of_means(rows):
    x, y = np.array([a for a, _ in rows], float), np.array([b for _, b in rows], float)
    knots, values = toxicity.isotonic(x, y)
    for v in np.unique(x):
        want = max(min(y[(x >= a) & (x <= b)].mean() for b in np.unique(x) if b >= v) for a in np.unique(x) if a <= v)
        assert abs(np.interp(v, knots, values) - want) < 1e-9


def test_a_split_is_the_best_of_all():
    r = np.random.default_rng(7)
    for _ in range(10):
        x, y = r.integers(0, 6, (60, 3)).astype(np.float32), (r.random(60) < 0.4).astype(float)
        t = toxicity.Trees(rounds=1, depth=1, least=0.0).fit(x, y)
        g, h = 1 / (1 + np.exp(-t.base)) - y, np.full(60, y.mean() * (1 - y.mean()))
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + t.decay)
        best = max(gain(x[:, j] <= c) + gain(x[:, j] > c) for j in range(3) for c in np.unique(x[:, j])[:-1])
        feature, cut, value = t.trees[0]
        left = np.searchsorted(t.edges[feature[0]], x[:, feature[0]]) <= cut[0]
        assert abs(gain(left) + gain(~left) - best) < 1e-6
        assert np.allclose(value[1:3], [-t.rate * g[m].sum() / (h[m].sum() + t.decay) for m in (left, ~left)])
