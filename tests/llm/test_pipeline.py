import random

import corpus_pipeline
from test_corpus_operators import brute_copies, brute_repeats, prose
from test_text_operators import table

from screenlake.llm import bpe, toxicity


def test_stages_do_what_brute_force_does(spark, tmp_path):
    r = random.Random(11)
    shared, rows, labels = prose(r, 80), [], []
    for i in range(150):
        w = prose(r, 120).split()
        if i % 5 == 0:
            for j in range(0, 120, 6):
                w[j : j + 2] = ["you", "vilefoe"]
        if i % 5 == 1:
            w[20:20] = shared.split()
        rows.append((i, " ".join(w), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + i, rows[i * 5 + 2][1], "en", "s1") for i in range(10)]
    table(spark, rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(q.doc_id, q.text) for q in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append((before, docs))
    ids = lambda df: {q.doc_id for q in df.collect()}
    assert ids(seen[0][1]) == {i for i, *_ in rows if i >= 200 or i % 5}
    assert ids(seen[1][1]) == {i for i, _ in seen[1][0]} - brute_copies(seen[1][0])
    after = {q.doc_id: q.text for q in seen[2][1].collect()}
    assert len(after) == len(seen[2][0]) and not brute_repeats(list(after.items()))
    assert sum(len(t.split()) for _, t in seen[2][0]) - sum(len(t.split()) for t in after.values()) == sum(m for _, _, m, *_ in brute_repeats(seen[2][0]))
    mixed = sum(len((t or "").split()) for t in (q.text for q in seen[3][1].collect()))
    assert 0 <= sum(len(t.split()) for t in after.values()) - mixed <= 3  # budgets are whole numbers of tokens
    assert all(q.round_trip for q in seen[4][1].collect()) and seen[4][1].count() == seen[3][1].count()
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((q.doc_id, q.n_tokens) for q in run.collect()) == sorted((q.doc_id, q.n_tokens) for q in seen[4][1].collect())
    assert toxicity.THRESHOLD and bpe.VOCABULARY


def test_awkward_tables_pass_all_stages(spark, tmp_path):
    r = random.Random(13)
    shared, same = prose(r, 70), prose(r, 90)
    calm = [(f"c{i}", prose(r, 60) + (" " + shared if i % 4 == 0 else ""), "en", f"s{i % 2}") for i in range(60)]
    toxic = [(f"t{i}", " ".join(["you", "vilefoe"] * 8) + " " + prose(r, 30), "en", "s0") for i in range(30)]
    odd = [("n", None, None, None), ("e", "", "en", ""), ("b", " \n ", "en", "s1"), (None, same, "en", "s1"), ("r", same, "en", "s0"), ("r", same, "en", "s0"), ("r", prose(r, 40), "en", "s0"), ("long", " ".join(prose(r, 200) for _ in range(60)), None, "s1")]
    columns = "doc_id string, text string, lang string, source string, n_chars long, `meta.url` int, row int, __0 string"
    docs = spark.createDataFrame([(*d, None if d[1] is None else len(d[1]), 1, 2, "x") for d in calm + toxic + odd], columns)
    labels = spark.createDataFrame([(d[0], 1, int(d[0][0] == "t"), 9) for d in calm + toxic] + [(None, 1, 1, 9), ("n", None, None, 9)], "doc_id string, quality int, toxic int, text int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"o{k}"))
        docs = spark.read.parquet(str(tmp_path / f"o{k}"))
        ids.append([q.doc_id for q in docs.collect()])
    clean = {c[0] for c in calm} | {"n", "e", "b", None, "r", "long"}
    assert set(ids[0]) == clean and len(ids[0]) == len(calm) + len(odd)
    assert set(ids[1]) == clean - {None} and ids[1].count("r") == 2  # the equal text without an id ranks last
    assert sorted(ids[1]) == sorted(ids[2]) and set(ids[3]) <= clean - {"n", "e", "b"} and "long" in ids[3]
    assert all(q.round_trip for q in docs.collect())
    none = spark.createDataFrame([], columns)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0
