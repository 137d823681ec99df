import pytest
from conftest import SF
from fixture_corpus import designations, edges, entities

from screenlake.config import InvalidRequest, NotFound, NotReady
from screenlake.operators import merge, ownership, records, render, screen
from screenlake.operators.names import name_index, screenable
from screenlake.plans import catalog
from screenlake.plans import crosswalk as cw
from screenlake.schemas import MIRROR_STATE

E = "IS_DIRECTLY_CONSOLIDATED_BY"
CHAIN = [("ROOT", "PARENT", E), ("PARENT", "GRAND", E), ("GRAND", "ULTIMATE", E)]


def roots(spark, *r):
    return spark.createDataFrame([(x,) for x in r], "root string")


def facts(spark, rows, root="ROOT", have=(), **how):
    e = entities(spark, [(x, f"{x} Ltd", [], "GB", "ISSUED") for x in have] or [("NONE", "None Ltd", [], "GB", "ISSUED")])
    got = ownership.graph(roots(spark, root), e, edges(spark, rows), **how)
    return got, got["facts"].first()


def test_cycle_is_complete(spark):
    got, f = facts(spark, [("ROOT", "B", E), ("B", "ROOT", E)], have=("ROOT", "B"), depth=5)
    assert (f.n_nodes, got["edges"].count(), f.truncated, f.complete) == (2, 2, False, True)


@pytest.mark.parametrize(("depth", "cut"), [(1, True), (2, True), (3, False)])
def test_depth_cuts(spark, depth, cut):
    got, f = facts(spark, CHAIN, have=("ROOT", "PARENT", "GRAND", "ULTIMATE"), direction="parents", depth=depth)
    assert f.truncated is cut and f.complete is not cut and f.n_nodes == depth + 1


def test_roles_and_missing(spark):
    rows = [*CHAIN, ("SIBLING", "PARENT", E), ("ROOT", "MISSING", E)]
    got, f = facts(spark, rows, have=("ROOT", "PARENT", "GRAND", "ULTIMATE", "SIBLING"), depth=3)
    role = {r.lei: (r.depth, r.role) for r in got["nodes"].collect()}
    assert role["SIBLING"] == (2, "child") and role["PARENT"] == (1, "parent") and role["ROOT"] == (0, "root")
    assert f.missing_leis == ["MISSING"] and not f.complete
    assert "MISSING" in render.graph(got["nodes"], got["edges"], got["facts"])


def test_many_roots_are_single_ones(spark):
    e = edges(spark, [*CHAIN, ("ROOT", "ROOT", E)])
    both = ownership.trace(roots(spark, "ROOT", "GRAND", "NOWHERE"), e, "both", 2)[0].collect()
    for r in ("ROOT", "GRAND", "NOWHERE"):
        one = ownership.trace(roots(spark, r), e, "both", 2)[0].collect()
        assert sorted(one) == sorted(x for x in both if x.root == r)
    assert ownership.relationships(e, roots(spark, "ROOT").selectExpr("root", "root AS lei")).where("child_lei = parent_lei").count() == 2


def test_node_screens(spark):
    more = [("un", f"N-{i:02}", "organization", "ROOT Ltd", []) for i in range(12)]
    d = designations(spark, more)
    names = screenable(name_index(d), d)
    got, f = facts(spark, CHAIN, have=("ROOT", "PARENT"), names=names, screen_nodes=True, depth=1)
    root = got["nodes"].where("lei = 'ROOT'").first()
    assert (root.matches, root.has_more, got["hits"].count()) == (12, True, 10)
    assert (f.screened_nodes, f.flagged_nodes, f.screening) == (2, 1, "screened")
    assert facts(spark, CHAIN, screen_nodes=True, names=names, sanctions_ready=False)[1].screening == "not_ready"
    assert facts(spark, CHAIN)[1].screening == "not_requested"
    with pytest.raises(NotReady):
        facts(spark, CHAIN, lei_ready=False)
    with pytest.raises(InvalidRequest):
        facts(spark, CHAIN, depth=6)


def test_records(spark):
    d = designations(spark)
    names = screenable(name_index(d), d)
    assert records.get_designation(d, "un", "FX-6006").first().primary_name == "Mohammed Al-Testi"
    with pytest.raises(NotFound):
        records.get_designation(d, "un", "no")
    with pytest.raises(InvalidRequest):
        records.get_entity("X", entities(spark), names)
    for call in (lambda: records.get_designation(d, "un", "FX-6006", ready=False), lambda: screen.screen(screen.queries_of(spark, ["Ivan Volkov"]), names, ready=False), lambda: records.get_entity("5493001KJTIIGC8Y1R12", entities(spark), names, lei_ready=False)):
        with pytest.raises(NotReady):
            call()
    got, hits = records.get_entity("5493001KJTIIGC8Y1R12", entities(spark), names)
    assert (got.first().matches, got.first().screening, hits.first().designation_id) == (1, "screened", "ofac_consolidated:FX-2002")
    with pytest.raises(NotFound):
        records.get_entity("5493001KJTIIGC8Y1R99", entities(spark), names)
    assert records.get_entity("5493001KJTIIGC8Y1R12", entities(spark), None)[0].first().screening == "not_ready"
    row = spark.createDataFrame([("5493001KJTIIGC8Y1R12",), ("5493001kjtiigc8y1r12",), (None,)], "x string").select(ownership.is_lei(ownership.F.col("x")))
    assert [r[0] for r in row.collect()] == [True, False, False]


def test_merges(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    batch = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "k string, v int, t int")
    once = merge.upsert(old, batch, ["k"], ["t"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 6), ("c", 7)]
    assert sorted(map(tuple, merge.upsert(once, batch, ["k"], ["t"]).collect())) == [("a", 1), ("b", 6), ("c", 7)]
    e = edges(spark, [("A", "X", E), ("A", "Y", E), ("B", "X", E)])
    new = edges(spark, [("A", "Z", E)]).withColumn("t", merge.F.lit(1))
    pairs = lambda df: sorted((r.child_lei, r.parent_lei) for r in df.collect())
    assert pairs(merge.replace_by_child(e, new, ["t"])) == [("A", "Z"), ("B", "X")]
    assert pairs(merge.replace_by_child(e, new, ["t"], insert_only=True)) == [("A", "X"), ("A", "Y"), ("A", "Z"), ("B", "X")]


def test_deferred_sets_nulls_and_adds_no_row(spark):
    d = designations(spark).withColumn("program", merge.F.lit("OLD"))
    late = spark.createDataFrame([("un", "FX-6006", "NEW", None), ("un", "orphan", "X", "Y")], "source string, source_entry_id string, program string, designation_date string")
    got = {r.source_entry_id: (r.program, r.designation_date) for r in merge.apply_deferred(d, late).collect()}
    assert len(got) == 10 and got["FX-6006"] == ("NEW", None) and got["FX-7007"] == ("OLD", None)


def test_state(spark):
    s = spark.createDataFrame([("lei", "running", None, None, None)], MIRROR_STATE)
    assert not merge.readiness(merge.advanced(s, "lei", "t1", 3)).first().ready
    done = merge.marked_ready(s, "lei", "t1", 3)
    assert merge.readiness(done).first().ready
    assert merge.readiness(merge.advanced(done, "lei", "t2", 4)).first().total == 4
    listed = records.list_sources(designations(spark), entities(spark), edges(spark, CHAIN), done)
    assert {r.source: (r.records, r.ready) for r in listed.collect()} == {"ofac_sdn": (2, False), "ofac_consolidated": (1, False), "eu": (2, False), "uk": (2, False), "un": (3, False), "lei": (4, True)}
    assert "EU consolidated list" in render.sources(listed)


def test_vet_and_render(spark):
    d = designations(spark)
    names = screenable(name_index(d), d)
    q = screen.queries_of(spark, ["Fictional Trading Company LLC", "Nobody"])
    rows = {r.query_id: r for r in records.vet(q, names, entities(spark), edges(spark, [("5493001KJTIIGC8Y1R12", "529900T8BM49AURSDO55", E)])).collect()}
    assert (rows["0"].top_designation, rows["0"].lei, rows["0"].n_nodes, rows["0"].flagged_nodes, rows["0"].complete) == ("ofac_consolidated:FX-2002", "5493001KJTIIGC8Y1R12", 2, 1, True)
    assert rows["1"].lei is None
    hits, facts_ = screen.screen(screen.queries_of(spark, ["Ivan Volkow"]), names)
    assert "score 1.000, 2/2" in render.hits(screen.page(hits), facts_)
    assert "Ivan Wolkow" in render.record(d.where("id = 'ofac_sdn:FX-1001'"))


def walked(steps, root, depth):
    """({lei: (depth, role)}, edges, truncated) by brute force."""
    seen, held, level = {root: (0, "root")}, set(), [root]
    for d in range(1, depth + 1):
        fresh = {}
        for lei in sorted(level):
            for turn, other, edge in sorted(steps.get(lei, [])):
                held.add(edge)
                if other not in seen:
                    fresh.setdefault(other, (d, "child" if turn else "parent"))
        seen |= fresh
        level = list(fresh)
    return seen, held, any(edge not in held for lei in level for _, _, edge in steps.get(lei, []))


def test_bulk_walks_start_from_every_customer(spark):
    rows = [tuple(r) for r in cw.relationships(spark, SF).select(*ownership.EDGE).collect()]
    every = {r.root for r in cw.table(spark, SF, "customer").select(cw.lei(catalog.F.col("c_custkey")).alias("root")).collect()}
    known = {r.lei for r in cw.entities(spark, SF).select("lei").collect()}
    steps = {"parents": {}, "children": {}, "both": {}}
    for e in rows:
        for way in ("parents", "both"):
            steps[way].setdefault(e[0], []).append((0, e[1], e))
        for way in ("children", "both"):
            steps[way].setdefault(e[1], []).append((int(e[0] != e[1]), e[0], e))
    got = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF).collect())
    walk = lambda way, depth: {r: walked(steps[way], r, depth) for r in every}
    assert len(every) > 100
    for name, way, depth in (("trace_parents", "parents", 5), ("trace_children", "children", 2), ("trace_both", "both", 3)):
        assert got(name) == sorted((r, lei, *x) for r, (seen, _, _) in walk(way, depth).items() for lei, x in seen.items())
    assert got("trace_edges") == sorted((r, *e) for r, (_, held, _) in walk("both", 2).items() for e in held)
    assert got("trace_truncated") == sorted((r, cut) for r, (_, _, cut) in walk("parents", 2).items())
    assert got("missing_entities") == sorted((r, lei) for r, (seen, _, _) in walk("parents", 5).items() for lei in seen if lei not in known)
    assert got("relationships_both") == sorted((lei, other, "child" if turn else "parent", e[2]) for lei in every for turn, other, e in steps["both"].get(lei, []))
    nodes = got("screen_graph_nodes")
    assert sorted(n[:2] for n in nodes) == sorted((r, lei) for r, (seen, _, _) in walk("parents", 3).items() for lei in seen)
    few = [tuple(r) for r in catalog.QUERIES["screen_graph_nodes"](spark, SF).collect()]
    assert few and set(few) <= set(nodes)


def test_what_grows_is_not_broadcast(spark):
    """However small the files are, edges, roots and names don't pass through the driver."""
    from screenlake.plans import crosswalk as cw
    from screenlake.plans.catalog import QUERIES

    for df in (QUERIES["relationships_both"](spark, "/root/testdata/sf0.001"), cw.names(spark, "/root/testdata/sf0.001", with_phonetic=False)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
