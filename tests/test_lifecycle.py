from datetime import datetime, timedelta

import pytest
from fixture_corpus import designations, edges, entities
from test_sources import ADVANCED, EU, LEI1, LEI2

from screenlake.config import InvalidRequest
from screenlake.plans import lifecycle
from screenlake.schemas import DESIGNATION, LEI_RELATIONSHIP, MIRROR_STATE
from screenlake.sources import lists
from screenlake.streaming.refresh import Store


def test_build_then_refresh(spark, tmp_path):
    read = lambda m: lists.column(spark.createDataFrame([(m,)], "m string"), "m")
    store = Store(spark, str(tmp_path))
    lifecycle.refresh(store, {"eu": read(EU)}, "t0", level1=read(LEI1))
    assert {r.source: (r.records, r.ready) for r in lifecycle.verify(store).collect()}["lei"] == (1, False)
    counts = lifecycle.build(store, {"ofac_sdn": read(ADVANCED), "eu": read(EU)}, "t1", level1=read(LEI1), level2=read(LEI2))
    assert {(r.source, r.outcome, r.n) for r in counts.collect()} == {("ofac_sdn", "accepted", 2), ("ofac_sdn", "unusable_name", 1), ("eu", "accepted", 2), ("lei", "accepted", 1), ("lei", "missing_identifier", 1)}
    got = {r.source: (r.records, r.ready, r.as_of) for r in lifecycle.verify(store).collect()}
    assert got["lei"] == (1, True, "t1") and got["eu"] == (2, True, "t1") and got["ofac_sdn"][0] == 2
    assert lifecycle.names(store).count() == 7
    lifecycle.refresh(store, {"eu": read(EU)}, "t2", level2=read(LEI2.replace(">B<", ">C<")))
    assert [(r.child_lei, r.parent_lei) for r in store.read("lei_relationship", LEI_RELATIONSHIP).collect()] == [("A", "C")]
    got = {r.source: (r.records, r.as_of) for r in lifecycle.verify(store).collect()}
    assert got["lei"] == (1, "t2") and got["ofac_sdn"] == (2, "t2")


def test_of_entries_that_repeat_in_a_feed_the_last_stays(spark, tmp_path):
    read = lambda m: lists.column(spark.createDataFrame([(m,)], "m string"), "m")
    store = Store(spark, str(tmp_path))
    entry = lambda n: f'<sanctionEntity logicalId="5"><nameAlias wholeName="Name {n}"/></sanctionEntity>'
    lifecycle.refresh(store, {"eu": read("<export>" + "".join(map(entry, range(12))) + "</export>")}, "t0")
    assert [r.primary_name for r in store.read("designation", DESIGNATION).collect()] == ["Name 11"]


def test_a_refresh_goes_on_where_it_stopped(spark, tmp_path):
    read = lambda m: lists.column(spark.createDataFrame([(m,)], "m string"), "m")
    store, ticks, seen = Store(spark, str(tmp_path)), iter([0, 1, 99, 0, 1]), []

    def noted(code, markup):
        return lambda tag, schema: (seen.append(code), read(markup)(tag, schema))[1]

    readers = {"ofac_sdn": noted("ofac_sdn", ADVANCED), "eu": noted("eu", EU)}
    assert not lifecycle.refresh_lists(store, readers, "t1", budget=50, clock=lambda: next(ticks))
    state = store.read("state", MIRROR_STATE).first()
    assert (state.status, state.completed_at, state.checkpoint) == ("running", None, "ofac_sdn") and "eu" not in seen
    seen.clear()
    assert lifecycle.refresh_lists(store, readers, "t2", budget=50, clock=lambda: next(ticks))
    state = store.read("state", MIRROR_STATE).first()
    assert (state.status, state.completed_at, state.total) == ("complete", "t2", 4) and set(seen) == {"eu"} and lifecycle.names(store).count() > 4


def test_schedules():
    at = datetime(2024, 2, 28, 4, 0, 30)
    assert lifecycle.next_run("0 4 * * *", at) == datetime(2024, 2, 29, 4, 0)
    assert lifecycle.next_run("*/20 * * * *", at) == datetime(2024, 2, 28, 4, 20)
    assert lifecycle.next_run("30 1 1 3-5 *", at) == datetime(2024, 3, 1, 1, 30)
    assert lifecycle.next_run("0 0 * * 7", at) == datetime(2024, 3, 3) and lifecycle.next_run("0 0 29 2 *", at.replace(day=29)) == datetime(2028, 2, 29)
    assert lifecycle.next_run("0 0 13 * 5", at) == datetime(2024, 3, 1)  # a Friday comes before the 13th
    for bad in ("0 4 * *", "61 * * * *", "0 0 31 2 *"):
        with pytest.raises(InvalidRequest):
            lifecycle.next_run(bad, at)
    now, runs = [at], []
    lifecycle.serve(runs.append, "0 4 * * *", stop=lambda: len(runs) == 3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + timedelta(seconds=s)))
    assert runs == [datetime(2024, 2, 29, 4), datetime(2024, 3, 1, 4), datetime(2024, 3, 2, 4)]


def test_seed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    lifecycle.seed(store, designations(spark), entities(spark), edges(spark, [("A", "B", "T")]), "t")
    assert lifecycle.names(store).count() == 22 and all(r.ready for r in lifecycle.verify(store).collect())
