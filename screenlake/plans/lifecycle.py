"""Jobs over a store: the first build, refreshes, what stands, and seeding. Each writes whole versions of tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.config import InvalidRequest, check
from screenlake.operators import merge, records
from screenlake.operators.names import name_index
from screenlake.schemas import DESIGNATION, LEI_ENTITY, LEI_RELATIONSHIP, MIRROR_STATE, NAME
from screenlake.sources import lei, lists
from screenlake.streaming.refresh import Store

EDGE = ["child_lei", "parent_lei", "relationship_type"]


def _ready(store: Store, mirror: str, now: str, total: int) -> None:
    store.write("state", merge.marked_ready(store.read("state", MIRROR_STATE), mirror, now, total))


def _designations(store: Store, rows: DataFrame, now: str) -> None:
    """Merges by id (of several in a feed the last), rebuilds the name index, and marks the lists ready."""
    store.write("designation", merge.upsert(store.read("designation", DESIGNATION), rows, ["id"], ["__turn"] if "__turn" in rows.columns else ["source_entry_id"]))
    built = store.read("designation", DESIGNATION)
    store.write("name", name_index(built))
    _ready(store, "sanctions", now, built.count())


def build(store: Store, readers: Mapping[str, lists.Reader], now: str, *, level1: lists.Reader | None = None, level2: lists.Reader | None = None) -> DataFrame:
    """Everything from full feeds. Without registry readers only the lists. Returns counts by source and outcome."""
    rows, counts = lists.harvest(dict(readers), "__turn")
    _designations(store, rows, now)
    if level1 is not None:
        found, tally = lei.entities(level1)
        store.write("lei_entity", merge.upsert(store.read("lei_entity", LEI_ENTITY), found, ["lei"], [F.coalesce("last_update", F.lit(""))]))
        counts = counts.unionByName(tally.withColumn("source", F.lit("lei")))
        edges = lei.relationships(level2) if level2 is not None else store.spark.createDataFrame([], LEI_RELATIONSHIP)
        # A full Level 2 takes the place of all edges.
        store.write("lei_relationship", edges.dropDuplicates(EDGE))
        _ready(store, "lei", now, store.read("lei_entity", LEI_ENTITY).count())
    return counts


def refresh(store: Store, readers: Mapping[str, lists.Reader], now: str, *, level1: lists.Reader | None = None, level2: lists.Reader | None = None) -> DataFrame:
    """Lists from full feeds, the registry from deltas: entities by key, edges child by child. A delta alone doesn't make it ready."""
    rows, counts = lists.harvest(dict(readers), "__turn")
    _designations(store, rows, now)
    if level1 is not None:
        found, tally = lei.entities(level1)
        store.write("lei_entity", merge.upsert(store.read("lei_entity", LEI_ENTITY), found, ["lei"], [F.coalesce("last_update", F.lit(""))]))
        counts = counts.unionByName(tally.withColumn("source", F.lit("lei")))
    if level2 is not None:
        store.write("lei_relationship", merge.replace_by_child(store.read("lei_relationship", LEI_RELATIONSHIP), lei.relationships(level2), [F.coalesce("relationship_period", F.lit(""))]))
    if level1 is not None or level2 is not None:
        total = store.read("lei_entity", LEI_ENTITY).count()
        store.write("state", merge.advanced(store.read("state", MIRROR_STATE), "lei", now, total))
    return counts


def refresh_lists(store: Store, readers: Mapping[str, lists.Reader], now: str, *, budget: float = 4 * 3600.0, clock: Callable[[], float] = time.monotonic) -> bool:
    """The lists source by source, each stamped when it is merged, so that a run that is out of time, or dies, goes on from there.

    Gives whether all were merged; only then names are rebuilt and the lists marked ready."""
    began = clock()
    state = {r["mirror"]: r for r in store.read("state", MIRROR_STATE).collect()}  # two rows
    old = state.get("sanctions")
    codes = [s.code for s in lists.REGISTRY if s.code in readers]
    done = codes.index(old["checkpoint"]) + 1 if old is not None and old["checkpoint"] in codes else 0
    for code in codes[done:]:
        if clock() - began > budget:
            return False
        rows, _ = lists.harvest({code: readers[code]}, "__turn")
        store.write("designation", merge.upsert(store.read("designation", DESIGNATION), rows, ["id"], ["__turn"]))
        last = merge.state(store.spark, "sanctions", "running", old["completed_at"] if old is not None else None, old["total"] if old is not None else 0, code)
        store.write("state", merge.upsert(store.read("state", MIRROR_STATE), last, ["mirror"], ["checkpoint"]))
    built = store.read("designation", DESIGNATION)
    store.write("name", name_index(built))
    _ready(store, "sanctions", now, built.count())
    return True


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
        check(low <= first <= last <= high, f"{text} isn't within {low} to {high}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def next_run(cron: str, after: datetime) -> datetime:
    """The first minute after ``after`` that a schedule of five fields names (Sunday is 0 or 7)."""
    fields = cron.split()
    check(len(fields) == 5, "a schedule has five fields")
    minutes, hours, days, months, weekdays = (_field(f, lo, hi) for f, lo, hi in zip(fields, (0, 0, 1, 1, 0), (59, 23, 31, 12, 7)))
    weekdays = {d % 7 for d in weekdays}
    either = fields[2] != "*" and fields[4] != "*"  # then one of them is enough
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 5):
        own = at.day in days, (at.weekday() + 1) % 7 in weekdays
        if at.month in months and (any(own) if either else all(own)):
            for h in sorted(hours):
                for m in sorted(minutes):
                    if (h, m) >= (at.hour, at.minute):
                        return at.replace(hour=h, minute=m)
        at = (at + timedelta(days=1)).replace(hour=0, minute=0)
    raise InvalidRequest(f"{cron} never comes")


def serve(run: Callable[[datetime], None], cron: str, *, stop: Callable[[], bool], clock: Callable[[], datetime] = datetime.now, sleep: Callable[[float], None] = time.sleep) -> None:
    """Calls ``run`` whenever the schedule says, until ``stop``. What comes due during a run is left out."""
    while not stop():
        due = next_run(cron, clock())
        while not stop() and (left := (due - clock()).total_seconds()) > 0:
            sleep(min(left, 60.0))
        if not stop():
            run(due)


def verify(store: Store) -> DataFrame:
    """The source list of what stands."""
    return records.list_sources(store.read("designation", DESIGNATION), store.read("lei_entity", LEI_ENTITY), store.read("lei_relationship", LEI_RELATIONSHIP), store.read("state", MIRROR_STATE))


def seed(store: Store, designations: DataFrame, entities: DataFrame, edges: DataFrame, now: str) -> None:
    """Given rows in place of feeds, both corpora ready."""
    _designations(store, designations, now)
    store.write("lei_entity", entities)
    store.write("lei_relationship", edges)
    _ready(store, "lei", now, entities.count())


def names(store: Store) -> DataFrame:
    return store.read("name", NAME)
