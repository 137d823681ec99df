import pytest
from conftest import SF

import __spark_entry__ as entry
from screenlake.plans import catalog


def test_names_and_sql_go_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["fold_documents", "strict_screen", "merged_screen", "resolve_strict", "trace_parents", "upsert_latest", "record_fragments", "list_sources", "compose_date", "ingest_ofac_standard", "ingest_ofac_advanced", "ingest_eu", "ingest_uk", "ingest_un", "ingest_all_counts", "ingest_lei_level1", "ingest_lei_level2", "insert_relationships", "mark_ready", "guard_content", "registry_file_urls", "phonetic_keys", "phonetic_block_whole", "screen_facts", "screen_page", "get_entities", "graph_facts", "graph_nodes", "bulk_resolve_strict", "vet_pipeline"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(key, want))


def test_plans_don_t_compare_all_pairs(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
