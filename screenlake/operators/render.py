"""Answers as Markdown, for people. Rows are those of one page, never of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from screenlake.config import CAVEAT, LABELS

MOST = 100


def _score(row) -> str:
    return "" if row["score"] is None else f", score {row['score']:.3f}, {row['covered']}/{row['n_tokens']} tokens"


def hits(page: DataFrame, facts: DataFrame) -> str:
    """A page of screening hits of one query."""
    f, rows = facts.first(), page.orderBy("position").take(MOST)
    about = "at least " if f["total_basis"] == "lower_bound" else ""
    lines = [f"**{about}{f['total_available']} candidates** for `{f['normalized_query']}` ({f['mode_used']})", ""]
    lines += [f"- {r['primary_name']} ({LABELS.get(r['source'], r['source'])}, {r['source_entry_id']}, {r['entity_type']}): {r['match_type']} on {r['matched_name']} ({r['matched_name_type']}){_score(r)}" for r in rows]
    return "\n".join([*lines, "", CAVEAT])


def matches(page: DataFrame, facts: DataFrame) -> str:
    """A page of entity matches of one query."""
    f, rows = facts.first(), page.orderBy("position").take(MOST)
    lines = [f"**{f['total_available']} entities** for `{f['normalized_query']}` ({f['mode_used']})", ""]
    lines += [f"- {r['legal_name']} ({r['lei']}, {r['jurisdiction'] or '-'}, {r['status'] or '-'}): {r['match_type']} on {r['matched_name']}{_score(r)}" for r in rows]
    return "\n".join([*lines, "", CAVEAT])


def record(row: DataFrame) -> str:
    """All that is known of one record, blanks left out."""
    r = row.first().asDict(recursive=True)
    return "\n".join([*(f"- {k.replace('_', ' ')}: {v}" for k, v in r.items() if v not in (None, [], "")), "", CAVEAT])


def graph(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> str:
    """An ownership graph of one root."""
    f = facts.first()
    lines = [f"**{f['n_nodes']} entities**, {'complete' if f['complete'] else 'incomplete'}" + (", cut off by depth" if f["truncated"] else ""), ""]
    lines += [f"{'  ' * r['depth']}- {r['legal_name']} ({r['lei']}, {r['role']})" for r in nodes.orderBy("place").take(MOST)]
    lines += ["", *(f"- {e['child_lei']} → {e['parent_lei']} ({e['relationship_type']})" for e in edges.orderBy("child_lei", "parent_lei").take(MOST))]
    return "\n".join([*lines, "", CAVEAT])


def sources(listed: DataFrame) -> str:
    rows = listed.orderBy("source").collect()  # six rows
    return "\n".join(f"- {r['label']}: {r['records']} records, {'as of ' + r['as_of'] if r['ready'] and r['as_of'] else 'ready' if r['ready'] else 'not ready'}" for r in rows)
