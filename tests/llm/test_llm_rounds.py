"""Rounds of verification carry pairs along no more often than needed."""

from __future__ import annotations

from canvass.llm import components as cc, near_dedup as nd
from canvass.llm.shared import settings


def test_rounds_without_links_join_no_roots(spark, monkeypatch):
    """All pairs between two roots fail; before, each round joined the pairs that were left to the same roots again."""
    calls, real = [], nd.rooted
    monkeypatch.setattr(nd, "rooted", lambda pairs, roots: calls.append(1) or real(pairs, roots))
    texts = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(40)], "node long, text string")
    pairs = spark.createDataFrame([(a, b, 0.0) for a in range(20) for b in range(20, 40)], "a long, b long, likeness double")
    roots = spark.createDataFrame([(i, 0 if i < 20 else 20) for i in range(40)], "node long, root long")
    assert {tuple(r) for r in nd.joined_up(pairs, texts, roots, 5, 0.8).collect()} == {tuple(r) for r in roots.collect()}
    assert len(calls) == 1


def test_a_single_link_among_many_pairs_is_found(spark):
    same = " ".join(f"w{k}" for k in range(9))
    texts = spark.createDataFrame(
        [(i, same if i in (7, 31) else " ".join(f"w{i}x{k}" for k in range(9))) for i in range(40)], "node long, text string")
    pairs = spark.createDataFrame([(a, b, 0.0) for a in range(20) for b in range(20, 40)], "a long, b long, likeness double")
    roots = spark.createDataFrame([(i, 0 if i < 20 else 20) for i in range(40)], "node long, root long")
    assert {r["root"] for r in nd.joined_up(pairs, texts, roots, 5, 0.8).collect()} == {0}


def test_a_small_graph_is_contracted_at_once(spark, monkeypatch):
    """Before, a path took a round of four shuffles for each halving."""
    tables, real = [], cc.stored
    monkeypatch.setattr(cc, "stored", lambda df, name: tables.append(name) or real(df, name))
    path = spark.range(300).selectExpr("id * 7919 % 1009 AS a", "(id + 1) * 7919 % 1009 AS b").repartition(7)
    found = {r["node"]: r["root"] for r in cc.components(path).collect()}
    assert set(found.values()) == {0} and len(found) == 301
    assert len(tables) == 2


def test_larger_graphs_are_contracted_in_parts(spark):
    """No more than five edges at once, then rounds; as in a plain search."""
    edges = [(k * 37 % 101, k * 53 % 97 + 101 * (k % 2)) for k in range(0, 120, 2)] + [(5, 5), (None, 3), (250, 251), (251, 250)]
    least = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    for _ in edges:
        for a, b in (e for e in edges if None not in e and e[0] != e[1]):
            least[a] = least[b] = min(least[a], least[b])
    rows = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r["node"]: r["root"] for r in cc.components(rows, 5).collect()} == least


def test_rounds_write_as_many_files_as_their_rows_need(spark, monkeypatch):
    """Before, each table of a round had a file for each of the shuffle's partitions that had rows."""
    files, real = {}, nd.stored

    def counted(df, name):
        out = real(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(nd, "stored", counted)
    same = " ".join(f"w{k}" for k in range(9))
    texts = spark.createDataFrame([(i, same) for i in range(40)], "node long, text string")
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(39)], "a long, b long, likeness double")
    roots = spark.createDataFrame([(i, i) for i in range(40)], "node long, root long")
    with settings(spark, spark__sql__shuffle__partitions=30, spark__sql__adaptive__coalescePartitions__enabled="false"):
        assert {r["root"] for r in nd.joined_up(pairs, texts, roots, 5, 0.8).collect()} == {0}
    assert {files[name] for name in ("picks", "verified", "roots")} == {1}
