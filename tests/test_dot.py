import pytest

from sparkweft.graph import Graph
from sparkweft.sources.dot import dot_lines, read_dot, write_dot


def text(df):
    return [r["line"] for r in df.orderBy("part", "number").collect()]


def test_mixed_graph(spark):
    g = Graph.local(spark, 3, [(0, 1, 1.0), (1, 2, 2.0, True)])
    assert text(dot_lines(g)) == ["digraph G {", "  v0;", "  v1;", "  v2;", "  v0 -> v1 [weight=1.0,dir=none];", "  v1 -> v2 [weight=2.0];", "}"]


def test_round_trip(spark, tmp_path):
    g = Graph.local(spark, 4, [(0, 1, 0.123456789), (1, 2, -999.999, True), (3, 3, 1e-05)], {"name": ['a "b"', "graph // x", "c\\d", None]})
    write_dot(g, f"{tmp_path}/g", "name")
    back = read_dot(spark, f"{tmp_path}/g", labels=True)
    assert sorted(tuple(r) for r in back.edges.collect()) == [(0, 0, 1, 0.123456789, False), (1, 1, 2, -999.999, True), (2, 3, 3, 1e-05, False)]
    assert {r["id"]: r["label"] for r in back.vertices.collect()} == {0: 'a "b"', 1: "graph // x", 2: "c\\d", 3: ""}


def test_reading(spark, tmp_path):
    (tmp_path / "g.dot").write_text("digraph roads {\n // nothing\n v7;\n v9 -> v7; // no brackets\n v7 -> v3 [weight=2.5, dir=none];\n}\n")
    g = read_dot(spark, f"{tmp_path}/g.dot")
    assert g.vertex_count() == 3
    assert [tuple(r) for r in g.edges.orderBy("eid").collect()] == [(0, 1, 0, 1.0, True), (1, 0, 2, 2.5, False)]
    with pytest.raises(ValueError):
        read_dot(spark, f"{tmp_path}/g.dot", labels=True)
