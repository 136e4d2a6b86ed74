"""The Java front-end on small sources."""

import pytest

from codelode.sources import java

SOURCE = '''
package a; // a comment with { brackets
class A {
  private int total = 0;
  @Override public String run(java.util.Map<String, Integer> m, int n) throws Exception {
    String s = read("x;y{");
    int i = 0;
    while (i < n) { i = i + 1; }
    if (n > 2) { s = clean(s); } else { return s; }
    for (int k = 0; k < n; k++) total += k;
    try { write(s); } catch (Exception e) { log(e); } finally { i++; }
    return s + i;
  }
  void other(String q) { write(read(q)); write(other2(read(q))); }
  abstract int none(int x);
}
'''
RULES = {"sources": ["read"], "sinks": ["write"], "sanitizers": ["clean"]}


def edges(rows, kind):
    label = {r["id"]: (r["kind"], r["label"], r["line"]) for r in rows if r["what"] == "node"}
    return {(label[r["source_node_id"]], label[r["target_node_id"]]) for r in rows if r["what"] == "edge" and r["kind"] == kind}


def test_methods_and_control_flow():
    found, flags = java.methods(SOURCE)
    assert [(m.name, m.parameters) for m in found] == [("run", ["m", "n"]), ("other", ["q"])] and not flags
    flow = {(a[1:], b[1:]) for a, b in edges(java.analyze("A.java", SOURCE, RULES), "CONTROL_FLOW")}
    assert {(("plain", 7), ("while", 8)), (("while", 8), ("plain", 8)), (("plain", 8), ("while", 8)), (("while", 8), ("if", 9)), (("if", 9), ("return", 9)), (("plain", 9), ("for", 10)), (("plain", 11), ("plain", 11)), (("plain", 11), ("return", 12))} <= flow
    assert (("return", 9), ("for", 10)) not in flow  # a return ends its path


def test_reaching_definitions():
    use = {(a[1:], b[1:]) for a, b in edges(java.analyze("A.java", SOURCE, RULES), "DEF_USE")}
    assert {(("n", 5), ("while", 8)), (("i", 7), ("while", 8)), (("i", 8), ("while", 8)), (("s", 6), ("plain", 9)), (("s", 6), ("return", 9)), (("s", 9), ("return", 12)), (("i", 11), ("return", 12))} <= use
    assert (("i", 11), ("while", 8)) not in use


def test_taint_stops_at_unknown_calls():
    taint = {(a[:2], b[:2]) for a, b in edges(java.analyze("A.java", SOURCE, RULES), "TAINT_FLOW")}
    assert (("SOURCE", "read"), ("SANITIZER", "clean")) in taint and (("SANITIZER", "clean"), ("SINK", "write")) in taint
    direct = [r for r in java.analyze("B.java", "class B { void other(String q) { write(read(q)); write(other2(read(q))); } }", RULES) if r["what"] == "edge" and r["kind"] == "TAINT_FLOW"]
    assert len(direct) == 1


def test_what_is_not_followed_is_named():
    rows = java.analyze("C.java", "class C { int f(int x) { for (;;) { if (x > 1) break; } switch (x) { case 1: return 2; } return x; } }", {})
    assert {r["label"] for r in rows if r["what"] == "limitation"} == {"JUMPS_NOT_FOLLOWED", "SWITCH_NOT_FOLLOWED"}
    assert java.analyze("D.java", "class D { void f( {", {})[0]["label"] == "UNREADABLE_SOURCE"


def test_files_as_rows(spark):
    files = spark.createDataFrame([("A.java", "class A { int f(int x) { return g(x); } }"), ("B.java", "class B { int g(int y) { return y; } }"), ("C.java", None), ("D.java", "")], "path string, content string")
    nodes, edges_ = java.graph_of(java.program_facts(files, RULES))
    kinds = {r["kind"]: r["count"] for r in edges_.groupBy("kind").count().collect()}
    assert kinds == {"CONTROL_FLOW": 2, "DEF_USE": 2, "ARGUMENT_FLOW": 1, "RETURN_FLOW": 1}
    ids = {r["id"] for r in nodes.collect()}
    assert all(r["source_node_id"] in ids and r["target_node_id"] in ids for r in edges_.collect())


@pytest.mark.parametrize("text", ['"a\\"b"', "'\\''", '"""x "y" z"""', "/* a * b */ 1", "a >>>= 2"])
def test_tokens(text):
    assert len(java.tokens(text)) in (1, 3)


def test_edges_are_counted_where_they_are_read(spark):
    rows = [(f"A{i}.java", "class A { int f(int a) { int x = a; if (x > 1) { x = x + 1; } return x; } }" if i % 2 else "class A { }") for i in range(40)] + [("null.java", None), ("bad.java", "class A { void f() { (")]
    sources = spark.createDataFrame(rows, "path string, content string").coalesce(1)
    got = java.edge_counts(sources, "CONTROL_FLOW")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and java.spread(sources).rdd.getNumPartitions() >= 16
    assert {tuple(r) for r in got.collect()} == {(f"A{i}.java", 5) for i in range(1, 40, 2)}
