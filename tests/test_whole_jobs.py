"""Queries and operators on all of their input, by brute force: no row is left out by its id, its size or its place."""

import duckdb
import pytest

from pyspark.sql import functions as F

from ledgerloom import queries as core
from ledgerloom import session
from ledgerloom.operators import binding, graph

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


LINES = "SELECT l_orderkey, l_linenumber, min(l_extendedprice)::DECIMAL(18,2) AS e FROM lineitem GROUP BY 1, 2"


def test_solve_exact_solves_every_order(spark, tables):
    got = {r.component: (r.total, r.consistent) for r in core.q_solve_exact(spark, DATA).collect()}
    want = {k: (float(e), True) for k, e in tables.execute(f"SELECT l_orderkey, sum(e) FROM ({LINES}) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1").fetchall()}
    assert got == want and any(k % 20 for k in got)


def union_find(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        root[hi] = lo
    return {x: top(x) for x in list(root)}


SMALL = [(1, 11, 1.0, 0.0, 0.0), (1, 17, 5.0, 0.1, 0.0), (2, 17, 9.0, 0.0, 0.2), (3, 12, 1.0, 0.0, 0.0), (3, 12, 2.0, 0.3, 0.1), (4, 13, 7.0, 0.0, 0.0), (5, 13, 1.0, 0.0, 0.0), (5, 14, 3.0, 0.0, 0.0), (4, 27, 3.0, 0.0, 0.0), (6, 37, 2.0, 0.05, 0.0)]


@pytest.mark.parametrize("whole", [False, True])
def test_components_of_all_lines(spark, tables, tmp_path, whole):
    d = DATA
    if not whole:
        d = str(tmp_path)
        spark.createDataFrame(SMALL, "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{d}/lineitem.parquet")
    lines = tables.execute("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem").fetchall() if whole else [r[:2] for r in SMALL]
    want = union_find([(f"s{s}", f"p{p}") for s, p in lines])
    assert {r.node: r.component for r in core.q_components(spark, d).collect()} == want
    groups = {}
    for node, component in want.items():
        groups.setdefault(component, []).append(node)
    dirty = {c: any(n[0] == "p" and n[-1] == "7" for n in nodes) for c, nodes in groups.items()}
    got = {r.component: (r.nodes, r.dirty, r.deferred) for r in core.q_dirty_components(spark, d).collect()}
    assert got == {c: (len(nodes), dirty[c], dirty[c] and len(nodes) > 5) for c, nodes in groups.items()}


def test_log_fix_binds_every_order(spark, tables):
    got = {(r.rule, r.src_line): r.fixed for r in core.q_log_fix(spark, DATA).collect()}
    want = {("total", k * 10): float(e) for k, e in tables.execute(f"SELECT l_orderkey, sum(e) FROM ({LINES}) GROUP BY 1").fetchall()}
    assert got == want and any(line >= 2000 for _, line in got)


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_components_shuffle_edges_once_for_each_end(spark):
    """A dense graph of 12,000 edges in two components, and a path against the order of the names: few more rows are shuffled than each edge for each of its ends."""
    edges = [(f"s{c}-{i:03}", f"p{c}-{j:03}") for c in (1, 2) for i in range(100) for j in range(100) if (i * j + i + c) % 5 < 3]
    path = [(f"w{i * 37 % 64:02}", f"w{(i + 1) * 37 % 64:02}") for i in range(63)]
    df = spark.createDataFrame(edges + path, "a string, b string").coalesce(1).cache()
    assert df.count() == len(edges) + 63
    before = shuffled_rows(spark)
    got = {r.node: r.component for r in graph.components(df).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert got == union_find(edges + path)
    assert sum(n for k, n in shuffled_rows(spark).items() if k not in before) < 3.5 * len(edges)


def test_dealt_goes_by_the_number_of_rows(spark):
    """Rows that all look alike fill no partition by their bytes; they are dealt by their number."""
    rows = spark.range(1000).selectExpr("id", "'same' AS text")
    got = session.dealt(rows, "id", each=100).groupBy(F.spark_partition_id()).count().collect()
    assert len(got) == 11 and sum(r["count"] for r in got) == 1000 and max(r["count"] for r in got) < 200


def test_log_fixes_meet_their_targets_without_one_task_for_a_rule(spark):
    """All bindings are of one rule: they are not dealt by it."""
    lines = spark.range(500).selectExpr("'total' AS rule", "array(id * 10, id * 10 + 1) AS lines")
    facts = spark.range(500).selectExpr("id * 10 AS src_line", "'total' AS concept", "0.0 AS value").unionByName(spark.range(500).selectExpr("id * 10 + 1 AS src_line", "'part' AS concept", "2.0 AS value"))
    got = binding.log_fixes(lines, facts, spark.createDataFrame([("total", "total")], "rule string, concept string"))
    assert got.count() == 500 and got.where("fixed != 2.0").isEmpty()
    assert "hashpartitioning(rule#" not in got._jdf.queryExecution().toString()
