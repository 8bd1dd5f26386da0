"""Queries that SQL is too slow for or can't express, against brute force on the smallest tables."""

import duckdb
import pytest

from factloom.operators import graph
from factloom.plans import catalogue, q_graph
from factloom.plans.facts import TABLES, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_whole_graph(spark, duck):
    nf = duck.execute("SELECT count(*) FROM customer").fetchone()[0]
    out = {}
    for c, o in duck.execute("SELECT o_custkey, o_orderkey FROM orders").fetchall():
        out.setdefault(c, set()).add((c * 7 + o % 3) % nf)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    far = {x: reach(x) for x in out}
    want = {}
    for x in far:
        own = {y for y in far[x] if x in far.get(y, ())} | {x}
        if len(own) > 1:
            want[x] = min(own)
    got = {r["node"]: r["component"] for r in catalogue.queries()["o209_strongly_connected"](spark, SF).collect()}
    assert got == want and want
    touched = {r["component"] for r in catalogue.queries()["o179_touched_cycles"](spark, SF).collect()}
    assert touched == {want[x] for x in (1, 50, 100, 200) if x in want}


def power_iteration(edges, seeds=None):
    """Ranks by the reference's rule: 100 rounds at most, until the change is less than n * 1e-6."""
    nodes = sorted({x for e in edges for x in e})
    out = {x: [b for a, b in edges if a == x] for x in nodes}
    starts = [x for x in nodes if seeds is None or x in seeds]
    restart = {x: 1 / len(starts) if x in starts else 0.0 for x in nodes}
    now = dict(restart)
    for _ in range(100):
        loose = sum(now[x] for x in nodes if not out[x])
        new = {x: 0.15 * restart[x] + 0.85 * loose * restart[x] for x in nodes}
        for x in nodes:
            for y in out[x]:
                new[y] += 0.85 * now[x] / len(out[x])
        change, now = sum(abs(new[x] - now[x]) for x in nodes), new
        if change < len(nodes) * 1e-6:
            break
    return now


def test_ranks_of_a_long_chain(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)] + [("n12", "n00"), ("n05", "n00")]
    got = {r["node"]: r["score"] for r in graph.page_rank(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == pytest.approx(power_iteration(edges), abs=1e-12)


@pytest.mark.parametrize("name", ["o207_def_page_rank", "o208_file_page_rank", "o214_personalised_page_rank"])
def test_ranks_of_whole_tables(spark, duck, name):
    edges = duck.execute(oracle(q_graph.DEF_EDGES if "o207" in name else q_graph.EDGES)).fetchall()
    seeds = {x for (x,) in duck.execute(oracle("SELECT path FROM files WHERE id IN (1, 2, 3)")).fetchall()} if "o214" in name else None
    want = power_iteration(edges, seeds)
    got = {r["node"]: r["score"] for r in catalogue.queries()[name](spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-9)


def test_gate_of_converged_ranks(spark, duck):
    ranks = power_iteration(duck.execute(oracle(q_graph.EDGES)).fetchall())
    top = sorted(ranks, key=lambda x: (-round(ranks[x], 9), x))[: max(1, int(len(ranks) * 0.1))]
    changed = {x for (x,) in duck.execute(oracle("SELECT path FROM files WHERE id < 200")).fetchall()}
    got = {r["node"] for r in catalogue.queries()["o213_centrality_gate"](spark, SF).collect()}
    assert got == {x for x in top if x in changed}


def test_graph_analysis(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("x", "y"), ("y", "x"), ("z", "z1")]
    (r,) = graph.analyse(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert (r["nodes"], r["edges"], r["cycles"], r["in_cycles"], r["largest_cycle"], r["communities"]) == (8, 7, 2, 5, 3, 3)
    ranks = power_iteration(edges)
    assert r["central"] == min(ranks, key=lambda x: (-round(ranks[x], 12), x))
    (none,) = graph.analyse(spark.createDataFrame([], "src string, dst string")).collect()
    assert (none["nodes"], none["cycles"], none["communities"]) == (0, 0, 0)


def test_labels_settle_on_a_long_path(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(14)]
    found = graph.communities(spark.createDataFrame(edges, "src string, dst string"))
    once = {r["node"]: r["community"] for r in found.collect()}
    again = {r["node"]: r["community"] for r in graph.communities(spark.createDataFrame(edges, "src string, dst string"), 60).collect()}
    assert once == again
