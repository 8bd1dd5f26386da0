"""Walks to the end, however far it is."""

from factloom.operators import resolve


def test_scopes_beyond_twelve_levels(spark):
    scopes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)] + [(50, 51), (51, 50)], "scope_id long, parent_scope_id long")
    got = {(r["scope_id"], r["ancestor"], r["depth"]) for r in resolve.scope_ancestors(scopes).collect()}
    assert got == {(i, j, i - j) for i in range(20) for j in range(i + 1)} | {(50, 50, 0), (50, 51, 1), (51, 51, 0), (51, 50, 1)}


def test_chains_beyond_six_links(spark):
    members = spark.createDataFrame([(f"T{i}", "next", f"T{i + 1}") for i in range(9)], "base_type string, member_name string, member_type string")
    starts = spark.createDataFrame([(1, "T0", ["next"] * 9), (2, "T7", ["next"] * 4)], "id long, type string, chain array<string>")
    got = {(r["id"], r["type"], r["steps"]) for r in resolve.trace_members(starts, members).collect()}
    assert got == {(1, "T9", 9), (2, "T9", 2)}
