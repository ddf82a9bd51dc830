"""Rules, states, lookups and gates against planted faults."""

import pytest
from pyspark.sql import functions as F

from orbweave.operators import gates, rules


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def frame(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_the_first_rule_that_fails_is_named(spark):
    d = frame(spark, "k int, v double, t string", (1, 5.0, "a"), (2, 99.0, " "), (3, None, ""), (4, float("nan"), "a"), (5, 1.0, None))
    why = rules.first_violation([(rules.outside(F.col("v"), 1, 10), F.concat(F.lit("v = "), F.coalesce(F.col("v").cast("string"), F.lit("null")))), (rules.blank(F.col("t")), "blank")])
    assert rows(d.select("k", why.alias("w"))) == [(1, None), (2, "v = 99.0"), (3, "v = null"), (4, "v = NaN"), (5, None)]
    assert d.select(rules.first_violation([]).alias("w")).distinct().collect()[0].w is None


def test_completeness_is_never_null(spark):
    d = frame(spark, "k int, a int, b boolean", (1, 1, True), (2, None, True), (3, 1, None), (4, 1, False))
    assert rows(d.select("k", rules.complete([F.col("a")], [F.col("b")]).alias("c"))) == [(1, True), (2, False), (3, False), (4, False)]


def test_contracts_name_strangers_and_nulls(spark):
    d = frame(spark, "s string", ("a",), ("b",), ("b",), (None,), ("A",))
    assert rows(rules.strangers(d, "x", "s", ["a"])) == [("x", "A", 1), ("x", "b", 2), ("x", None, 1)]


def test_work_is_what_has_no_finished_record(spark):
    p, r = frame(spark, "k int, x string", (1, "a"), (2, "b"), (3, "c"), (None, "d")), frame(spark, "k int, ok boolean", (1, True), (2, False), (2, None), (None, True))
    assert rows(rules.work_list(p, r, "k", F.col("ok")), "k") == [(2,), (3,), (None,)]


def test_lookups_are_strict(spark):
    r, d = frame(spark, "k int", (1,), (2,), (2,)), frame(spark, "id int, v string", (1, "a"), (2, "b"), (9, "z"))
    assert rows(rules.strict_lookup(r, d, "k", "id"), "k", "v") == [(1, "a"), (2, "b"), (2, "b")]
    for bad, why in ((frame(spark, "k int", (1,), (7,)), "no row for k = 7"), (frame(spark, "k int", (None,)), "no row for k = null")):
        with pytest.raises(Exception, match=why):
            rules.strict_lookup(bad, d, "k", "id").collect()
        assert rules.unmatched(bad, d, "k", "id").count() == 1
    with pytest.raises(ValueError, match="id = 2 is there 2 times"):
        rules.strict_lookup(r, d.union(d.where("id = 2")), "k", "id")
    assert rows(rules.unmatched(r.union(frame(spark, "k int", (5,), (5,))), d.union(d), "k", "id")) == [(5, 2)]


def test_states_of_matches(spark):
    r = frame(spark, "g string, k int", ("x", 1), ("x", 2), ("x", 3), ("x", None), ("y", 1))
    c = frame(spark, "id int, bad boolean", (1, None), (2, True), (4, False))
    s = rules.match_states(r, c, "k", "id", F.col("bad"))
    assert rows(s, "g", "k", "state") == [("x", 1, "covered"), ("x", 2, "degraded"), ("x", 3, "uncached"), ("x", None, "uncached"), ("y", 1, "covered")]
    assert rows(rules.coverage_by(s, "g")) == [("x", 4, 1, 1, 2, 0.25), ("y", 1, 1, 0, 0, 1.0)]


def test_provenance_needs_the_declared_content(spark):
    r = frame(spark, "k int, content string", (1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, None))
    g = frame(spark, "k int, version int, declared_digest string", (1, 3, None), (2, 1, "b"), (3, 1, "changed"), (5, 1, None))
    got = rules.provenance(r, g, "k", F.col("content"), F.col("version") == 1, F.col("version") == 3)
    assert rows(got, "k", "state") == [(1, "current"), (2, "declared"), (3, "unaccounted"), (4, "none"), (5, "unaccounted")]


def test_comparisons_have_both_sides(spark):
    a, b = frame(spark, "c string, n int", ("a", 1), ("b", 5), ("x", 2)), frame(spark, "c string, n int", ("a", 2), ("b", 5), ("y", 1))
    assert rows(rules.compared(a, b, "c", "n")) == [("a", 1, 2, "differs"), ("b", 5, 5, "holds"), ("x", 2, None, "not published"), ("y", None, 1, "missing")]


def test_reads_have_three_states(spark):
    k, r = frame(spark, "k int", (1,), (2,), (3,), (None,)), frame(spark, "k int, ok boolean", (1, True), (2, False), (None, True))
    assert rows(rules.read_states(k, r, "k", F.col("ok"))) == [(1, "record"), (2, "unreadable"), (3, "absent"), (None, "absent")]


def test_registries_show_duplicates_first(spark):
    d = frame(spark, "k int, id string, s string", (1, "a", "ok"), (2, "a", "no"), (3, "b", "no"), (4, None, "ok"), (5, None, "ok"))
    assert rows(rules.registry_faults(d, "k", F.col("id"), [(F.col("s") != "ok", "unknown"), (F.col("id").isNull(), "no id")])) == [(1, "duplicate"), (2, "duplicate"), (3, "unknown"), (4, "no id"), (5, "no id")]


def test_what_was_promoted_never_changes(spark):
    s, p = frame(spark, "k int, h string", (1, "a"), (2, "b"), (3, "c"), (4, None)), frame(spark, "k int, h string", (2, "b"), (3, "x"), (4, None))
    assert rows(rules.promotion(s, p, "k", "h")) == [(1, "promote"), (2, "same"), (3, "refused"), (4, "same")]


def test_shares_add_up(spark):
    d = frame(spark, "g string, i int, w double", ("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 5, 0.0), ("b", 7, 0.0), ("c", 0, 9.0), ("c", 1, 1.0), (None, 0, 3.0))
    got = rules.largest_remainder(d, "g", "i", "w", 100)
    assert rows(got, "g", "i", "points") == sorted([("a", 0, 34), ("a", 1, 33), ("a", 2, 33), ("b", 5, 100), ("b", 7, 0), ("c", 0, 90), ("c", 1, 10), (None, 0, 100)], key=str)
    assert got.columns == ["g", "i", "w", "points"]


def test_gates_fail_closed(spark):
    c = frame(spark, "gate string, criterion string, observed double, least double, most double", ("a", "x", 1.0, 0.0, 2.0), ("a", "y", 1.0, None, 1.0), ("b", "x", 3.0, None, 2.0), ("b", "w", None, None, 2.0), ("c", "x", float("nan"), 0.0, None), ("c", "y", 1.0, None, None), ("d", "x", -1.0, 0.0, None))
    assert rows(gates.gate_verdicts(c)) == [("a", "PASS", 0, None), ("b", "FAIL", 2, "x"), ("c", "BLOCKED", 3, "x"), ("d", "FAIL", 2, "x")]


def test_a_change_invalidates_only_what_depends_on_it(spark):
    v = frame(spark, "gate string, verdict string", *((g, "FAIL" if g == "f" else "PASS") for g in "abcdef"))
    used = frame(spark, "gate string, input string, digest string", ("a", "i1", "1"), ("b", "i2", "2"), ("c", "i3", "3"), ("d", "i2", "2"), ("f", "i1", "1"))
    links = frame(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("d", "e"), ("c", "e"))
    now = {"i1": "1", "i2": "2", "i3": "3"}
    state = lambda x: {r.gate: (r.verdict, r.rc, r.reason) for r in gates.standing(v, used, frame(spark, "input string, digest string", *x.items()), links).collect()}
    same = {g: ("PASS", 0, None) for g in "abcde"} | {"f": ("FAIL", 2, None)}
    assert state(now) == same
    lost = lambda why: ("INVALIDATED", 4, why)
    assert state(now | {"i3": "x"}) == same | {"c": lost("input i3"), "e": lost("gate c")}
    assert state(now | {"i1": "x"}) == {"a": lost("input i1"), "f": lost("input i1"), "b": lost("gate a"), "c": lost("gate a"), "e": lost("gate a"), "d": ("PASS", 0, None)}
    assert state({k: x for k, x in now.items() if k != "i2"})["d"] == lost("input i2")
    assert state(now | {"i9": "new"}) == same
