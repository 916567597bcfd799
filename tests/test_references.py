from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions.keys import uuid_hex, uuid_text
from docloom.operators.references import find_orphans, referring, target_states
from docloom.operators.skew import hot_keys, salted_join

T1, T2, T3 = (datetime(2025, 1, d) for d in (1, 2, 3))


def rows(df):
    return {(r.record_key, r.reason) for r in df.collect()}


def run(spark, refs, targets, deleted=(), match="simple", width=1):
    names = [f"r{i}" for i in range(width)]
    kinds = ", ".join(f"{n} string" for n in names)
    a = spark.createDataFrame(refs, f"k string, {kinds}, at timestamp, __salt int, reason string")
    b = spark.createDataFrame(targets, f"{kinds}, at timestamp")
    d = spark.createDataFrame(list(deleted), kinds)
    cols = [F.col(n) for n in names]
    return rows(find_orphans(referring(a, F.col("k"), cols, F.col("at")), target_states(b, cols, F.col("at"), d, cols), width, match))


def test_reasons_in_order_and_copies(spark):
    refs = [("a", "x", T1, 1, "z"), ("a", "x", T3, 1, "z"), ("b", "y", T2, 1, "z"), ("c", None, T1, 1, "z"), ("d", "gone", T1, 1, "z"), ("e", "", T1, 1, "z"), ("f", "x", T3, 1, "z"), ("g", "x", None, 1, "z")]
    targets = [("x", T2), ("x", T3), ("gone", T1), (None, T1)]
    assert run(spark, refs, targets, [("gone",)]) == {("a", "late"), ("b", "missing"), ("d", "deleted"), ("e", "missing")}


def test_empty_tables(spark):
    assert run(spark, [], [("x", T1)]) == set()
    assert run(spark, [("a", "x", T1, 1, "")], []) == {("a", "missing")}


@pytest.mark.parametrize(("match", "want"), [("simple", {("a", "missing")}), ("full", {("a", "missing"), ("b", "incomplete"), ("c", "incomplete")}), ("partial", {("a", "missing"), ("c", "missing")})])
def test_null_masks(spark, match, want):
    refs = [("a", "1", "9", T2, 0, ""), ("b", "1", None, T2, 0, ""), ("c", None, "7", T2, 0, ""), ("d", None, None, T2, 0, ""), ("e", "1", "2", T2, 0, "")]
    assert run(spark, refs, [("1", "2", T1), ("3", "4", T1)], match=match, width=2) == want


def test_one_good_target_is_enough_for_a_partial_match(spark):
    refs = [("a", "1", None, T2, 0, ""), ("b", "3", None, T2, 0, ""), ("c", "4", None, T2, 0, ""), ("d", "5", "5", T2, 0, "")]
    targets = [("1", "2", T1), ("1", "3", T3), ("3", "4", T3), ("4", "4", T1), ("5", "5", T1)]
    assert run(spark, refs, targets, [("4", "4"), ("1", "3")], "partial", 2) == {("b", "late"), ("c", "deleted")}


def test_rows_without_a_key_are_told_apart_by_their_references(spark):
    refs = [(None, "x", T1, 0, ""), (None, "x", T3, 0, ""), (None, "y", T3, 0, ""), (None, None, T1, 0, "")]
    assert run(spark, refs, [("x", T2), ("y", T2)]) == {(None, "late")}


def test_wrong_arguments(spark):
    df = spark.createDataFrame([], "__key string")
    with pytest.raises(ValueError):
        find_orphans(df, df, match="other")
    with pytest.raises(ValueError):
        find_orphans(df, df, width=9)


def test_uuid_spellings(spark):
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    forms = [u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", ""), f" {u}\t", f" {u}", None, "  No Uuid ", ""]
    df = spark.createDataFrame([(x,) for x in forms], "x string")
    assert [r[0] for r in df.select(uuid_text(uuid_hex(F.col("x")))).collect()] == [u] * 7 + [None, "no uuid", ""]


def test_hot_keys_are_salted_and_nothing_is_lost(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("hot")).when(F.col("id") < 1010, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("1500", 2), ("nobody", 3)], "k string, v int")
    assert [r[0] for r in hot_keys(left, ["k"], 0.01, 100).collect()] == ["hot"]
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = salted_join(left, right, ["k"], how, share=0.01, least=100)
        b = left.join(right, "k", how)
        assert a.columns == b.columns
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
