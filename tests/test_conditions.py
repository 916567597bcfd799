import pytest

from docloom.plans.conditions import ConditionError, evaluate, where

GOOD = [
    ("0 <= depth < 4", {"depth": 3}, True), ("0 <= depth < 4", {"depth": -1}, False), ("empty or lang == 'de' and pages >= 7", {"empty": False, "lang": "de", "pages": 9}, True), ("not (empty or late)", {"empty": False, "late": True}, False), ("site.owner.lang != 'es'", {"site": {"owner": {"lang": "en"}}}, True),
    ("exists(nowhere)", {}, False), ("exists(title)", {"title": None}, True), ("exists(site.title)", {"site": {}}, False), ("TRUE", {}, True), (" false ", {}, False), ("words != 12", {"words": 13}, True), ("1 < pages == 5", {"pages": 5}, True),
]
BAD = ["__import__('os')", "(lambda: 1)()", "[x for x in y]", "user.__class__", "a in b", "a not in b", "a +", "a[0]", "len(a)", "exists(a, b)", "unknown", "a + 1"]


@pytest.mark.parametrize(("condition", "values", "want"), GOOD)
def test_values(condition, values, want):
    assert evaluate(condition, values) is want


@pytest.mark.parametrize("condition", BAD)
def test_refused(condition, spark):
    values = {"a": 1, "b": [1], "y": [1], "user": {}}
    with pytest.raises(ConditionError):
        evaluate(condition, values)
    with pytest.raises(ConditionError):
        where(spark.createDataFrame([(1, 2, {"k": "v"})], "a int, b int, user struct<k:string>"), condition)


def test_unknown_names_show_on_either_side():
    with pytest.raises(ConditionError):
        evaluate("a or unknown", {"a": True})


def test_columns(spark):
    rows = [(1, "x", {"tier": "pro"}, ("n",)), (2, None, {}, (None,)), (3, "", None, None)]
    df = spark.createDataFrame(rows, "v int, s string, m map<string,string>, t struct<name:string>")
    ids = lambda c: sorted(r.v for r in where(df, c).collect())
    assert ids("1 < v <= 3") == [2, 3]
    assert ids("m.tier == 'pro'") == [1]
    assert ids("not m.tier == 'pro'") == [2, 3]
    assert ids("exists(t.name)") == [1]
    assert ids("exists(s)") == [1, 2, 3]
    assert ids("exists(nothing)") == []
    assert ids("s or v == 3") == [1, 3]
    assert ids("true") == [1, 2, 3]
    plan = where(df, "v == 2 and exists(s)")._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan
