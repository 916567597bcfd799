import random

import pytest
from pyspark.sql import functions as F

from docloom.llm.groups import clean_id, connected_groups, edges


def brute(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = ((x or "").strip().lower() for x in (a, b))
        if a and b and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {(find(x), x) for x in list(top)}


def groups(spark, pairs, **k):
    df = spark.createDataFrame([(a, b, "m", 1) for a, b in pairs], "x string, y string, a string, n int")
    out = connected_groups(edges(df, clean_id(F.col("x")), clean_id(F.col("y"))), **k).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_spellings_nulls_and_self_links(spark):
    pairs = [("A ", "b"), (" a\t", "B"), (None, "c"), ("", "c"), ("d", "D "), ("e", " "), ("f", "g"), ("g", "h")]
    assert groups(spark, pairs) == {("a", "a"), ("a", "b"), ("f", "f"), ("f", "g"), ("f", "h")}


def test_empty(spark):
    assert groups(spark, []) == set()
    assert groups(spark, [("a", "a"), (None, None)]) == set()


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randint(0, 150)}", f"n{rnd.randint(0, 150)}") for _ in range(90)]
    pairs += [("hub", f"h{i}") for i in range(60)] + pairs[:20]
    assert groups(spark, pairs) == brute(pairs)


def test_a_chain_that_hangs_on_the_giant(spark):
    chain = [f"c{i:03d}" for i in range(70)]
    pairs = [("zz-hub", f"x{i}") for i in range(30)] + [("x3", chain[35])] + list(zip(chain, chain[1:])) + [("q1", "q2")]
    random.Random(1).shuffle(pairs)
    assert groups(spark, pairs, peel_rounds=2) == brute(pairs)
