import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import packing as P
from docloom.llm.tokens import VOCABULARY, encoding, with_tokens


@given(st.lists(st.integers(1, 100), max_size=120), st.sampled_from(["norm", "dot"]), st.integers(1, 9), st.sampled_from([3_000, 5_000, 10_000, 12_000]))
@settings(max_examples=150, deadline=None)
def test_every_constraint_holds(sizes, rule, most, cost):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    box = P.best_fit(sizes, 100, most, cost, rule=rule)
    for b in set(box.tolist()):
        own = sizes[box == b]
        assert own.sum() <= 100
        assert len(own) <= most
        assert (own * own).sum() <= cost or len(own) == 1
    if len(sizes) and most == 9 and cost >= 10_000:
        assert len(set(box.tolist())) <= 2 * max(1, sizes.sum() / 100) + len(sizes) / most + 1


def test_attention_cost_binds():
    sizes = np.array([90] * 3 + [60] * 4 + [10] * 60, np.int64)
    free = P.best_fit(sizes, 100, 50, 10_000)
    tight = P.best_fit(sizes, 100, 50, 3_700)
    costs = lambda box: [(sizes[box == b] ** 2).sum() for b in range(box.max() + 1)]
    assert max(costs(free)) > 8_100 and free.max() < tight.max()
    assert sorted(costs(tight))[-4] <= 3_700  # all but the three of 90, which stand alone
    assert [(tight == b).sum() for b in tight[:3]] == [1, 1, 1]
    assert all((sizes[tight == b] == 60).sum() <= 1 for b in range(tight.max() + 1))


def table(spark, rows):
    return spark.createDataFrame([(*r, 3) for r in rows], "key long, tokens long, position int").select("key", "tokens")


def test_every_item_comes_out_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(0, 60, 3000))] + [(9000, 250), (9001, 100), (9002, 101)]
    out = P.pack(table(spark, rows + rows[:50]), capacity=100, shard_tokens=4000).collect()
    per = {}
    for r in out:
        per.setdefault(r.key, []).append(r)
    assert {k: sum(r.tokens for r in v) for k, v in per.items()} == dict(rows)
    assert [(r.piece_no, r.start_token, r.tokens) for r in sorted(per[9000], key=lambda r: r.piece_no)] == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert len(per[9001]) == 1
    assert len(per[9002]) == 2
    boxes = {}
    for r in out:
        if r.container is not None:
            boxes.setdefault(r.container, []).append(r)
    assert all(sum(r.tokens for r in v) <= 100 for v in boxes.values())
    assert all(sorted(r.position for r in v) == list(range(len(v))) for v in boxes.values())
    used = sum(t for _, t in rows)
    assert len(boxes) <= 1.03 * used / 100 + 1
    assert all(r.container is None and r.position is None for r in out if r.tokens == 0)


def test_many_short_items_are_bounded_by_number(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 500)
    rows = [(i, 1 + i % 3) for i in range(4000)]
    out = P.pack(table(spark, rows), capacity=1000, max_items=16, max_cost=40).collect()
    assert {r.key: r.tokens for r in out} == dict(rows)
    assert len({r.container.split("-")[0] for r in out}) >= 8
    per = {}
    for r in out:
        per.setdefault(r.container, []).append(r.tokens)
    assert all(len(v) <= 16 and sum(x * x for x in v) <= 40 for v in per.values())


def test_empty_and_arguments(spark):
    assert P.pack(table(spark, [])).count() == 0
    assert P.pack(table(spark, [(1, 0)])).count() == 1
    for bad in ({"rule": "x"}, {"max_cost": 0}, {"max_items": 0}):
        with pytest.raises(ValueError):
            P.pack(table(spark, []), **bad)


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["Hello world", "", None, "ünïcödé 😀 <|endoftext|>", "a" * 5000, " \n\t "]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    out = {r.key: r.tokens for r in with_tokens(df, ["key"]).collect()}
    enc = encoding(VOCABULARY)
    assert out == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
