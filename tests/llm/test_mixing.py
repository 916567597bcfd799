from collections import Counter

import numpy as np
import pytest

from docloom.llm.mixing import BLOCKS, Mix, split_quotas

KIND = "key long, source string, tokens long"


def mix(spark, docs, targets, **k):
    return Mix(spark.createDataFrame(docs, KIND), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **k)


def test_quotas_are_used_up_exactly():
    q = np.array([100, 7, 0, 1000])
    out = split_quotas(q, 7, np.random.default_rng(1))
    assert (out.sum(axis=0) == q).all()
    assert out.min() >= 0
    sizes = out.sum(axis=1)
    assert sizes.max() - sizes.min() <= 2
    # each shard's part of a source follows the source's share
    assert np.abs(out[:, 3] - 1000 / 7).max() < 40


def test_shares_repeats_and_places(spark):
    rng = np.random.default_rng(2)
    docs = [(i, ["A ", "b", "c", None, "out"][i % 5], int(rng.integers(0, 200))) for i in range(4000)]
    m = mix(spark, docs + docs[:20], [("a", 0.1, 1), ("B", 0.45, 3), ("c", 0.5, 2), ("none", 0.01, 9), ("zero", 0.0, 1)], shards=4)
    total = sum(t for *_, t in docs)
    report = {r.source: r for r in m.report().collect()}
    have = {s: sum(t for _, x, t in docs if x and x.strip().lower() == s) for s in "abc"}
    for s, share in (("a", 0.1), ("B", 0.45)):
        r = report[s]
        assert r.reached
        assert r.available_tokens == have[s.lower()]
        assert share * total <= r.drawn_tokens < share * total + 200
    assert not report["c"].reached
    assert report["c"].repeats == 2.0
    assert (report["none"].reached, report["zero"].reached, report["none"].drawn_tokens) == (False, True, 0)
    draws = m.draws().collect()
    assert len({(r.key, r.repeat_no) for r in draws}) == len(draws)
    assert Counter(r.source for r in draws).keys() == {"a", "b", "c"}
    for s in range(4):
        assert sorted(r.position for r in draws if r.shard == s) == list(range(sum(r.shard == s for r in draws)))
    by = Counter((r.source, r.repeat_no) for r in draws)
    assert by[("c", 0)] == by[("c", 1)] == 800
    per = Counter(r.shard for r in draws)
    assert max(per.values()) < 1.6 * min(per.values())


def test_one_document_and_nothing(spark):
    m = mix(spark, [(1, "a", 10)], [("a", 0.5, 1)])
    assert [(r.key, r.repeat_no) for r in m.draws().collect()] == [(1, 0)]
    e = mix(spark, [], [("a", 0.5, 1), ("a", 0.5, 1)])
    assert e.draws().count() == 0
    assert [(r.source, r.drawn_tokens) for r in e.report().collect()] == [("a", 0)]
    n = mix(spark, [(1, None, None), (None, "a", 3)], [("a", 0.5, 1), (None, 0.5, 1)])
    assert n.draws().count() == 0


def test_very_many_sources_and_repeats(spark, monkeypatch):
    monkeypatch.setattr("docloom.llm.mixing.MAX_SUMS", 20_000)
    docs = [(i, f"s{i % 5000}", 10) for i in range(10_000)]
    m = mix(spark, docs, [(f"s{i}", 1 / 5000, 3) for i in range(5000)] + [("S7", 0.05, 300)])
    assert m.blocks == 4
    rows = m.report().collect()
    assert len(rows) == 5000 and all(r.reached for r in rows)
    assert {r.repeats for r in rows if r.max_repeats == 300} == {250.0}


@pytest.mark.parametrize("upto", [0.5, 7.0, 7.5, 3500.0, 6999.5, 7000.0])
def test_the_last_block_is_cut_where_the_target_is_reached(spark, monkeypatch, upto):
    monkeypatch.setattr("docloom.llm.mixing.BLOCKS", 1)
    monkeypatch.setattr("docloom.llm.mixing.BUCKETS", 16)
    docs = [(i, "a", 7) for i in range(1000)]
    r = mix(spark, docs, [("a", upto / 7000, 1)]).report().first()
    assert upto <= r.drawn_tokens + 1e-6 < upto + 7 + 1e-6


@pytest.mark.parametrize("share", [0.2, 0.9999, 1.0])
def test_a_whole_number_of_passes(spark, share):
    docs = [(i, "a", 7) for i in range(BLOCKS // 2)]
    r = mix(spark, docs, [("a", share, 1)]).report().first()
    assert r.reached
    assert share * r.available_tokens <= r.drawn_tokens + 1e-6 < share * r.available_tokens + 7 + 1e-6
