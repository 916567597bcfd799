import numpy as np
import pytest

from docloom.llm import neighbours as N

KIND = "namespace string, record_id string, vector array<float>, loaded_at int, id string, rank int"


def current(spark, rows, dim=16):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], KIND)
    return N.current_vectors(df, "namespace", "record_id", "vector", "loaded_at", dim)


def brute(vectors, k):
    """{(grp, id): [(other, cosine)...]} by falling cosine, then id."""
    out = {}
    for (g, a), v in vectors.items():
        v = np.asarray(v, np.float64)
        sims = [(-(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), b) for (h, b), w in vectors.items() if h == g and b != a]
        out[(g, a)] = [b for _, b in sorted((round(s, 9), b) for s, b in sims)[:k]]
    return out


def test_unusable_vectors_and_versions(spark):
    nan, inf = float("nan"), float("inf")
    ok = [1.0] * 16
    rows = [("n", "a", ok, 1), ("n", "b", None, 2), ("n", "b", ok, 1), ("n", "c", [1.0] * 15, 1), ("n", "d", [nan] + ok[1:], 1), ("n", "e", [inf] + ok[1:], 1), ("n", "f", [0.0] * 16, 1), ("n", "g", [None] + ok[1:], 1), ("n", None, ok, 1), ("n", "h", ok, 1), ("n", "h", ok, None), ("m", "a", ok, 1), ("n", "i", [], 1)]
    assert {(r.grp, r.id) for r in current(spark, rows).collect()} == {("n", "a"), ("n", "h"), ("m", "a")}


def test_copies_come_by_id_and_alone_is_none(spark):
    v, w = [1.0] + [0.0] * 15, [0.9, 0.1] + [0.0] * 14
    rows = [("n", f"c{i:02d}", v, 1) for i in range(14)] + [("n", "w", w, 1), ("solo", "x", v, 1)]
    out = N.Neighbours(current(spark, rows), 16, 3).pairs()
    got = {(r.grp, r.id, r["rank"]): r.other for r in out.collect()}
    assert [got[("n", "c00", i)] for i in (1, 2, 3)] == ["c01", "c02", "c03"]
    assert [got[("n", "c05", i)] for i in (1, 2, 3)] == ["c00", "c01", "c02"]
    assert [got[("n", "w", i)] for i in (1, 2, 3)] == ["c00", "c01", "c02"]
    assert not any(k[0] == "solo" for k in got)


def test_empty(spark):
    assert N.Neighbours(current(spark, []), 16).pairs().count() == 0


def recall(rows, k, out):
    want = brute({(g, i): v for g, i, v, _ in rows}, k)
    got = {}
    for r in out.collect():
        got.setdefault((r.grp, r.id), []).append(r.other)
    assert all(len(v) == len(set(v)) <= k for v in got.values())
    asked = [x for x in want if x in got]
    return sum(len(set(want[x]) & set(got[x])) for x in asked) / sum(len(want[x]) for x in asked), len(asked)


@pytest.mark.parametrize("cell", [512, 40])
def test_recall_against_brute_force(spark, cell):
    """Large and small cells of clustered vectors, a group beside it in one cell."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = []
    for g, n in (("n", 1500), ("m", 60)):
        for i in range(n):
            v = centres[i % 12] + 0.5 * rng.standard_normal(16)
            rows.append((g, f"r{i:05d}", v.astype(np.float32).tolist(), 1))
    share, asked = recall(rows, 5, N.Neighbours(current(spark, rows), 16, 5, cell=cell).pairs())
    assert share >= 0.9 and asked == 1560


def flat(n, dim, seed):
    """Vectors without any clusters, the hardest case for cells, kept as one array."""
    v = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def general_recall(spark, v, k, every, **more):
    n, dim = v.shape
    df = spark.createDataFrame([("n", f"r{i:06d}", x.tolist(), 1) for i, x in enumerate(v)], "namespace string, record_id string, vector array<float>, loaded_at int")
    search = N.Neighbours(N.current_vectors(df, "namespace", "record_id", "vector", "loaded_at", dim), dim, k, **more)
    asked = search.records.where(f"cast(substr(id, 2) as int) % {every} = 0").select("grp", "id")
    got = {}
    for r in search.pairs(asked).collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.other[1:]))
    sims = v[::every] @ v.T
    sims[np.arange(len(sims)), np.arange(0, n, every)] = -2
    want = np.argsort(-sims, axis=1)[:, :k]
    visited = search._visits(asked.withColumnRenamed("id", "lead")).groupBy("num").count().agg({"count": "avg"}).first()[0]
    leaves = search.codes.select("cell").distinct().count()
    return sum(len(got[i * every] & set(w.tolist())) for i, w in enumerate(want)) / want.size, visited, leaves


def test_general_recall_with_hundreds_of_cells_in_part(spark):
    share, visited, leaves = general_recall(spark, flat(21_000, 24, 6), 10, 50, cell=48)
    assert leaves >= 400 and visited < 0.5 * leaves
    assert share >= 0.9


def test_deeper_trees_keep_every_vector_and_find_the_near_ones(spark):
    v = flat(3000, 16, 7)
    v[1::2] = v[::2] + 0.05 * v[1::2]  # every vector has one very near it
    share, _, leaves = general_recall(spark, v, 1, 7, cell=5, fan=8)
    assert leaves > 64  # more than two levels of eight
    assert share >= 0.9


def test_asked_records_only(spark):
    rng = np.random.default_rng(4)
    rows = [("n", f"r{i}", rng.standard_normal(16).astype(np.float32).tolist(), 1) for i in range(50)]
    s = N.Neighbours(current(spark, rows), 16, 4)
    asked = s.records.where("id in ('r3', 'r7')").select("grp", "id")
    assert {r.id for r in s.pairs(asked).collect()} == {"r3", "r7"}


@pytest.mark.parametrize("dim", [64, 50, 130])
def test_code_estimates_are_within_their_bounds(dim):
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((400, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    c = (0.3 * unit[:40].mean(axis=0) * 8).astype(np.float32)[None]
    turn = N.rotation(dim)
    data = dict(zip(("bits", "length", "f", "g"), N.encode(unit, c, turn))) | {"num": np.arange(400)}
    ask = dict(zip(("planes", "base", "low", "step", "total", "width"), N.encode_query(unit[:50], c, turn))) | {"num": np.arange(50)}
    qi, di, guess, slack = N.search_block(ask, data, dim, 400, -1.0, 1.9)
    assert len(qi) == 50 * 399
    error = np.abs(guess - (unit[qi] * unit[di]).sum(axis=1))
    assert (error <= slack + 1e-6).mean() > 0.93
    assert np.allclose(turn @ turn.T, np.eye(dim), atol=1e-5)


def test_null_group_takes_no_part(spark):
    rows = [(None, "a", [1.0] * 16, 1), (None, "b", [1.0] * 16, 1), ("n", "c", [1.0] * 16, 1), ("n", "d", [1.0] * 16, 1)]
    assert {r.id for r in N.Neighbours(current(spark, rows), 16, 3).pairs().collect()} == {"c", "d"}
