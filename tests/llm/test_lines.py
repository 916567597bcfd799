import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import lines as L

KIND = "doc long, source string, text string, line_no string, h1 int"


def brute(rows, min_docs, share):
    docs, by = defaultdict(set), defaultdict(set)
    for d, s, t, *_ in rows:
        if s is None or t is None:
            continue
        docs[s].add(d)
        for i, x in enumerate(L.normalise(t)):
            if x:
                by[(s, x)].add(d)
    return {(d, i) for d, s, t, *_ in rows if s is not None and t is not None for i, x in enumerate(L.normalise(t)) if x and len(by[(s, x)]) >= min_docs and len(by[(s, x)]) >= share * len(docs[s])}


def found(spark, rows, min_docs=4, share=0.3):
    return {tuple(r) for r in L.repeated_lines(spark.createDataFrame(rows, KIND), min_docs, share).collect()}


def corpus(seed, docs=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    frame = [" ".join(rnd.choices(words, k=n)) for n in (1, 1, 2, 5, 20, 80, 300)]
    rows = []
    for d in range(docs):
        own = [" ".join(rnd.choices(words, k=rnd.choice((1, 3, 40)))) for _ in range(4)]
        text = rnd.sample(frame, 3) + own + [f"{rnd.randint(1, 99)} shares", "  ", ""]
        rnd.shuffle(text)
        rows.append((d, rnd.choice(["a", "a", "a", "b", "c"]), "\n".join(text), "x", 1))
    rows += rnd.sample(rows, 10)  # copies
    rows += [(900, None, "w1", "x", 1), (901, "a", None, "x", 1), (902, "a", "", "x", 1), (903, "a", "W1   W2 \t", "x", 1)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows, 4, 0.3)
    assert want
    assert found(spark, rows) == want


def test_thresholds_and_empty(spark):
    rows = [(i, "s", f"Same  line {i}\nown {chr(97 + i)}", "", 0) for i in range(4)]
    assert found(spark, rows) == {(i, 0) for i in range(4)}
    assert found(spark, rows[:3]) == set()
    assert found(spark, rows + [(i, "s", f"x{chr(97 + i)}", "", 0) for i in range(5, 15)]) == set()
    assert found(spark, []) == set()


def test_very_long_repeated_lines(spark):
    long = " ".join(str(i) + "word" for i in range(40_000))
    assert found(spark, [(i, "s", f"{long}\n{'z' * (i + 1)}", "", 0) for i in range(4)]) == {(i, 0) for i in range(4)}


def test_chunks_depend_on_the_line_alone():
    lines = [" ".join(str(i * i) for i in range(n)).encode() for n in (1, 2, 5, 30, 900)]

    def chunks(data):
        sizes = L.np.array([len(x) for x in data])
        starts = L.np.cumsum(sizes + 1) - sizes - 1
        stream = b"\n".join(data)
        return [stream[a:z] if a >= 0 else None for a, z in zip(*L.line_chunks(stream, starts, starts + sizes))]

    alone = [chunks([x])[0] for x in lines]
    assert alone[-1] and alone[-2] and alone[0] is None
    assert chunks([b"other words", *lines, b"more"])[1:-1] == alone
    assert chunks(lines[::-1]) == alone[::-1]
    assert all(c in x for c, x in zip(alone, lines) if c)


def test_most_repeated_lines_come_by_hash_cuts(spark):
    words = "privacy terms of use all rights reserved share this page with friends sign up for our letter about cookies".split()
    frame = [" ".join(random.Random(i).sample(words, 4 + i % 9)) for i in range(40)]
    rows = [(i, "s", "\n".join([*random.Random(i).sample(frame, 20), chr(97 + i % 26) * i]), "", 0) for i in range(60)]
    places = L.repeated_places(spark.createDataFrame(rows, KIND)).collect()
    assert {(r.doc, r.line_no) for r in places} == brute(rows, 4, 0.3)
    text = {r[0]: L.normalise(r[2]) for r in rows if r[2] is not None}
    long = [r for r in places if len(text[r.doc][r.line_no]) >= 20]
    assert long and sum(r.cut for r in long) / len(long) > 0.9


def test_a_page_that_names_two_sites(spark):
    rows = [(i, "a", "same\nown" + "x" * i, "", 0) for i in range(4)] + [(0, "b", "same", "", 0)] + [(i, "b", "same" if i < 53 else "y" * i, "", 0) for i in range(50, 70)]
    want = brute(rows, 4, 0.3)
    assert found(spark, rows) == want and (0, 0) in want and (50, 0) not in want


def test_hosts(spark):
    urls = ["http://WWW.A.example:80/x", "https://u:p@blog.a.example?q", "a.example/x", None, "", "https://www.www.a.example#f", "  HTTPS://a.example  "]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(L.host(F.col("u"))).collect()] == ["a.example", "blog.a.example", None, None, None, "www.a.example", "a.example"]


def test_text_without_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\n"), (2, None), (3, "")], "doc long, text string")
    places = spark.createDataFrame([(1, 0), (1, 2)], "doc long, line_no int")
    assert {tuple(r) for r in L.without_lines(docs, places).collect()} == {(1, "b\n"), (2, None), (3, "")}
