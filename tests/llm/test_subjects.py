import random

import numpy as np

from docloom.llm import subjects as S

WORDS = {s: [f"{s}{a}{b}" for a in "kmn" for b in "aeiou"] for s in ("law", "food", "sport", "arts", "travel", "health", "science", "finance")}
FILLER = ["the", "what", "mattered", "looked", "anyway", "said"]


def paragraph(rnd, subject, n=4):
    return " ".join(" ".join(rnd.sample(WORDS[subject], 4) + rnd.sample(FILLER, 3)).capitalize() + "." for _ in range(n))


def corpus(seed=0, n=300):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rnd.sample(list(WORDS), rnd.choice((1, 1, 1, 2)))
        parts = [paragraph(rnd, s) for s in own for _ in range(2)]
        truth[i] = set(own)
        docs.append((i, "\n\n".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "checking your browser"), (1004, docs[0][1]), (None, docs[0][1])]
    truth[1004] = truth[0]
    return docs, truth


def run(spark, docs, labels, **k):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "key long, text string, subject string")
    a = spark.createDataFrame([(s,) for s in WORDS], "subject string")
    return {tuple(r) for r in S.subjects_of(d, a, spark.createDataFrame(labels, "key long, subject string"), **k).collect()}


def test_held_out_accuracy_with_wrong_labels(spark):
    docs, truth = corpus()
    labels = [(i, s.upper()) for i in range(0, 300, 4) for s in truth[i]] + [(4, " food "), (4, "food"), (99999, "law"), (8, "nothing"), (None, "law"), (3, None)]
    labels += [(i, ({*WORDS} - truth[i]).pop()) for i in range(0, 300, 40)]  # wrong ones
    got = run(spark, docs, labels)
    want = {(i, s) for i, t in truth.items() for s in t}
    assert len(got & want) / len(want) > 0.95
    assert len(got & want) / len(got) > 0.95
    assert not {i for i, _ in got} & {1000, 1001, 1002, 1003}


def test_nothing_without_labels_or_documents(spark):
    docs, _ = corpus(n=20)
    assert run(spark, docs, []) == set()
    assert run(spark, [], [(1, "law")]) == set()


def test_paragraphs():
    assert S.paragraphs("A b-c 5\n\nd") == [["a", "b", "c"], ["d"]]
    assert S.paragraphs("- a\n- b\n- c\n- d\ne") == [["a", "b", "c"], ["d"], ["e"]]
    assert S.paragraphs("") == []
    assert S.paragraphs("1 2\n!!") == []
    long = "One two three. " * 200
    assert sum(map(len, S.paragraphs(long))) == 600
    assert 50 < len(S.paragraphs(long)) < 70


def test_a_subject_may_hold_a_third_of_all(spark):
    """With three subjects each subject word lies in about a quarter of the paragraphs."""
    rnd = random.Random(1)
    few = list(WORDS)[:3]
    truth = {i: set(rnd.sample(few, rnd.choice((1, 1, 1, 2)))) for i in range(300)}
    docs = [(i, "\n\n".join(paragraph(rnd, s) for s in sorted(t) for _ in range(2))) for i, t in truth.items()]
    got = run(spark, docs, [(i, s) for i in range(0, 300, 4) for s in truth[i]])
    want = {(i, s) for i, t in truth.items() for s in t}
    assert len(got & want) / len(want) > 0.95
    assert len(got & want) / len(got) > 0.95


def test_words_of_two_letters_carry_weight(spark):
    texts = [(1, "ai eu tv un"), (2, "ai tv un eu"), (3, "some longer words here"), (4, "nothing shared with these"), (5, "yet another line")]
    index = S.build_index(spark.createDataFrame(texts, "key long, text string"))
    assert {"ai", "eu", "tv", "un"} <= set(index.ids)


def test_links_find_the_nearest_landmarks():
    """Projected candidates against the exact cosines with every landmark."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(600)]
    texts = [[words[i] for i in np.minimum(rng.zipf(1.3, 25) + rng.integers(0, 400), 599)] for _ in range(1500)]
    index = S.Index({w: float(rng.uniform(1, 6)) for w in words}, texts[:700])
    rows, marks, _ = index.links(texts[700:], 0.25)
    got = {int(r): set(m[m >= 0].tolist()) for r, m in zip(rows, marks)}
    row, word, value = index.vectors(texts[700:])
    hit = want = 0
    for r in range(800):
        mine = row == r
        cosines = (index.dense[word[mine]] * value[mine, None]).sum(axis=0)
        top = [int(i) for i in np.argsort(-cosines, kind="stable")[: S.LINKS] if cosines[i] >= 0.25]
        want += len(top)
        hit += len(got.get(r, set()) & set(top))
    assert want > 500 and hit / want >= 0.9


def test_fewer_landmarks_than_links():
    index = S.Index({"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}, [["a", "b", "c", "d"]])
    rows, marks, cosines = index.links([["a", "b", "c", "d"], ["x"]], 0.25)
    assert rows.tolist() == [0] and marks[0].tolist() == [0, -1, -1] and abs(cosines[0][0] - 1) < 1e-5


def texts_with_many_words():
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    return [[words[i] for i in np.minimum(rng.zipf(1.3, 25) + rng.integers(0, 400), 599)] for _ in range(1500)], words, rng


def test_links_are_the_nearest_of_all_landmarks():
    """Every link and cosine as told from all landmarks, none left out."""
    texts, words, rng = texts_with_many_words()
    index = S.Index({w: float(rng.uniform(1, 6)) for w in words}, texts[:700])
    rows, marks, cosines = index.links(texts[700:], 0.25)
    got = dict(zip(rows.tolist(), cosines))
    row, word, value = index.vectors(texts[700:])
    for r in range(800):
        mine = row == r
        exact = np.sort((index.dense[word[mine]] * value[mine, None]).sum(axis=0))[::-1][: S.LINKS]
        exact[(exact < 0.25) | (mine.sum() < S.MIN_WORDS)] = 0
        np.testing.assert_allclose(got.get(r, np.zeros(S.LINKS)), exact, atol=1e-5)


def test_many_words_cost_no_landmarks(spark, monkeypatch):
    """A table of all landmarks beyond the size allowed is taken in turns, with the same links."""
    texts, _, _ = texts_with_many_words()
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "key long, text string")
    whole = S.build_index(docs)
    monkeypatch.setattr(S, "MAX_INDEX_BYTES", 4 * len(whole.ids) * 100)
    turns = S.build_index(docs)
    assert turns.size == whole.size > 900 and turns.turn == 100
    rows, marks, cosines = whole.links(texts, 0.25)
    rows2, marks2, cosines2 = turns.links(texts, 0.25)
    assert rows.tolist() == rows2.tolist()
    np.testing.assert_allclose(cosines, cosines2, atol=1e-5)
    assert (marks == marks2).mean() > 0.999  # all but ties in the last digit


def test_paragraphs_that_no_drawn_landmark_is_near_get_their_subject(spark, monkeypatch):
    """A small subject that the sample of landmarks misses has landmarks of its own."""
    rnd = random.Random(2)
    of = {i: "food" if i >= 180 else ("law", "sport", "arts")[i % 3] for i in range(186)}
    docs = [(i, " ".join(w for w in paragraph(rnd, s).split() if w.lower().strip(".") not in FILLER)) for i, s in of.items()]
    build = S.build_index
    monkeypatch.setattr(S, "build_index", lambda texts: build(texts, landmarks=6))
    index = S.build_index(spark.createDataFrame(docs, "key long, text string"))
    assert not any(w.startswith("food") for t in index.landmarks for w in t)
    assert run(spark, docs, [(i, of[i]) for i in (*range(12), 180, 181)]) == set(of.items())
