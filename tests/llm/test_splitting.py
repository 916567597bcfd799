import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitting as S

WORDS = st.lists(st.sampled_from(["a", "b.", "c!", "d…", "e。", "f,", "g?"]), max_size=400)
GAPS = st.sampled_from([" ", " ", " ", "\n", "\n\n", " ", " ", "\r\n"])


@given(WORDS, st.data())
@settings(max_examples=150, deadline=None)
def test_pieces_hold_to_the_limit_and_join_to_the_text(words, data):
    text = "".join(w + data.draw(GAPS) for w in words)
    n = len(words)
    pieces = S.split_text(text, 40, 8)
    if n <= 40:
        assert pieces == []
        return
    assert pieces[0][0] == 0
    assert pieces[-1][1] == n
    for (s, e, _), (t, _, _) in zip(pieces, pieces[1:]):
        assert t == e - 8
        assert t >= s
    assert all(8 < e - s <= 40 for s, e, _ in pieces)


def test_kind_by_the_longest_stretch():
    assert {k for *_, k in S.split_text("a " * 129)} == {"forced"}
    assert {k for *_, k in S.split_text("a " * 127 + "b. " + "c " * 128)} == {"natural"}
    assert {k for *_, k in S.split_text("a " * 64 + "\n" + "c " * 129)} == {"forced"}
    assert S.split_text("a " * 128) == []
    assert {k for *_, k in S.split_text("a.b " * 129)} == {"forced"}
    assert {k for *_, k in S.split_text("a\u0085" * 129)} == {"natural"}


def test_cuts_at_the_strongest_boundary_near_the_midpoint():
    words = ["w"] * 150
    words[69] = "w."
    text = " ".join(words[:80]) + "\n\n" + " ".join(words[80:])
    assert S.split_text(text)[0][1] == 80
    assert S.split_text(" ".join(words))[0][1] == 70
    assert S.split_text(" ".join(["w"] * 150))[0][1] == 75


def test_table(spark):
    long = "word " * 100_000
    rows = [(1, "Short one.", "x"), (2, None, "x"), (3, "", "x"), (4, "Ab cd. " * 100, "x"), (5, long, "x"), (None, long, "x")]
    df = spark.createDataFrame(rows, "key long, text string, tokens string")
    out = S.split_oversized(df).orderBy("key", "piece_no").collect()
    four = [r for r in out if r.key == 4]
    assert {r.key for r in out} == {4, 5}
    assert [r.piece_id for r in four] == [f"4:{i}" for i in range(len(four))]
    for a, b in zip(four, four[1:]):
        assert b.text.split()[:16] == a.text.split()[-16:]
    assert all(r.text == ("Ab cd. " * 100)[r.start_char : r.end_char] and r.tokens == len(r.text.split()) <= 128 for r in four)
    five = [r for r in out if r.key == 5]
    assert five[-1].end_token == 100_000
    assert max(r.tokens for r in five) <= 128
    assert S.split_oversized(df.limit(0)).count() == 0


@pytest.mark.parametrize("overlap", [0, 1, 3, 5, 9])
def test_any_overlap_below_the_limit(overlap):
    text = " ".join(f"w{i}{'.' if i % 4 == 0 else ''}" for i in range(137))
    pieces = S.split_text(text, 10, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == 137
    for (_, e, _), (s, z, _) in zip(pieces, pieces[1:]):
        assert s == max(0, e - overlap) and z > e
    assert all(0 < e - s <= 10 for s, e, _ in pieces)


def test_wrong_overlap(spark):
    df = spark.createDataFrame([], "key long, text string")
    for overlap in (-1, 10, 11):
        with pytest.raises(ValueError):
            S.split_oversized(df, 10, overlap)
