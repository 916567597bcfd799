import hashlib
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import documents as D
from docloom.operators import vectors as V

ODD = [
    "  Hello\n\nWORLD  ", "", "   \t ", None, "a\r\nb\rc", "x y\u0085z\u001cw", "Straße ﬁn ΟΔΟΣ İx", "a😀b", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\tnew\nline '", "​zero",
]


def frame(spark, texts, meta=None):
    return spark.createDataFrame([(i, t, meta) for i, t in enumerate(texts)], "document_id long, text string, metadata map<string,string>")


def model_normal(x):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).casefold()).strip()


def test_normalize(spark):
    out = {r.document_id: r.normalized_text for r in D.normalize(frame(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        assert out[i] == (None if t is None else model_normal(t))


def test_text_primitives(spark):
    df = spark.createDataFrame([(t,) for t in ODD if t is not None], "t string")
    for r in df.select("t", X.tokens(F.col("t")).alias("tok"), X.strip(F.col("t")).alias("s"), X.lines(F.col("t")).alias("l")).collect():
        assert r.tok == r.t.split()
        assert r.s == r.t.strip()
        assert r.l == r.t.splitlines()


def test_enrich(spark):
    text = "Engine enriches text. Engine enriches metadata. https://example.com"
    r = D.enrich(frame(spark, [text, "", None])).orderBy("document_id").collect()
    assert r[0].keywords == ["engine", "enriches", "com", "example", "https", "metadata", "text"]
    assert r[0].urls == ["https://example.com"]
    assert r[0].statistics.asDict() == {"character_count": 67, "line_count": 1, "sentence_count": 3, "word_count": 9, "unique_word_count": 7, "keyword_count": 7, "url_count": 1}
    assert r[0].summary.startswith("Engine enriches text.")
    assert r[1].statistics.sentence_count == 0
    assert r[1].statistics.line_count == 1
    assert r[2].statistics is None


def test_dedup_small_case_and_fingerprint(spark):
    df = frame(spark, ["Engine is clean.", "engine  is CLEAN. ", "other", None, None])
    d = D.Deduplicated(df)
    kept = {r.document_id: r for r in d.documents().collect()}
    assert set(kept) == {0, 2}
    assert kept[0].duplicate_count == 1
    assert kept[0].text == "engine is clean."
    assert kept[0].fingerprint == "dbd931df383dc7ea47a294e9bc8a307c52da52a9ecdbc0f32574f9ebd08870a4"
    assert [(r[0], r[1]) for r in d.decisions().collect()] == [(1, 0)]
    assert d.summary().first().asDict() == {"kept_count": 2, "removed_count": 1}


def test_fingerprint_equals_the_literal_form(spark):
    df = frame(spark, ODD, {"a": "it's", "b": None})
    s = D.DedupSettings(fingerprint_metadata_keys=("a", "b", "c"))
    for r in D.with_fingerprint(df, s).select("text", F.col("fingerprint").alias("f")).where("text is not null").collect():
        if r.text is not None:
            c = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", r.text)).casefold().strip()
            assert r.f == hashlib.sha256(repr({"text": c, "metadata": {"a": "it's", "b": None}}).encode()).hexdigest()


def test_dedup_empty(spark):
    d = D.Deduplicated(frame(spark, []))
    assert d.documents().count() == 0
    assert d.summary().first().asDict() == {"kept_count": 0, "removed_count": 0}


def test_compliance(spark):
    rules = [D.Rule("r", forbidden_terms=("secret", "password", ""), required_metadata_keys=("source",), min_unique_words=3)]
    bad = D.check(frame(spark, ["This document contains a secret password."]), rules).first()
    assert (bad.compliant, bad.findings[0].details) == (False, {"missing_keys": "source"})
    worse = D.check(frame(spark, ["This document contains a SECRET password."], {"source": "x"}), rules).first()
    assert worse.findings[0].details == {"forbidden_terms": "secret,password"}
    good = D.check(frame(spark, ["One two three four"], {"source": "x"}), rules).first()
    assert (good.compliant, good.findings[0].details) == (True, {"word_count": "4", "unique_words": "4"})
    assert D.check(frame(spark, ["x"]), []).first().compliant
    long = D.check(frame(spark, ["x" * 9]), [D.Rule("l", max_characters=8, min_unique_words=5)]).first()
    assert long.findings[0].details == {"character_count": "9", "maximum": "8"}
    exact = D.check(frame(spark, ["Secret"]), [D.Rule("c", forbidden_terms=("secret",), case_sensitive=True)]).first()
    assert exact.compliant
    totals = D.check_totals(D.check(frame(spark, ["a secret", "b", None], {"source": "s"}), [D.Rule("t", forbidden_terms=("secret",))])).first()
    assert (totals.compliant, totals.passed_count, totals.failed_count) == (False, 1, 1)
    assert [r.rule_id for r in D.default_rules(rules, D.Rule("default-policy", max_characters=1))] == ["r", "default-policy"]
    assert D.default_rules(rules, D.Rule("default-policy")) == rules


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (128, 1), (129, 2), (240, 2), (241, 3)])
def test_chunk_counts(spark, n, chunks):
    out = D.chunk(frame(spark, [" ".join(f"t{i}" for i in range(n))])).orderBy("chunk_index").collect()
    assert len(out) == chunks
    if chunks:
        assert out[-1].end_token == n
        assert all(b.start_token == a.start_token + 112 for a, b in zip(out, out[1:]))


def test_chunk_case(spark):
    out = D.chunk(frame(spark, ["one two three four five", "  ", None], {"k": "v", "overlap": "mine"}), D.ChunkSettings(3, 1)).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.text, r.start_token, r.end_token) for r in out] == [("0:0", "one two three", 0, 3), ("0:1", "three four five", 2, 5)]
    assert out[0].metadata == {"k": "v", "chunk_index": "0", "chunk_size": "3", "overlap": "1"}
    with pytest.raises(ValueError):
        D.ChunkSettings(3, 3)


def test_analyze(spark):
    text = "b a b c a Hello world from Engine"
    r = D.analyze(frame(spark, [text])).first()
    assert r.keywords == [t for t, _ in Counter(text.lower().split()).most_common(12)]
    assert (r.token_count, r.language, r.entities) == (9, "en", [])


def test_diff(spark):
    df = spark.createDataFrame([("hello", "hello world"), ("a\nb\nb", "b\nc"), ("x", "x"), (None, "x")], "before string, after string")
    r = D.diff(df).collect()
    assert (r[0].added_lines, r[0].removed_lines, r[0].changed) == (["ello world"], ["ello"], True)
    assert r[0].ratio < 1.0
    assert r[1].removed_lines == [""]
    assert not r[2].changed
    assert r[2].ratio == 1.0
    assert r[3].ratio is None
    assert D.diff(df, drop_first=False).first().added_lines == ["hello world"]


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython") + plan.count("MapInArrow") + plan.count("MapInPandas"), plan.count("regexp_extract_all")


def test_texts_cross_to_python_once(spark):
    df = frame(spark, ["Some text. More text."], {"source": "x"})
    assert python_nodes(D.normalize(df).where("normalized_text <> ''")) == (1, 0)
    assert python_nodes(D.enrich(df).where("size(keywords) > 0").select("statistics.*", "fingerprint", "summary")) == (1, 0)
    assert python_nodes(D.chunk(df)) == (1, 0)
    assert python_nodes(D.analyze(df).where("token_count > 1")) == (1, 0)
    assert python_nodes(D.check(df, [D.Rule("a", min_unique_words=1), D.Rule("b", forbidden_terms=("x",))]).where("compliant")) == (1, 0)
    assert python_nodes(V.embed(df).select(F.posexplode("values"))) == (1, 0)
    assert python_nodes(D.Deduplicated(df).documents()) == (0, 0)  # written by the one pass before


def test_diff_of_many_lines_is_not_quadratic(spark):
    a, b = "\n".join(f"x{i}" for i in range(60_000)), "\n".join(f"x{i}" for i in range(1, 60_001))
    df = spark.createDataFrame([(a, b), (None, b)], "before string, after string").withColumn("d", D.line_changes(F.col("before"), F.col("after"), False)).select("d.*")
    assert [tuple(r) for r in df.orderBy(F.col("added_lines").isNull()).collect()] == [(["x60000"], ["x0"]), (None, None)]
