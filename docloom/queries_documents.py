"""Registered document, vector and search queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import documents as D
from docloom.operators import search as S
from docloom.operators import vectors as V
from docloom.plans.knowledge import knowledge
from docloom.storage import table

RULES = [
    D.Rule("length", "warning", max_characters=6000),
    D.Rule("substance", min_unique_words=12),
    D.Rule("origin", required_metadata_keys=("lang", "source")),
    D.Rule("terms", forbidden_terms=("Password", "magistrate", "mortgage")),
    D.Rule("terms-exact", forbidden_terms=("The magistrate",), case_sensitive=True),
]
QUERY = "Which telescope array measured the neutrino signal during the eclipse?"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents")
    meta = F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), lambda k, v: v.isNotNull())
    return df.select(F.col("doc_id").alias("document_id"), "text", meta.alias("metadata"))


def _full(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")


def normalize_text(spark, sf):
    return D.normalize(documents(spark, sf)).select("document_id", "normalized_text")


def _enriched(spark, sf):
    return D.enrich(documents(spark, sf)).where("text is not null")


def enrich_stats(spark, sf):
    return _enriched(spark, sf).select("document_id", "statistics.*")


def enrich_keywords(spark, sf):
    return _enriched(spark, sf).select("document_id", F.array_join("keywords", " ").alias("keywords"))


def enrich_urls(spark, sf):
    return _enriched(spark, sf).select("document_id", F.array_join("urls", " ").alias("urls"))


def enrich_summary(spark, sf):
    return _enriched(spark, sf).select("document_id", "summary", "fingerprint")


def dedup_canonical(spark, sf):
    return D.Deduplicated(documents(spark, sf)).documents().select("document_id", "text", "fingerprint", "duplicate_count")


def dedup_decided(spark, sf):
    return D.Deduplicated(documents(spark, sf)).decisions()


def dedup_summary(spark, sf):
    return D.Deduplicated(documents(spark, sf)).summary()


def compliance_findings(spark, sf):
    checked = D.check(documents(spark, sf), RULES).where("text is not null")
    return checked.select("document_id", F.explode("findings").alias("f")).select("document_id", "f.rule_id", "f.passed", "f.severity")


def compliance_summary(spark, sf):
    return D.check_totals(D.check(documents(spark, sf), RULES))


def chunk_tokens(spark, sf):
    return D.chunk(documents(spark, sf)).select("chunk_id", "document_id", "chunk_index", "start_token", "end_token", "text")


def embed_hash(spark, sf):
    out = V.embed(documents(spark, sf)).where("text is not null")
    return out.select("document_id", F.posexplode("values").alias("bucket", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


def analyze_keywords(spark, sf):
    return D.analyze(documents(spark, sf)).where("text is not null").select("document_id", F.array_join("keywords", " ").alias("keywords"), "token_count", "summary")


def diff_lines(spark, sf):
    """Each document against the one with the next number: lines added and removed."""
    docs = documents(spark, sf).select("document_id", "text").where("text is not null")
    after = docs.select((F.col("document_id") - 1).alias("document_id"), F.col("text").alias("after"))
    pairs = docs.withColumnRenamed("text", "before").join(after, "document_id").withColumn("d", D.line_changes(F.col("before"), F.col("after")))
    return pairs.select("document_id", F.array_join("d.added_lines", "\n").alias("added"), F.array_join("d.removed_lines", "\n").alias("removed"), (F.col("before") != F.col("after")).alias("changed"))


def diff_ratio(spark, sf):
    """Similarity ratio and unified diff of the same pairs."""
    docs = documents(spark, sf).select("document_id", "text").where("text is not null")
    after = docs.select((F.col("document_id") - 1).alias("document_id"), F.col("text").alias("after"))
    return D.diff(docs.withColumnRenamed("text", "before").join(after, "document_id")).select("document_id", "ratio", "unified_diff", "changed")


def search_topk(spark, sf):
    return S.search(_full(spark, sf), QUERY).select("document_id", "score", "title", "url")


def search_snippet(spark, sf):
    return S.search(_full(spark, sf), QUERY).select("document_id", "snippet")


def search_batch(spark, sf):
    """Every subject's scope as a query over the postings."""
    asked = table(spark, sf, "subject_areas").select(F.col("subject").alias("query_id"), F.col("scope").alias("query"))
    return S.search_many(S.postings(_full(spark, sf)), asked)


def _records(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.lit("default").alias("namespace"), F.col("embedding").cast("array<double>").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")
    )


def _asked(spark, sf):
    return table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def vector_upsert(spark, sf):
    rows = table(spark, sf, "vector_records").where("record_id is not null")
    return V.upsert(rows, "loaded_at").select("namespace", "record_id", "document_id", F.size("vector").alias("length"), "loaded_at")


def vector_topk(spark, sf):
    return V.top_k(_records(spark, sf), _asked(spark, sf), 10, "default", digits=6).select("record_id", "score")


def vector_topk_filtered(spark, sf):
    return V.top_k(_records(spark, sf), _asked(spark, sf), 10, "default", {"label": "3"}, digits=6).select("record_id", "score")


def vector_topk_many(spark, sf):
    """Queries are the records whose id is divisible by 20, against all."""
    records = _records(spark, sf)
    asked = records.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), F.col("vector").alias("query"))
    return V.top_k_many(records, asked, 5).select("query_id", "record_id", "rank", F.round("score", 6).alias("score"))


def _chunk_records(chunks: DataFrame) -> DataFrame:
    return V.embed(chunks).select(F.col("chunk_id").alias("record_id"), F.lit("default").alias("namespace"), F.col("values").alias("vector"), "document_id", "chunk_id", "text", "metadata")


def retrieve_topk(spark, sf):
    hits = V.retrieve(_chunk_records(D.chunk(documents(spark, sf))), QUERY, 5, digits=6)
    return hits.select("record_id", "document_id", "score", F.col("provenance")["chunk_index"].alias("chunk_index"))


def knowledge_pipeline(spark, sf):
    """Normalize, enrich, deduplicate, check, chunk, embed, upsert, retrieve: the flagship."""
    return knowledge(documents(spark, sf), QUERY, RULES[1:3], 5).select("record_id", "document_id", "score", "text")


WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_E = f"trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))"
_C = f"replace(lower({_E}), 'ß', 'ss')"
_LIT = r"""case when not contains(c, '''') then '''' || c || '''' when not contains(c, '"') then '"' || c || '"' else '''' || replace(c, '''', '\''') || '''' end"""
_FP = f"sha256('{{''text'': ' || {_LIT} || ', ''metadata'': {{}}}}')"
_TOK = "regexp_extract_all({0}, '[A-Za-z0-9'']+')"
_STOP = ", ".join(f"'{w}'" for w in D.STOPWORDS)
_DOCS = "select doc_id as document_id, text, lang, source, title, url from documents"
_DEDUP = f"with c as (select doc_id, {_C} as c from documents where text is not null), g as (select doc_id, c, {_FP} as fp from c), f as (select fp, min(doc_id) as first, count(*) as n from g group by fp)"


def _chunk_cte(src: str, name: str = "chunks") -> str:
    return f"""tk as (select document_id, regexp_extract_all(text, '[^{WS}]+') as tok from ({src})),
    ck as (select document_id, tok, unnest(range(0, 1 + greatest(0, ceil((len(tok) - 128) / 112.0))::bigint)) as k from tk where len(tok) > 0),
    {name} as (select document_id || ':' || k as chunk_id, document_id, cast(k as int) as chunk_index, cast(k * 112 as int) as start_token, cast(least(k * 112 + 128, len(tok)) as int) as end_token, array_to_string(tok[k * 112 + 1 : k * 112 + 128], ' ') as text from ck)"""


def _score_cte(chunks: str) -> str:
    """Cosines of hash embeddings of chunk texts with the query's."""
    return f"""w as (select chunk_id, unnest({_TOK.format('text')}) as t from {chunks}),
    b as (select chunk_id, ('0x' || substr(sha256(lower(t)), 1, 16))::ubigint % 64 as k, count(*)::double as n from w group by 1, 2),
    q as (select ('0x' || substr(sha256(lower(t)), 1, 16))::ubigint % 64 as k, count(*)::double as n from (select unnest({_TOK.format(repr(QUERY))}) as t) group by 1),
    nb as (select chunk_id, sqrt(sum(n * n)) as l from b group by 1),
    d as (select b.chunk_id, sum(b.n * q.n) as d from b join q on b.k = q.k group by 1),
    sc as (select c.chunk_id, c.document_id, c.chunk_index, c.text, round(coalesce(d.d / (nb.l * (select sqrt(sum(n * n)) from q)), 0), 6) as score from {chunks} c left join nb on c.chunk_id = nb.chunk_id left join d on c.chunk_id = d.chunk_id)"""


_BAD_LENGTH = "length(text) > 6000"
_F = "replace(lower(text), 'ß', 'ss')"
_UNIQUE = f"len(list_distinct({_TOK.format(_F)}))"
_COMPLY = f"""with r as (
  select doc_id as document_id, 'length' as rule_id, not ({_BAD_LENGTH}) as passed, 'warning' as severity from documents where text is not null union all
  select doc_id, 'substance', {_UNIQUE} >= 12, 'error' from documents where text is not null union all
  select doc_id, 'origin', lang is not null and source is not null, 'error' from documents where text is not null union all
  select doc_id, 'terms', not (contains({_F}, 'password') or contains({_F}, 'magistrate') or contains({_F}, 'mortgage')), 'error' from documents where text is not null union all
  select doc_id, 'terms-exact', not contains(text, 'The magistrate'), 'error' from documents where text is not null)"""
_HITS = f"""with t as (select doc_id as document_id, title, url, text, list_distinct({_TOK.format("lower(coalesce(text, '') || ' ' || coalesce(title, '') || ' ' || coalesce(url, ''))")}) as own from documents),
q as (select unnest({_TOK.format(repr(QUERY.lower()))}) as t),
h as (select document_id, any_value(title) as title, any_value(url) as url, any_value(text) as text, count(*)::double as score from t join q on list_contains(t.own, q.t) group by 1 order by score desc, document_id limit 10)"""
_LINES = r"regexp_split_to_array({0}, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
_PAIRS = f"""with l as (select doc_id, text, {_LINES.format('text')} as x from documents where text is not null),
t as (select doc_id, text, case when x[-1] = '' then x[:-2] else x end as l from l)"""

QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, enrich_stats, enrich_keywords, enrich_urls, enrich_summary, dedup_canonical, dedup_decided, dedup_summary, compliance_findings, compliance_summary, chunk_tokens, embed_hash,
        analyze_keywords, diff_lines, diff_ratio, search_topk, search_snippet, search_batch, vector_upsert, vector_topk, vector_topk_filtered, vector_topk_many, retrieve_topk, knowledge_pipeline,
    )
}
SQL = {
    "normalize_text": f"select doc_id as document_id, {_C} as normalized_text from documents",
    "enrich_stats": f"""with e as (select doc_id, text, {_E} as e from documents where text is not null), t as (select *, list_transform({_TOK.format('e')}, lambda x: lower(x)) as t,
      regexp_extract_all(text, 'https?://[^{WS}]+|www\\.[^{WS}]+') as u from e),
      k as (select doc_id, count(distinct w) as n from (select doc_id, unnest(t) as w from t) where length(w) >= 3 and w not in ({_STOP}) group by 1)
      select t.doc_id as document_id, cast(length(e) as int) as character_count, 1 as line_count, cast(greatest(len(regexp_extract_all(e, '[.!?]+')), case when e <> '' then 1 else 0 end) as int) as sentence_count,
      cast(len(t) as int) as word_count, cast(len(list_distinct(t)) as int) as unique_word_count, cast(least(8, coalesce(k.n, 0)) as int) as keyword_count, cast(len(list_distinct(u)) as int) as url_count
      from t left join k on t.doc_id = k.doc_id""",
    "enrich_keywords": f"""with w as (select doc_id, lower(unnest({_TOK.format(_E)})) as t from documents where text is not null),
      n as (select doc_id, t, count(*) as n from w where length(t) >= 3 and t not in ({_STOP}) group by 1, 2),
      r as (select *, row_number() over (partition by doc_id order by n desc, t) as r from n),
      k as (select doc_id, string_agg(t, ' ' order by r) as keywords from r where r <= 8 group by 1)
      select d.doc_id as document_id, coalesce(k.keywords, '') as keywords from documents d left join k on d.doc_id = k.doc_id where d.text is not null""",
    "enrich_urls": f"""with u as (select doc_id, regexp_extract_all(text, 'https?://[^{WS}]+|www\\.[^{WS}]+') as u from documents where text is not null)
      select doc_id as document_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') as urls from u""",
    "enrich_summary": f"""with e as (select doc_id, {_E} as e from documents where text is not null)
      select doc_id as document_id, array_to_string(list_filter(string_split(e, ' '), lambda x: x <> '')[1:24], ' ') as summary, sha256(e) as fingerprint from e""",
    "dedup_canonical": f"{_DEDUP} select g.doc_id as document_id, g.c as text, g.fp as fingerprint, f.n - 1 as duplicate_count from g join f on g.fp = f.fp and g.doc_id = f.first",
    "dedup_decided": f"{_DEDUP} select g.doc_id as duplicate_document_id, f.first as canonical_document_id, g.fp as fingerprint, 'duplicate' as reason from g join f on g.fp = f.fp and g.doc_id <> f.first",
    "dedup_summary": f"{_DEDUP} select count(*) as kept_count, cast(sum(n - 1) as bigint) as removed_count from f",
    "compliance_findings": f"{_COMPLY} select * from r",
    "compliance_summary": f"{_COMPLY}, a as (select document_id, bool_and(passed) as ok from r group by 1) select bool_and(ok) as compliant, count(*) filter (ok) as passed_count, count(*) filter (not ok) as failed_count from a",
    "chunk_tokens": f"with {_chunk_cte(_DOCS)} select * from chunks",
    "embed_hash": f"""with w as (select doc_id, unnest({_TOK.format('text')}) as t from documents where text is not null),
      b as (select doc_id, cast(('0x' || substr(sha256(lower(t)), 1, 16))::ubigint % 64 as int) as bucket, count(*)::double as n from w group by 1, 2)
      select doc_id as document_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as value from b""",
    "analyze_keywords": f"""with t as (select doc_id, text, list_transform({_TOK.format('text')}, lambda x: lower(x)) as t from documents where text is not null),
      w as (select doc_id, unnest(t) as w, unnest(range(len(t))) as i from t), n as (select doc_id, w, count(*) as n, min(i) as i from w group by 1, 2),
      r as (select *, row_number() over (partition by doc_id order by n desc, i) as r from n), k as (select doc_id, string_agg(w, ' ' order by r) as k from r where r <= 12 group by 1)
      select t.doc_id as document_id, coalesce(k.k, '') as keywords, cast(len(t) as int) as token_count, substr({_E}, 1, 240) as summary from t left join k on t.doc_id = k.doc_id""",
    "diff_lines": f"""{_PAIRS} select a.doc_id as document_id,
      array_to_string(list_transform(list_filter(b.l, lambda x: not list_contains(a.l, x)), lambda x: substr(x, 2)), chr(10)) as added,
      array_to_string(list_transform(list_filter(a.l, lambda x: not list_contains(b.l, x)), lambda x: substr(x, 2)), chr(10)) as removed, a.text <> b.text as changed from t a join t b on b.doc_id = a.doc_id + 1""",
    "search_topk": f"{_HITS} select document_id, score, title, url from h",
    "search_snippet": f"""{_HITS}, p as (select document_id, text, (select min(instr(lower(h.text), t)) from q where instr(lower(h.text), t) > 0) - 1 as pos from h)
      select document_id, case when text is null or text = '' then null when pos is null then substr(text, 1, 120)
      else trim(regexp_replace(substr(text, cast(greatest(pos - 40, 0) as bigint) + 1, cast(pos + 24 - greatest(pos - 40, 0) as bigint)), '[{WS}]+', ' ', 'g')) end as snippet from p""",
    "search_batch": f"""with d as (select distinct doc_id, unnest({_TOK.format("lower(coalesce(text, '') || ' ' || coalesce(title, '') || ' ' || coalesce(url, ''))")}) as t from documents),
      q as (select subject, unnest({_TOK.format('lower(scope)')}) as t from subject_areas), s as (select subject as query_id, doc_id as document_id, count(*)::double as score from q join d on q.t = d.t group by 1, 2)
      select query_id, document_id, score, cast(r as int) as rank from (select *, row_number() over (partition by query_id order by score desc, document_id) as r from s) where r <= 10""",
    "vector_upsert": """select namespace, record_id, arg_max({'v': document_id}, loaded_at).v as document_id, cast(coalesce(len(arg_max({'v': vector}, loaded_at).v), null) as int) as length, max(loaded_at) as loaded_at
      from vector_records where record_id is not null group by 1, 2""",
    "vector_topk": """with q as (select embedding::double[] as q from embeddings order by vec_id limit 1)
      select vec_id as record_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q order by score desc, record_id limit 10""",
    "vector_topk_filtered": """with q as (select embedding::double[] as q from embeddings order by vec_id limit 1)
      select vec_id as record_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q where label = 3 order by score desc, record_id limit 10""",
    "vector_topk_many": """with s as (select a.vec_id as query_id, b.vec_id as record_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b where a.vec_id % 20 = 0)
      select query_id, record_id, cast(r as int) as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, record_id) as r from s) where r <= 5""",
    "retrieve_topk": f"with {_chunk_cte(_DOCS)}, {_score_cte('chunks')} select chunk_id as record_id, document_id, score, cast(chunk_index as varchar) as chunk_index from sc order by score desc, record_id limit 5",
    "knowledge_pipeline": f"""{_DEDUP}, kept as (select g.doc_id as document_id, g.c as text from g join f on g.fp = f.fp and g.doc_id = f.first join documents d on d.doc_id = g.doc_id
      where d.lang is not null and d.source is not null and len(list_distinct({_TOK.format('g.c')})) >= 12),
      {_chunk_cte('select * from kept')}, {_score_cte('chunks')} select chunk_id as record_id, document_id, score, text from sc order by score desc, record_id limit 5""",
}
