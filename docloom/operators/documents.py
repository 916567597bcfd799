"""Operators on documents: normalize, enrich, deduplicate, check, chunk, analyze, compare.

Each takes a DataFrame with ``document_id``, ``text`` and, where named, ``metadata`` (map of string
to string) and returns columns beside or instead of them. Null text gives null results and takes no
part in grouping. Order-sensitive operators name their order column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from difflib import SequenceMatcher, unified_diff
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X
from docloom.operators.skew import salted_join
from docloom.storage import Staging

#: Words that are no keywords.
STOPWORDS = tuple("a an and are as at be but by for from has have if in is it of on or that the this to was were will with".split())


@dataclass(frozen=True)
class NormalizeSettings:
    unicode_form: str = "NFKC"
    lowercase: bool = True
    collapse_whitespace: bool = True
    strip_edges: bool = True


def normalized(c: Column, s: NormalizeSettings = NormalizeSettings()) -> Column:
    """Normal form, line ends, case folding, blanks, edges: in this order, in one pass through Python."""
    return X.once(X.cleaner(s.unicode_form, s.lowercase, s.collapse_whitespace, s.strip_edges), T.StringType())(c)


def normalize(df: DataFrame, settings: NormalizeSettings = NormalizeSettings()) -> DataFrame:
    return df.withColumn("normalized_text", normalized(F.col("text"), settings))


@dataclass(frozen=True)
class EnrichSettings:
    unicode_form: str = "NFKC"
    collapse_whitespace: bool = True
    strip_edges: bool = True
    summary_word_limit: int = 24
    max_keywords: int = 8
    min_keyword_length: int = 3
    stopwords: tuple[str, ...] = STOPWORDS

    def __post_init__(self) -> None:
        for value, high in ((self.summary_word_limit, 128), (self.max_keywords, 64), (self.min_keyword_length, 32)):
            if not 1 <= value <= high:
                raise ValueError("an enrichment limit is out of its bounds")


_COUNTS = ("character_count", "line_count", "sentence_count", "word_count", "unique_word_count", "keyword_count", "url_count")
_STRINGS_TYPE = T.ArrayType(T.StringType())
_ENRICHED = T.StructType(
    [T.StructField("enriched_text", T.StringType()), T.StructField("keywords", _STRINGS_TYPE), T.StructField("urls", _STRINGS_TYPE), T.StructField("summary", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in _COUNTS]]
)
_WORDS, _URLS, _ENDS = re.compile(r"[A-Za-z0-9']+"), re.compile(r"https?://\S+|www\.\S+"), re.compile(r"[.!?]+")


def _top_words(tokens: list[str], limit: int, least: int, stop: frozenset[str], by_position: bool) -> list[str]:
    """The most frequent tokens; equal counts by first place or by name."""
    seen: dict[str, int] = {}
    for t in tokens:
        seen[t] = seen.get(t, 0) + 1
    pairs = [(n, t) for t, n in seen.items() if len(t) >= least and t not in stop]
    # dictionaries keep first occurrences in order, and the sort is stable
    pairs.sort(key=(lambda x: -x[0]) if by_position else (lambda x: (-x[0], x[1])))
    return [t for _, t in pairs[:limit]]


def enrich(df: DataFrame, settings: EnrichSettings = EnrichSettings()) -> DataFrame:
    """Adds enriched_text, summary, keywords, urls, statistics and fingerprint.

    The text crosses to Python once; everything that is told from it comes back together.
    """
    s = settings
    clean, stop = X.cleaner(s.unicode_form, False, s.collapse_whitespace, s.strip_edges), frozenset(s.stopwords)

    def one(raw: str) -> tuple:
        text = clean(raw)
        tokens = [t.lower() for t in _WORDS.findall(text)]
        keywords = _top_words(tokens, s.max_keywords, s.min_keyword_length, stop, False)
        urls = list(dict.fromkeys(_URLS.findall(raw)))
        sentences = max(len(_ENDS.findall(text)), 1 if text else 0)
        return text, keywords, urls, " ".join(text.split()[: s.summary_word_limit]), len(text), text.count("\n") + 1, sentences, len(tokens), len(set(tokens)), len(keywords), len(urls)

    out = df.withColumn("__e", X.once(one, _ENRICHED)(F.col("text")))
    for c in ("enriched_text", "keywords", "urls", "summary"):
        out = out.withColumn(c, F.col("__e")[c])
    stats = F.struct(*[F.col("__e")[c].alias(c) for c in _COUNTS])
    out = out.withColumn("statistics", F.when(F.col("text").isNotNull(), stats))
    return out.withColumn("fingerprint", F.sha2("enriched_text", 256)).drop("__e")


@dataclass(frozen=True)
class DedupSettings:
    unicode_form: str = "NFKC"
    collapse_whitespace: bool = True
    casefold: bool = True
    fingerprint_metadata_keys: tuple[str, ...] = ()


def canonical(s: DedupSettings = DedupSettings()) -> Callable[[str], str]:
    """Like normalize, but blanks collapse before folding and the edges are always stripped."""
    return X.cleaner(s.unicode_form, s.casefold, s.collapse_whitespace, True, fold_last=True)


_CANONICAL = T.StructType([T.StructField("canonical", T.StringType()), T.StructField("literal", T.StringType())])


def with_fingerprint(df: DataFrame, s: DedupSettings = DedupSettings()) -> DataFrame:
    """Adds __canonical and fingerprint, the SHA-256 of the literal {'text': canonical text, 'metadata': {selected keys present}}."""
    clean = canonical(s)
    if not s.fingerprint_metadata_keys:

        def one(raw: str) -> tuple[str, str]:
            text = clean(raw)
            return text, sha256(f"{{'text': {text!r}, 'metadata': {{}}}}".encode()).hexdigest()

        out = df.withColumn("__c", X.once(one, _CANONICAL)(F.col("text")))
        return out.withColumn("__canonical", F.col("__c.canonical")).withColumn("fingerprint", F.col("__c.literal")).drop("__c")
    quoted = X.once(repr, T.StringType())
    out = df.withColumn("__c", X.once(lambda raw: (t := clean(raw), repr(t)), _CANONICAL)(F.col("text")))
    pairs = [F.when(F.map_contains_key("metadata", k), F.concat(F.lit(repr(k) + ": "), F.coalesce(quoted(F.col("metadata")[k]), F.lit("None")))) for k in s.fingerprint_metadata_keys]
    literal = F.concat(F.lit("{'text': "), F.col("__c.literal"), F.lit(", 'metadata': {"), F.concat_ws(", ", *pairs), F.lit("}}"))
    return out.withColumn("__canonical", F.col("__c.canonical")).withColumn("fingerprint", F.sha2(literal, 256)).drop("__c")


class Deduplicated:
    """Exact duplicates: the first by ``order`` stays.

    The canonical rows are written once. Groups are reduced to (fingerprint, first, count) before the
    shuffle and no text is shuffled for them, so a group that holds a third of all rows costs no task
    more than its share.
    """

    def __init__(self, df: DataFrame, order: str = "document_id", settings: DedupSettings = DedupSettings(), staging: Staging | None = None):
        staging = staging or Staging(df.sparkSession, "dedup")
        self.order = order
        self.rows = staging.put(with_fingerprint(df.where(F.col("text").isNotNull() & F.col(order).isNotNull()), settings).drop("text"))
        keys = self.rows.select("fingerprint", F.col(order).alias("__first"))
        self.groups = keys.groupBy("fingerprint").agg(F.min("__first").alias("__first"), F.count(F.lit(1)).alias("__n"))

    def documents(self) -> DataFrame:
        """The documents kept, with canonical text, fingerprint and duplicate_count."""
        first = self.groups.select(F.col("__first").alias(self.order), F.col("fingerprint").alias("__fp"), (F.col("__n") - 1).alias("duplicate_count"))
        joined = self.rows.join(first, self.order).where("fingerprint = __fp")
        return joined.drop("__fp").withColumnRenamed("__canonical", "text")

    def retained(self) -> DataFrame:
        """The documents kept, with ``dedup``: their fingerprint and how many copies were dropped."""
        return self.documents().withColumn("dedup", F.struct("fingerprint", "duplicate_count")).drop("fingerprint", "duplicate_count")

    def decisions(self) -> DataFrame:
        """(duplicate_document_id, canonical_document_id, fingerprint, reason) of the documents dropped."""
        several = self.groups.where("__n > 1")
        keys = self.rows.select("fingerprint", F.col(self.order).alias("duplicate_document_id"))
        joined = salted_join(keys, several, ["fingerprint"], "inner").where("duplicate_document_id <> __first")
        return joined.select("duplicate_document_id", F.col("__first").alias("canonical_document_id"), "fingerprint", F.lit("duplicate").alias("reason"))

    def summary(self) -> DataFrame:
        return self.groups.agg(F.count(F.lit(1)).alias("kept_count"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("removed_count"))


@dataclass(frozen=True)
class Rule:
    """A compliance rule; its checks run in the order of the fields and the first failure is reported."""

    rule_id: str
    severity: str = "error"
    max_characters: int | None = None
    min_unique_words: int | None = None
    required_metadata_keys: tuple[str, ...] = ()
    forbidden_terms: tuple[str, ...] = ()
    case_sensitive: bool = False


_FINDINGS = T.ArrayType(T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("passed", T.BooleanType()), T.StructField("severity", T.StringType()), T.StructField("message", T.StringType()), T.StructField("details", T.MapType(T.StringType(), T.StringType()))]))


class _Facts:
    """What rules ask of a text, each worked out once."""

    def __init__(self, text: str, keys: set[str]):
        self.text, self.folded, self.keys = text, text.casefold(), keys
        self._words: dict[bool, list[str]] = {}

    def words(self, exact: bool) -> list[str]:
        if exact not in self._words:
            self._words[exact] = _WORDS.findall(self.text if exact else self.folded)
        return self._words[exact]


def _finding(rule: Rule, facts: _Facts) -> tuple:
    def failed(message: str, **details: object) -> tuple:
        return rule.rule_id, False, rule.severity, message, {k: str(v) for k, v in details.items()}

    words = facts.words(rule.case_sensitive)
    unique = len(set(words))
    if rule.max_characters is not None and len(facts.text) > rule.max_characters:
        return failed(f"longer than {rule.max_characters} characters", character_count=len(facts.text), maximum=rule.max_characters)
    if rule.min_unique_words is not None and unique < rule.min_unique_words:
        return failed(f"fewer than {rule.min_unique_words} unique words", unique_words=unique, minimum=rule.min_unique_words)
    missing = [k for k in rule.required_metadata_keys if k not in facts.keys]
    if missing:
        return failed("required metadata keys are missing", missing_keys=",".join(missing))
    text = facts.text if rule.case_sensitive else facts.folded
    hits = [t for t in (x if rule.case_sensitive else x.casefold() for x in rule.forbidden_terms) if t and t in text]
    if hits:
        return failed("forbidden terms occur", forbidden_terms=",".join(hits))
    return rule.rule_id, True, rule.severity, "passed", {"word_count": str(len(words)), "unique_words": str(unique)}


def default_rules(rules: list[Rule], settings: Rule) -> list[Rule]:
    """The given rules, then the settings as ``default-policy`` if any of their checks is set."""
    some = settings.forbidden_terms or settings.required_metadata_keys or settings.max_characters is not None or settings.min_unique_words is not None
    return [*rules, settings] if some else list(rules)


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``findings`` (one per rule, in order) and ``compliant``; rules are literals, nothing is joined.

    Folding has no built-in, so the text crosses to Python; all rules are answered in that one pass.
    """
    if not rules:
        return df.withColumn("findings", F.array().cast(_FINDINGS)).withColumn("compliant", F.lit(True))

    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, keys):
            facts = None if text is None else _Facts(text, set() if own is None else set(own))
            out.append(None if facts is None else [_finding(r, facts) for r in rules])
        return pd.Series(out, dtype=object)

    keys = F.map_keys("metadata") if any(r.required_metadata_keys for r in rules) else F.array().cast(_STRINGS_TYPE)
    out = df.withColumn("findings", F.pandas_udf(run, _FINDINGS).asNondeterministic()(F.col("text"), keys))
    return out.withColumn("compliant", F.forall("findings", lambda f: f["passed"]))


def check_totals(checked: DataFrame) -> DataFrame:
    return checked.where("text is not null").agg(
        F.coalesce(F.bool_and("compliant"), F.lit(True)).alias("compliant"), F.count_if("compliant").alias("passed_count"), F.count_if(~F.col("compliant")).alias("failed_count")
    )


@dataclass(frozen=True)
class ChunkSettings:
    chunk_size: int = 128
    overlap: int = 16

    def __post_init__(self) -> None:
        if self.chunk_size < 1 or not 0 <= self.overlap < self.chunk_size:
            raise ValueError("the overlap must be smaller than the chunk size")


def chunk(df: DataFrame, settings: ChunkSettings = ChunkSettings(), keep: tuple[str, ...] = ("metadata",)) -> DataFrame:
    """Overlapping windows of tokens, one row each: chunk_id, document_id, chunk_index, start_token, end_token, text."""
    size, step = settings.chunk_size, settings.chunk_size - settings.overlap
    kept = [c for c in keep if c in df.columns]
    toks = df.select("document_id", *kept, X.once(str.split, _STRINGS_TYPE)(F.col("text")).alias("__t"))
    n = F.size("__t")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    out = toks.withColumn("chunk_index", F.explode(F.when(n > 0, F.sequence(F.lit(0), last))))
    start = F.col("chunk_index") * step
    out = out.select(
        F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "document_id", "chunk_index", start.alias("start_token"), F.least(start + size, n).alias("end_token"), F.array_join(F.slice("__t", start + 1, F.lit(size)), " ").alias("text"), *kept
    )
    if "metadata" in kept:
        extra = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("chunk_size"), F.lit(str(size)), F.lit("overlap"), F.lit(str(settings.overlap)))
        own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("chunk_index", "chunk_size", "overlap"))
        out = out.withColumn("metadata", F.map_concat(own, extra))
    return out


_ANALYZED = T.StructType([T.StructField("keywords", _STRINGS_TYPE), T.StructField("token_count", T.IntegerType())])


def analyze(df: DataFrame, keywords: int = 12, summary_chars: int = 240) -> DataFrame:
    """Adds language, keywords (by count, then first place), entities, summary and token_count."""

    def one(text: str) -> tuple:
        tokens = [t.lower() for t in _WORDS.findall(text)]
        return _top_words(tokens, keywords, 0, frozenset(), True), len(tokens)

    out = df.withColumn("__a", X.once(one, _ANALYZED)(F.col("text"))).withColumn("keywords", F.col("__a.keywords"))
    entities = F.array().cast("array<struct<text:string,label:string>>")
    out = out.withColumn("language", F.lit("en")).withColumn("entities", entities).withColumn("token_count", F.col("__a.token_count"))
    return out.withColumn("summary", F.substring(X.squeeze(F.col("text")), 1, summary_chars)).drop("__a")


_CHANGES = T.StructType([T.StructField("added_lines", _STRINGS_TYPE), T.StructField("removed_lines", _STRINGS_TYPE)])
_COMPARED = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("unified_diff", T.StringType()), *_CHANGES.fields])


def _sides(a: list[str], b: list[str], cut: int) -> tuple[list[str], list[str]]:
    one, other = set(a), set(b)
    return [x[cut:] for x in b if x not in one], [x[cut:] for x in a if x not in other]


def line_changes(before: Column, after: Column, drop_first: bool = True) -> Column:
    """(added_lines, removed_lines): lines of one side that the other lacks, repeats kept, in order.

    ``drop_first`` leaves out each line's first character (the compatible form). Each side is looked
    up as a set, which no built-in does inside a row without losing the repeats.
    """
    cut = int(drop_first)

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if a is None or b is None else _sides(a.splitlines(), b.splitlines(), cut) for a, b in zip(x, y)]
        return pd.DataFrame(rows, columns=_CHANGES.names, dtype=object)

    return F.pandas_udf(run, _CHANGES).asNondeterministic()(before, after)


def diff(df: DataFrame, before: str = "before", after: str = "after", drop_first: bool = True) -> DataFrame:
    """Adds ratio, unified_diff, added_lines, removed_lines and changed."""
    cut = int(drop_first)

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(x, y):
            if a is None or b is None:
                rows.append((None,) * 4)
                continue
            a, b = a.splitlines(), b.splitlines()
            rows.append((SequenceMatcher(a=a, b=b).ratio(), "\n".join(unified_diff(a, b, lineterm="")), *_sides(a, b, cut)))
        return pd.DataFrame(rows, columns=_COMPARED.names, dtype=object)

    out = df.withColumn("__d", F.pandas_udf(run, _COMPARED).asNondeterministic()(F.col(before), F.col(after)))
    for c in _COMPARED.names:
        out = out.withColumn(c, F.col("__d")[c])
    return out.drop("__d").withColumn("changed", F.col(before) != F.col(after))
