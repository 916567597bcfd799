"""Subject areas of documents, by label propagation over a verified similarity graph.

Nodes are paragraphs (a line of text; list lines join in threes) and landmarks, paragraphs drawn in
hash order: a sample (``LANDMARKS``), and further ones until every paragraph that could be a landmark
has one within ``least``. They are the index of the graph, and every paragraph
of every document is linked to its ``LINKS`` nearest ones, told by the exact cosine of the weighted
word vectors with every landmark (equal ones by the landmarks' order); an edge is kept only where
that cosine reaches ``least``. Word weights come from document frequencies counted over all
paragraphs; words in less than ``RARE`` or more than ``COMMON`` of them carry none.

Labels go from seed documents to their paragraphs, over the edges to the landmarks and back, round
by round, as DataFrame joins, until no landmark's share of a subject moves by ``settled``. Seeds are
clamped: a labelled document's paragraphs share out its own labels only, and a trusted document
comes out with exactly its labels. It is trusted if each label finds support among the neighbours
of one of its paragraphs and no more than a share of ``stray`` of its decided paragraphs are about
something else; a document that is not (people label wrongly at times) is treated as unlabelled. A
paragraph keeps several subjects while it is undecided; a document gets every subject that one of
its paragraphs is mostly about, so it may have several or none.

Defined results: null and blank texts, and paragraphs with fewer than ``MIN_WORDS`` weighted words
or no verified edge, have no subject; labels of unknown subjects or documents are ignored, letter
case too, and repeated ones count once; with no labels nothing has a subject; rows of one id are
taken together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.storage import Staging

LANDMARKS = 1024
#: COMMON: a word that all of a subject's paragraphs hold still counts where the subject holds a third of all.
RARE, COMMON = 0.0008, 0.4
MIN_WORDS = 3
LINKS = 3
LONG = 360
#: A dense table of landmarks, one of which every Python worker holds, has at most this size; more landmarks come in turns.
MAX_INDEX_BYTES = 256 << 20
_SENTENCE = re.compile(r"(?<=[.!?]) ")


class _Letters(dict):
    """A translation that keeps letters and turns everything else into blanks, filled as it is used."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c if c.isalpha() else " "
        return self[code]


_LETTERS = _Letters()



def paragraphs(text: str) -> list[list[str]]:
    """Lower-case words of each paragraph; list lines are joined in threes, blank lines dropped.

    A line of more than ``LONG`` characters may be several paragraphs that lost their breaks: it is
    taken in runs of three sentences.
    """
    out: list[list[str]] = []
    run = 0
    for line in text.lower().split("\n"):
        if len(line) > LONG:
            run = 0
            parts = _SENTENCE.split(line)
            ends = [*range(3, max(4, len(parts) - 1), 3), len(parts)]
            out += [w for a, z in zip([0, *ends], ends) if (w := " ".join(parts[a:z]).translate(_LETTERS).split())]
            continue
        words = line.translate(_LETTERS).split()
        if not words:
            run = 0
            continue
        if line.lstrip()[:2] in ("- ", "* ", "-\xa0"):
            if 0 < run < 3:
                out[-1] = out[-1] + words
            else:
                out.append(words)
                run = 0
            run += 1
        else:
            out.append(words)
            run = 0
    return out


def _survey(sample: int):
    """Per task: document frequencies of its words, the number of its paragraphs, its landmark candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        count = 0
        best: dict[int, list[str]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in paragraphs(text):
                    count += 1
                    own = set(words)
                    seen.update(own)
                    if len(own) >= 8:
                        h = xxhash.xxh3_64_intdigest(" ".join(words)) >> 1
                        best[h] = words
            if len(best) > 4 * sample:
                best = dict(nsmallest(sample, best.items(), key=lambda x: x[0]))
        best = dict(nsmallest(sample, best.items(), key=lambda x: x[0]))
        words, counts = list(seen), list(seen.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(["w"] * len(words) + ["n"] + ["p"] * len(best), pa.string()), pa.array([*words, "", *map(" ".join, best.values())], pa.string()), pa.array([*counts, count, *best], pa.int64())],
            ["what", "text", "n"],
        )

    return run


class Index:
    """Vocabulary with weights, and landmarks, shared with the executors."""

    def __init__(self, weights: dict[str, float], landmarks: list[list[str]]):
        self.weights, self.landmarks = weights, landmarks
        self.ids = {w: i for i, w in enumerate(sorted(weights))}
        self.weight = np.array([weights[w] for w in sorted(weights)], np.float32)
        row, word, value = self.vectors(landmarks)
        keep = np.bincount(row, minlength=len(landmarks)) >= MIN_WORDS + 1
        place = np.cumsum(keep) - 1
        ok = keep[row] if len(row) else np.zeros(0, bool)
        self.size = int(keep.sum())
        self.marks = place[row[ok]], word[ok], value[ok]
        self.turn = max(1, min(self.size, MAX_INDEX_BYTES // (4 * max(1, len(self.ids)))))

    def table(self, a: int, z: int) -> np.ndarray:
        """Landmarks ``a`` to ``z`` as columns over the vocabulary."""
        out = np.zeros((max(1, len(self.ids)), max(1, z - a)), np.float32)
        place, word, value = self.marks
        s, e = np.searchsorted(place, (a, z))
        out[word[s:e], place[s:e] - a] = value[s:e]
        return out

    @cached_property
    def dense(self) -> np.ndarray:
        return self.table(0, self.size)

    def vectors(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse unit vectors (row, word, value) of paragraphs."""
        get = self.ids.get
        flat, lengths = [], []
        for words in texts:
            found = [i for i in map(get, words) if i is not None]
            flat += found
            lengths.append(len(found))
        if not flat:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        key = np.repeat(np.arange(len(texts)), lengths) * len(self.ids) + np.array(flat)
        key, n = np.unique(key, return_counts=True)
        row, word = np.divmod(key, len(self.ids))
        value = (np.sqrt(n) * self.weight[word]).astype(np.float32)
        norm = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
        return row, word, (value / norm[row]).astype(np.float32)

    def links(self, texts: list[list[str]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that have links, their LINKS landmarks (-1 for none) and exact cosines."""
        rows, marks, cosines, _ = self.nearest(texts, least)
        has = marks[:, 0] >= 0
        return rows[has], marks[has], cosines[has]

    def nearest(self, texts: list[list[str]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows with weighted words, their LINKS landmarks (-1 for none), cosines and numbers of such words."""
        row, word, value = self.vectors(texts)
        if not len(row):
            return np.zeros(0, np.int64), np.zeros((0, LINKS), np.int64), np.zeros((0, LINKS), np.float32), np.zeros(0, np.int64)
        rows, start, nnz = np.unique(row, return_index=True, return_counts=True)
        marks, cosines = np.full((len(rows), LINKS), -1), np.zeros((len(rows), LINKS), np.float32)
        taken = np.empty((0, 0), np.float32)
        for t in range(0, self.size, self.turn):
            dense = self.dense if self.turn == self.size else self.table(t, min(t + self.turn, self.size))
            if taken.shape[1] != dense.shape[1]:
                taken = np.empty((int(nnz.max()), dense.shape[1]), np.float32)
            near = np.empty((256, dense.shape[1]), np.float32)
            for a in range(0, len(rows), 256):  # blocks that stay in the cache, in one buffer
                z = min(a + 256, len(rows))
                for i in range(a, z):
                    s, n = start[i], nnz[i]
                    np.dot(value[s : s + n], np.take(dense, word[s : s + n], axis=0, out=taken[:n], mode="clip"), out=near[i - a])
                part, each = near[: z - a], np.arange(z - a)
                best, at = [cosines[a:z]], [marks[a:z]]
                for _ in range(min(LINKS, dense.shape[1])):
                    top = part.argmax(axis=1)
                    best.append(part[each, top][:, None])
                    at.append(top[:, None] + t)
                    part[each, top] = -1
                best, at = np.hstack(best), np.hstack(at)
                order = np.argsort(-best, axis=1, kind="stable")[:, :LINKS]
                cosines[a:z], marks[a:z] = np.take_along_axis(best, order, 1), np.take_along_axis(at, order, 1)
        off = (cosines < least) | (nnz < MIN_WORDS)[:, None]
        marks[off] = -1
        cosines[off] = 0
        return rows, marks, cosines, nnz

    def apart(self, texts: list[list[str]], least: float) -> list[list[str]]:
        """Those of ``texts`` that can be landmarks, without any that is near an earlier one that stays."""
        able = [t for t, n in zip(texts, np.bincount(self.vectors(texts)[0], minlength=len(texts))) if n > MIN_WORDS]
        dense = Index(self.weights, able).dense[:, : len(able)]
        near = dense.T @ dense >= least
        stay: list[int] = []
        for i in range(len(able)):
            if not near[i, stay].any():
                stay.append(i)
        return [able[i] for i in stay]


def build_index(texts: DataFrame, landmarks: int = LANDMARKS) -> Index:
    found = texts.select("text").mapInArrow(_survey(landmarks), "what string, text string, n long")
    found = Staging(texts.sparkSession, "survey").put(found)
    total = found.where("what = 'n'").agg(F.sum("n")).first()[0] or 0
    low, high = max(2.0, RARE * total), COMMON * total
    # every word kept is in at least RARE of the paragraphs: at most words per paragraph / RARE of them
    words = found.where("what = 'w'").groupBy("text").agg(F.sum("n").alias("n")).where((F.col("n") >= low) & (F.col("n") <= high)).collect()
    marks = found.where("what = 'p'").select("n", "text").distinct().orderBy("n", "text").limit(landmarks).collect()
    return Index({r["text"]: float(np.log(total / r["n"])) for r in words}, [r["text"].split(" ") for r in marks])


def similarity_links(docs: DataFrame, index: Index, least: float) -> DataFrame:
    """One row per linked paragraph: key, para, its landmarks m0.. and cosines w0.. (null for none).

    Paragraphs that no landmark is near, though they could be landmarks, come with their words as ``rest``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                keys, paras, texts = [], [], []
                part = batch.slice(a, 512)
                for key, text in zip(*(c.to_pylist() for c in part.columns)):
                    ps = paragraphs(text)
                    keys += [key] * len(ps)
                    paras += range(len(ps))
                    texts += ps
                rows, marks, cosines, words = own.nearest(texts, least)
                out = (marks[:, 0] >= 0) | (words > MIN_WORDS)
                rows, marks, cosines = rows[out], marks[out], cosines[out]
                cols = [pa.array(np.array(keys, np.int64)[rows]), pa.array(np.array(paras, np.int32)[rows])]
                for i in range(LINKS):
                    off = marks[:, i] < 0
                    cols += [pa.array(marks[:, i].astype(np.int32), mask=off), pa.array(cosines[:, i].astype(np.float32), mask=off)]
                cols.append(pa.array([" ".join(texts[r]) if m < 0 else None for r, m in zip(rows.tolist(), marks[:, 0].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["key", "para", *[f"{c}{i}" for i in range(LINKS) for c in "mw"], "rest"])

    return docs.mapInArrow(run, "key long, para int, " + ", ".join(f"m{i} int, w{i} float" for i in range(LINKS)) + ", rest string")


def _not_near(texts: DataFrame, index: Index, least: float) -> DataFrame:
    """The rows of ``texts`` (rest: words) that no landmark is near."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                linked = shared.value.links([t.split(" ") for t in part.column(0).to_pylist()], least)[0]
                out = np.ones(part.num_rows, bool)
                out[linked] = False
                yield part.filter(pa.array(out))

    return texts.mapInArrow(run, "rest string")


def all_linked(texts: DataFrame, index: Index, least: float, staging: Staging) -> DataFrame:
    """``similarity_links``, written, with landmarks added until no paragraph that could be one is without."""
    links = staging.put(similarity_links(texts, index, least))
    rest = staging.put(links.where("rest is not null").select("rest").distinct())
    more: list[list[str]] = []
    while drawn := [r["rest"].split(" ") for r in rest.orderBy(F.xxhash64("rest"), "rest").limit(LANDMARKS).collect()]:
        fresh = index.apart(drawn, least)
        more += fresh
        left = staging.put(_not_near(rest, Index(index.weights, fresh), least))
        staging.drop(rest)
        rest = left
    if more:
        staging.drop(links)
        links = staging.put(similarity_links(texts, Index(index.weights, index.landmarks + more), least))
    return links.where("rest is null").drop("rest")


@contextmanager
def _compiled(spark):
    """Keeps generated methods below the 8,000 bytes beyond which the JVM only interprets them.

    Whole-stage code over a column per subject is longer than that; operators apart are not, and run
    several times as fast.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def subjects_of(docs: DataFrame, areas: DataFrame, labels: DataFrame, rounds: int = 20, least: float = 0.25, sure: float = 0.5, trust: float = 0.15, stray: float = 0.25, self_weight: float = 0.3, settled: float = 0.05, staging: Staging | None = None) -> DataFrame:
    """``docs`` (key long, text), ``areas`` (subject), ``labels`` (key, subject) to (key, subject)."""
    staging = staging or Staging(docs.sparkSession, "subjects")
    spark = docs.sparkSession
    names = sorted({r[0] for r in areas.where("subject is not null").select("subject").distinct().limit(1001).collect()})
    if len(names) > 1000:
        raise ValueError("more than 1000 subjects")
    texts = docs.where("key is not null and text is not null").select("key", "text")
    index = build_index(texts)
    links = all_linked(texts, index, least, staging)
    cols = [f"s{i}" for i in range(len(names))]
    wanted = labels.where("key is not null").select("key", F.lower(F.trim("subject")).alias("subject")).distinct()
    marked = wanted.groupBy("key").agg(*[F.max(F.when(F.col("subject") == n.lower(), 1.0).otherwise(0.0)).alias(f"l_{c}") for n, c in zip(names, cols)])
    total = lambda xs: sum(xs[1:], xs[0])
    marked = marked.where(total([F.col(f"l_{c}") for c in cols]) > 0)
    with _compiled(spark):
        return _spread(staging, staging.put(links.join(marked, "key", "left")), names, rounds, sure, trust, stray, self_weight, settled)


def _spread(staging: Staging, seeded: DataFrame, names: list[str], rounds: int, sure: float, trust: float, stray: float, self_weight: float, settled: float) -> DataFrame:
    """The rounds over the linked paragraphs, and the subjects picked from them, written."""
    spark = seeded.sparkSession
    cols = [f"s{i}" for i in range(len(names))]
    total = lambda xs: sum(xs[1:], xs[0])
    is_seed = F.col("l_s0").isNotNull()

    def to_landmarks(p: DataFrame, weight) -> DataFrame:
        """Sums of weight * p over the edges, per landmark, normalised."""
        edges = p.select(*cols, weight.alias("__v"), F.explode(F.array(*[F.struct(F.col(f"m{i}").alias("m"), F.col(f"w{i}").alias("w")) for i in range(LINKS)])).alias("e")).where("e.m is not null")
        sums = edges.groupBy(F.col("e.m").alias("m")).agg(*[F.sum(F.col(c) * F.col("e.w") * F.col("__v")).alias(c) for c in cols])
        all_of = total([F.col(c) for c in cols])
        return sums.where(all_of > 0).select("m", *[(F.col(c) / all_of).alias(c) for c in cols])

    def to_paragraphs(marks: list) -> DataFrame:
        """Weighted means over each paragraph's landmarks, clamped to the seeds' own labels."""
        small = spark.createDataFrame(marks, ", ".join(["m int", *[f"{c} double" for c in cols]]))
        out = seeded
        for i in range(LINKS):
            out = out.join(F.broadcast(small.withColumnsRenamed({"m": f"m{i}", **{c: f"{c}_{i}" for c in cols}})), f"m{i}", "left")
        means = [total([F.coalesce(F.col(f"{c}_{i}") * F.col(f"w{i}") ** 2, F.lit(0.0)) for i in range(LINKS)]).alias(f"r_{c}") for c in cols]
        return out.select(*seeded.columns, *means)

    start = seeded.where(is_seed)
    labelled = total([F.col(f"l_{c}") for c in cols])
    marks = to_landmarks(start.select(*[F.col(c) for c in seeded.columns], *[(F.col(f"l_{c}") / labelled).alias(c) for c in cols]), 1 / labelled).collect()
    p = None
    for _ in range(rounds):
        p = to_paragraphs(marks)
        free_sum = total([F.col(f"r_{c}") for c in cols])
        # a seed label counts only where the neighbours give it some support
        held = {c: F.when(is_seed & (F.col(f"r_{c}") >= trust * free_sum), F.col(f"r_{c}") * F.col(f"l_{c}")).otherwise(F.when(is_seed, F.lit(0.0)).otherwise(F.col(f"r_{c}"))) for c in cols}
        p = p.select(*seeded.columns, *[f"r_{c}" for c in cols], *[held[c].alias(f"h_{c}") for c in cols])
        held_sum = total([F.col(f"h_{c}") for c in cols])
        p = p.select(*seeded.columns, *[F.when(held_sum > 0, F.col(f"h_{c}") / held_sum).otherwise(F.lit(0.0)).alias(c) for c in cols], *[(F.col(f"r_{c}") / F.greatest(total([F.col(f"r_{k}") for k in cols]), F.lit(1e-12))).alias(f"f_{c}") for c in cols])
        fresh = to_landmarks(p, F.when(is_seed, F.lit(1.0)).otherwise(F.lit(self_weight))).collect()  # a row a landmark
        moved = _change(marks, fresh)
        marks = fresh
        if moved < settled:
            break
    # seeds are clamped: a document all of whose labels find support in its paragraphs, and most of
    # whose decided paragraphs are about one of them, keeps its labels and no others
    outside = total([F.when((F.col(f"f_{c}") >= sure) & (F.col(f"l_{c}") == 0), 1).otherwise(0) for c in cols])
    decided = total([F.when(F.col(f"f_{c}") >= sure, 1).otherwise(0) for c in cols])
    per_doc = p.groupBy("key").agg(
        *[F.max(f"f_{c}").alias(f"f_{c}") for c in cols], *[F.max(f"l_{c}").alias(f"l_{c}") for c in cols],
        F.sum(outside).alias("outside"), F.sum(decided).alias("decided"),
    )
    backed = total([F.when((F.col(f"l_{c}") > 0) & (F.col(f"f_{c}") < trust), 1).otherwise(0) for c in cols]) == 0
    trusted = F.coalesce(is_seed & backed & (F.col("outside") <= stray * F.col("decided")), F.lit(False))
    keeps = lambda c: F.when(trusted, F.col(f"l_{c}") > 0).otherwise(F.col(f"f_{c}") >= sure)
    picked = F.filter(F.array(*[F.when(keeps(c), F.lit(n)) for n, c in zip(names, cols)]), lambda x: x.isNotNull())
    return staging.put(per_doc.select("key", F.explode(picked).alias("subject")))


def _change(before: list, after: list) -> float:
    """The largest change of any share of any landmark."""
    old = {r["m"]: r[1:] for r in before}
    none = (0.0,) * (len(after[0]) - 1) if after else ()
    return max((abs(a - b) for r in after for a, b in zip(r[1:], old.get(r["m"], none))), default=0.0)
