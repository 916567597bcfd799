"""Most similar vectors for every vector: cells, randomly rotated one-bit codes, exact reranking.

Index. Every unit vector descends a tree of cells. A node of more than ``2 * cell`` vectors (below
the root: ``8 * cell``) is split by spherical k-means, fitted on at most ``SAMPLE`` of its vectors,
into a child for every ``cell`` of them, ``fan`` at most; larger nodes are split again, so a leaf
stays small however many vectors there are. In its leaf with centroid c a vector v is c + r; o = r / |r|,
randomly rotated, is kept as one sign bit per dimension with three scalars: |r|, f = <signs/sqrt(D), o>
and g = <r, c>. (Gao and Long 2024.)

Search. A query follows the ``probes`` nearest children of the nodes it visits. In a leaf its own
rotated q - c is rounded to four bits a dimension, so that the sum behind <signs, q - c> is four
population counts of packed words; <c, q> + g + |r| <signs/sqrt(D), q - c> / f estimates <v, q>
within a bound e. Codes travel alone: only pairs whose estimate plus e reaches ``least`` and the k-th
best of the estimates minus e are joined to the vectors and reranked by their exact cosine.

``probes`` is set when the root is fitted, for each group: without ``least``, the fewest cells that
hold the share ``recall`` of the k nearest of sampled queries within the sample (the whole group is
denser, its neighbours lie nearer); with ``least``, the fewest that hold 99.9 percent of vectors
turned away from sampled ones to a cosine of just ``least``.

Equal vectors of one group are searched once, through a representative, and expanded afterwards: of
a class of copies only its k + 1 smallest ids can be anyone's neighbours. Nodes and leaves are cut
into blocks of ``BLOCK`` rows on either side, so no task grows with a hot one.

Defined results: a vector that is null, of another length, not finite or all zero takes no part,
nor does one without a group; rows of one id must be made one before (``current_vectors``); equal
cosines go by id; an empty table gives no rows; a group of one record gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.skew import salted_join
from docloom.storage import Staging

SAMPLE = 16_384
CELL = 512
FAN = 1024
DEPTH = 4
BLOCK = 4_096
#: Tables of node sizes with more rows than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST = 200_000
QUERY_BITS = 4
SEED = 11


def current_vectors(df: DataFrame, group: str, key: str, vector: str, at: str, dim: int) -> DataFrame:
    """(grp, id, vec) of the latest row of each record, where that vector is usable."""
    order = F.struct(F.col(at), F.xxhash64(vector))
    # max_by skips no nulls of the value: wrapped in a struct, a null vector can be the latest
    now = df.where(F.col(key).isNotNull()).groupBy(F.col(group).alias("grp"), F.col(key).alias("id")).agg(F.max_by(F.struct(F.col(vector).alias("v")), order).alias("r")).select("grp", "id", F.col("r.v").alias("v"))
    return usable(now, "v", dim).select("grp", "id", F.col("v").cast("array<float>").alias("vec"))


def usable(df: DataFrame, v: str, dim: int) -> DataFrame:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; a cell that runs empty keeps its centroid."""
    if cells <= 1:
        return np.zeros((1, sample.shape[1]), np.float32)
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, least: float, recall: float) -> int:
    """How many of the nearest cells a query has to visit."""
    rng = np.random.default_rng(SEED + 1)
    pick = rng.choice(len(sample), min(512, len(sample)), replace=False)
    asked = sample[pick].astype(np.float32)
    home = np.concatenate([(sample[i : i + 4096].astype(np.float32) @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
    if least > -1:
        turn = rng.standard_normal((8, *asked.shape)).astype(np.float32)
        turn -= (turn * asked).sum(-1, keepdims=True) * asked
        turn /= np.linalg.norm(turn, axis=-1, keepdims=True)
        others = (least * asked + sqrt(max(0.0, 1 - least * least)) * turn).reshape(-1, asked.shape[1])
        want, sims, share = np.tile(home[pick], 8)[:, None], others @ c.T, 0.999
    else:
        near = asked @ sample.astype(np.float32).T
        near[np.arange(len(pick)), pick] = -np.inf
        k = min(k, len(sample) - 1)
        want, sims, share = home[np.argpartition(-near, k - 1, axis=1)[:, :k]], asked @ c.T, recall
    place = (-sims).argsort(axis=1).argsort(axis=1)
    ranks = np.sort(np.take_along_axis(place, want, 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)]) + 1


def encode(unit: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, |r|, f and g of unit vectors about their centroid(s)."""
    r = unit - centroid
    length = np.linalg.norm(r, axis=1)
    x = (r / np.maximum(length, 1e-12)[:, None]) @ turn
    f = np.maximum(np.abs(x).sum(axis=1) / sqrt(unit.shape[1]), 1e-6)
    g = (r * centroid).sum(axis=1)
    return _packed(x > 0), length.astype(np.float32), f.astype(np.float32), g.astype(np.float32)


def encode_query(unit: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bit planes of the rotated residuals, and <c, q>, their least value, step, sum and length."""
    r = unit - centroid
    x = r @ turn
    low = x.min(axis=1)
    step = np.maximum((x.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-12)
    u = np.rint((x - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.concatenate([_packed((u >> j) & 1) for j in range(QUERY_BITS)], axis=1)
    return planes, (unit * centroid).sum(axis=1), low, step, x.sum(axis=1), np.linalg.norm(r, axis=1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits packed into whole 64-bit words a row."""
    raw = np.packbits(bits.astype(bool), axis=1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


def search_block(queries: dict[str, np.ndarray], data: dict[str, np.ndarray], dim: int, k: int, least: float, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, estimate, slack) of the pairs that survive the bounds, from codes alone."""
    bits, words = data["bits"], data["bits"].shape[1]
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.float32)
    scale = (data["length"] / data["f"]).astype(np.float32)
    spread = np.maximum(1 - data["f"] ** 2, 0) / (dim - 1)
    out: list[list[np.ndarray]] = [[], [], [], []]
    step = max(1, (1 << 18) // max(1, len(bits)))
    for a in range(0, len(queries["num"]), step):
        q = {name: v[a : a + step] for name, v in queries.items()}
        hits = np.zeros((len(q["num"]), len(bits)), np.uint32)
        for j in range(QUERY_BITS):
            for w in range(words):
                hits += np.bitwise_count(q["planes"][:, j * words + w, None] & bits[None, :, w]).astype(np.uint32) << np.uint32(j)
        sums = 2 * (q["low"][:, None] * ones + q["step"][:, None] * hits) - q["total"][:, None]
        guess = q["base"][:, None] + data["g"] + scale * sums / np.float32(sqrt(dim))
        slack = bound * scale * np.sqrt(q["width"][:, None] ** 2 * spread + q["step"][:, None] ** 2 / 12) + np.float32(1e-5)
        guess[q["num"][:, None] == data["num"]] = -np.inf  # a vector is not its own neighbour
        floor = np.full(len(q["num"]), least - 1e-5)
        if least <= -1 and len(bits) > k:
            floor = np.partition(guess - slack, len(bits) - k, axis=1)[:, len(bits) - k]
        qi, di = np.nonzero((guess + slack >= floor[:, None]) & np.isfinite(guess))
        for o, v in zip(out, (qi + a, di, guess[qi, di], slack[qi, di])):
            o.append(v)
    return tuple(np.concatenate(o) for o in out)


_CODE = "bits binary, length float, f float, g float"
_ASK = "planes binary, base float, low float, step float, total float, width float"
_FLOATS = ("base", "low", "step", "total", "width")


def _rows(t: pa.Table | pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind).reshape(t.num_rows, -1)


def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(a)], pa.binary())


def _attach(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Joins a table of nodes to rows, many of which may lie in one node."""
    if small.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(small), ["grp", "cell"], how)
    return salted_join(rows, small, ["grp", "cell"], how)


class Neighbours:
    """k nearest records of the same group. ``records``: grp string, id string, vec array<float>.

    ``recall``: the share of the true neighbours that the visited cells are to hold. ``bound``: how
    many standard errors of an estimate are allowed for, by default 3 with ``least`` and else 2.
    ``probes`` overrides the number found when the root is fitted.
    """

    def __init__(self, records: DataFrame, dim: int, k: int = 10, least: float = -1.0, recall: float = 0.97, bound: float | None = None, probes: int | None = None, cell: int = CELL, fan: int = FAN, staging: Staging | None = None):
        self.dim, self.k, self.least, self.recall, self.cell, self.fan = dim, k, least, recall, cell, fan
        self.bound = bound or (3.0 if least > -1 else 2.0)
        self.probes = probes
        self.spark = records.sparkSession
        self.staging = staging or Staging(self.spark, "neighbours")
        copies = Window.partitionBy("grp", "h", "vec").orderBy("id")
        self.records = self.staging.put(records.where("grp is not null").withColumn("h", F.xxhash64("vec")))
        # the k + 1 smallest ids of each class of equal vectors; the limit applies before the shuffle
        few = self.records.withColumn("rank", F.row_number().over(copies)).where(F.col("rank") <= k + 1)
        few = self.staging.put(few)
        lead = few.where("rank = 1").select("grp", "h", "vec", F.col("id").alias("lead"), F.monotonically_increasing_id().alias("num"))
        self.leads = self.staging.put(lead)  # written, so the numbers stay
        self.members = few.join(self.leads, ["grp", "h", "vec"]).select("grp", "lead", "id")
        self._index()

    def _index(self) -> None:
        dim, turn = self.dim, rotation(self.dim)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    unit = _unit(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).astype(np.float32)
                    code = encode(unit, np.zeros((1, dim), np.float32), turn)
                    yield pa.RecordBatch.from_arrays([batch.column("num"), batch.column("grp"), batch.column("lead"), pa.array(np.ones(len(unit), np.int64)), _bytes(unit), _bytes(code[0]), *map(pa.array, code[1:])], ["num", "grp", "lead", "cell", "unit", "bits", "length", "f", "g"])

        first = self.staging.put(self.leads.select("num", "grp", "lead", "vec").mapInArrow(start, f"num long, grp string, lead string, cell long, unit binary, {_CODE}"))
        self.units = first.select("num", "grp", "lead", "unit")
        nodes = first.drop("lead")
        self.levels: list[tuple[DataFrame, DataFrame]] = []  # (sizes, centroids) of the nodes split at each depth
        for depth in range(DEPTH):
            floor = self.cell * (8 if depth else 2)
            sizes = self.staging.put(nodes.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor))
            if sizes.isEmpty():
                break
            centroids = self._fit(nodes, sizes, depth == 0)
            self.levels.append((sizes, centroids))
            moved = self._assign(nodes, sizes, centroids)
            nodes = self.staging.put(moved.unionByName(_attach(nodes, sizes.select("grp", "cell"), "left_anti")))
        self.codes = nodes.drop("unit")

    def _fit(self, nodes: DataFrame, sizes: DataFrame, root: bool) -> DataFrame:
        """(grp, cell, child, c, probes): centroids of the nodes in ``sizes``."""
        k, least, recall, size, fan = self.k, self.least, self.recall, self.cell, self.fan

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            sample = np.frombuffer(b"".join(pdf.unit), np.float32).reshape(len(pdf), -1)
            c = fit_cells(sample, int(min(fan, len(pdf) // 16, max(2, round(pdf.n.iloc[0] / size))))).astype(np.float32)
            probes = probes_for(sample, c, k, least, recall) if root else 0
            return pd.DataFrame({"grp": key[0], "cell": key[1], "child": key[1] * fan + np.arange(len(c)), "c": [x.tobytes() for x in c], "probes": probes})

        # the smallest hashes of each node: what is far from them is left out before the shuffle,
        # so that the one task of a node sorts about twice the sample at any size of the node
        draw = F.pmod(F.xxhash64("num", F.lit(SEED)), F.lit(1 << 30))
        near = _attach(nodes.select("num", "grp", "cell", "unit", draw.alias("draw")), sizes).where(F.col("draw") <= F.lit(float(1 << 30)) * 2 * SAMPLE / F.col("n"))
        pick = Window.partitionBy("grp", "cell").orderBy("draw", "num")
        sample = near.withColumn("at", F.row_number().over(pick)).where(F.col("at") <= SAMPLE)
        return self.staging.put(sample.select("grp", "cell", "unit", "n").groupBy("grp", "cell").applyInPandas(fit, "grp string, cell long, child long, c binary, probes int"))

    def _meet(self, rows: DataFrame, sizes: DataFrame, centroids: DataFrame, step, schema: str) -> DataFrame:
        """Cogroups the rows of each node, in blocks, with the centroids of its children."""
        blocks = sizes.select("grp", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        mine = _attach(rows, blocks).withColumn("b", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")).drop("blocks")
        theirs = centroids.join(blocks, ["grp", "cell"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        on = ["grp", "cell", "b"]
        return mine.groupBy(*on).cogroup(theirs.groupBy(*on)).applyInArrow(step, schema)

    def _assign(self, nodes: DataFrame, sizes: DataFrame, centroids: DataFrame) -> DataFrame:
        turn = rotation(self.dim)
        names = ["num", "grp", "cell", "unit", "bits", "length", "f", "g"]
        kinds = pa.schema([("num", pa.int64()), ("grp", pa.string()), ("cell", pa.int64()), ("unit", pa.binary()), ("bits", pa.binary()), ("length", pa.float32()), ("f", pa.float32()), ("g", pa.float32())])

        def step(rows: pa.Table, cents: pa.Table) -> pa.Table:
            if not rows.num_rows or not cents.num_rows:
                return kinds.empty_table()
            unit, c = _rows(rows, "unit", np.float32), _rows(cents, "c", np.float32)
            near = (unit @ c.T).argmax(axis=1)
            code = encode(unit, c[near], turn)
            cell = cents.column("child").to_numpy()[near]
            return pa.table([rows.column("num"), rows.column("grp"), pa.array(cell), rows.column("unit"), _bytes(code[0]), *map(pa.array, code[1:])], names)

        return self._meet(nodes.select("num", "grp", "cell", "unit"), sizes, centroids, step, f"num long, grp string, cell long, unit binary, {_CODE}")

    def _visits(self, asked: DataFrame | None) -> DataFrame:
        """One row per query and leaf that it visits: its code there."""
        dim, turn, forced = self.dim, rotation(self.dim), self.probes
        units = self.units if asked is None else self.units.join(asked, ["grp", "lead"], "left_semi")
        schema = f"num long, grp string, cell long, probes int, unit binary, {_ASK}"
        kinds = pa.schema([("num", pa.int64()), ("grp", pa.string()), ("cell", pa.int64()), ("probes", pa.int32()), ("unit", pa.binary()), ("planes", pa.binary()), *((n, pa.float32()) for n in _FLOATS)])

        def table(num, grp, cell, probes, unit: np.ndarray, centroid: np.ndarray) -> list[pa.Array]:
            planes, *floats = encode_query(unit, centroid, turn)
            return [pa.array(num), grp, pa.array(cell), pa.array(probes, pa.int32()), _bytes(unit), _bytes(planes), *[pa.array(x.astype(np.float32)) for x in floats]]

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    unit = _rows(batch, "unit", np.float32)
                    ones = np.ones(len(unit), np.int64)
                    yield pa.RecordBatch.from_arrays(table(batch.column("num"), batch.column("grp"), ones, ones, unit, np.zeros((1, dim), np.float32)), schema=kinds)

        def step(rows: pa.Table, cents: pa.Table) -> pa.Table:
            if not rows.num_rows or not cents.num_rows:
                return kinds.empty_table()
            unit, c = _rows(rows, "unit", np.float32), _rows(cents, "c", np.float32)
            own, fitted = rows.column("probes").to_numpy(), int(cents.column("probes")[0].as_py())
            probes = np.full(len(unit), forced or fitted) if fitted else own
            n = min(int(probes.max()), len(c))
            top = np.argsort(-(unit @ c.T), axis=1, kind="stable")[:, :n]
            who, at = np.nonzero(np.arange(n)[None, :] < probes[:, None])
            child = top[who, at]
            num, cell = rows.column("num").to_numpy()[who], cents.column("child").to_numpy()[child]
            return pa.table(table(num, rows.column("grp").take(pa.array(who)), cell, probes[who], unit[who], c[child]), schema=kinds)

        def last(rows: pa.Table, cents: pa.Table) -> pa.Table:
            return step(rows, cents).drop_columns(["probes", "unit"])

        codes = ["num", "grp", "cell", "planes", *_FLOATS]
        beam = units.select("num", "grp", "unit").mapInArrow(start, schema)
        for depth, (sizes, centroids) in enumerate(self.levels):
            split = sizes.select("grp", "cell")
            inner, stay = _attach(beam, split, "left_semi").select("num", "grp", "cell", "probes", "unit"), _attach(beam, split, "left_anti")
            if not depth and len(self.levels) == 1:  # nothing is below, so the vectors are left behind
                beam = self._meet(inner, sizes, centroids, last, f"num long, grp string, cell long, {_ASK}").unionByName(stay.select(codes))
                break
            beam = self._meet(inner, sizes, centroids, step, schema).unionByName(stay)
            if depth:  # below the root the children of several nodes compete
                best = Window.partitionBy("num").orderBy(F.desc("base"), "cell")
                beam = beam.withColumn("at", F.row_number().over(best)).where(F.col("at") <= F.col("probes")).drop("at")
            beam = self.staging.put(beam)
        return self.staging.put(beam.select(codes))

    def _near(self, asked: DataFrame | None) -> DataFrame:
        """(grp, a, b, s): the neighbours of each representative among the representatives."""
        visits = self._visits(asked)
        count = lambda df, name: df.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        blocks = self.staging.put(count(self.codes, "nd").join(count(visits, "nq"), ["grp", "cell"]))
        place = lambda n: F.pmod(F.xxhash64("num"), F.col(n)).cast("int")
        other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        d = _attach(self.codes, blocks).withColumn("db", place("nd")).withColumn("qb", other("nq")).drop("nd", "nq")
        q = _attach(visits, blocks).withColumn("qb", place("nq")).withColumn("db", other("nd")).drop("nd", "nq")
        dim, k, least, bound = self.dim, self.k, self.least, self.bound
        kinds = pa.schema([("q", pa.int64()), ("d", pa.int64()), ("guess", pa.float32()), ("slack", pa.float32())])

        def search(qs: pa.Table, ds: pa.Table) -> pa.Table:
            if not qs.num_rows or not ds.num_rows:
                return kinds.empty_table()
            ask = {n: qs.column(n).to_numpy() for n in ("num", *_FLOATS)} | {"planes": _rows(qs, "planes", np.uint64)}
            data = {n: ds.column(n).to_numpy() for n in ("num", "length", "f", "g")} | {"bits": _rows(ds, "bits", np.uint64)}
            qi, di, guess, slack = search_block(ask, data, dim, k, least, bound)
            return pa.table([pa.array(ask["num"][qi]), pa.array(data["num"][di]), pa.array(guess.astype(np.float32)), pa.array(slack.astype(np.float32))], schema=kinds)

        on = ["grp", "cell", "db", "qb"]
        found = q.groupBy(*on).cogroup(d.groupBy(*on)).applyInArrow(search, "q long, d long, guess float, slack float")
        if least <= -1:  # over all visited cells, what cannot be among the k best falls out
            low = Window.partitionBy("q").orderBy(F.desc(F.col("guess") - F.col("slack")))
            found = found.withColumn("at", F.row_number().over(low))
            floor = F.min(F.when(F.col("at") <= k, F.col("guess") - F.col("slack"))).over(Window.partitionBy("q"))
            found = found.withColumn("floor", floor).where(F.col("guess") + F.col("slack") >= F.col("floor"))
        side = lambda p, *more: self.units.select(F.col("num").alias(p), F.col("lead").alias(f"{p}_id"), F.col("unit").alias(f"{p}_unit"), *more)
        pairs = self.staging.put(found.select("q", "d")).join(side("q", "grp"), "q").join(side("d"), "d")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    s = np.einsum("ij,ij->i", _rows(batch, "q_unit", np.float32).astype(np.float64), _rows(batch, "d_unit", np.float32).astype(np.float64))
                    yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("q_id"), batch.column("d_id"), pa.array(s)], ["grp", "a", "b", "s"])

        scored = pairs.select("grp", "q_id", "d_id", "q_unit", "d_unit").mapInArrow(exact, "grp string, a string, b string, s double").where(F.col("s") >= least)
        best = Window.partitionBy("grp", "a").orderBy(F.desc("s"), "b")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")

    def pairs(self, asked: DataFrame | None = None) -> DataFrame:
        """(grp, id, other, rank, cosine) for every record, or for those in ``asked`` (grp, id)."""
        k = self.k
        every = self.records.select("grp", "h", "vec", "id")
        if asked is not None:
            every = every.join(asked, ["grp", "id"], "left_semi")
        member = salted_join(every, self.leads, ["grp", "h", "vec"], "inner").select("grp", "lead", "id")
        reps = None if asked is None else member.select("grp", "lead").distinct()
        near = self._near(reps).select("grp", F.col("a").alias("lead"), F.col("b").alias("of"), "s")
        others = near.join(self.members.withColumnsRenamed({"lead": "of", "id": "other"}), ["grp", "of"]).select("grp", "lead", "other", "s")
        own = self.members.select("grp", "lead", F.col("id").alias("other"), F.lit(1.0).alias("s"))
        front = Window.partitionBy("grp", "lead").orderBy(F.desc("s"), "other")
        lists = others.unionByName(own).withColumn("r", F.row_number().over(front)).where(F.col("r") <= k + 1)
        # one small list per class, carried to its members as an array of at most k + 1
        lists = lists.groupBy("grp", "lead").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("neg"), "other"))).alias("list"))
        out = salted_join(member, lists, ["grp", "lead"], "inner")
        mine = F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)
        out = out.select("grp", "id", F.posexplode(mine).alias("pos", "n"))
        return out.select("grp", "id", F.col("n.other").alias("other"), (F.col("pos") + 1).alias("rank"), (-F.col("n.neg")).alias("cosine"))
