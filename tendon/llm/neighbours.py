"""Nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .common import counted, saved

TABLES = 8
#: Width of a cell, where the projections of unit vectors have deviation 1.
WIDTH = 2.0
#: Buckets that a query visits in a table, at most.
PROBES = 1024
#: Queries on which the number of probes is fitted, against exact answers over all rows.
SAMPLE = 200
#: Share of the sample's true neighbours that must lie in visited buckets.
RECALL = 0.96
#: A query whose expected recall, from the distances of what it found, is below this is answered exactly over all rows.
FLOOR = 0.9
#: Queries that meet one group of vectors in an exact answer.
BLOCK = 5_000
#: Vectors of one table that meet in one group.
GROUP = 50_000
_CELL = 6  # bits of a cell number in a bucket's code


def probe_sets(k: int, most: int) -> np.ndarray:
    """Sets of perturbations in estimated success order, as rows of a 0/1 matrix [sets, 2k].

    Column j is the perturbation with the j-th smallest distance between a query and a cell's side, of the 2k sides. The expected square of
    that distance is known, so the order is one for all queries. A set may not move one coordinate both ways: column j and column 2k-1-j are
    sides of one coordinate.
    """
    j = np.arange(1, k + 1)
    cost = np.r_[j * (j + 1) / (4 * (k + 1) * (k + 2)), [1 - (2 * k + 1 - i) / (k + 1) + (2 * k + 1 - i) * (2 * k + 2 - i) / (4 * (k + 1) * (k + 2)) for i in range(k + 1, 2 * k + 1)]]
    rows, heap = [()], [(cost[0], (0,))]
    while heap and len(rows) < most:
        c, s = heapq.heappop(heap)
        if not any(2 * k - 1 - i in s for i in s):
            rows.append(s)
        last = s[-1] + 1
        if last < 2 * k:
            heapq.heappush(heap, (c - cost[s[-1]] + cost[last], (*s[:-1], last)))
            heapq.heappush(heap, (c + cost[last], (*s, last)))
    out = np.zeros((len(rows), 2 * k), np.int64)
    for i, s in enumerate(rows):
        out[i, list(s)] = 1
    return out


@dataclass
class Hashes:
    """k projections in each table. A vector is scaled by the largest norm and gets one more coordinate that makes its
    length 1; a query is scaled to length 1. Then the nearest by distance are those with the largest inner product."""

    k: int
    scale: float
    lines: np.ndarray  # [TABLES, dim + 1, k]
    shift: np.ndarray  # [TABLES, k]

    @classmethod
    def draw(cls, dim: int, k: int, scale: float, seed: int = 5) -> Hashes:
        """Gaussian directions, made orthogonal block by block so that tables repeat one another less."""
        rng = np.random.default_rng(seed)
        need, blocks = TABLES * k, []
        while sum(b.shape[1] for b in blocks) < need:
            blocks.append(np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0] * math.sqrt(dim))
        lines = np.concatenate(blocks, 1)[:, :need].reshape(dim + 1, TABLES, k).transpose(1, 0, 2)
        return cls(k, scale, np.ascontiguousarray(lines), rng.uniform(0, WIDTH, (TABLES, k)))

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x / np.sqrt((x * x).sum(1))[:, None], np.zeros(len(x))]

    def _place(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.lines[t] + self.shift[t]) / WIDTH

    def _code(self, cells: np.ndarray) -> np.ndarray:
        half = 1 << _CELL - 1
        return (np.clip(cells + half, 1, 2 * half - 2) << _CELL * np.arange(self.k)).sum(1)

    def codes(self, x: np.ndarray, t: int) -> np.ndarray:
        """Bucket of each prepared vector in table t."""
        return self._code(np.floor(self._place(x, t)).astype(np.int64))

    def visits(self, x: np.ndarray, t: int, sets: np.ndarray) -> np.ndarray:
        """Buckets that each prepared query visits, in order [queries, sets]."""
        z = self._place(x, t)
        cell = np.floor(z)
        away = z - cell
        side = np.argsort(np.c_[away, 1 - away], axis=1, kind="stable")  # sides by distance: first k downward, then k upward
        step = np.where(side < self.k, -1, 1).astype(np.int64) << _CELL * (side % self.k)
        return self._code(cell.astype(np.int64))[:, None] + step @ sets.T


    def chances(self, q: np.ndarray, cosines: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """For a prepared query, the chance over random lines that a point at each of `cosines` lies in a bucket it visits."""
        cosines = np.clip(cosines, -1, 1)[:, None]
        wide = np.maximum(np.sqrt(1 - cosines * cosines), 1e-9)
        missed = np.ones(len(cosines))
        for t in range(TABLES):
            own = q @ self.lines[t]
            low = np.floor((own + self.shift[t]) / WIDTH) * WIDTH - self.shift[t]
            edges = [_below((low + i * WIDTH - cosines * own) / wide) for i in (-1, 0, 1, 2)]
            down, here, up = (np.log(np.maximum(b - a, 1e-300)) for a, b in zip(edges, edges[1:], strict=False))
            away = (own - low) / WIDTH
            side = np.argsort(np.r_[away, 1 - away], kind="stable")
            gain = np.concatenate([down - here, up - here], 1)[:, side]
            missed *= 1 - np.minimum(1, np.exp(here.sum(1)[:, None] + gain @ sets.T).sum(1))
        return 1 - missed


def _below(z: np.ndarray) -> np.ndarray:
    """Normal distribution function."""
    return 0.5 + 0.5 * np.frompyfunc(math.erf, 1, 1)(z / math.sqrt(2)).astype(np.float64)


def _matrix(column) -> np.ndarray:
    return np.array(list(column), np.float64).reshape(len(column), -1)


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest scores, ties to smaller ids."""
    at = np.arange(len(ids))
    if len(ids) > most:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[-most])
    return at[np.lexsort((ids[at], -scores[at]))][:most]


def distinct_vectors(rows: DataFrame, id_col: str, vec_col: str, most: int) -> DataFrame:
    """(rep, ids, v): each vector once, with its `most` smallest ids; a hot vector is cut down in 64 parts first."""
    first = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["v", "__part"], ["v"]):
        first = first.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("__n") <= most)
    return first.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector of the table's usual length that is not zero and has finite components only."""
    v = F.col(vec_col)
    fine = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    usual = fine.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size(v) == (usual[0] if usual else 0))


def exact_for(queries: pd.DataFrame, points: DataFrame, most: int) -> pd.DataFrame:
    """(query, id, score, v): exact answers for a bounded block of queries, over all of `points` (rep, v)."""
    q = _matrix(queries["v"])
    names = queries["rep"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, s = f["rep"].to_numpy(), q @ _matrix(f["v"]).T
            kept = [(names[i], b) for i in range(len(q)) for b in _best(ids, s[i], most)]
            at = [b for _, b in kept]
            yield pd.DataFrame({"query": [n for n, _ in kept], "id": ids[at], "score": s[np.repeat(np.arange(len(q)), min(most, len(ids))), at], "v": f["v"].to_numpy()[at]})

    found = points.select("rep", "v").mapInPandas(run, "query long, id long, score double, v array<float>")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("n", rank).where(F.col("n") <= most).drop("n").toPandas()


def fit(points: DataFrame, asked: DataFrame, rows: int, most: int, recall: float = RECALL) -> tuple[Hashes, np.ndarray] | None:
    """Hash functions and probing sets for the table: the finest cells at which the sample's true neighbours are reached with PROBES probes.

    The sample is SAMPLE of the queries (`asked`), by a hash of their ids; its true neighbours come from all rows.
    """
    sample = asked.orderBy(F.xxhash64(F.lit(3), "rep"), "rep").limit(SAMPLE).toPandas()
    if not len(sample):
        return None
    scale = math.sqrt(points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0])
    truth = exact_for(sample, points, most)
    where = {r: i for i, r in enumerate(sample["rep"])}
    owner = truth["query"].map(where).to_numpy()
    q, x = _matrix(sample["v"]), _matrix(truth["v"])
    for k in range(min(10, max(2, round(math.log2(max(2, rows / 8)) / 1.7))), 0, -1):
        h, sets = Hashes.draw(q.shape[1], k, scale), probe_sets(k, PROBES)
        need = np.full(len(x), len(sets))
        for t in range(TABLES):
            hit = h.visits(h.queries(q), t, sets)[owner] == h.codes(h.points(x), t)[:, None]
            need = np.minimum(need, np.where(hit.any(1), hit.argmax(1), len(sets)))
        probes = int(np.sort(need)[math.ceil(recall * len(need)) - 1]) + 1
        if probes <= len(sets):
            return h, sets[:probes]
    return h, sets


def nearest(rows: DataFrame, asked: DataFrame, count: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `asked` (a part of `rows`) its `count` nearest rows found, itself left out.

    Nearness is the inner product in double precision; ties go to the smaller id; with fewer candidates all found are given.
    Rows without id, and vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part. An empty table gives no
    rows; rows that repeat an id with one vector are one candidate. Other columns are not looked at.

    Equal vectors are one entry of the index and one query, with their count + 1 smallest ids, which is all that an answer can
    hold. Each vector stands in one bucket of each table; a query visits buckets in estimated success order and
    scores what it finds exactly; answers are merged over tables. A query that finds too little, or whose expected recall is under FLOOR,
    is scored against all vectors instead. Buckets of a table are dealt to groups of about GROUP vectors,
    and a group that holds more is cut by id, so no group grows with the table.
    """
    most = count + 1
    fine = usable(rows.select(id_col, vec_col), id_col, vec_col)
    points = saved(distinct_vectors(fine, id_col, vec_col, most), "vectors")
    named = usable(asked.select(id_col, vec_col), id_col, vec_col).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("v")).distinct()
    named = saved(named.join(points.select("v", "rep"), "v").select("query_id", "rep"), "queries")
    wanted = saved(points.join(named.select("rep").distinct(), "rep", "left_semi").select("rep", "v"), "wanted")
    total = points.count()
    fitted = fit(points, wanted, total, most)
    if fitted is None:
        return named.selectExpr("query_id", "CAST(0 AS INT) AS rank", "rep AS vec_id", "CAST(0 AS DOUBLE) AS score")
    h, sets = fitted
    groups = max(1, -(-total // GROUP))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = h.points(_matrix(f["v"]))
            for t in range(TABLES):
                code = h.codes(x, t)
                yield pd.DataFrame({"t": t, "g": code % 1_000_003 % groups, "code": code, "id": f["rep"], "v": f["v"]})

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = h.queries(_matrix(f["v"]))
            for t in range(TABLES):
                codes = h.visits(x, t, sets)
                g = codes % 1_000_003 % groups
                for i in range(len(x)):
                    own = [codes[i][g[i] == n] for n in np.unique(g[i])]
                    yield pd.DataFrame({"t": t, "g": np.unique(g[i]), "codes": own, "id": f["rep"].iloc[i], "v": [f["v"].iloc[i]] * len(own)})

    kind = "t int, g long, {}, id long, v array<float>"
    stored = points.select("rep", "v").mapInPandas(place, kind.format("code long"))
    parts = counted(stored.groupBy("t", "g").count().select("t", "g", F.ceil(F.col("count") / GROUP).alias("parts")))
    stored = stored.join(parts, ["t", "g"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    going = wanted.mapInPandas(visit, kind.format("codes array<long>")).join(parts, ["t", "g"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = ["t", "g", "part"]
    hits = (stored.select(*keys, "code", "id", "v").groupBy(*keys).cogroup(going.select(*keys, "codes", "id", "v").groupBy(*keys))
            .applyInPandas(lambda p, q: _search(p, q, most), "query long, id long, score double"))
    merged = cut(_top(hits.groupBy("query", "id").agg(F.max("score").alias("score")), "query", "id", most))
    doubtful = cut(in_doubt(wanted, merged, h, sets, min(most, total)))
    if not doubtful.isEmpty():
        merged = cut(merged.join(doubtful, F.col("query") == F.col("rep"), "left_anti").unionByName(exact(points, wanted.join(doubtful, "rep", "left_semi"), doubtful.count(), total, most)))
    spelled = _top(merged.join(points.select("rep", "ids"), F.col("id") == F.col("rep")).select("query", "score", F.explode("ids").alias("vec_id")), "query", "vec_id", most)
    answers = spelled.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, count)
    return (named.join(answers, F.col("rep") == F.col("query")).select("query_id", F.posexplode(others).alias("n", "x"))
            .select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")))


def in_doubt(wanted: DataFrame, merged: DataFrame, h: Hashes, sets: np.ndarray, least: int) -> DataFrame:
    """(rep) of the queries that found fewer than `least` vectors, or whose expected recall is under FLOOR.

    Each hit that had the chance p to be found stands for 1/p vectors like it.
    """
    found = merged.groupBy("query").agg(F.collect_list(F.when(F.col("id") != F.col("query"), F.col("score"))).alias("scores"), F.count(F.lit(1)).alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = _matrix(f["v"])
            x, norm = h.queries(v), np.sqrt((v * v).sum(1))
            out = []
            for i, (rep, scores, n) in enumerate(zip(f["rep"], f["scores"], f["n"], strict=True)):
                if not n >= least:
                    out.append(rep)
                elif len(scores):
                    p = h.chances(x[i], np.asarray(scores, np.float64) / (h.scale * norm[i]), sets)
                    if len(p) < FLOOR * (1 / np.maximum(p, 1e-12)).sum():
                        out.append(rep)
            yield pd.DataFrame({"rep": np.array(out, np.int64)})

    return wanted.join(found, F.col("rep") == F.col("query"), "left").select("rep", "v", "scores", "n").mapInPandas(run, "rep long")


def exact(points: DataFrame, queries: DataFrame, asked: int, total: int, most: int) -> DataFrame:
    """(query, id, score): the best `most` of all `points` for each of `queries` (rep, v), in blocks of bounded size on both sides."""
    rows, columns = -(-total // GROUP), -(-asked // BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = points.select(F.pmod(F.xxhash64("rep"), F.lit(rows)).cast("int").alias("g"), "rep", "v").withColumn("b", every(columns))
    going = queries.select(F.pmod(F.xxhash64("rep"), F.lit(columns)).cast("int").alias("b"), "rep", "v").withColumn("g", every(rows))
    hits = stored.groupBy("g", "b").cogroup(going.groupBy("g", "b")).applyInPandas(lambda p, q: _score_all(p, q, most), "query long, id long, score double")
    return _top(hits, "query", "id", most)


def _score_all(points: pd.DataFrame, queries: pd.DataFrame, most: int) -> pd.DataFrame:
    out = [pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64"})]
    if len(points) and len(queries):
        ids, x, q = points["rep"].to_numpy(), _matrix(points["v"]), _matrix(queries["v"])
        for at in range(0, len(q), 64):
            for name, score in zip(queries["rep"][at:at + 64], q[at:at + 64] @ x.T, strict=True):
                best = _best(ids, score, most)
                out.append(pd.DataFrame({"query": name, "id": ids[best], "score": score[best]}))
    return pd.concat(out[1:] or out)


def _top(df: DataFrame, query: str, id_: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), id_))
    return df.withColumn("__n", rank).where(F.col("__n") <= most).drop("__n")


def _search(points: pd.DataFrame, queries: pd.DataFrame, most: int) -> pd.DataFrame:
    """Best `most` of the vectors that each query finds in its buckets of one group."""
    if not len(points) or not len(queries):
        return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64"})
    order = np.argsort(points["code"].to_numpy(), kind="stable")
    codes, ids = points["code"].to_numpy()[order], points["id"].to_numpy()[order]
    x = _matrix(points["v"])[order]
    q, out = _matrix(queries["v"]), []
    for i, (name, wanted) in enumerate(zip(queries["id"], queries["codes"], strict=True)):
        lo, hi = np.searchsorted(codes, wanted), np.searchsorted(codes, wanted, side="right")
        some = hi > lo
        if not some.any():
            continue
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo[some], hi[some], strict=True)])
        score = x[at] @ q[i]
        best = _best(ids[at], score, most)
        out.append(pd.DataFrame({"query": name, "id": ids[at][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64"})
