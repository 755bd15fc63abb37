"""Vector search, components of similar pairs, and contraction of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.session import cut

#: Numbers in the query vectors that are sent to the tasks at a time.
BLOCK = 1 << 20
#: Queries and vectors that a task compares at once, and vectors that it looks through only if the best of them counts.
QUERIES, VECTORS, STRIP = 512, 4096, 128
#: Pairs whose components a single task finds.
IN_A_TASK = 200_000


def _best(row: np.ndarray, sim: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row, ties to the smaller key: row, sim, key, place from 0."""
    order = np.lexsort((own, -sim, row))
    row, sim, own = row[order], sim[order], own[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return tuple(x[place < k] for x in (row, sim, own, place))


class _Search:
    """The k best of a task's vectors for each row of ``q`` (unit vectors), by cosine rounded to 4, of ``floor`` at least.

    Short floats only tell which pairs may be among the best; these are computed
    again in full.  ``low`` is what a vector needs to be among them so far.
    """

    def __init__(self, q: np.ndarray, k: int, floor: float):
        self.q, self.short, self.k = q, q.astype("float32"), k
        self.low, self.slack = np.full(len(q), floor), 5.1e-5 + 1e-7 * q.shape[1]
        self.held: dict[int, list[tuple]] = {}

    def add(self, own: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(x), VECTORS):
            keys, part = own[at : at + VECTORS], x[at : at + VECTORS]
            short = np.zeros((len(part) + -len(part) % STRIP, part.shape[1]), dtype="float32")
            short[: len(part)] = part
            for first in range(0, len(self.q), QUERIES):
                self._compare(first, keys, part, short.T)

    def _compare(self, first: int, keys: np.ndarray, part: np.ndarray, short: np.ndarray) -> None:
        raw = self.short[first : first + QUERIES] @ short
        raw[:, len(part) :] = -np.inf
        strips = raw.reshape(len(raw), -1, STRIP)
        bar = (self.low[first : first + QUERIES] - self.slack).astype("float32")
        row, strip = np.nonzero(strips.max(axis=2) >= bar[:, None])
        most = 4 * self.k * len(raw)
        if len(part) > self.k and (len(row) > most or np.count_nonzero(strips[row, strip] >= bar[row, None]) > most):
            bar = np.maximum(bar, np.partition(raw, -self.k, axis=1)[:, -self.k] - np.float32(2 * self.slack))
            row, strip = np.nonzero(strips.max(axis=2) >= bar[:, None])
        at, place = np.nonzero(strips[row, strip] >= bar[row, None])
        rows, cols = row[at], strip[at] * STRIP + place
        rows, cols = rows[cols < len(part)], cols[cols < len(part)]
        for at in range(0, len(rows), 1 << 16):
            row, col = rows[at : at + (1 << 16)] + first, cols[at : at + (1 << 16)]
            sim = np.round(np.einsum("ij,ij->i", self.q[row], part[col]), 4)
            good = sim >= self.low[row]
            held = self.held.setdefault(first, [])
            held.append((row[good], sim[good], keys[col[good]]))
            if sum(len(x[0]) for x in held) > 2 * self.k * len(raw):
                self._shrink(first)

    def _shrink(self, first: int) -> None:
        row, sim, own, place = _best(*map(np.concatenate, zip(*self.held[first], strict=True)), self.k)
        full = place == self.k - 1
        self.low[row[full]] = np.maximum(self.low[row[full]], sim[full])
        self.held[first] = [(row, sim, own)]

    def found(self) -> Iterator[tuple[np.ndarray, ...]]:
        for first in self.held:
            self._shrink(first)
            yield self.held[first][0]


def _units(values: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which of the values have one."""
    m = np.stack(values).astype("float64")
    norm = np.linalg.norm(m, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return m[good] / norm[good, None], good


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", floor: float | None = None) -> DataFrame:
    """The k nearest of ``vectors`` to each of a stated set of queries, by cosine: query_id, key, sim (rounded to 4), rank.

    Queries go out in blocks of bounded size; each task keeps its own k best, so
    what is shuffled is k rows per query and task.  Ties go to the smaller key.
    Null and zero vectors match nothing.  With a ``floor``, nearest ones of a
    smaller sim are left out.
    """
    rows = ((r[key], r[vec]) for r in queries.where(F.col(vec).isNotNull()).select(key, vec).toLocalIterator())
    spark, out, head = vectors.sparkSession, None, next(rows, None)
    blocks = batched(chain([head], rows), max(1, BLOCK // max(1, len(head[1])))) if head else ()
    for part in chain(blocks, [()]):
        if not part and out is not None:
            break
        q, good = _units([v for _, v in part]) if part else (np.zeros((0, 1)), np.zeros(0, dtype=bool))
        block = spark.sparkContext.broadcast((np.array([i for i, _ in part], dtype="int64")[good], q))

        def search(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            qid, q = block.value
            best = _Search(q, k, -np.inf if floor is None else floor)
            for b in batches:
                b = b[b[vec].notna()]
                if len(b) and len(qid):
                    x, good = _units(b[vec].to_list())
                    best.add(b[key].to_numpy()[good], x)
            for row, sim, own in best.found():
                yield pd.DataFrame({"query_id": qid[row], key: own, "sim": sim})

        found = vectors.select(key, vec).mapInPandas(search, f"query_id bigint, {key} bigint, sim double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_pairs(queries: DataFrame, vectors: DataFrame, k: int = 10, threshold: float = 0.75, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Unordered pairs among each query's k nearest (itself counts) at the threshold or above: i, j, sim."""
    near = nearest(queries, vectors, k, key, vec, threshold).where(F.col("query_id") != F.col(key))
    return near.groupBy(F.least("query_id", key).alias("i"), F.greatest("query_id", key).alias("j")).agg(F.max("sim").alias("sim"))


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a few pairs, all in one task: the least member of each is its root."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch["x"].tolist(), batch["y"].tolist(), strict=True):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    ids = list(root)
    if ids:
        yield pd.DataFrame({"id": ids, "root": [find(x) for x in ids]})


def components(pairs: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """The least member of each member's connected component: id, root.

    Up to ``IN_A_TASK`` pairs go through one task.  For more, each round takes the
    least label among neighbours, then the label's own label, so that chains
    halve; labels are tables in the shared folder.  Results are the same.
    """
    few = cut(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null").distinct())
    kind = dict(few.dtypes)["x"]
    if few.count() <= IN_A_TASK:
        return few.coalesce(1).mapInPandas(_united, f"id {kind}, root {kind}")
    pairs = few.toDF(a, b)
    links = cut(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    state = cut(links.groupBy(F.col("x").alias("id")).agg(F.least(F.col("x"), F.min("y")).alias("root")))
    while True:
        near = links.join(state.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("root").alias("least"))
        new = state.join(near, "id").select("id", F.least("root", "least").alias("root"), F.col("root").alias("old"))
        hop = new.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = cut(new.join(hop, "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            return new.select("id", "root")
        state = new.select("id", "root")


def with_singletons(labels: DataFrame, members: DataFrame) -> DataFrame:
    """Labels of ``components`` for all ``members`` (one column); a member without a pair is its own root."""
    m = members.toDF("id").where("id is not null").distinct()
    return m.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def contract(edges: DataFrame, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Edges with merged nodes in place of their members, once each; links within a merged node go."""
    m = mapping.select(F.col("id").alias("_id"), F.col("root").alias("_to"))
    e = edges.join(m.withColumnRenamed("_id", source), source, "left").withColumn(source, F.coalesce("_to", source)).drop("_to")
    e = e.join(m.withColumnRenamed("_id", target), target, "left").withColumn(target, F.coalesce("_to", target)).drop("_to")
    return e.where(F.col(source) != F.col(target)).distinct()
