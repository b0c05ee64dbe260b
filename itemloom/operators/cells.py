"""Exact nearest vectors from a stored index of cells: a cell is read for a query only while its angle bound can beat the k-th score.

Vectors lie in the cell of the centre that is nearest by angle; a cell knows its widest angle. A vector of the cell is at least as far from a
query as the query is from the centre, less that angle, so its cosine is bounded. Centres come from a bounded sample; every vector is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators.search import FLOOR, rank_hits
from itemloom.sources.workspace import kept

#: Vectors that centres are fitted on, and the most centres there are; both bound what the driver and each task hold.
SAMPLE, MOST_CELLS = 8192, 1024
#: Members and queries that one task meets at a time; cells of more are split.
PART, QUERIES = 8192, 4096
#: Queries whose bounds to all cells a task holds at a time.
ASKING = 32
#: Scores have six digits, so bounds give way by one of these.
SLACK = 1e-6


@dataclass
class Store:
    """members(cell, part, question_id, vector), in folders by cell; cells(cell, centre, angle, n, parts, shelf): as many rows as there are centres.

    Small cells share a shelf of PART members or little more, which one task meets; a larger cell is alone on its own, in parts.
    """

    members: DataFrame
    cells: DataFrame


def usable(vectors: DataFrame, id_column: str, dimension: int) -> DataFrame:
    """Rows whose vector has that dimension, no null or non-finite component, and isn't zero: others are near nothing."""
    v = vectors.select(id_column, F.col("vector").cast("array<double>").alias("vector")).filter(F.size("vector") == dimension)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.filter(F.coalesce(fine, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_centres(sample: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """n unit centres of the sample's directions; a centre that loses all its rows stays where it was."""
    u = _unit(sample)
    centres = u[np.linspace(0, len(u) - 1, n).astype(int)]
    for _ in range(steps):
        near = (u @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, u)
        found = np.linalg.norm(sums, axis=1) > 1e-9
        centres = np.where(found[:, None], _unit(sums), centres)
    return centres


def write(vectors: DataFrame, path: str, dimension: int, n_cells: int | None = None, part: int = PART) -> Store:
    """Stores vectors(question_id, vector) of the dimension under path; n_cells is the root of their number if it isn't given."""
    spark = vectors.sparkSession
    good = usable(vectors, "question_id", dimension)
    sample = good.orderBy(F.xxhash64("question_id"), "question_id").select("vector").limit(SAMPLE).collect()
    n = min(n_cells or max(1, int(good.count() ** 0.5)), MOST_CELLS, max(1, len(sample)))
    centres = fit_centres(np.array([r[0] for r in sample], np.float64).reshape(len(sample), dimension), n) if sample else np.zeros((0, dimension))
    held = spark.sparkContext.broadcast(centres)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                cosine = _unit(np.stack(f["vector"].to_numpy()).astype(np.float64)) @ held.value.T
                near = cosine.argmax(axis=1)
                yield f.assign(cell=near.astype(np.int32), angle=np.arccos(np.clip(cosine[np.arange(len(f)), near], -1, 1)))

    kind = dict(vectors.dtypes)["question_id"]
    placed = kept(good.mapInPandas(place, f"question_id {kind}, vector array<double>, cell int, angle double"), "cells-placed")
    sizes = placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n"))
    rows, filled = [], 0
    for r in sizes.orderBy("cell").collect():  # MOST_CELLS at most
        parts = -(-r.n // part)
        rows.append((r.cell, centres[r.cell].tolist(), r.angle, r.n, parts, filled // part if parts == 1 else -1 - r.cell))
        filled += r.n if parts == 1 else 0
    spark.createDataFrame(rows, "cell int, centre array<double>, angle double, n long, parts int, shelf int").coalesce(1).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    dealt = placed.join(cells.select("cell", "parts"), "cell").select("question_id", "vector", F.pmod(F.xxhash64("question_id"), F.col("parts")).cast("int").alias("part"), "cell")
    dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/members")
    return read(spark, path, kind)


def read(spark: SparkSession, path: str, kind: str = "bigint") -> Store:
    members = spark.read.schema(f"question_id {kind}, vector array<double>, part int, cell int").parquet(f"{path}/members")
    return Store(members, spark.read.parquet(f"{path}/cells"))


def bounds(queries: DataFrame, store: Store, k: int, floor: float = FLOOR) -> DataFrame:
    """(query_id, vector, cell, bound, first): cells that may hold a cosine of `floor`; the first are those with the best bounds that hold k vectors together."""
    rows = store.cells.orderBy("cell").collect()  # MOST_CELLS at most
    dim = len(rows[0].centre) if rows else 0
    cells, angle, size = (np.array([r[c] for r in rows]) for c in ("cell", "angle", "n"))
    held = queries.sparkSession.sparkContext.broadcast(np.array([r.centre for r in rows], np.float64).reshape(len(rows), dim))

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a query has a row for each cell at most, so some queries at a time
        for f in (batch.iloc[at : at + ASKING] for batch in frames for at in range(0, len(batch), ASKING)):
            if not len(cells):
                continue
            cosine = np.clip(_unit(np.stack(f["vector"].to_numpy()).astype(np.float64)) @ held.value.T, -1, 1)
            most = np.cos(np.maximum(np.arccos(cosine) - angle - 1e-7, 0))
            order = np.argsort(-most, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.empty(most.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            i, j = np.nonzero(most >= floor - SLACK)
            yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[i], "vector": f["vector"].to_numpy()[i], "cell": cells[j].astype(np.int32), "bound": most[i, j], "first": first[i, j]})

    kind = dict(queries.dtypes)["query_id"]
    return usable(queries, "query_id", dim).mapInPandas(bound, f"query_id {kind}, vector array<double>, cell int, bound double, first boolean")


def _visit(asks: DataFrame, store: Store, blocks: int, k: int, floor: float) -> DataFrame:
    """(query_id, question_id, score): of each part of a shelf, the k best that reach `least` for each query of asks(query_id, vector, cell, least), from the cells it visits."""
    shelves = store.cells.select("cell", "parts", "shelf")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    wanted = asks.join(shelves, "cell").select("query_id", "vector", "cell", "least", "parts", "shelf", block)
    # a query's vector goes to a shelf once, with the cells that it visits there
    q = wanted.groupBy("query_id", "shelf", "block", "parts").agg(F.first("vector").alias("vector"), F.first("least").alias("least"), F.collect_list("cell").alias("cells"))
    q = q.select("query_id", "vector", "least", "cells", "shelf", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    m = store.members.join(wanted.select("cell", "shelf", "block").distinct(), "cell").select("question_id", "vector", "cell", *(F.col(c).alias(c) for c in ("shelf", "block", "part")))  # columns of its own, not q's
    kinds = dict(asks.dtypes)["query_id"], dict(store.members.dtypes)["question_id"]

    def best(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": asked["query_id"][:0], "question_id": members["question_id"][:0], "score": np.zeros(0)})
        if not len(asked) or not len(members):
            return none
        members = members.sort_values("question_id", kind="stable")
        ids, u, out = members["question_id"].to_numpy(), _unit(np.stack(members["vector"].to_numpy())), [none]
        there, of_cell = np.unique(members["cell"].to_numpy(), return_inverse=True)
        for at in range(0, len(asked), 256):
            some = asked.iloc[at : at + 256]
            visits = np.array([np.isin(there, c) for c in some["cells"]])
            score = np.where(visits[:, of_cell], (_unit(np.stack(some["vector"].to_numpy())) @ u.T).round(6), -2.0)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # equal scores stay in order of id
            value = np.take_along_axis(score, top, axis=1)
            i, j = np.nonzero(value >= np.maximum(some["least"].fillna(floor).to_numpy(), floor)[:, None])
            out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[i], "question_id": ids[top[i, j]], "score": value[i, j]}))
        return pd.concat(out)

    keys = ("shelf", "part", "block")
    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInPandas(best, f"query_id {kinds[0]}, question_id {kinds[1]}, score double")


def vector_topk(queries: DataFrame, store: Store, k: int = 10, floor: float = FLOOR, block: int = QUERIES) -> DataFrame:
    """(query_id, question_id, score, rank): the rows of search.vector_topk from the cells that can hold them; `floor` has to be positive.

    queries(query_id, vector) stay distributed. Each first reads its best cells until they hold k vectors; the k-th score it has then
    rules out cells of lower bounds, and the others are read. Null, zero and non-finite vectors, and those of another dimension, have no hits.
    """
    if floor <= 0:
        raise ValueError("floor has to be positive")
    asks, first, rest = plan(queries, store, k, floor, block)
    blocks = _blocks(queries, block)
    return rank_hits(first.unionByName(_visit(rest, store, blocks, k, floor)), ["query_id"], k)


def _blocks(queries: DataFrame, block: int) -> int:
    return max(1, -(-queries.count() // block))


def plan(queries: DataFrame, store: Store, k: int, floor: float, block: int = QUERIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All bounds, the first cells' hits, and the bounds of cells that still have to be read."""
    asks = kept(bounds(queries, store, k, floor), "cells-asked")
    first = kept(_visit(asks.filter("first").withColumn("least", F.lit(None).cast("double")), store, _blocks(queries, block), k, floor), "cells-first")
    least = rank_hits(first, ["query_id"], k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = asks.filter("not first").join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    return asks, first, rest.select("query_id", "vector", "cell", "bound", "least")


def share_read(queries: DataFrame, store: Store, k: int = 10, floor: float = FLOOR) -> DataFrame:
    """One row (pairs, visited): how many pairs of a query and a vector there are, and how many are met in the cells that are read."""
    asks, _, rest = plan(queries, store, k, floor)
    size = store.cells.select("cell", "n")
    met = asks.filter("first").select("cell").unionByName(rest.select("cell")).join(size, "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visited"))
    return size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(F.broadcast(met)).select((F.col("n") * queries.count()).alias("pairs"), "visited")
