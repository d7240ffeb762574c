"""Near-duplicate vectors by product quantisation: inverted lists, table lookups, exact cosine.

A coarse quantiser deals the vectors into lists; the residual of each vector is coded in
subspaces. Every vector looks into its nearest lists. There, the distance of a query to a
coded vector is summed from a table per subspace; whatever may be within the limit, given
the coded vector's known coding error, is checked by its exact cosine in double precision.
So a link can only be missed if neither vector's probes reach the other's list.

Vectors are compared only when their labels are equal. Equal vectors of one label are one
node with a multiplicity. Lists longer than a block are split: each block of stored vectors
meets each block of queries, and a task returns counts and a spanning forest, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and vectors without label, link with nothing. Vectors of another length than most are
compared with those of their own length in one list without codes. A row without id takes
part; its component's id is the smallest id in it. Repeated rows link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import components
from wardline.plans.stages import Stages

SAMPLE_ROWS = 12_000
LIST_ROWS = 150
MOST_LISTS = 2048
PROBES = 8
PARTS = 8
CODES = 64
STORED_BLOCK = 512
QUERY_BLOCK = 2048
LIMIT = 0.93
NO_CODES = -1


class Index(NamedTuple):
    length: int
    lists: np.ndarray  # coarse centres
    codes: np.ndarray  # parts x codes x part length


def _nearest(x: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """Numbers of the nearest centres, nearest first."""
    distance = (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    if count == 1:
        return distance.argmin(axis=1)[:, None]
    near = np.argpartition(distance, count - 1, axis=1)[:, :count]
    return np.take_along_axis(near, np.take_along_axis(distance, near, axis=1).argsort(axis=1, kind="stable"), axis=1)


def k_means(x: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES) -> Index:
    """Coarse centres and, on the residuals, a code book per subspace."""
    centres = k_means(sample, lists)
    rest = sample - centres[_nearest(sample, centres)[:, 0]]
    while sample.shape[1] % parts:
        parts -= 1
    books = [k_means(piece, codes) for piece in np.split(rest, parts, axis=1)]
    size = max(map(len, books))
    books = [np.vstack([b, np.repeat(b[:1], size - len(b), axis=0)]) for b in books]
    return Index(sample.shape[1], centres, np.stack(books))


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest lists, codes of the residual in the first of them, and the coding error."""
    probes = _nearest(x, index.lists, min(PROBES, len(index.lists)))
    rest = x - index.lists[probes[:, 0]]
    pieces = np.split(rest, len(index.codes), axis=1)
    codes = np.stack([_nearest(p, book)[:, 0] for p, book in zip(pieces, index.codes)], axis=1)
    decoded = np.hstack([book[codes[:, i]] for i, book in enumerate(index.codes)])
    return probes, codes, np.linalg.norm(rest - decoded, axis=1)


def table_distances(index: Index, cell: int, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of queries to coded vectors of a list, from a table per subspace."""
    rest = queries - index.lists[cell]
    total = np.zeros((len(queries), len(codes)))
    for i, piece in enumerate(np.split(rest, len(index.codes), axis=1)):
        book = index.codes[i]
        table = (piece**2).sum(axis=1)[:, None] - 2 * piece @ book.T + (book**2).sum(axis=1)[None, :]
        total += table[:, codes[:, i]]
    return np.sqrt(np.maximum(total, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _valid(vector: Column) -> Column:
    def bad(x: Column) -> Column:
        value = x.cast("double")
        return x.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))

    nonzero = F.exists(vector, lambda x: x != 0)
    return F.when(vector.isNull(), False).otherwise(F.when(F.exists(vector, bad), False).otherwise(nonzero))


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Root of each item when the pairs (a, b) are joined."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(index: Index | None, cell: int, q: dict, s: dict, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, stored) of a block of either that are linked, each pair of vectors once.

    ``q`` and ``s`` hold vectors ``x``, node names ``node``, ``home`` lists and ``probes``;
    ``s`` also codes and coding errors.
    """
    if index is None or cell == NO_CODES:
        near = np.ones((len(q["x"]), len(s["x"])), dtype=bool)
    else:
        most = np.sqrt(max(0.0, 2 - 2 * limit)) + s["error"][None, :] + 1e-6
        near = table_distances(index, cell, _unit(q["x"]), s["codes"]) <= most
    a, b = np.nonzero(near)
    # one direction only: within a list by name; between lists, the lower list's when both probe each other
    away = q["home"][a] != cell
    back = (s["probes"][b] == q["home"][a][:, None]).any(axis=1)
    once = np.where(away, ~back | (q["home"][a] < cell), q["node"][a] < s["node"][b])
    a, b = a[once], b[once]
    left, right = q["x"], s["x"]
    size_a, size_b = np.sqrt((left**2).sum(axis=1)), np.sqrt((right**2).sum(axis=1))
    linked = [np.zeros(0, dtype=bool)]
    for at in range(0, len(a), 100_000):
        i, j = a[at : at + 100_000], b[at : at + 100_000]
        linked.append(np.einsum("ij,ij->i", left[i], right[j]) / (size_a[i] * size_b[j]) >= limit)
    keep = np.concatenate(linked)
    return a[keep], b[keep]


def train(nodes: DataFrame, count: int, length: int) -> Index:
    """Fit on at most ``SAMPLE_ROWS`` vectors in hash order; the number of lists follows that of the vectors."""
    sample = nodes.where(F.size("x") == length).orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("x").toArrow()
    x = _unit(_matrix(sample["x"].combine_chunks()))
    return fit(x, max(1, min(MOST_LISTS, count // LIST_ROWS, len(x) // 4)))


def _coded(nodes: DataFrame, index: Index) -> DataFrame:
    """Adds home list, probes, codes and coding error."""
    shared = nodes.sparkSession.sparkContext.broadcast(index)
    kind = "struct<probes: array<int>, codes: array<int>, error: double>"

    @F.arrow_udf(kind)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            probes, codes, error = encode(shared.value, _unit(_matrix(batch)))
            columns = [pa.array(list(probes.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(error)]
            yield pa.StructArray.from_arrays(columns, ["probes", "codes", "error"])

    usual = nodes.where(F.size("x") == index.length).withColumn("c", coded("x")).select("*", "c.*").drop("c")
    none = F.array(F.lit(NO_CODES))
    other = nodes.where(F.size("x") != index.length)
    other = other.withColumns({"probes": none, "codes": none, "error": F.lit(0.0)})
    return usual.unionByName(other).withColumn("home", F.col("probes")[0])


def linked(nodes: DataFrame, index: Index, stages: Stages, limit: float = LIMIT) -> DataFrame:
    """(node, n, root) rows: partial numbers of links and edges of a spanning forest."""
    coded = stages.write(_coded(nodes, index))
    list_key = ["label", "size", "cell"]
    stored = coded.withColumn("cell", F.col("home"))
    queries = coded.withColumn("cell", F.explode("probes"))
    sizes = (
        queries.groupBy(*list_key)
        .agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("home") == F.col("cell")).alias("held"))
        .where((F.col("held") > 0) & (F.col("asked") > 1))
        .select(
            *list_key,
            F.ceil(F.col("held") / STORED_BLOCK).cast("int").alias("stored_blocks"),
            F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("query_blocks"),
        )
    )
    sizes = stages.write(sizes)

    def dealt(rows: DataFrame, own: str, others: str, stored_side: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        every = F.sequence(F.lit(0), F.col(others) - 1)
        placed = rows.join(sizes, list_key).withColumns({"mine": mine, "theirs": F.explode(every)})
        sb, qb = ("mine", "theirs") if stored_side else ("theirs", "mine")
        return placed.select(
            *list_key, F.col(sb).alias("sb"), F.col(qb).alias("qb"), F.lit(stored_side).alias("stored"), "node", "copies", "x", "home", "probes", "codes", "error"
        )

    both = dealt(stored, "stored_blocks", "query_blocks", True).unionByName(dealt(queries, "query_blocks", "stored_blocks", False))
    shared = nodes.sparkSession.sparkContext.broadcast(index)

    def side(table: pa.Table) -> dict:
        lists = {c: table[c].combine_chunks() for c in ("x", "probes", "codes")}
        return {
            "x": _matrix(lists["x"]),
            "node": np.array(table["node"].to_pylist(), dtype=object).astype("U32"),
            "copies": table["copies"].to_numpy(),
            "home": table["home"].to_numpy(),
            "probes": _matrix(lists["probes"]).astype(np.int64),
            "codes": _matrix(lists["codes"]).astype(np.int64),
            "error": table["error"].to_numpy(),
        }

    def block(table: pa.Table) -> pa.Table:
        s, q = side(table.filter(pa.compute.field("stored"))), side(table.filter(~pa.compute.field("stored")))
        schema = pa.schema([("node", pa.string()), ("n", pa.int64()), ("root", pa.string())])
        if not len(s["node"]) or not len(q["node"]):
            return schema.empty_table()
        a, b = compare(shared.value, table["cell"][0].as_py(), q, s, limit)
        names, place = np.unique(np.concatenate([q["node"][a], s["node"][b]]), return_inverse=True)
        one, two = place[: len(a)], place[len(a) :]
        n = np.bincount(one, s["copies"][b], len(names)) + np.bincount(two, q["copies"][a], len(names))
        root = _forest(one, two, len(names)) if len(a) else np.zeros(0, dtype=np.int64)
        return pa.table([pa.array(names.tolist(), pa.string()), pa.array(n.astype(np.int64)), pa.array(names[root].tolist(), pa.string())], schema=schema)

    return stages.write(both.groupBy(*list_key, "sb", "qb").applyInArrow(block, "node string, n bigint, root string"))


def classes(df: DataFrame, limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    stages = Stages(df.sparkSession, "vectors")
    ok = _valid(F.col("embedding")) & F.col("label").isNotNull()
    name = F.concat(
        F.lpad(F.hex(F.xxhash64("label", "embedding")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), "embedding", "label")), 16, "0")
    )
    rows = stages.write(df.select("vec_id", "label", "embedding", F.when(ok, name).alias("node")))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node", "label", F.col("embedding").alias("x"))
    nodes, count = stages.measured(nodes.agg(F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("x")), F.count(F.lit(1)))
    slim = rows.select("vec_id", "node")
    if count:
        usual = nodes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()["size"]
        found = linked(nodes, train(nodes, count, usual), stages, limit)
        labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), stages)
        degree = found.groupBy("node").agg(F.sum("n").alias("others"))
        named = nodes.select("node", "copies").join(degree, "node", "left").join(labels, "node", "left")
    else:
        named = nodes.select("node", "copies", F.lit(0).alias("others"), "node").toDF("node", "copies", "others", "component")
    own = slim.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = own.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("vec_id").alias("least"))
    out = own.join(smallest, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))
    return out.select(
        "vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
