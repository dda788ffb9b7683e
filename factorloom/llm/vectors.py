"""Near-duplicate vectors by collision counting on one-dimensional projections.

Each of T tables sorts the vectors by one random projection inside cells that the signs of K other
projections make (sorting alone would leave a fixed share of all pairs in every window, which is
quadratic). Two vectors collide in a table if they share its cell and lie within a window about each
other on its sorted projection. T and the number of collisions asked for are calibrated so that a
pair at the threshold passes with probability RECALL; K follows the number of vectors, so that cells
stay small. Pairs that pass the count are verified by cosine in double precision, in the first table
in which they collide, so that each pair is met once.

Without a chance, `exact` keeps all vectors in one cell and one table: a window of the projection's length times the
distance at the threshold holds every link, and blocks of the cell meet each other, at a cost that is quadratic.

Equal vectors are one node. A cell with more than BLOCK rows is cut into blocks and its pairs of
blocks are dealt out. Tasks return sums of links and a spanning forest, never the pairs themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose squares
overflow or vanish in double precision, link with nothing; vectors of different lengths do not link; rows that repeat a vec_id are vectors of their
own; a component is named by its least vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, tidy, written

COSINE = 0.95
RECALL = 0.9995
COUNT = 2
BLOCK = 2048
PAIRS = 1 << 16


def calibrated(n: int, cosine: float = COSINE, recall: float = RECALL, count: int = COUNT):
    """(K, T, width) for n vectors: the fewest tables with P(Binomial(T, p) >= count) >= recall."""
    bits = max(4, math.ceil(math.log2(max(n, 2))) + 2)
    deviation = math.sqrt(2 - 2 * cosine)
    p = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(3 / math.sqrt(2))
    tables = count
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(count)) > 1 - recall:
        tables += 1
    return bits, tables, 3 * deviation


def unit_rows(packed) -> np.ndarray:
    """Packed doubles as rows of unit length."""
    x = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@lru_cache(maxsize=8)
def planes(dims: int, bits: int, tables: int):
    rng = np.random.default_rng(17)
    return rng.normal(size=(dims, tables * bits)), rng.normal(size=(dims, tables))


def cells_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each row in each table, as a 64-bit key that differs between tables."""
    signs = (x @ planes(x.shape[1], bits, tables)[0] > 0).reshape(len(x), tables, bits)
    keys = signs.astype(np.int64) @ (np.int64(1) << np.arange(bits))
    return keys + (np.arange(tables, dtype=np.int64) << np.int64(48))


def valid(column: pa.Array) -> list:
    """Packed doubles of each vector that can link, else None."""
    found = []
    for values in column.to_pylist():
        ok = values and None not in values
        x = np.asarray(values, float) if ok else None
        ok = ok and np.isfinite(x).all() and x.any() and np.isfinite((x * x).sum()) and (x * x).sum() > 0
        found.append((x + 0.0).astype("<f8").tobytes() if ok else None)
    return found


def _pack(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(valid(batch.column("embedding")), pa.binary())], names=["vec_id", "packed"]
        )


def _cells(bits: int, tables: int):
    def run(batches):
        for batch in batches:
            nodes, packed = batch.column("node").to_pylist(), batch.column("packed").to_pylist()
            by_size: dict = {}
            for at, x in enumerate(packed):
                by_size.setdefault(len(x), []).append(at)
            for some in by_size.values():
                for start in range(0, len(some), 1024):
                    part = some[start : start + 1024]
                    keys = cells_of(unit_rows([packed[i] for i in part]), bits, tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([nodes[i] for i in part], tables)), pa.array(keys.ravel())], names=["node", "cell"]
                    )

    return run


def sufficient(dims: int, cosine: float) -> float:
    """How far two vectors with that cosine can lie apart on the first projection."""
    return float(np.linalg.norm(planes(dims, 0, 1)[1])) * math.sqrt(2 - 2 * cosine) * (1 + 1e-9) + 1e-9


def _links(bits: int, tables: int, width: float | None, cosine: float, count: int):
    """Rows (kind, a, b): kind 0 adds b links to node a, kind 1 is an edge of a spanning forest. No width is a sufficient one."""

    def pairs_of(x, i, j, keys, places, table, width):
        """Which pairs i, j pass the count, collide in `table` first, and then pass the cosine."""
        passed = []
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            met = (keys[a] == keys[b]) & (np.abs(places[a] - places[b]) <= width)
            counted = (met.sum(axis=1) >= count) & (met.argmax(axis=1) == table)
            a, b = a[counted], b[counted]
            good = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            passed.append((a[good], b[good]))
        return (np.concatenate(s) for s in zip(*passed, strict=True)) if passed else (i[:0], j[:0])

    def group(rows):
        nodes, sizes, side = (np.array([r[k] for r in rows]) for k in (0, 1, 2))
        lengths = {len(r[3]) for r in rows}
        found = []
        for length in lengths:
            mine = np.array([len(r[3]) == length for r in rows])
            x = unit_rows([r[3] for r in rows if len(r[3]) == length])
            found.append(same_length(nodes[mine], sizes[mine], side[mine], x, rows[0][4]))
        return [np.concatenate(p) for p in zip(*found, strict=True)]

    def same_length(nodes, sizes, side, x, cell):
        wide = sufficient(x.shape[1], cosine) if width is None else width
        keys, places = cells_of(x, bits, tables), x @ planes(x.shape[1], bits, tables)[1]
        table = int(cell) >> 48
        order = np.argsort(places[:, table], kind="stable")  # the sorted projection of this cell
        line = places[order, table]
        last = np.searchsorted(line, line + wide, side="right")
        degree, forest = np.zeros(len(nodes), np.int64), {}

        def root(v):
            while forest.setdefault(v, v) != v:
                forest[v] = forest[forest[v]]
                v = forest[v]
            return v

        across = side.any()
        edges = []
        step = max(1, PAIRS // max(1, len(order)))
        for at in range(0, len(order), step):
            spans = last[at : at + step] - np.arange(at, min(at + step, len(order))) - 1
            i = np.repeat(np.arange(at, at + len(spans)), spans)
            j = i + 1 + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
            i, j = order[i], order[j]
            if across:
                other = side[i] != side[j]
                i, j = i[other], j[other]
            i, j = pairs_of(x, i, j, keys, places, table, wide)
            np.add.at(degree, i, sizes[j])
            np.add.at(degree, j, sizes[i])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    forest[ra] = rb
                    edges.append((nodes[a], nodes[b]))
        met = degree > 0
        edges = np.array(edges, np.int64).reshape(-1, 2)
        return (
            np.r_[np.zeros(met.sum(), np.int64), np.ones(len(edges), np.int64)],
            np.r_[nodes[met], edges[:, 0]], np.r_[degree[met], edges[:, 1]],
        )

    def out(groups):
        kind, a, b = (np.concatenate(c) for c in zip(*groups, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    def run(batches):
        names, held, last, done = ("node", "size", "side", "packed", "cell", "low", "high"), [], None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if row[4:] != last and held:
                    done.append(group(held))
                    held = []
                last = row[4:]
                held.append(row)
                if len(done) >= 512:
                    yield out(done)
                    done = []
        if held:
            done.append(group(held))
        if done:
            yield out(done)

    return run


@tidy
def linked(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, count: int = COUNT, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding); exact takes no chance of a lost link."""
    packed = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_pack, "vec_id long, packed binary"), "packed")
    whole = packed.filter("packed IS NOT NULL").withColumn("key", F.sha2("packed", 256))
    grouped = whole.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.min("packed").alias("packed"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    if exact:
        bits, tables, width, count = 0, 1, None, 1
        cells = nodes.select("node", F.lit(0).cast("long").alias("cell"))
    else:
        bits, tables, width = calibrated(nodes.count(), cosine, recall, count)
        cells = nodes.select("node", "packed").mapInArrow(_cells(bits, tables), "node long, cell long")
    cells = written(cells, "cells")
    shared = written(cells.groupBy("cell").agg(F.count("*").alias("rows")).filter("rows > 1"), "shared")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        cells.join(shared, "cell").withColumn("blocks", blocks).withColumn("own", mine)
        .select("node", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("node", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
        .join(nodes.select("node", "size", "packed"), "node")
        .repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    )
    found = written(dealt.mapInArrow(_links(bits, tables, width, cosine, count), "kind long, a long, b long"), "links")
    degrees = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    edges = found.filter("kind = 1").select("a", "b")
    joined = written(nodes.join(degrees, "node", "left").join(components(edges), "node", "left").select(
        "key", "node", "least", "size", "others", F.coalesce("component", "node").alias("component")
    ), "joined")
    names = written(joined.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    facts = joined.join(names, "component").select("key", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    rows = packed.select("vec_id", F.sha2("packed", 256).alias("key"))
    return rows.join(written(facts, "facts"), "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
