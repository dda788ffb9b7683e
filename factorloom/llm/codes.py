"""Vector code compression: product quantisation in integers, entries found by exponion search.

Components become integers floor(4096 x). Vectors are cut into PARTS equal parts, each with a codebook
of at most ENTRIES entries that starts as the parts of the smallest vec_ids and is refined ROUNDS times.
Every search starts at the entry of the round before, at squared distance d. An entry that is as near
lies within twice that distance of it (triangle inequality), so only its neighbour entries, sorted by their squared
distance to it, are scanned up to 4 d; ties go to the lower index. All of it is integer arithmetic.

A round is one pass over the vectors, which writes them with their new entries and adds, in each task, one row of counts and
sums for each entry; these sums are aggregated by Spark, and what reaches the driver has a fixed size
(PARTS x ENTRIES entries). Batches whose integers are too large for 64 bits are worked in Python's integers.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, as are those
whose length differs from that of the smallest kept vec_id or is no multiple of PARTS; a null vec_id comes
last; rows that share a vec_id are rows of their own, and each may start an entry, in the order of their vectors; with fewer
than ENTRIES rows the codebooks are smaller; an error that a long cannot hold is null, and so is a sum over
it; repeated rows are counted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, tidy, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LIMB = 48  # bits of a sum that one row carries
CHUNK = 1 << 20  # components that a task holds at once
LARGEST = 1 << 62


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), in 64 bits where no squared distance between such rows can overflow, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    top = float(np.abs(scaled).max(initial=0)) + 1
    if 16 * top * top * max(1, x.shape[1]) < LARGEST:
        return scaled.astype(np.int64)
    exact = np.empty(x.shape, object)
    exact[:] = [[floor(Fraction(v) * SCALE) for v in row] for row in x.tolist()]
    return exact


def fitting(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and entries in one arithmetic: 64 bits only if both allow it."""
    top = max((abs(int(v)) for v in (parts.max(initial=0), parts.min(initial=0), book.max(initial=0), book.min(initial=0))), default=0) + 1
    kind = np.int64 if 16 * top * top * max(1, parts.shape[1]) * PARTS < LARGEST else object
    return parts.astype(kind), book.astype(kind)


def nearest(parts: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row, its squared distance, and how many distances were worked out, searched from `start`."""
    parts, book = fitting(parts, book)
    apart = ((book[:, None] - book[None]) ** 2).sum(2)
    order = np.array([sorted((j for j in range(len(book)) if j != a), key=lambda j: (apart[a, j], j)) for a in range(len(book))]).reshape(len(book), -1)
    least = ((parts - book[start]) ** 2).sum(1)
    best, reach, rows, measured = start.copy(), 4 * least, np.arange(len(parts)), len(parts)
    for k in range(order.shape[1]):
        entry = order[start[rows], k]
        inside = (apart[start[rows], entry] <= reach[rows]).astype(bool)
        rows, entry = rows[inside], entry[inside]
        if not len(rows):
            break
        found = ((parts[rows] - book[entry]) ** 2).sum(1)
        better = ((found < least[rows]) | ((found == least[rows]) & (entry < best[rows]))).astype(bool)
        best[rows[better]], least[rows[better]] = entry[better], found[better]
        measured += len(rows)
    return best, least, measured


def searched(v: np.ndarray, books: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x PARTS) and squared distances summed over the parts."""
    codes, width = np.empty_like(start), v.shape[1] // PARTS
    error = np.zeros(len(v), v.dtype)
    for p in range(PARTS):
        codes[:, p], found, _ = nearest(v[:, p * width : (p + 1) * width], books[p], start[:, p])
        error = error + found
    return codes, error


def chunks(batches, columns: int):
    """Record batches joined up to CHUNK components."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n * columns >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held and n:
        yield pa.Table.from_batches(held)


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
    codes = table.column("codes").combine_chunks()
    start = np.frombuffer(b"".join(c or bytes(PARTS) for c in codes.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
    return integers(x), start


def limbs(values: list[int]) -> list[list[int]]:
    """The values as lists of limbs of LIMB bits, lowest first, signs kept; lists of zeros at the end are left out."""
    found = []
    while any(values) or not found:
        found.append([(abs(v) & ((1 << LIMB) - 1)) * (1 if v >= 0 else -1) for v in values])
        values = [(abs(v) >> LIMB) * (1 if v >= 0 else -1) for v in values]
    return found


def _round(books, dims: int, schema: pa.Schema):
    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for table in chunks(batches, dims):
            v, start = _vectors(table)
            codes, _ = searched(v, books.value, start)
            width = dims // PARTS
            for p in range(PARTS):
                part = v[:, p * width : (p + 1) * width]
                for entry in np.unique(codes[:, p]).tolist():
                    mine = part[codes[:, p] == entry]
                    total = sums.setdefault((p, entry), [0, [0] * width])
                    total[0] += len(mine)
                    total[1] = [a + int(b) for a, b in zip(total[1], mine.sum(0), strict=True)]
            fresh = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
            n = table.num_rows
            columns = [table.column(c) if c in ("vec_id", "label", "embedding") else fresh if c == "codes" else pa.nulls(n, schema.field(c).type) for c in schema.names]
            yield from pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches(max_chunksize=1000)
        rows = [
            {"part": p, "entry": entry, "limb": k, "n": n if k == 0 else 0, "sums": limb}
            for (p, entry), (n, total) in sums.items() for k, limb in enumerate(limbs(total))
        ]
        if rows:
            yield pa.RecordBatch.from_pylist([{c: row.get(c) for c in schema.names} for row in rows], schema)

    return run


def _replaced(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with every used entry replaced by the floor of its parts' mean."""
    sums = table.filter("part is not null").select("part", "entry", "limb", "n", F.posexplode("sums").alias("at", "sum"))
    total: dict[tuple[int, int, int], list[int]] = {}
    long = F.col("sum").cast("decimal(38,0)")
    for r in sums.groupBy("part", "entry", "limb", "at").agg(F.sum("n").alias("n"), F.sum(long).alias("sum")).collect():
        found = total.setdefault((r["part"], r["entry"], r["at"]), [0, 0])
        found[0], found[1] = found[0] + r["n"], found[1] + (int(r["sum"]) << (LIMB * r["limb"]))
    fresh = [book.astype(object) for book in books]
    for (p, entry, at), (n, value) in total.items():
        fresh[p][entry, at] = value // n
    return fresh


def _errors(books, dims: int, schema: pa.Schema):
    def run(batches):
        for table in chunks(batches, dims):
            v, start = _vectors(table)
            codes, error = searched(v, books.value, start)
            held = pa.array([int(e) if int(e) < 1 << 63 else None for e in error], pa.int64())
            fresh = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
            whole = pa.Table.from_arrays([table.column("vec_id"), table.column("label"), fresh, held], schema=schema)
            yield from whole.combine_chunks().to_batches(max_chunksize=1000)

    return run


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """The rows whose vector is whole, finite and can be cut into PARTS."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0)).filter(sound).select(
        "vec_id", "label", x.cast("array<double>").alias("embedding")
    )


def quantised(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the kept rows of vectors(vec_id, label, embedding), and the final codebooks."""
    spark = vectors.sparkSession
    kinds = kept_vectors(vectors).schema
    out = T.StructType([kinds["vec_id"], kinds["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    table = written(kept_vectors(vectors).withColumn("codes", F.lit(None).cast("binary")), "vectors")
    head = table.orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    if not (one := head.limit(1).collect()):
        return spark.createDataFrame([], out), [np.zeros((0, 0), object)] * PARTS
    dims = len(one[0]["embedding"])
    table, head = (rows.filter(F.size("embedding") == dims) for rows in (table, head))
    first = integers(np.array([r["embedding"] for r in head.limit(entries).collect()], float)).astype(object)
    books = [part.copy() for part in np.split(first, PARTS, axis=1)]
    schema = T.StructType([
        *table.schema.fields, *[T.StructField(c, T.IntegerType()) for c in ("part", "entry", "limb")],
        T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())),
    ])
    arrow = _arrow(schema)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        before, table = table, written(table.select(*table.columns[:4]).mapInArrow(_round(shared, dims, arrow), schema), "round")
        discard(before)
        books = _replaced(table, books)
        table = table.filter("part is null").select("vec_id", "label", "embedding", "codes")
    shared = spark.sparkContext.broadcast(books)
    return table.mapInArrow(_errors(shared, dims, _arrow(out)), out), books


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


@tidy
def compress_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of vectors(vec_id, embedding, label)."""
    rows, books = quantised(vectors)
    rows = written(rows, "coded")
    whole = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint"))
    labels = written(rows.groupBy(F.col("label").alias("group")).agg(whole.alias("label_error")), "label_errors")
    return rows.join(labels, F.col("label").eqNullSafe(F.col("group"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The whole of it in SQL: every entry is measured, each round is a pair of tables."""
    steps: list[str] = []
    square = "list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i])))"
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT n, part, any_value(p) AS p, min({{'d': d, 'e': entry}}) AS best
  FROM (SELECT n, part, p, entry, {square} AS d FROM parts JOIN book{k} USING (part)) GROUP BY n, part)""")
        if k < ROUNDS:
            steps.append(f"""sums{k} AS (
  SELECT part, best.e AS entry, i, sum(p[i])::HUGEINT AS s, count(*)::HUGEINT AS c FROM near{k}, (SELECT unnest(range(1, 9)) AS i) GROUP BY ALL
), fresh{k} AS (
  SELECT part, entry, list(((s - ((s % c + c) % c)) // c)::BIGINT ORDER BY i) AS c FROM sums{k} GROUP BY ALL
), book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(f.c, b.c) AS c FROM book{k} b LEFT JOIN fresh{k} f ON b.part = f.part AND b.entry = f.entry)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT n, part, v[part * 8 + 1 : part * 8 + 8] AS p FROM kept, (SELECT unnest(range(0, {PARTS})) AS part)
), book0 AS (SELECT part, n - 1 AS entry, p AS c FROM parts WHERE n <= {ENTRIES}),
{", ".join(steps)}, coded AS (
  SELECT n, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY n
), named AS (
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error FROM coded JOIN kept USING (n)
)
SELECT *, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256 FROM named
"""


ORACLE_SQL = _oracle()
