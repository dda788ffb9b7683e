"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is the multiset of its five-word shingles (lower-cased runs of letters and digits);
similarity is the weighted Jaccard similarity of the multisets. Each unit of weight of a shingle is
a region at which darts are thrown at times that a hash of shingle, unit and dart number settles;
a dart falls on one of COORDINATES coordinates. The earliest dart of each coordinate is kept. Two
documents agree in a coordinate with the probability of their similarity, and the work for one
is about its number of shingles, however many coordinates there are.

Documents with equal multisets are one class at once; only one of each goes on. Signatures are cut
into BANDS bands; documents that share a band are compared with the band's leader, by exact
similarity: the document with most copies. Whoever is linked with the same leader bears its label.
Bands in which more than BLOCK nodes do not bear the commonest label get a second leader among these.
After that all nodes of a band that bear different labels are compared, block by block: the nodes
beside the commonest label among themselves and with those that bear it, never those with each other.
Only links are written: none between labels is lost, and a group is not expanded into its pairs.

The exact check counts units by 32-bit hashes: of two documents of n units each, about n^2 / 2^32
different units are taken for equal (for 1,000 units, one in every 4,000 pairs has one unit too many).

Defined results: nodes are doc_ids, so rows that share a doc_id share a class, and rows without one
are in no class and are kept; texts of one to four words are one shingle; texts without a word are
never linked; the class id is the least doc_id of the class, which is the one kept; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, id_bitmap, perhaps_in, tidy, written

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 100
ROWS = 5
BANDS = COORDINATES // ROWS
EXTRA = 3.0
CHUNK = 1 << 17
BLOCK = 256  # nodes of a band that one task compares with as many others
CELLS = 1 << 22  # of a dense part of the matrix of nodes and units

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser of x and a salt (xor-shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt) * _ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: np.ndarray, lengths: np.ndarray, size: int = WORDS):
    """Hashes of the shingles of each word list, sorted by list and hash, and each list's number."""
    with np.errstate(over="ignore"):
        rows = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        place = np.arange(len(words)) - starts[rows]
        left = lengths[rows] - place
        used = (left >= size) | ((lengths[rows] < size) & (place == 0))
        total = np.zeros(len(words), np.uint64)
        for k in range(size):
            there = np.flatnonzero(left > k)
            total[there] += mixed(words[there + k], k + 1) * np.uint64(2 * k + 3)
        found, row = mixed(total[used], 77), rows[used]
    order = np.lexsort((found, row))
    return found[order], row[order], np.bincount(row, minlength=len(lengths))


def units(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the n-th time that a row has a shingle."""
    if not len(hashes):
        return hashes
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]
    at = np.arange(len(hashes))
    return mixed(hashes ^ (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64), 5)


def dart_minhash(elements: np.ndarray, rows: np.ndarray, counts: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Time of the earliest dart at each of k coordinates, for each row; infinite for empty rows."""
    earliest = np.full(len(counts) * k, np.inf)
    until = np.zeros(len(counts))
    need = np.flatnonzero(counts > 0)
    until[need] = k * (np.log(k) + EXTRA) / counts[need]
    todo = np.zeros(len(counts), bool)
    todo[need] = True
    while todo.any():
        chosen = np.flatnonzero(todo[rows])
        for start in range(0, len(chosen), CHUNK):
            element, row = elements[chosen[start : start + CHUNK]], rows[chosen[start : start + CHUNK]]
            time, dart = np.zeros(len(element)), 0
            while len(element):
                dart += 1
                u = mixed(element, 1000 + 2 * dart)
                time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                hit = time <= until[row]
                element, row, time = element[hit], row[hit], time[hit]
                where = (mixed(element, 1001 + 2 * dart) >> np.uint64(32)) % np.uint64(k)
                np.minimum.at(earliest, row * k + where.astype(np.int64), time)
        todo &= np.isinf(earliest.reshape(-1, k)).any(axis=1)
        until[todo] *= 2
    return earliest.reshape(-1, k)


def bands(times: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of each row."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), -1, rows)
    with np.errstate(over="ignore"):
        total = np.zeros(bits.shape[:2], np.uint64)
        for r in range(rows):
            total += mixed(bits[:, :, r], r + 1) * np.uint64(2 * r + 3)
        return mixed(total + np.arange(bits.shape[1], dtype=np.uint64) * _ODD, 9)


def _elements(column: pa.Array):
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    hashes, rows, counts = shingles(words, lengths)
    return units(hashes, rows), rows, counts


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _sign(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            elements, rows, counts = _elements(batch.column("words"))
            with np.errstate(over="ignore"):
                sums = [np.zeros(len(counts), np.uint64) for _ in range(2)]
                for salt, total in enumerate(sums):
                    np.add.at(total, rows, mixed(elements, 50 + salt))
            keys = bands(dart_minhash(elements, rows, counts))
            keys = keys[counts > 0].ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(s.view(np.int64)) for s in sums], pa.array(counts), _lists(keys.view(np.int64), np.where(counts > 0, BANDS, 0))],
                names=["doc_id", "k1", "k2", "n", "bands"],
            )


def _sets(batches):
    """Sorted 32-bit hashes of the units of each document, for the exact check of pairs."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            elements, rows, counts = _elements(batch.column("words"))
            short = (elements >> np.uint64(32)).astype(np.uint32)
            short = short[np.lexsort((short, rows))]
            ends = np.concatenate([[0], np.cumsum(counts)])
            packed = [short[ends[i] : ends[i + 1]].tobytes() for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "units"])


def _similar(threshold: float):
    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
            kept = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                    kept.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                # repeats within one side stand for different units with equal short hashes: too few to matter
                common = int((both[1:] == both[:-1]).sum())
                kept.append(common >= threshold * (len(both) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(kept)], names=["a", "b", "similar"])

    return run


def unit_sets(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """node and packed units of (about) the documents of ids(node), as a written table."""
    # texts are read again where they lie; only the units of (about) the wanted ones are shuffled
    texts = perhaps_in(docs.select("doc_id", "text"), "doc_id", id_bitmap(ids, "node"))
    if repeated:
        texts = texts.dropDuplicates(["doc_id", "text"])
    sets = texts.select("doc_id", word_hashes(F.col("text")).alias("words")).mapInArrow(_sets, "doc_id long, units binary")
    return written(sets.withColumnRenamed("doc_id", "node"), "units")


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose exact similarity reaches the threshold."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("units").alias("left")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("units").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    return both.mapInArrow(_similar(threshold), "a long, b long, similar boolean").filter("similar").select("a", "b")


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a spanning forest of a symmetric matrix of links."""
    todo, left, right = linked.any(axis=1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while todo.any():
        front = np.flatnonzero(todo)[:1]
        todo[front] = False
        while len(front):
            near = linked[front] & todo
            reached = np.flatnonzero(near.any(axis=0))
            left.append(front[near[:, reached].argmax(axis=0)])
            right.append(reached)
            todo[reached] = False
            front = reached
    return np.concatenate(left), np.concatenate(right)


def common_units(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of units that any two of some documents have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, unit, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    column, kept = np.cumsum(several) - 1, several[unit]
    owner, column = owner[kept], column[unit[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(several.sum())
    common, width = np.zeros((len(sets), len(sets))), max(1, min(total, CELLS // len(sets)))
    for start in range(0, total, width):
        low, high = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        common += part @ part.T
    return common


def _block_links(threshold: float):
    """A spanning forest of the similar documents of different labels in each block of a band."""

    def group(rows):
        nodes, labels, sides = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        sets = [np.frombuffer(r[3], np.uint32) for r in rows]
        n, common = np.array([len(x) for x in sets]), common_units(sets)
        similar = common >= threshold * (n[:, None] + n[None] - common) - 1e-9
        similar &= labels[:, None] != labels[None]
        if sides.any():
            similar &= sides[:, None] != sides[None]
        left, right = forest(similar)
        return nodes[left], nodes[right]

    def run(batches):
        held, last, done = [], None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("node", "label", "side", "units", "band", "kind", "low", "high")], strict=True):
                if row[4:] != last and held:
                    done.append(group(held))
                    held = []
                last = row[4:]
                held.append(row)
            if done:
                a, b = (np.concatenate(c) for c in zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                done = []
        if held:
            a, b = group(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _across(placed: DataFrame, mixed_bands: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the labels of each band of mixed_bands(band, top, tops, others).

    Nodes are dealt by hash to blocks of about BLOCK, those beside the top label and those that bear
    it apart. Each two blocks of the first meet in a task that holds their units, and each of the first
    with each of the second: pairs are compared there and only links are written."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    met = placed.join(mixed_bands, "band").withColumn("no", blocks("others")).withColumn("nt", blocks("tops")).withColumn("beside", F.col("label") != F.col("top"))
    task = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.cast("int").alias("side"))
    every = lambda n, of: F.transform(F.sequence(F.lit(0), F.col(n) - 1), of)
    mine = F.concat(
        every("no", lambda k: task(0, F.least(own("no"), k), F.greatest(own("no"), k), own("no") > k)),
        every("nt", lambda k: task(1, own("no"), k, F.lit(0))),
    )
    tasks = F.when(F.col("beside"), mine).otherwise(every("no", lambda k: task(1, k, own("nt"), F.lit(1))))
    dealt = met.select("band", "node", "label", F.explode(tasks).alias("t")).select("band", "node", "label", "t.*")
    keys = ["band", "kind", "low", "high"]
    whole = dealt.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys)
    return whole.mapInArrow(_block_links(threshold), "a long, b long")


def _labels_of(placed: DataFrame) -> DataFrame:
    """Bands with several labels: (band, top, tops, others), the commonest label and how many bear it or not."""
    counts = placed.groupBy("band", "label").agg(F.count("*").alias("n"))
    tops = counts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    return written(tops.filter("all > top.n").select("band", F.col("top.label").alias("top"), F.col("top.n").alias("tops"), (F.col("all") - F.col("top.n")).alias("others")), "mixed")


def _linked(met: DataFrame, placed: DataFrame, sets: DataFrame, threshold: float):
    """Links of met(band, node, leader) with their leaders, and placed(band, node, label) with what they tell."""
    links = written(compared(met.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), sets, threshold), "links")
    found = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("with"))
    return links, written(placed.join(written(found, "with"), "node", "left").select("band", "node", F.coalesce("with", "label").alias("label")), "placed")


def node_links(nodes: DataFrame, docs: DataFrame, threshold: float, repeated: bool) -> DataFrame:
    """Links (a, b) between nodes(node, size, bands) that connect all similar ones that share a band."""
    keys = nodes.select("node", "size", F.explode("bands").alias("band"))
    leaders = keys.groupBy("band").agg(F.max(F.struct("size", (-F.col("node")).alias("at"))).alias("top"), F.count("*").alias("n"))
    leaders = written(leaders.filter("n > 1").select("band", (-F.col("top.at")).alias("leader")), "leaders")
    met = written(keys.join(leaders, "band").select("band", "node", "leader"), "met")
    sets = unit_sets(docs, met, repeated)
    links, placed = _linked(met, met.select("band", "node", F.col("node").alias("label")), sets, threshold)
    several = _labels_of(placed)
    crowded = several.filter(F.col("others") > BLOCK)
    if not crowded.isEmpty():
        beside = placed.join(crowded.select("band", "top"), "band").filter("label <> top")
        leaders = written(beside.groupBy("band").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("leader")), "leaders")
        more, placed = _linked(beside.join(leaders, "band").select("band", "node", "leader"), placed, sets, threshold)
        links, several = links.unionByName(more), _labels_of(placed)
    return written(links.unionByName(_across(placed, several, sets, threshold)), "links")


@tidy
def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and n_units of every row of docs(doc_id, text)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(
        ids.select("doc_id", word_hashes(F.col("text")).alias("words")).mapInArrow(_sign, "doc_id long, k1 long, k2 long, n long, bands array<long>"),
        "signatures",
    )
    real = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # bands follow from the multiset, so that they are part of the key
    nodes = written(real.groupBy("k1", "k2", "bands").agg(F.min("doc_id").alias("node"), F.count("*").alias("size")), "nodes")
    repeated = written(real.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "repeated")
    some = not repeated.isEmpty()
    links = node_links(nodes, ids, threshold, some)
    if some:  # rows of one doc_id share a class: an id is a node that is linked with the nodes of all its texts
        mine = real.join(repeated, "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct()
        own = mine.join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        links = links.unionByName(own)
    grouped = components(links)
    named = written(nodes.join(grouped, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class_id")), "named")
    found = signed.select("doc_id", "k1", "k2", "n").join(named, ["k1", "k2"], "left")
    lone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return found.select("doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.col("n").alias("n_units"))


def kept_documents(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, but for those whose class keeps another document."""
    dropped = written(classes(docs, threshold).filter("class_id <> doc_id").select("doc_id").distinct(), "dropped")
    bitmap, names = id_bitmap(dropped, "doc_id"), docs.columns
    rows = docs.withColumn("_id", F.col("doc_id").cast("long"))
    sure = perhaps_in(rows, "_id", bitmap, wanted=False)
    rest = perhaps_in(rows, "_id", bitmap).join(dropped.withColumnRenamed("doc_id", "_id"), "_id", "left_anti")
    return sure.select(*names).unionByName(rest.select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("class_id").eqNullSafe(F.col("doc_id")))
