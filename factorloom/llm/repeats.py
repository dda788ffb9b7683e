"""Exact removal of byte strings that occur more than once in the corpus.

A start is a place at which LENGTH (400) bytes of a text begin; it is removed, with its bytes, if
the same bytes also start anywhere else. Sorting every place of the corpus at every length would take
many times the corpus in shuffles, so that prefix doubling runs on sampled places, chosen by content
such that nothing can be lost:

* Each start has an anchor, the least hashed CORE-gram (leftmost on ties) of its 400 bytes. Equal
  strings have equal anchors at equal distances. Neighbouring starts share anchors: a run.
* Anchors whose core is unique in the corpus end their runs. Runs of one core whose bytes (first to
  last start's end) are equal are all removed; of each such class one run goes on, as a witness, if
  its core has several classes.
* The places of a run are those at multiples of CELL (32) bytes from its anchor. Their ranks at 32 bytes
  are hashes; from there Spark groups (rank, rank at an offset) pairs of one core and distance at
  growing offsets of 1, 2 and 4 places: ranks of 64, 128 and 256 bytes, and by an offset of 3 of 352.
  At each length, places whose rank is unique drop out, and the others' pairs are ranked anew.
* A place that is left at 352 bytes stands for the cell of the 32 starts before it: the 400 bytes of each hold
  the place's 352 and 48 more, before and after. The last ranks are pairs of the rank that doubling gave the
  place and the rank of those ends. Cells whose whole reach (431 bytes, ends of 31 and 48) is repeated are removed;
  the others, the cells at the borders of repeats, are ranked start by start, with ends of 48 bytes.

A rank is a 64-bit hash, of the bytes or of the pair, together with the 64-bit hash of the core.

Repeats of under 400 bytes are kept, long as they may be in words. `shared_passages` finds the documents that
hold PASSAGE (51) words in a row which another document holds too, by the same anchors: each passage has the least hashed
SHINGLE of its words, runs of equal words settle their texts, and the passages of the others are compared one by one.

Defined results: a null text counts as empty; texts under 400 bytes lose nothing; rows that repeat
are texts of their own, so both lose all they share; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_bitmap, perhaps_in, tidy, written

LENGTH = 400
CORE = 32
CELL = 32
SHARED = 352  # bytes that doubling ranks: all starts of a cell hold them, as SHARED + CELL <= LENGTH + 1
SEGMENT = 1 << 19
PASSAGE = 51  # words: maximal runs of bytes other than 0x20 and 0x09-0x0D
SHINGLE = 16
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOW = np.uint64((1 << 20) - 1)


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


with np.errstate(over="ignore"):
    _LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def core_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the CORE bytes at each place."""
    n = len(data) - CORE + 1
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view(np.uint64).ravel()
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(0, CORE, 8):
            total = _mix(total + words[k : k + n] * np.uint64(2 * k + 0x9E3779B1))
    return total


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each width hashes in a row, leftmost on ties."""
    starts = len(hashes) - width + 1
    keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.concatenate([keys, np.full(-len(keys) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts]) & _LOW).astype(np.int64)


def runs(data: bytes):
    """(anchor, first start, last start, core hash) of each run of starts in data."""
    parts = []
    for base in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        piece = data[base : base + SEGMENT + LENGTH - 1]
        hashes = core_hashes(piece)
        places = anchors(hashes, LENGTH - CORE + 1)
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        last = np.r_[first[1:] - 1, len(places) - 1]
        at = places[first]
        parts.append((at + base, first + base, last + base, hashes[at].view(np.int64)))
    return [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def rank(data) -> int:
    return signed(xxhash.xxh3_64_intdigest(data))


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], names=list(columns))


def _runs(batches):
    for batch in batches:
        ids, vs, texts = (batch.column(c) for c in ("id", "v", "text"))
        for doc, v, text in zip(ids.to_pylist(), vs.to_pylist(), texts.to_pylist(), strict=True):
            data = text.encode()
            anchor, first, last, core = runs(data)
            if not len(anchor):
                continue
            view = memoryview(data)
            whole = [rank(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
            n = len(anchor)
            yield _table({
                "core": core, "whole": np.array(whole, np.int64), "id": np.full(n, doc, np.int64), "v": np.full(n, v, np.int64),
                "place": (anchor << 20) | ((anchor - first) << 10) | (anchor - last),
            })


def squeezed(text: Column) -> Column:
    """The text's bytes under zstandard, which is what the joins on documents shuffle."""

    @F.pandas_udf("binary")
    def squeeze(texts):
        press = zstandard.ZstdCompressor(level=1)
        return texts.map(lambda t: press.compress(t.encode()))

    return squeeze(text)


def _slices(batches):
    """The bytes that the starts of each listed run reach."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.select(["id", "v", "data", "listed"]).to_pylist():
            data = expand.decompress(row["data"])
            for at in range(0, len(row["listed"]), 4096):
                listed = row["listed"][at : at + 4096]
                spots = [(r["place"] >> 20, (r["place"] >> 10) & 1023, r["place"] & 1023) for r in listed]
                yield _table({
                    "core": pa.array([r["core"] for r in listed], pa.int64()), "whole": pa.array([r["whole"] for r in listed], pa.int64()),
                    "n": pa.array([r["n"] for r in listed], pa.int64()), "id": pa.array([row["id"]] * len(listed), pa.int64()),
                    "v": pa.array([row["v"]] * len(listed), pa.int64()), "place": pa.array([r["place"] for r in listed], pa.int64()),
                    "bytes": pa.array([data[a - far : a - near + LENGTH] for a, far, near in spots], pa.binary()),
                })


def _cells(batches):
    """Of each slice, its places: the rank of 32 bytes, whether a full cell of starts lies before, and the rank of the ends of that cell's reach."""
    for batch in batches:
        out = {k: [] for k in ("row", "cell", "full", "rank", "ends")}
        for i, (place, data) in enumerate(zip(batch.column("place").to_pylist(), batch.column("bytes").to_pylist(), strict=True)):
            far, near, view = (place >> 10) & 1023, place & 1023, memoryview(data)
            for cell in range(-((LENGTH - near) // CELL - 1), far // CELL + 1):
                low, high = cell * CELL, cell * CELL + CELL - 1  # distances to the anchor
                full, at = near <= low and high <= far, far - low
                out["row"].append(i)
                out["cell"].append(cell)
                out["full"].append(full)
                out["rank"].append(rank(view[at : at + CELL]))
                out["ends"].append(rank(data[far - high : at] + data[at + SHARED : at + LENGTH]) if full else 0)
        rows = pa.array(out["row"], pa.int64())
        yield _table({
            **{c: batch.column(c).take(rows) for c in ("core", "whole", "n", "id", "v", "place")},
            "cell": pa.array(out["cell"], pa.int32()), "full": pa.array(out["full"], pa.bool_()),
            "rank": pa.array(out["rank"], pa.int64()), "ends": pa.array(out["ends"], pa.int64()),
        })


def doubled(ranks: DataFrame) -> DataFrame:
    """Of ranks(core, whole, cell, rank) of 32 bytes, those of SHARED bytes that several runs of a core share.

    A run's cells count backwards, so that the place an offset ahead is the cell of so many less."""
    for offset in (0, 1, 2, 4, 3):
        if offset:
            ahead = Window.partitionBy("core", "whole").orderBy("cell").rangeBetween(-offset, -offset)
            pairs = ranks.withColumn("next", F.first("rank").over(ahead)).filter("next IS NOT NULL")
            ranks = pairs.select("core", "whole", "cell", F.xxhash64("rank", "next").alias("rank"))
            before, ranks = live, written(ranks, "pairs")
            discard(before)
        twice = ranks.groupBy("core", "cell", "rank").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
        live = written(ranks.join(written(twice, "twice"), ["core", "cell", "rank"]).select("core", "whole", "cell", "rank"), "live")
        if offset:
            discard(ranks)
        ranks = live
    return live


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the offsets of its values in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def end_ranks(data: np.ndarray, start: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of each start in data, the rank of its LENGTH bytes without the SHARED that follow the first so many."""
    at = np.arange(LENGTH - SHARED)
    ends = data[start[:, None] + at + SHARED * (at >= before[:, None])].view(np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(start), np.uint64)
        for k in range(ends.shape[1]):
            total = _mix(total + ends[:, k] * np.uint64(16 * k + 0x9E3779B1))
    return total.view(np.int64)


def _starts(batches):
    """Each start of the listed cells: its distance to the anchor, the cell's rank, and the rank of the ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _bytes(batch.column("bytes"))
        place, listed = batch.column("place").to_numpy(), batch.column("cells")
        far, near, anchor = (place >> 10) & 1023, place & 1023, place >> 20
        row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
        cell, shared = (listed.flatten().field(k).to_numpy() for k in ("cell", "shared"))
        low = cell.astype(np.int64) * CELL
        first = np.maximum(near[row], low)
        count = np.minimum(far[row], low + CELL - 1) - first + 1
        for k in range(0, len(row), 1024):
            of = np.repeat(np.arange(k, min(k + 1024, len(row))), count[k : k + 1024])
            within = np.arange(len(of)) - np.repeat(np.cumsum(count[k : k + 1024]) - count[k : k + 1024], count[k : k + 1024])
            distance, at = first[of] + within, row[of]
            rows = pa.array(at)
            yield _table({
                "core": batch.column("core").take(rows), "distance": distance.astype(np.int32), "shared": shared[of],
                "ends": end_ranks(data, offsets[at] + far[at] - distance, distance - low[of]), "id": batch.column("id").take(rows),
                "v": batch.column("v").take(rows), "start": anchor[at] - distance, "asks": (batch.column("n").to_numpy() == 1)[at],
            })


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, id, v, text: id and v stand for the document; equal rows share them, and their spans."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
        F.xxhash64(F.col("doc_id").isNull(), text).alias("v"), text.alias("text"),
    )


@tidy
def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, v, spans) of the documents that lose bytes; spans are (start, end) and may overlap."""
    rows = identified(docs).filter(F.octet_length("text") >= LENGTH)
    sampled = written(rows.select("id", "v", "text").mapInArrow(_runs, "core long, whole long, id long, v long, place long"), "runs")
    cores = written(sampled.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "cores")
    met = written(sampled.join(cores, "core"), "met")
    discard(sampled)

    classes = met.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "v", "place")).alias("one"))
    classes = written(classes.select("core", "whole", "n", "one.*"), "classes")
    equal = met.join(classes.filter("n > 1").select("core", "whole"), ["core", "whole"])
    anchor, far, near = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(1023), F.col("place").bitwiseAND(1023)
    spans = [equal.select("id", "v", (anchor - far).alias("start"), (anchor - near + LENGTH).alias("end"))]

    several = classes.groupBy("core").agg(F.count("*").alias("classes")).filter("classes > 1").select("core")
    going = classes.join(written(several, "several"), "core")
    listed = going.groupBy("id", "v").agg(F.collect_list(F.struct("core", "whole", "n", "place")).alias("listed"))
    slices = rows.select("id", "v", squeezed(F.col("text")).alias("data")).join(written(listed, "listed"), ["id", "v"]).dropDuplicates(["id", "v"])
    slices = written(slices.mapInArrow(_slices, "core long, whole long, n long, id long, v long, place long, bytes binary"), "slices")

    cells = written(slices.mapInArrow(_cells, "core long, whole long, n long, id long, v long, place long, cell int, full boolean, rank long, ends long"), "cells")
    shared = doubled(cells.select("core", "whole", "cell", "rank")).withColumnRenamed("rank", "shared")
    near, far = F.col("place").bitwiseAND(1023), F.shiftright("place", 10).bitwiseAND(1023)
    starts = (F.col("cell") * CELL <= far) & (F.col("cell") * CELL + CELL > near)  # the cells that hold starts
    live = written(cells.filter(starts).drop("rank").join(shared, ["core", "whole", "cell"]), "live")
    reach = live.filter("full").groupBy("core", "cell", "shared", "ends").agg(F.count("*").alias("k"), F.min(F.struct("whole", "place")).alias("first")).filter("k > 1")
    reach = written(reach.select("core", "cell", "shared", "ends", "first"), "reach")
    judged = written(
        live.join(reach.withColumn("full", F.lit(True)), ["core", "cell", "shared", "ends", "full"], "left")
        .withColumn("gone", F.col("first").isNotNull())
        .withColumn("stands", ~F.col("gone") | (F.col("first.whole") == F.col("whole"))).drop("first"),
        "judged",
    )
    low = F.col("cell") * CELL
    spans.append(judged.filter("gone AND n = 1").select("id", "v", (anchor - low - CELL + 1).alias("start"), (anchor - low + LENGTH).alias("end")))

    asking = written(judged.filter("NOT gone AND n = 1").select("core", "cell", "shared").distinct(), "asking")
    wanted = judged.filter("stands").join(asking, ["core", "cell", "shared"]).groupBy("core", "whole").agg(F.collect_list(F.struct("cell", "shared")).alias("cells"))
    starts = slices.join(written(wanted, "wanted"), ["core", "whole"]).mapInArrow(
        _starts, "core long, distance int, shared long, ends long, id long, v long, start long, asks boolean"
    )
    starts = written(starts.withColumn("rank", F.xxhash64("distance", "shared", "ends")).drop("distance", "shared", "ends"), "starts")
    twice = starts.groupBy("core", "rank").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    last = starts.filter("asks").join(written(twice, "twice"), ["core", "rank"])
    spans.append(last.select("id", "v", "start", (F.col("start") + LENGTH).alias("end")))

    every = spans[0].unionByName(spans[1]).unionByName(spans[2])
    return written(every.groupBy("id", "v").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts that lie in data between the offsets, and the text's index."""
    inside = ~_SPACE[data]
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False  # words end with their text
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    length = np.flatnonzero(inside & ~after) - starts + 1
    at, letters = np.cumsum(length) - length, data[inside]
    hashes = np.zeros(len(starts), np.uint64)
    edges = np.unique(np.r_[np.searchsorted(at, np.arange(0, len(letters), SEGMENT)), len(at)])
    with np.errstate(over="ignore"):
        weights = _mix(np.arange(1, length.max(initial=0) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            first, n = at[a:b] - at[a], length[a:b]
            terms = _LETTERS[letters[at[a] : at[a] + n.sum()]] * weights[np.arange(n.sum()) - np.repeat(first, n)]
            hashes[a:b] = _mix(np.add.reduceat(terms, first) + n.astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def passage_runs(words: np.ndarray, owner: np.ndarray):
    """(first passage, last passage, core hash) of each run of passages that lie in one text and share their anchor."""
    parts = []
    for base in range(0, max(0, len(words) - PASSAGE + 1), SEGMENT):
        piece = words[base : base + SEGMENT + PASSAGE - 1]
        n, starts = len(piece) - SHINGLE + 1, len(piece) - PASSAGE + 1
        with np.errstate(over="ignore"):
            hashes = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + piece[k : k + n]
            hashes = _mix(_mix(hashes))
        one = np.flatnonzero(owner[base : base + starts] == owner[base + PASSAGE - 1 : base + PASSAGE - 1 + starts])
        if not len(one):
            continue
        places = anchors(hashes, PASSAGE - SHINGLE + 1)[one]
        new = np.r_[True, places[1:] != places[:-1]]
        parts.append((one[new] + base, one[np.r_[new[1:], True]] + base, hashes[places[new]].view(np.int64)))
    return [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3


def _passages(batches):
    """The runs of passages of each text: their core, the rank of all their words, and which they are."""
    for batch in batches:
        data, offsets = _bytes(batch.column("text"))
        lo = 0
        while lo < batch.num_rows:  # as many texts as SEGMENT bytes hold, but one at least
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SEGMENT, "right")) - 1)
            words, owner = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            first, last, core = passage_runs(words, owner)
            if len(first):
                view, begin = memoryview(words).cast("B"), np.searchsorted(owner, owner[first])
                whole = [rank(view[8 * a : 8 * b]) for a, b in zip(first.tolist(), (last + PASSAGE).tolist(), strict=True)]
                rows = pa.array(owner[first] + lo)
                yield _table({
                    "core": core, "whole": np.array(whole, np.int64), "id": batch.column("id").take(rows), "v": batch.column("v").take(rows),
                    "at": first - begin, "n": (last - first + 1).astype(np.int32),
                })
            lo = hi


def _each_passage(batches):
    """The passages of the listed runs, each with its rank."""
    for batch in batches:
        data, offsets = _bytes(batch.column("text"))
        for i, listed in enumerate(batch.column("listed")):
            view = memoryview(word_hashes(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]).cast("B")
            for k in range(0, len(listed), 1024):
                runs = listed.values[k : k + 1024].to_pylist()
                found = [(r["core"], rank(view[8 * j : 8 * (j + PASSAGE)]), r["lo"], r["hi"]) for r in runs for j in range(r["at"], r["at"] + r["n"])]
                yield _table({name: np.array(x, np.int64) for name, x in zip(("core", "passage", "lo", "hi"), zip(*found, strict=True), strict=True)})


@tidy
def shared_passages(docs: DataFrame) -> DataFrame:
    """(id, v) of the documents that hold PASSAGE words in a row which another document, that is another row, holds too."""
    rows = identified(docs).filter(F.octet_length("text") >= 2 * PASSAGE - 1).select("id", "v", "text")
    sampled = written(rows.mapInArrow(_passages, "core long, whole long, id long, v long, at long, n int"), "passages")
    classes = sampled.groupBy("core", "whole").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(F.struct("id", "v", "at", "n")).alias("one"))
    classes = written(classes, "classes")
    texts = sampled.filter("at = 0").select("id", "v")  # a row of each document that holds a passage
    copies = texts.groupBy("v").agg(F.count("*").alias("k")).filter("k > 1").select("v")
    equal = sampled.select("core", "whole", "v").join(classes.filter("lo < hi").select("core", "whole"), ["core", "whole"]).select("v")
    held = written(equal.unionByName(copies).distinct(), "held")

    # of texts that are not settled, all runs are of one text: their passages are compared with those of the core's other runs
    several = classes.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core")
    met = written(classes.join(written(several, "several"), "core"), "met")
    asking = met.filter("lo = hi").join(held.select(F.col("v").alias("lo")), "lo", "left_anti").select("core").distinct()
    wanted = met.join(written(asking, "asking"), "core")
    listed = wanted.groupBy("one.id", "one.v").agg(F.collect_list(F.struct("core", "lo", "hi", "one.at", "one.n")).alias("listed"))
    listed = written(listed, "listed")
    near = perhaps_in(rows, "v", id_bitmap(listed, "v")).join(listed, ["id", "v"]).dropDuplicates(["id", "v"])
    passages = written(near.select("text", "listed").mapInArrow(_each_passage, "core long, passage long, lo long, hi long"), "each")
    twice = passages.groupBy("core", "passage").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("core", "passage")
    more = passages.filter("lo = hi").join(written(twice, "twice"), ["core", "passage"]).select(F.col("lo").alias("v"))
    return texts.distinct().join(held.unionByName(more).distinct(), "v").select("id", "v")


def unions(column) -> list[list[tuple[int, int]]]:
    """Of each list of (start, end) spans, the maximal runs of the bytes that they cover."""
    values, length = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(column)), length)
    start, end = (values.field(k).to_numpy() + (row << 32) for k in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, end, out = start[order], np.maximum.accumulate(end[order]), [[] for _ in range(len(column))]
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(start) else np.zeros(0, np.int64)
    for a, b in zip(start[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist() if len(new) else (), strict=True):
        out[a >> 32].append((a & 0xFFFFFFFF, b & 0xFFFFFFFF))
    return out


def _cut(keep: bool):
    def run(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, gone in zip(batch.column("data").to_pylist(), unions(batch.column("spans")), strict=True):
                data = expand.decompress(packed) if packed else b""
                edges = [0, *[x for s in gone for x in s], len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else data
                out.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), left if keep else None, gone if keep else None))
            n_bytes, n_removed, n_spans, digest, left, gone = zip(*out, strict=True) if out else [()] * 6
            columns = {
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
            }
            if keep:
                columns |= {"kept": pa.array(left, pa.binary()), "spans": pa.array([[{"start": a, "end": b} for a, b in g] for g in gone], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
            if "shares_passage" in batch.schema.names:
                columns["shares_passage"] = batch.column("shares_passage")
            yield _table(columns)

    return run


def without_repeats(docs: DataFrame, keep: bool = True, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with keep, kept bytes and spans; with passages,
    shares_passage: 1 if it holds PASSAGE words in a row that another document holds too, repeated bytes or not, else 0."""
    marks, columns = repeated_spans(docs), ["doc_id", "data", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep:
        schema += ", kept binary, spans array<struct<start:long,end:long>>"
    if passages:
        marks = written(marks.join(shared_passages(docs).withColumn("share", F.lit(1)), ["id", "v"], "full"), "marks")
        columns, schema = [*columns, F.coalesce("share", F.lit(0)).alias("shares_passage")], f"{schema}, shares_passage int"
    rows = identified(docs).select("doc_id", "id", "v", squeezed(F.col("text")).alias("data")).join(marks, ["id", "v"], "left")
    return rows.select(*columns).mapInArrow(_cut(keep), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, whether the document holds a repeated string, and whether it shares a passage of over 50 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, keep=False, passages=True).withColumn("repeats", F.col("n_removed") > 0)
