"""Audio fingerprints of media columns, and alignment of recordings by them.

A recording is a column of 16-bit PCM. Frames are turned into the energies of the twelve pitch
classes. Sixteen filters, each the log ratio of two areas of a window of sixteen frames, are read
off the integral image of the frames; each gives two bits, so that a window is a 32-bit integer.

Recordings with equal fingerprints are one class. To align, queries meet the index on every pair of
neighbouring integers, on the one integer of recordings of a single window, and on VOTES integers at
one offset of fingerprints thinned by keeping the least hashed integer of every KEEP neighbours. Of a
pair of classes that meets, the equal integers at each offset met are counted in full. Offsets with
VOTES of them (or as many as the shorter recording has windows) are judged by the share of different
bits over the overlap. So no run of two equal windows is missed, nor a contained single window.

The tables hold no audio, so the query renders each turn of `conversations` as a recording of its
words, two tones a word. Queries are the rows with conv_id divisible by 50, the index is all rows.

Defined results: a null or empty text is an empty recording, which has no fingerprint and matches
nothing; recordings shorter than a window are padded with silence; of the offsets within the errors
the one with the most equal windows is taken, then the least; rows that repeat share a class; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_bitmap, perhaps_in, tidy, written

RATE = 4096
FRAME = 256
WINDOW = 16
KEEP = 8
VOTES = 2
ERRORS = 0.2
EVERY = 50


def pitches(n: int = 24) -> np.ndarray:
    """Frequencies of n semitones from 440 Hz."""
    return 440.0 * 2 ** (np.arange(n) / 12)


def rendered(text: str | None) -> bytes:
    """PCM of a text: a frame with two tones for each word, by the word's checksum."""
    sums = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in (text or "").split()], np.int64)
    tones = np.sin(2 * np.pi * pitches()[:, None] * np.arange(FRAME) / RATE)
    return ((tones[sums % 24] + 0.6 * tones[sums // 24 % 24]) * 8000).astype("<i2").tobytes()


def chroma(pcm: bytes) -> np.ndarray:
    """Energies of the twelve pitch classes in each frame, as shares of the frame's energy."""
    samples = np.frombuffer(pcm, "<i2")
    frames = samples[: len(samples) // FRAME * FRAME].reshape(-1, FRAME).astype(np.float32)
    bins = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = np.flatnonzero((bins >= 400) & (bins <= 1800))
    classes = np.rint(12 * np.log2(bins[heard] / 440)).astype(int) % 12
    table = np.zeros((len(heard), 12), np.float32)
    table[np.arange(len(heard)), classes] = 1
    energy = (np.abs(np.fft.rfft(frames, axis=1)[:, heard]) ** 2).astype(np.float32) @ table
    return energy / np.maximum(energy.sum(axis=1, keepdims=True), 1e-9)


def filters(seed: int = 29):
    """Sixteen pairs of areas (frame from, to, class from, to): halves in time or pitch, or a middle."""
    rng, out = np.random.default_rng(seed), []
    for k in range(16):
        width, low = (4, 8, 12, 16)[k % 4], int(rng.integers(0, 9))
        height, start = int(rng.integers(2, 13 - low)), int(rng.integers(0, WINDOW - width + 1))
        whole = (start, start + width, low, low + height)
        if k % 3 == 0:
            parts = ((start, start + width // 2, low, low + height), (start + width // 2, start + width, low, low + height))
        elif k % 3 == 1:
            parts = ((start, start + width, low, low + height // 2), (start, start + width, low + height // 2, low + height))
        else:
            parts = ((start + width // 4, start + width - width // 4, low, low + height), whole)
        out.append(parts)
    return out


def fingerprint(pcm: bytes | None) -> np.ndarray:
    """A 32-bit integer for each window of WINDOW frames."""
    image = chroma(pcm or b"")
    if not len(image):
        return np.zeros(0, np.uint32)
    image = np.vstack([image, np.zeros((max(0, WINDOW - len(image)), 12), np.float32)])
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(len(image) - WINDOW + 1)

    def area(box):
        t0, t1, p0, p1 = box
        return integral[at + t1, p1] - integral[at + t0, p1] - integral[at + t1, p0] + integral[at + t0, p0]

    out = np.zeros(len(at), np.uint32)
    for a, b in filters():
        value = np.log((0.1 + area(a)) / (0.1 + area(b)))
        level = np.searchsorted([-0.4, 0.0, 0.4], value).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    return out


def fingerprints(pcm: Column) -> Column:
    """The packed fingerprint of each recording of a binary column."""

    @F.pandas_udf("binary")
    def prints(recordings: pd.Series) -> pd.Series:
        return recordings.map(lambda x: fingerprint(x).astype("<u4").tobytes())

    return prints(pcm)


def recordings(text: Column) -> Column:
    @F.pandas_udf("binary")
    def render(texts: pd.Series) -> pd.Series:
        return texts.map(rendered)

    return render(text)


def thinned(codes: np.ndarray):
    """Places and values of the least hashed integer of every KEEP neighbours."""
    order = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    width = min(KEEP, len(codes))
    views = np.lib.stride_tricks.sliding_window_view(order, width)
    places = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return places, codes[places]


THIN, PAIR, SHORT, EVERY_PLACE = range(4)


def mixed(kind: int, *codes: np.ndarray) -> np.ndarray:
    """A 64-bit key of a kind of posting and its integers.

    The kind lies above the bits of the first integer, so that keys of one integer differ if kind or integer do.
    """
    out = np.full(len(codes[0]), (kind + 1) << 32, np.uint64)
    for x in codes:
        out = (out ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def posted(codes: np.ndarray, asks: bool):
    """Keys, places and kinds of a fingerprint in the index, or of a query that meets it.

    A recording of a single window meets every place of another, so that the two kinds of key are
    swapped in queries.
    """
    where, thin = thinned(codes)
    short, every = (EVERY_PLACE, SHORT) if asks else (SHORT, EVERY_PLACE)
    all_places = np.arange(len(codes))
    parts = [(THIN, where, mixed(THIN, thin)), (PAIR, all_places[:-1], mixed(PAIR, codes[:-1], codes[1:])), (every, all_places, mixed(every, codes))]
    if len(codes) == 1:
        parts.append((short, all_places, mixed(short, codes)))
    kinds = np.concatenate([np.full(len(p), k, np.int32) for k, p, _ in parts])
    return np.concatenate([x for _, _, x in parts]), np.concatenate([p for _, p, _ in parts]).astype(np.int32), kinds


def _postings(batches, asks: bool):
    for batch in batches:
        nodes, rows = [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for node, packed in zip(batch.column("node").to_pylist(), batch.column("print").to_pylist(), strict=True):
            rows.append(posted(np.frombuffer(packed, "<u4"), asks))
            nodes.append(np.full(len(rows[-1][0]), node, np.int64))
        columns = [np.concatenate(nodes), *[np.concatenate(x) for x in zip(*rows, strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["node", "key", "place", "kind"])


def postings_of(nodes: DataFrame, asks: bool) -> DataFrame:
    return nodes.select("node", "print").mapInArrow(lambda batches: _postings(batches, asks), "node long, key long, place int, kind int")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int):
    """Share of different bits where b, put off by offset, overlaps a; and the number of windows."""
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    if end <= start:
        return 1.0, 0
    x = np.ascontiguousarray(a[start:end] ^ b[start + offset : end + offset])
    return float(np.bitwise_count(x).mean() / 32), int(end - start)


def equal_windows(a: np.ndarray, b: np.ndarray, offset: int) -> int:
    """How many windows are equal where b, put off by offset, overlaps a."""
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    return int((a[start:end] == b[start + offset : end + offset]).sum()) if end > start else 0


def judged_offset(a: np.ndarray, b: np.ndarray, offsets, votes: int, errors: float):
    """(offset, votes, error, overlap) of the most votes, then the least offset, or None if none is within the errors."""
    least = min(votes, len(a), len(b))
    for count, back in sorted(((equal_windows(a, b, o), -o) for o in offsets), reverse=True):
        if count < least:
            break
        error, overlap = bit_errors(a, b, -back)
        if error <= errors:
            return -back, count, error, overlap
    return None


def _judge(batches, votes: int, errors: float):
    for batch in batches:
        rows = []
        for query, node, a, b, offsets in zip(*[batch.column(c).to_pylist() for c in ("query", "node", "left", "right", "offsets")], strict=True):
            found = judged_offset(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), offsets, votes, errors)
            rows += [(query, node, *found)] if found else []
        names, types = ["query", "node", "offset", "votes", "error", "overlap"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def aligned(media: DataFrame, queries: Column, votes: int = VOTES, errors: float = ERRORS) -> tuple[DataFrame, DataFrame]:
    """Of media(rec_id, pcm): (rec_id, class_id), and matches between classes.

    matches: query_class, class_id, offset, votes, error, overlap; query classes are those with a
    row for which the `queries` condition on rec_id holds. Class ids are the least rec_id.
    """
    prints = written(media.select("rec_id", fingerprints(F.col("pcm")).alias("print")), "prints").withColumn("key", F.sha2("print", 256))
    real = prints.filter(F.octet_length("print") > 0)
    grouped = real.groupBy("key").agg(F.min("rec_id").alias("class_id"), F.max(queries).alias("asks"), F.min("print").alias("print"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    asked = written(postings_of(nodes.filter("asks"), True).select(F.col("node").alias("query"), "key", F.col("place").alias("at")), "asked")
    postings = written(perhaps_in(postings_of(nodes, False), "key", id_bitmap(asked, "key")), "postings")
    weight = F.when(F.col("kind") == THIN, 1).otherwise(votes)  # what other kinds meet is counted in full below
    counted = (
        asked.join(postings, "key").filter("query <> node")
        .groupBy("query", "node", (F.col("place") - F.col("at")).alias("offset")).agg(F.sum(weight).alias("weight")).filter(F.col("weight") >= votes)
    )
    best = written(counted.groupBy("query", "node").agg(F.collect_list("offset").alias("offsets")), "best")
    both = best.join(nodes.select(F.col("node").alias("query"), F.col("print").alias("left")), "query").join(nodes.select("node", F.col("print").alias("right")), "node")
    judged = both.select("query", "node", "offsets", "left", "right").mapInArrow(
        lambda batches: _judge(batches, votes, errors), "query long, node long, offset int, votes long, error double, overlap long"
    )
    ids = nodes.select("node", "class_id")
    matches = judged.join(ids, "node").join(ids.select(F.col("node").alias("query"), F.col("class_id").alias("query_class")), "query").select(
        "query_class", "class_id", "offset", "votes", "error", "overlap"
    )
    members = prints.select("rec_id", "key").join(nodes.select("key", "class_id"), "key", "left").select("rec_id", "class_id")
    return members, matches


@tidy
def query(spark, sf_dir: str) -> DataFrame:
    """Every turn with its class, the length of its fingerprint and, for query classes, its matches.

    n_matches counts the recordings of other classes that align with the class (copies of its own
    class are not matches); best_* is the match of the fewest bit errors, then of the least id.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    media = turns.select(F.struct("conv_id", "turn").alias("rec_id"), recordings(F.col("text")).alias("pcm"))
    asks = lambda rec: F.coalesce(rec["conv_id"] % EVERY == 0, F.lit(False))
    members, matches = aligned(media, asks(F.col("rec_id")))
    members = written(members, "members")
    known = members.filter("class_id IS NOT NULL")
    sizes = written(known.groupBy("class_id").agg(F.count("*").alias("members"), F.max(asks(F.col("rec_id"))).alias("asks")), "sizes")
    best = (
        matches.join(sizes, "class_id").groupBy("query_class")
        .agg(F.sum("members").alias("found"), F.min(F.struct("error", "class_id", "offset", "overlap")).alias("best"))
        .withColumnRenamed("query_class", "class_id")
    )
    facts = written(sizes.join(best, "class_id", "left"), "facts")
    return members.join(facts, "class_id", "left").select(
        "rec_id.conv_id", "rec_id.turn", F.col("class_id.conv_id").alias("class_conv_id"), F.col("class_id.turn").alias("class_turn"),
        F.coalesce("members", F.lit(0)).alias("n_copies"), F.coalesce("asks", F.lit(False)).alias("is_query"), F.coalesce("found", F.lit(0)).alias("n_matches"),
        F.col("best.class_id.conv_id").alias("best_conv_id"), F.col("best.class_id.turn").alias("best_turn"),
        F.col("best.offset").alias("best_offset"), F.col("best.error").alias("best_error"),
    )
