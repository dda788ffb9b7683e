"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The normaliser of a model is a transducer of rules, read from the model: at each place the longest rule
that applies writes its target, and a character of no rule writes itself. Its output is the input of
the pieces' transducer, which has a state for each piece that may have been written last. Arcs read
the characters of a piece and write its id; characters of no piece write their UTF-8 bytes' ids, or the
unknown id, once for neighbours, if the model has no byte pieces. User-defined pieces of byte-pair models
are found first, leftmost and longest, are not normalised, and end what stands before them.
Weights are tropical. For byte-pair models an arc from piece p to piece t weighs 0 if merging the
characters of p and t gives back p, t, and infinity otherwise: the path of finite weight is unique
and is the byte-pair segmentation, because a sequence of pieces is one exactly if all neighbours
in it are. (The sum of byte-pair scores, which are merge ranks, would not give the library's ids.) For unigram models an arc weighs minus the score of its piece. Arcs are made as inputs
need them and kept. A text is composed with the transducer unit by unit (white space with the word
after it), which no piece crosses; results of units are kept in a bounded cache of each worker.

Defined results: a null text counts as empty, and an empty text has no pieces; decoding gives the
normalised text, in which the piece for white space reads as a space; repeated rows are encoded
each; other columns are ignored. Unknown ids read as the model's mark, so that such texts have no round trip.
Models with unused pieces, denormalisers, white space as a suffix, or user-defined pieces beside unigram
scores are an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE = 128 << 20  # bytes of units and arc weights, about, that a worker holds in each of two generations
LONG_UNIT = 64
ARC = 100  # bytes that an arc's weight takes in a dict; half of CACHE is for arcs
INFINITE = float("inf")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fields(data: bytes):
    """(number, value) of the fields of a serialized protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Recent(dict):
    """What `make` gives for the keys asked for lately: two generations of at most `room` each, of which the
    older is dropped when the younger is full. What is found in the older moves to the younger."""

    def __init__(self, make, room: int, cost):
        super().__init__()
        self.make, self.room, self.cost, self.size, self.older = make, room, cost, 0, {}

    def __missing__(self, key):
        found = self.older.pop(key, None)
        if found is None:
            found = self.make(key)
        size = self.cost(key, found)
        if size:
            if self.size >= self.room:
                self.older = dict(self)
                self.clear()
                self.size = 0
            self[key] = found
            self.size += size
        return found


def unit_cost(unit: str, ids: bytes) -> int:
    """Bytes that a unit and its ids take in a dict; long units are not held."""
    return 200 + 2 * len(unit) + len(ids) if len(unit) <= LONG_UNIT else 0


class Normaliser:
    """The rules of a model, as the double array of their sources' bytes that the model holds, and its handling of spaces."""

    def __init__(self, rules: bytes, squeeze: bool, special: re.Pattern | None):
        self.squeeze, self.special = squeeze, special
        size = int.from_bytes(rules[:4], "little")
        self.units, self.targets = np.frombuffer(rules[4 : 4 + size], "<u4").tolist(), rules[4 + size :]
        # ASCII that stands before ASCII is mapped at once, unless rules read two such characters
        found = [self.longest(bytes([c])) for c in range(128)]
        self.table = {c: target for c, (length, target) in enumerate(found) if length}
        pairs = any(self.begins(bytes([a, b])) for a in range(128) for b in range(128))
        self.part = re.compile(rb"(?s)[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*" if pairs else rb"(?s)[\x00-\x7f]+(?![\x80-\xff])|[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*")

    def nodes(self, data: bytes, at: int = 0):
        """Numbers of bytes of data from `at` on, and the places of the units that they lead to."""
        place = self.child(0) if self.units else 0
        for i in range(at, len(data) if self.units else 0):
            node = place ^ data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                return
            yield i + 1 - at, node
            place = self.child(node)

    def child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def begins(self, data: bytes) -> bool:
        """Whether the source of any rule begins with data."""
        return any(n == len(data) for n, _ in self.nodes(data))

    def longest(self, data: bytes, at: int = 0) -> tuple[int, str]:
        """The bytes that the longest rule reads from `at` on (0: no rule applies) and its target."""
        length, target = 0, ""
        for n, node in self.nodes(data, at):
            if self.units[node] & 0x100:
                start = self.units[self.child(node)] & 0x7FFFFFFF
                length, target = n, self.targets[start : self.targets.index(b"\0", start)].decode()
        return length, target

    def mapped(self, text: str) -> str:
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            part = self.part.match(data, at)[0]
            if len(part) > 1 and part[0] < 128:
                out.append(part.decode().translate(self.table))
                at += len(part)
            else:
                length, target = self.longest(data, at)
                out.append(target if length else part.decode())
                at += length or len(part)
        return "".join(out)

    def __call__(self, text: str) -> str:
        """The normalised text, without the space that the model may set before it."""
        parts = self.special.split(text) if self.special else [text]
        parts[::2] = map(self.mapped, parts[::2])
        text = "".join(parts)
        return re.sub(" +", " ", text).lstrip(" ").rstrip(" " + SPACE) if self.squeeze else text


class Transducer:
    def __init__(self, path: str, cache: int = CACHE):
        with open(path, "rb") as file:
            model = list(fields(file.read()))
        self.score, self.ids, self.bytes, self.out, self.given, self.unknown = {}, {}, {}, [], {}, None
        trainer, normal, back = (dict(fields(b"".join(v for n, v in model if n == k))) for k in (2, 3, 5))
        for number, value in model:
            if number != 1:
                continue
            piece = dict(fields(value))
            text, kind, at = piece[1].decode(), piece.get(3, 1), len(self.out)
            if kind == 6:
                self.bytes[int(text[1:-1], 16)] = at
                self.out.append(bytes([int(text[1:-1], 16)]))
                continue
            if kind == 1:
                self.ids[text] = at
                self.score[text] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif kind == 2:
                self.unknown = at
            elif kind == 4:
                self.given[text] = at
            elif kind == 5:
                raise ValueError("unused pieces are not supported")
            mark = trainer.get(44, " ⁇ ".encode())
            self.out.append(text.replace(SPACE, " ").encode() if kind in (1, 4) else mark if kind == 2 and not trainer.get(35) else b"")
        self.prefix = SPACE if normal.get(3, 1) else ""
        self.unigram = trainer.get(3, 1) == 1
        if back.get(2) or trainer.get(24) or not normal.get(5, 1) or (self.given and self.unigram):
            raise ValueError("denormalisers, white space as a suffix or kept, and user-defined pieces beside unigram scores are not supported")
        longest = sorted(self.given, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.squeeze = bool(normal.get(4, 1))
        self.normaliser = Normaliser(normal.get(2, b""), self.squeeze, self.special) if normal.get(2) or self.squeeze else None
        self.text = {at: text for text, at in self.ids.items()}
        automaton = ahocorasick.Automaton()  # finds all pieces in an input, by end, longest first
        for text, at in self.ids.items():
            automaton.add_word(text, (at, len(text)))
        automaton.make_automaton()
        self.matches = automaton.iter
        crossing = any(SPACE in t.lstrip(SPACE) for t in self.ids)
        plain = f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"
        if not self.bytes:  # unknown neighbours are one, so that units end at known characters only
            crossing, plain = crossing or SPACE not in self.ids, f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        self.unit = re.compile(r"(?s).+" if crossing else plain)
        self.lines = bool(self.bytes) and not crossing and not any("\n" in t for t in self.ids)
        self.kind = "<u2" if len(self.out) < 1 << 16 else "<u4"
        self.units = Recent(self.shortest_path, cache // 2, unit_cost)
        self.weights, self.split = Recent(self.weight, cache // 2, lambda arc, weight: ARC), {}

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Characters of text merged by the best score first, leftmost among equals, to `least` parts."""
        parts = list(text)
        while len(parts) > least:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -INFINITE), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """What the last merge of a piece joins; None for a character."""
        if piece not in self.split:
            parts = self.merged(piece, 2)
            self.split[piece] = tuple(parts) if len(parts) == 2 else None
        return self.split[piece]

    def stands(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b leaves a, b: no merge across their border is
        due before the merges that the two parts at the border take part in."""
        bound = INFINITE
        while True:
            if -self.score.get(a + b, -INFINITE) < bound and a:
                return False
            made_a, made_b = (-self.score[x] if len(x) > 1 else -1.0 for x in (a, b))
            if max(made_a, made_b) < 0:
                return True
            if made_a > made_b:
                bound, a = made_a, self.halves(a)[1]
            else:
                bound, b = made_b + 0.5, self.halves(b)[0]

    def weight(self, arc: int) -> float:
        """Of the arc numbered state * number of pieces + piece; the last state is the start."""
        state, piece = divmod(arc, len(self.out))
        if self.unigram:
            found = -self.score[self.text[piece]]
        elif state == len(self.out):
            found = 0.0 if self.merged(self.text[piece]) == [self.text[piece]] else INFINITE
        else:
            found = 0.0 if self.stands(self.text[state], self.text[piece]) else INFINITE
        return found

    def shortest_path(self, unit: str) -> bytes:
        """Ids on the lightest path that reads the unit; ties go to the longest last piece."""
        ids = []
        start = 0
        for at in range(len(unit) + 1):
            if at == len(unit) or unit[at] not in self.score:
                ids += self._path(unit[start:at])
                if at < len(unit) and self.bytes:
                    ids += [self.bytes[b] for b in unit[at].encode("utf-8", "replace")]
                elif at < len(unit) and (at == 0 or start < at):
                    ids.append(self.unknown)
                start = at + 1
        return np.array(ids, self.kind).tobytes()

    def _path(self, text: str) -> list[int]:
        weights, size = self.weights, len(self.out)
        cost, last = [0.0] + [INFINITE] * len(text), [size] + [-1] * len(text)
        for end, (piece, length) in self.matches(text):
            if not self.unigram and last[end + 1] >= 0:
                continue  # the path of finite weight is the only one
            start = end + 1 - length
            arc = last[start] * size + piece
            total = cost[start] + weights[arc]
            if total < cost[end + 1]:
                cost[end + 1], last[end + 1] = total, piece
        found, end = [], len(text)
        while end:
            found.append(last[end])
            end -= len(self.text[last[end]])
        return found[::-1]

    def encode(self, text: str) -> np.ndarray:
        if text and self.normaliser:
            text = self.normaliser(text)
            empty = not text and self.squeeze
        else:
            empty = not text
        if empty:
            return np.zeros(0, self.kind)
        text = self.prefix + text
        if self.special:
            parts = self.special.split(text.replace(" ", SPACE))
            found = [np.array([self.given[p]], self.kind).tobytes() if i % 2 else self.units_of(p) for i, p in enumerate(parts)]
            return np.frombuffer(b"".join(found), self.kind)
        return np.frombuffer(self.units_of(text), self.kind)

    def units_of(self, text: str) -> bytes:
        """Ids of the units of a normalised text."""
        if self.lines and "\n" not in text and "  " not in text and SPACE not in text[1:] and " " not in (text[:1], text[1:2], text[-1:]):
            units = text.replace(" ", " " + SPACE).split(" ")  # the units of the pattern below, sooner
        else:
            units = self.unit.findall(text.replace(" ", SPACE))
        return b"".join(map(self.units.__getitem__, units))

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def normalised(self, text: str) -> str:
        return (self.normaliser(text) if self.normaliser else text).replace(SPACE, " ")


@lru_cache(maxsize=4)
def transducer(path: str, cache: int = CACHE) -> Transducer:
    """One for each model and worker process."""
    return Transducer(path, cache)


def encode_documents(docs: DataFrame, path: str | None = None, cache: int = CACHE) -> DataFrame:
    """doc_id, ids and round_trip (decoding gives the normalised text) of every row of docs(doc_id, text).

    A smaller cache costs time and no results: workers that other stages share may need the memory."""
    path = path or model_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = transducer(path, cache)
        for batch in batches:
            ids, same = [], []
            for text in batch.column("text").to_pylist():
                found = machine.encode(text or "")
                ids.append(found)
                same.append(machine.decode(found.tolist()) == machine.normalised(text or ""))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, machine.kind), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same)],
                names=["doc_id", "ids", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of encoded(doc_id, ids)."""
    path = path or model_path()

    @F.pandas_udf("string")
    def decode(ids):
        return ids.map(lambda x: transducer(path).decode(x.tolist()))

    return encoded.select("doc_id", decode("ids").alias("text"))


def ids_digest(ids) -> str:
    return hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents: their number, SHA-256 of the ids as little-endian 32-bit integers."""

    @F.pandas_udf("string")
    def digest(ids):
        return ids.map(ids_digest)

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), digest("ids").alias("ids_sha256"), "round_trip"
    )
