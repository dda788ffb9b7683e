"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed from left to right into the
longest phrases that occur in a language's text: the automaton follows the text as long as it can, and the
phrase ends where it has no transition; that fresh start is a transition of its own, so that a step is one lookup. A language of m learnt symbols that needs c phrases for n symbols
is measured at c log2(m) / n bits a symbol; the least wins, ties go to the lesser name. Whole texts are
parsed: batches of texts step through the automata side by side, and the few longest ones one by one.

What is learnt is bounded: WINDOWS windows of WINDOW characters in all, an equal share for each language,
one at a hashed place of each of the documents of the least hashed ids; of more than WINDOWS languages those
of the least names are learnt. Each automaton is built in
a task of its own; together they have at most 2 x WINDOWS x (WINDOW + 1) states of SYMBOLS transitions of four bytes.

Only the text is an input of a prediction. Rows whose crc32(doc_id as text) mod 4 is 2 are never learnt.
The score is 1 - least / second least entropy: 0 where two languages tie, 1 if only one was learnt.

Defined results: a null text, one without a letter, and all texts where nothing could be learnt are `und` at
score 0; letters are compared in lower case, runs of other characters are one space, as are both ends of a text,
and letters beyond the most frequent ones are one symbol, which no automaton has; a null doc_id counts as the
empty text for the held-out rule; rows that share a doc_id are learnt at most once for each language;
repeated rows get equal results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import tidy, written
from .quality import held_out

WINDOWS = 256
WINDOW = 512
SYMBOLS = 64  # columns of a transition table: space, other letters, the break between windows, and letters
SPACE, OTHER, BREAK = 0, 1, 2
UNKNOWN = "und"
CHUNK = 1 << 22  # characters that a task holds at once
LANES = 8  # texts: below that many, one by one is faster than side by side
_CODES = 0x110000


@cache
def lowered() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case where that is one code point."""
    chars = [chr(i) for i in range(_CODES)]
    letters = np.fromiter((c.isalpha() for c in chars), bool, _CODES)
    small = np.arange(_CODES, dtype=np.uint32)
    for i in np.flatnonzero(letters).tolist():
        low = chars[i].lower()
        if len(low) == 1:
            small[i] = ord(low)
    return letters, small


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Symbols of the most frequent letters; every code point has one."""

    def __init__(self, letters: np.ndarray):
        is_letter, small = lowered()
        known = np.full(_CODES, OTHER, np.uint8)
        known[letters] = np.arange(BREAK + 1, BREAK + 1 + len(letters))
        self.of = np.where(is_letter, known[small], SPACE).astype(np.uint8)

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts that lie one after another, and their new ends: no text has two spaces in a row."""
        found = self.of[points]
        space = found == SPACE
        before = np.r_[False, space[:-1]]
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        before[starts[starts < len(found)]] = False
        keep = ~(space & before)
        return found[keep], np.r_[0, np.cumsum(keep)][ends]


class Automaton:
    """The suffix automaton of a list of symbols, as a table of transitions; state 0 is the root and no target."""

    def __init__(self, symbols: list[int], width: int = SYMBOLS):
        steps, link, length, last = [{}], [-1], [0], 0
        for c in symbols:
            state, at = len(steps), last
            steps.append({})
            link.append(0)
            length.append(length[last] + 1)
            while at >= 0 and c not in steps[at]:
                steps[at][c] = state
                at = link[at]
            if at >= 0:
                met = steps[at][c]
                if length[met] > length[at] + 1:
                    copy = len(steps)
                    steps.append(dict(steps[met]))
                    link.append(link[met])
                    length.append(length[at] + 1)
                    while at >= 0 and steps[at].get(c) == met:
                        steps[at][c] = copy
                        at = link[at]
                    link[met] = copy
                    met = copy
                link[state] = met
            last = state
        self.table = np.zeros((len(steps), width), np.int32)
        for state, to in enumerate(steps):
            self.table[state, list(to)] = list(to.values())
        self.table[:, BREAK] = 0  # a phrase never runs from one window into the next


class Model:
    """Automata of all languages in one table, and their parses.

    An entry is 4 times the offset of the row that follows, plus the phrases that end before it: one if a phrase
    was open and cannot go on, and one if no phrase can begin with the symbol."""

    def __init__(self, letters: np.ndarray, languages: list[str], tables: list[np.ndarray], learnt: list[int]):
        self.letters, self.languages = letters, languages
        self.bits = np.log2(np.maximum(2, np.array(learnt, float)))
        width = BREAK + 1 + len(letters)
        self.roots = np.cumsum([0, *[len(t) * width for t in tables]])[:-1].astype(np.int64)
        self.table = np.zeros(sum(t.size for t in tables), np.int32)
        for t, root in zip(tables, self.roots.tolist(), strict=True):
            none = t == 0
            ended = none * ((np.arange(len(t)) > 0).astype(np.int32)[:, None] + (t[0] == 0)[None])
            self.table[root : root + t.size] = (4 * (np.where(none, t[0], t) * width + root) + ended).reshape(-1)
        self._alphabet = None

    def __getstate__(self):
        return {**self.__dict__, "_alphabet": None}

    @property
    def alphabet(self) -> Alphabet:
        if self._alphabet is None:
            self._alphabet = Alphabet(self.letters)
        return self._alphabet

    def alone(self, symbols: bytes, state: int, count: int) -> tuple[int, int]:
        """State and phrases so far after more symbols of one text and one language."""
        table = memoryview(self.table)
        for c in symbols:
            to = table[state + c]
            count += to & 3
            state = to >> 2
        return state, count

    def phrases(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases (texts x languages) of texts that lie one after another."""
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        order = np.argsort(-(ends - starts), kind="stable")
        at, sizes = starts[order], (ends - starts)[order]
        states, counts = np.tile(self.roots, (len(at), 1)), np.zeros((len(at), len(self.roots)), np.int64)
        live = np.searchsorted(-sizes, -np.arange(1 + sizes.max(initial=0)), "left").tolist()  # texts longer than t are a prefix
        t = 0
        while (n := live[t]) >= LANES:
            to = self.table[states[:n] + symbols[at[:n] + t][:, None]]
            counts[:n] += to & 3
            states[:n] = to >> 2
            t += 1
        for row in range(live[t]):
            rest = symbols[at[row] + t : at[row] + sizes[row]].tobytes()
            for column in range(len(self.roots)):
                states[row, column], counts[row, column] = self.alone(rest, int(states[row, column]), int(counts[row, column]))
        out = np.empty_like(counts)
        out[order] = counts + (states != self.roots)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; a run of texts of up to CHUNK characters is parsed side by side."""
        names, scores, at = [], [], 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to] or "") <= CHUNK):
                held += len(texts[to] or "")
                to += 1
            part = [f" {t or ''} " for t in texts[at:to]]
            if len(part) == 1 and held > CHUNK:
                counts, some = self.long(part[0])
            else:
                symbols, ends = self.alphabet.symbols(code_points("".join(part)), np.cumsum([len(t) for t in part]))
                counts, some = self.phrases(symbols, ends), np.diff(ends, prepend=0) > 1
            found, score = self.judged(counts, some)
            names += found
            scores.append(score)
            at = to
        return names, np.concatenate([np.zeros(0), *scores])

    def long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of one very long text, a piece of CHUNK characters after another."""
        states, counts, some, before = self.roots.tolist(), [0] * len(self.roots), False, False
        for at in range(0, len(text), CHUNK):
            found = self.alphabet.of[code_points(text[at : at + CHUNK])]
            space = found == SPACE
            piece = found[~(space & np.r_[before, space[:-1]])].tobytes()
            before, some = bool(space[-1]), some or not space.all()
            for k in range(len(self.roots)):
                states[k], counts[k] = self.alone(piece, states[k], counts[k])
        return np.array([counts]) + (np.array([states]) != self.roots), np.array([some])

    def judged(self, counts: np.ndarray, some: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(some), np.zeros(len(some))
        entropy = counts * self.bits
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        if len(self.languages) == 1:
            score = np.ones(len(best))
        else:
            second = np.partition(entropy, 1, axis=1)[:, 1]
            score = 1 - least / np.maximum(second, 1e-300)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)


def windows(docs: DataFrame, total: int = WINDOWS, size: int = WINDOW) -> DataFrame:
    """(lang, window): at most `total` windows of learnable documents, an equal share for each language.

    Ids and languages alone are hashed and counted by powers of two of the hash, so that the documents that are joined are few."""
    docs = docs.select("doc_id", "text", "lang")
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 1)
    ids = written(known.select("lang", h.alias("h")).distinct(), "learnable")
    level = F.floor(F.log2(F.col("h") + 1)).cast("int")  # documents below 2^(level + 1)
    sizes = ids.groupBy("lang", level.alias("level")).agg(F.count("*").alias("n"))
    share = max(1, total // max(1, ids.select("lang").distinct().count()))
    upto = sizes.withColumn("n", F.sum("n").over(Window.partitionBy("lang").orderBy("level")))
    limit = upto.groupBy("lang").agg(F.min(F.when(F.col("n") >= share, F.col("level"))).alias("top"))
    limit = written(limit.select("lang", F.coalesce("top", F.lit(63)).alias("top")).orderBy("lang").limit(total), "limits")
    near = ids.join(limit, "lang").filter(level <= F.col("top"))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= share).select("lang", "h")
    length = F.length("text")
    spot = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.greatest(length - size + 1, F.lit(1)))
    found = known.withColumn("h", h).join(F.broadcast(written(ranked, "chosen")), ["lang", "h"])
    cut = F.substring("text", (spot + 1).cast("int"), F.lit(size))
    return written(found.groupBy("lang", "h").agg(F.min(cut).alias("window")).select("lang", "window").distinct(), "windows")


def _built(letters: np.ndarray):
    def build(group: pd.DataFrame) -> pd.DataFrame:
        alphabet, held = Alphabet(letters), [BREAK]
        for text in sorted(group["window"]):
            symbols, _ = alphabet.symbols(code_points(text), np.array([len(text)]))
            held += [*symbols.tolist(), BREAK]
        table = Automaton(held, BREAK + 1 + len(letters)).table
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "table": [table.tobytes()], "learnt": [len(held)]})

    return build


def learn(docs: DataFrame, total: int = WINDOWS, size: int = WINDOW) -> Model:
    """The model of docs(doc_id, text, lang); what reaches the driver is bounded by total and size."""
    sample = windows(docs, total, size)
    is_letter, small = lowered()
    counts = sample.select(F.explode(F.split(F.lower("window"), "")).alias("c")).groupBy("c").count().toPandas()
    letters = [(-n, ord(c)) for c, n in zip(counts["c"], counts["count"], strict=True) if len(c) == 1 and is_letter[ord(c)] and small[ord(c)] == ord(c)]
    chosen = np.array([c for _, c in sorted(letters)[: SYMBOLS - BREAK - 1]], dtype=np.int64)
    built = sample.groupBy("lang").applyInPandas(_built(chosen), "lang string, table binary, learnt int").toPandas().sort_values("lang")
    tables = [np.frombuffer(t, np.int32).reshape(-1, BREAK + 1 + len(chosen)) for t in built["table"]]
    return Model(chosen, built["lang"].tolist(), tables, built["learnt"].tolist())


def _predicted(model, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            names, scores = model.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], schema=schema)

    return run


@tidy
def identify_languages(docs: DataFrame, total: int = WINDOWS, size: int = WINDOW) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs(doc_id, text, lang)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    model = docs.sparkSession.sparkContext.broadcast(learn(docs, total, size))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = T.StructType([*rows.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predicted(model, to_arrow_schema(out)), out)


def query(spark, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
