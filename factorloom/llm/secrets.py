"""Secret scan: fixed patterns, and strings that zstandard cannot shorten near sensitive words.

A candidate is a run of 16 or more token characters that starts within REACH after a sensitive word,
on its line or the next, or ends within REACH before it on its line, and that base spans do not cover; of a run
that holds a sensitive word, what follows the word. It is judged whole; what base spans leave of it is reported. A compressor is primed with a dictionary of
identifiers and the text around the candidate; what the candidate adds to an empty frame, in bytes,
is its novelty. Words, paths and names that the surroundings or the identifiers explain cost little;
random keys cost nearly their entropy. Candidates whose novelty is at least NOVELTY of what random
strings of their alphabet and length cost, and which mix letters and digits, are reported as kind
novel. Copies of a candidate do not explain it: they are cut out of the text around. Once a string,
or the value of an assign span, is judged so, all its occurrences outside base spans are reported.

The dictionary is learnt from the corpus: names without digits (so that no key can be one of them)
that stand after a sensitive word on its line, those of most documents, at most NAMES of them, and a
fixed list of common ones.

Defined results: a null text counts as empty and has no spans; ties in start are put in the order
of KINDS; each row is judged alone, given the dictionary, so repeated rows get equal results; an empty
table gives an empty table; the time for a text is about its length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter

import ahocorasick
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, prepared, written

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace(
    "(password|passwd|secret|token|api_?key)", "((?ai:password|passwd|secret|token|api_?key))"))
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"(?ai:password|passwd|secret|token|api.?key|credential|private.?key|access.?key|bearer|authorization|signature)")
SENSITIVE_WORDS = ("passw", "secret", "token", "api", "credential", "private", "access", "bearer", "authorization", "signature")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIERS = (
    b"public static void final return string config settings environment variable value default "
    b"https://www.example.com/index.html user_name client_id session_id request response header "
    b"content-type application/json authorization bearer password secret token api_key access_key "
    b"private_key credential username database connection localhost abcdefghijklmnopqrstuvwxyz "
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx "
)
TOKEN = string.ascii_letters + string.digits + "+/_=-"
ALPHABETS = (
    "0123456789ABCDEF", "0123456789abcdef", string.digits + string.ascii_uppercase, string.digits + string.ascii_lowercase,
    string.digits + string.ascii_letters, "".join(sorted(TOKEN)),
)
LONG = 4096  # beyond, a character costs no less
NOVELTY = 0.7
AROUND = 512
REACH = 80  # characters between a word and a candidate, by default
NAMES = 1000  # of the corpus in the dictionary
NAME = r"[A-Za-z]+(?:[_/.-][A-Za-z]+)*"
LINE = r"(?i)(?:passw|secret|token|api.?key|credential|private.?key|access.?key|bearer|authorization|signature)[^\n]*"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans of a text by start, then kind: whole matches, ends exclusive, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return _ordered(found)


def _ordered(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def alphabet_of(text: str) -> str:
    return next(a for a in ALPHABETS if set(text) <= set(a))


def mixed(text: str) -> bool:
    """Letters and digits; of letters alone, a case that changes at two of five steps at least."""
    if not re.search("[A-Za-z]", text):
        return False
    changes = sum(a.islower() != b.islower() for a, b in zip(text, text[1:]) if a.isalpha() and b.isalpha())
    return bool(re.search("[0-9]", text)) or (len(text) >= 20 and 5 * changes >= 2 * len(text))


def uncovered(covered: bytearray, start: int, end: int) -> list[tuple[int, int]]:
    """The runs of start:end that are not covered."""
    out = []
    while 0 <= (low := covered.find(0, start, end)):
        high = covered.find(1, low, end)
        start = end if high < 0 else high
        out.append((low, start))
    return out


def occurrences(text: str, values) -> dict[str, list[int]]:
    """Starts of the occurrences of each value that occurs; those of long values do not overlap.

    Short values are found by one automaton. It follows chains as long as a value repeats in itself,
    so that long ones, which are few in a text, are searched one by one."""
    machine, found = ahocorasick.Automaton(), {}
    for value in values:
        if len(value) <= 256:
            machine.add_word(value, value)
            continue
        at = text.find(value)
        while at >= 0:
            found.setdefault(value, []).append(at)
            at = text.find(value, at + len(value))
    if len(machine):
        machine.make_automaton()
        for end, value in machine.iter(text):
            found.setdefault(value, []).append(end + 1 - len(value))
    return found


def copies(text: str, values, taken) -> list[tuple[str, int, int]]:
    """Occurrences of the values that meet no taken span; longer values first, then by value and place."""
    found, covered = [], covering(text, taken)
    starts = occurrences(text, values)
    for value in sorted(starts, key=lambda v: (-len(v), v)):
        free = 0
        for at in starts[value]:
            end = at + len(value)
            if at >= free and covered.find(1, at, end) < 0:
                found.append(("novel", at, end))
                covered[at:end] = b"\1" * len(value)
                free = end
    return found


def covering(text: str, spans) -> bytearray:
    covered = bytearray(len(text))
    for _, start, end in spans:
        covered[start:end] = b"\1" * (end - start)
    return covered


def candidates(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """Runs of token characters near sensitive words, each once: by word, those after it before those before it."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    starts, ends = [s for s, _ in runs], [e for _, e in runs]
    seen, out = set(), []
    for word in SENSITIVE.finditer(text):
        low, high = word.span()
        line = text.find("\n", high, high + reach + 16)
        line = text.find("\n", line + 1, high + reach + 16) if line >= 0 else -1
        stop = (line if line >= 0 else high + reach + 15) - 16  # the last start of 16 characters in reach
        k = bisect_right(ends, high)
        near = [(max(starts[k], high), ends[k])] if k < len(runs) and starts[k] < high and ends[k] - high >= 16 else []
        near += [runs[i] for i in range(bisect_left(starts, high), bisect_right(starts, stop))]
        before = range(bisect_right(ends, low - reach), bisect_left(ends, low))
        near += [runs[i] for i in before if "\n" not in text[ends[i] : low]]
        for start, end in near:
            if end not in seen:
                seen.add(end)
                out.append((start, end))
    return out


class Scanner:
    """Judges candidates by a dictionary of identifiers."""

    def __init__(self, names: bytes = b"", ratio: float = NOVELTY, reach: int = REACH):
        self.names, self.ratio, self.reach, self.costs = names + IDENTIFIERS, ratio, reach, {}

    def novelty(self, text: str, start: int, end: int, known=()) -> int:
        """Bytes that text[start:end] adds to a frame primed with identifiers and its surroundings.

        Copies of it, and those of the known values that are parts of it, are cut out of the surroundings.
        """
        own = text[start:end]
        before, after = text[max(0, start - AROUND - len(own)) : start], text[end : end + AROUND + len(own)]
        for value in (own, *[v for v in known if v in own]):
            before, after = before.replace(value, "\n"), after.replace(value, "\n")
        around = (before[-AROUND:] + "\n" + after[:AROUND]).encode("utf-8", "surrogatepass")
        primer = zstandard.ZstdCompressionDict(self.names + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_dict_id=False)
        return len(press.compress(own.encode())) - len(press.compress(b""))

    def random_cost(self, text: str) -> float:
        """Mean bytes that random strings of the text's alphabet and length cost without surroundings."""
        key = alphabet_of(text), min(len(text), LONG)
        if key not in self.costs:
            if len(self.costs) >= 10_000:
                self.costs.clear()
            rng = random.Random(key[1])
            drawn = ["".join(rng.choices(key[0], k=key[1])) for _ in range(3)]
            self.costs[key] = sum(self.novelty(x, 0, key[1]) for x in drawn) / len(drawn)
        return min(1.0, self.costs[key] / key[1]) * len(text)

    def share(self, text: str, start: int, end: int, known=()) -> float:
        """Novelty as a share of what a random string costs."""
        return self.novelty(text, start, end, known) / self.random_cost(text[start:end])

    def judged(self, text: str, base) -> list[tuple[int, int, float, bool]]:
        """(start, end, share, secret) of each candidate that base spans do not cover."""
        covered, out = covering(text, base), []
        values = [(m.start(2), m.end(2)) if k == "assign" and (m := ASSIGN.match(text, s)) else (s, e) for k, s, e in base]
        values.sort()
        for start, end in candidates(text, self.reach):
            if covered.find(0, start, end) < 0:
                continue
            reach = AROUND + end - start
            near = values[bisect_left(values, (start - reach,)) : bisect_left(values, (end + reach,))]
            share = self.share(text, start, end, {text[s:e] for s, e in near})
            out.append((start, end, share, share >= self.ratio and mixed(text[start:end])))
        return out

    def scan(self, text: str | None):
        """Base spans, all spans and judged candidates of a text."""
        text = text or ""
        base, low = base_spans(text), text.lower()
        if not any(w in low for w in SENSITIVE_WORDS):
            return base, base, []
        judged = self.judged(text, base)
        covered = covering(text, base)
        found = [("novel", *part) for s, e, _, secret in judged if secret for part in uncovered(covered, s, e)]
        # values of assign spans that occur elsewhere too are judged without their names
        places = [(m[2], m.start(2)) for k, s, _ in base if k == "assign" and (m := ASSIGN.match(text, s)) and CANDIDATE.fullmatch(m[2])]
        often = Counter({v: len(x) for v, x in occurrences(text, {v for v, _ in places}).items()})
        values = {v for v, s in places if often[v] > 1 and mixed(v) and self.share(text, s, s + len(v)) >= self.ratio}
        return base, _ordered(base + found + copies(text, values | {text[s:e] for _, s, e in found if e - s >= 16}, base + found)), judged


def all_spans(text: str | None, ratio: float = NOVELTY):
    return Scanner(ratio=ratio).scan(text)[:2]


def names_of(docs: DataFrame, n: int = NAMES) -> bytes:
    """The dictionary's names of the corpus, the most frequent last (where they cost least)."""
    lines = docs.select(F.regexp_extract_all("text", F.lit(LINE), F.lit(0)).alias("lines")).filter(F.size("lines") > 0)
    found = F.array_distinct(F.flatten(F.transform("lines", lambda x: F.regexp_extract_all(x, F.lit(NAME), F.lit(0)))))
    names = lines.select(F.explode(found).alias("name")).filter(F.char_length("name").between(4, 32))
    counted = written(names.groupBy("name").agg(F.count("*").alias("docs")).filter("docs > 1"), "names")
    rows = sorted((r.docs, r.name) for r in at_most(counted, "docs", n).collect())
    return " ".join(name for _, name in rows).encode() + b" " if rows else b""


SPAN = "array<struct<kind:string,start:int,end:int>>"
JUDGED = "array<struct<start:int,end:int,share:double,secret:boolean>>"


def secret_spans(text: Column, names: bytes = b"", ratio: float = NOVELTY, reach: int = REACH) -> Column:
    """struct(base, spans, judged) of a text column, by an Arrow-batched function."""

    @F.pandas_udf(f"base {SPAN}, spans {SPAN}, judged {JUDGED}")
    def scan(texts: pd.Series) -> pd.DataFrame:
        scanner = Scanner(names, ratio, reach)
        rows = [scanner.scan(t) for t in texts]
        as_dicts = lambda spans, keys: [dict(zip(keys, s, strict=True)) for s in spans]
        span = ("kind", "start", "end")
        return pd.DataFrame({
            "base": [as_dicts(b, span) for b, _, _ in rows], "spans": [as_dicts(a, span) for _, a, _ in rows],
            "judged": [as_dicts(j, ("start", "end", "share", "secret")) for _, _, j in rows],
        })

    return scan(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ratio: float = NOVELTY, names: int = NAMES, reach: int = REACH) -> DataFrame:
    """doc_id, base, spans and judged candidates of every row of docs(doc_id, text)."""
    prepared(docs.sparkSession)
    found = secret_spans(F.col("text"), names_of(docs, names), ratio, reach)
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.base", "found.spans", "found.judged")


def redact(text: str | None, mark: str = "[SECRET]", scanner: Scanner | None = None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for _, start, end in (scanner or Scanner()).scan(text)[1]:
        if end > at:
            out += [text[at : max(at, start)], mark] if start >= at else []
            at = end
    return "".join(out) + text[at:]


def redacted(text: Column, names: bytes = b"") -> Column:
    """The text with every run of found spans replaced by a mark; null and clean texts as they are."""

    @F.pandas_udf("string")
    def blank(texts: pd.Series) -> pd.Series:
        scanner = Scanner(names)
        return texts.map(lambda t: redact(t, scanner=scanner))

    return blank(text)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs with spans blanked in text, and n_chars, where it is a column, of the new text."""
    prepared(docs.sparkSession)
    out = docs.withColumn("text", redacted(F.col("text"), names_of(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and every candidate with its novelty as start:end:share."""
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    shares = F.transform("judged", lambda j: F.concat_ws(":", j["start"].cast("string"), j["end"].cast("string"), F.round(j["share"], 3).cast("string")))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(shares, ",").alias("novelty"),
    )


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
