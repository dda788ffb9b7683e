"""Token counts by a byte-level BPE vocabulary, without making token ids.

A text is cut into pre-tokens by the vocabulary's own pattern. Each distinct pre-token of the
corpus is counted in pieces once, by the public tokenizer library, in a table of the shared folder.
A text's count is the sum over its pre-tokens: the most frequent ones (at most HEAD of at most
HEAD_CHARS characters: those above a power of two that leaves so many) are looked up in a broadcast table, all others by a join on the pre-token. Both sides of
the lookups are counted per document before they are shuffled, so no token is a row of its own.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special token's string in a text
is one token, as the library takes it; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, tidy, written

#: White space as the tokenizer's regular expressions know it (the Unicode property).
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The byte-level pre-tokenizer's pattern, which the vocabulary file names by "use_regex".
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
HEAD = 100_000
HEAD_CHARS = 64
LIMIT = 1024


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def special_strings(path: str) -> list[str]:
    """The added tokens that the library finds in raw text; others would need rules not kept here."""
    with open(path) as file:
        spec = json.load(file)
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("only plain byte-level vocabularies are counted")
    return [t["content"] for t in spec["added_tokens"]]


def pre_tokens(text: Column, specials: list[str]) -> Column:
    """All pre-tokens of a text in order; special strings are cut out before."""
    import re

    cut = "|".join(re.sub(r"([^\w])", r"\\\1", s) for s in specials) or "(?!)"
    parts = F.split(text, cut, -1)
    return F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(PATTERN), F.lit(0))))


def n_special(text: Column, specials: list[str]) -> Column:
    count = F.lit(0)
    for s in specials:
        count = count + (F.char_length(text) - F.char_length(F.replace(text, F.lit(s), F.lit("")))) / len(s)
    return F.coalesce(count, F.lit(0)).cast("long")


def count_pieces(path: str):
    """Pieces of each pre-token in a batch, by the library, one thread in each task."""

    @F.pandas_udf("int")
    def pieces(tokens: pd.Series) -> pd.Series:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = _LOADED.get(path) or _LOADED.setdefault(path, Tokenizer.from_file(path))
        out = []
        for at in range(0, len(tokens), 1000):
            batch = found.encode_batch_fast(list(tokens[at : at + 1000]), add_special_tokens=False)
            out += [len(e.ids) for e in batch]
        return pd.Series(out, dtype="int32")

    return pieces


_LOADED: dict = {}


@tidy
def token_counts(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of docs(doc_id, text)."""
    path = path or tokenizer_path()
    specials = special_strings(path)
    text = F.coalesce("text", F.lit(""))
    words = docs.select(F.explode(pre_tokens(text, specials)).alias("token"))
    distinct = words.groupBy("token").agg(F.count("*").alias("freq"))
    vocabulary = written(distinct.withColumn("pieces", count_pieces(path)("token")), "vocabulary")
    bounded = at_most(vocabulary.filter(F.char_length("token") <= HEAD_CHARS), "freq", head).select("token", "pieces").toPandas()
    known = docs.sparkSession.sparkContext.broadcast((bounded["token"].tolist(), bounded["pieces"].to_numpy("int64")))
    rows = docs.select("doc_id", text.alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        n_special(F.col("text"), specials).alias("special"), pre_tokens(F.col("text"), specials).alias("tokens"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(
        look_up(known), f"row long, doc_id {kind}, n_bytes long, n long, rare array<string>, times array<long>"
    )
    counted = written(counted, "counted")  # row numbers are settled here
    rest = (
        counted.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("freq"))
        .join(vocabulary.select("token", "pieces"), "token")
        .groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("more"))
    )
    return counted.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    )


def look_up(known):
    """Sums the known pieces of each row, and keeps its other pre-tokens with their frequencies."""

    def run(batches):
        names, pieces = known.value
        names = pa.array(names, pa.string())
        for batch in batches:
            tokens = batch.column("tokens")
            flat, ends = tokens.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))])
            at = pc.index_in(flat, value_set=names)
            rare = pc.is_null(at).to_numpy(zero_copy_only=False)
            got = np.where(rare, 0, pieces[pc.fill_null(at, 0).to_numpy(zero_copy_only=False)]) if len(pieces) else np.zeros(len(flat), "int64")
            sums = np.concatenate([[0], np.cumsum(got)])
            rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))[rare]
            table = pa.table({"r": rows, "token": flat.filter(pa.array(rare))})
            table = table.group_by(["r", "token"], use_threads=False).aggregate([([], "count_all")]).sort_by("r")
            offsets = np.searchsorted(table.column("r").to_numpy(), np.arange(batch.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.column(c).combine_chunks()) for c in ("token", "count_all")]
            n = pa.array(sums[ends[1:]] - sums[ends[:-1]] + batch.column("special").to_numpy(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), n, *lists],
                names=["row", "doc_id", "n_bytes", "n", "rare", "times"],
            )

    return run


def query(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
