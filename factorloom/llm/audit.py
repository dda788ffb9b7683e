"""How document filters interact: every order of them replayed over every document.

Each document has a set of filters that it fails. It meets every order of the filters (n! rows of a
fixed small table, broadcast: 120 for five filters), its first failure in that order is worked out,
and the steps of the order are exploded and counted by (part, order, step); tasks aggregate before
anything is shuffled, so that what is shuffled is at most n! x n rows of each part and task.

Defined results: a null text is empty, a null source is the part of the empty string; a document is a
smaller document's copy by the SHA-256 of its text; rows of one doc_id are no copies of each other, and a
null doc_id neither is nor makes a copy; a document with several labels is good or toxic if any of them says
so; repeated rows are counted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import tidy, written

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of the words
MAX_CAPITALS = 2  # per cent of the code points
WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Failures of the filters A to D on a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        100 * capitals > MAX_CAPITALS * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every document; bit k of fails is the k-th filter's failure.

    Texts are read once; what is shuffled is a hash, an id and the flags."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(text))), F.lit(0))
    rows = written(
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), bits.alias("bits")), "flags"
    )
    # tables of their own: a join reads two plain exchanges, so that the rows of a hot text can be split
    copied = written(
        rows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("hash", "least"), "copied"
    )
    marks = written(
        labels.filter("doc_id is not null").groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "marks",
    )
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    return rows.join(copied, "hash", "left").join(marks, "doc_id", "left").select(
        "part", (F.col("bits") + F.when(copy, 1 << (len(LETTERS) - 1)).otherwise(0)).alias("fails"), yes("good"), yes("toxic")
    )


def orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(order_no, filter_order, at_<letter>…, path): the step of each letter, and the letters' numbers by step, four bits each."""
    rows = []
    for no, order in enumerate(permutations(letters)):
        path = sum(letters.index(letter) << (4 * step) for step, letter in enumerate(order))
        rows.append((no, "".join(order), *[order.index(letter) + 1 for letter in letters], path))
    names = ["order_no", "filter_order", *[f"at_{letter}" for letter in letters], "path"]
    kinds = [T.IntegerType(), T.StringType(), *[T.IntegerType()] * len(letters), T.LongType()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def replayed(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order, of flags(part, fails, good, toxic).

    At most eight letters: the table of orders has len(letters)! rows."""
    if not 0 < len(letters) <= 8:
        raise ValueError("one to eight filters")
    n, table = len(letters), orders(flags.sparkSession, letters)
    met = flags.crossJoin(F.broadcast(table.drop("filter_order")))
    fails = lambda bit: F.col("fails").bitwiseAND(bit) != 0
    first = F.least(F.lit(n + 1), F.lit(n + 1), *[F.when(fails(1 << k), F.col(f"at_{letter}")) for k, letter in enumerate(letters)])
    steps = met.select(
        "part", "order_no", "fails", "good", "toxic", "path", first.alias("first"), F.explode(F.array(*[F.lit(s) for s in range(1, n + 1)])).alias("step")
    )
    bit = F.expr("shiftleft(1, cast(shiftright(path, 4 * (step - 1)) & 15 as int))")
    failing, removed = fails(bit), F.col("first") == F.col("step")
    number = lambda condition: F.count(F.when(condition, 1))
    counts = steps.groupBy("part", "order_no", "step").agg(
        number(F.col("first") > F.col("step")).alias("kept"),
        number(removed).alias("removed"),
        number(failing & (F.col("first") < F.col("step"))).alias("redundant"),
        number(F.col("fails") == bit).alias("unique_fails"),
        number(removed & F.col("good")).alias("good_lost"),
        number(removed & F.col("toxic")).alias("toxic_lost"),
    )
    named = counts.join(F.broadcast(table.select("order_no", "filter_order")), "order_no")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shapley = F.sum("removed").over(Window.partitionBy("part", letter))
    return named.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley")
    )


@tidy
def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of the five filters over docs(doc_id, text, source) and labels(doc_id, quality, toxic)."""
    return replayed(written(flagged(docs, labels), "flagged"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ORDERS = " ".join(f"JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f{k}(l{k}) ON {' AND '.join(f'l{k} <> l{j}' for j in range(1, k)) or 'true'}" for k in range(2, 6))
ORACLE_SQL = rf"""
WITH marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::int), 0) AS good, coalesce(max((toxic = 1)::int), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM texts
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM words LEFT JOIN marks USING (doc_id)
), orders AS (
  SELECT concat(l1, l2, l3, l4, l5) AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f1(l1) {_ORDERS}
), replay AS (
  SELECT part, filter_order, step, fails, good, toxic, substr(filter_order, step::int, 1) AS letter,
    CASE WHEN fails = '' THEN 6 ELSE length(regexp_extract(filter_order, '^[^' || fails || ']*')) + 1 END AS first
  FROM flags, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counts AS (
  SELECT part, filter_order, step, letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (contains(fails, letter) AND first < step) AS redundant, count(*) FILTER (fails = letter) AS unique_fails,
    count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost
  FROM replay GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counts
"""
