"""Mix sources to target weights with DataFrame operations only.

Every source is cut into blocks by a hash of doc_id. A pass over a source takes each block once;
the last pass takes blocks in a hashed order until the source's target is met, and cuts its last
block and document there. Which output shard gets which draw is settled by a splitting tree: the
sources' quotas of draws are halved again and again, each half drawn by a multivariate
hypergeometric law, so that shards are equally large and every draw lands in exactly one shard.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of
its own, last in order; an empty table gives an empty table; rows that repeat are rows of their
own; columns other than the three named are carried along untouched by `mixed_documents` and
ignored by `mixing_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
BLOCKS = 1024  # of a source, at least
BLOCK_WORDS = 1 << 21  # of the mix's input, for each of a source's blocks beyond that
SHARD_WORDS = 1 << 21  # of the mix, for each output shard
SHARDS = 64  # at least


def power_of_two(least: int, total, each: int) -> Column:
    """The least power of two that is at least `least` and total / each."""
    return F.greatest(F.lit(least), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), total / each))))).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, which SQL engines agree on."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, repeats=MAX_REPEATS) -> DataFrame:
    """(source, source_no, source_size, target): water-filling of share by weight under the caps.

    The table has one row per source, which is what its single-partition windows sort.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(cycle, F.col("source_no") % len(weights) + 1))
        .withColumn("cap", F.lit(repeats) * F.col("source_size"))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn(
            "open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
        )
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
        .withColumn(
            "level",
            F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))).over(everything)["level"],
        )
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return ranked.select("source", "source_no", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def block_draws(sized: DataFrame, targets: DataFrame, shards: int | None = None) -> DataFrame:
    """(source, block, source_size, target, draws): draws are (pass, shard, words) of the block.

    Without a number of shards there are as many as the mix's size asks for."""
    blocks = (
        sized.groupBy("source", "block").agg(F.sum("size").alias("words")).filter("words > 0")
    )
    known = targets.withColumn("goal", F.round("target").cast("long")).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    )
    known = known.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    by_pass = Window.partitionBy("source_no", "pass").orderBy("order", "block")
    drawn = (
        blocks.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
        .join(
            known.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source"),
            ["key", "none"],
        )
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))))
        .withColumn("order", hashed(F.col("source_no"), F.col("block"), F.col("pass")))
        .withColumn("end", F.sum("words").over(by_pass))
        .withColumn("at", F.row_number().over(by_pass) - 1)
        .withColumn("left", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(
            F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("end") + F.col("words")))))
        .filter("left > 0")
        .withColumn("n_blocks", F.count(F.when(F.col("pass") == 0, 1)).over(Window.partitionBy("source_no")))
        .withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("at"))
    )
    drawn = written(drawn.drop("key", "none", "order", "end", "at", "n_blocks"), "draws")
    if shards is None:
        shards = targets.select(power_of_two(SHARDS, F.coalesce(F.sum("target"), F.lit(0.0)), SHARD_WORDS)).first()[0]
    placed = splitting_tree(drawn.groupBy("source_no").agg(F.count("*").alias("quota")), shards)
    # a row for each draw: the join's keys spread a source over all tasks
    slots = placed.select(F.col("source").alias("source_no"), "shard", F.explode(F.sequence("start", F.col("end") - 1)).alias("draw"))
    return (
        drawn.join(slots, ["source_no", "draw"])
        .groupBy("source_no", "block")
        .agg(
            F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
            F.sort_array(F.collect_list(F.struct("pass", "shard", F.col("left").alias("words"), F.col("words").alias("of")))).alias("draws"),
        )
    )


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """(source, shard, start, end): which of a source's draws each shard gets; shards are a power of two.

    A node of the tree is one row with the quotas of all sources; its left child gets half of its
    draws, source by source from the hypergeometric law of what is left, the right child the rest.
    A level is a written table, dealt out by node, so that the nodes of a level are split side by side.
    """
    depth = max(0, (shards - 1).bit_length())
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_no", "quota"))).alias("q")).select(
        F.lit(0).cast("long").alias("node"), F.transform("q", lambda x: x["source_no"]).alias("sources"), F.transform("q", lambda x: x["quota"]).alias("q")
    )
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(total.alias("n"), F.floor((total + 1) / 2).alias("m"), F.array().cast("array<bigint>").alias("got"))
        at = F.lit(level)
        left = F.aggregate("q", start, lambda acc, k: _draw(acc, k, seed, at))["got"]  # noqa: B023
        split = written(nodes.select("node", "sources", "q", left.alias("l")), "split")
        nodes = split.select("sources", F.posexplode(F.array("l", F.zip_with("q", "l", lambda a, b: a - b))).alias("side", "q"), "node").select(
            (F.col("node") * 2 + F.col("side")).alias("node"), "sources", "q")
        nodes = nodes.repartition("node") if level > 4 else nodes
    per_shard = nodes.select("node", F.explode(F.arrays_zip("sources", "q")).alias("x")).select(F.col("x.sources").alias("source"), F.col("node").alias("shard"), F.col("x.q").alias("n"))
    ends = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    return written(per_shard.withColumn("end", ends).withColumn("start", F.col("end") - F.col("n")).filter("n > 0").drop("n"), "tree")


def _draw(acc: Column, k: Column, seed: int, level: Column) -> Column:
    u = (hashed(F.lit(seed), level, F.col("node"), F.size(acc["got"])) + 0.5) / F.lit(float(2**52))
    x = hypergeometric(u, acc["n"], k, acc["m"])
    return F.struct((acc["n"] - k).alias("n"), (acc["m"] - x).alias("m"), F.concat(acc["got"], F.array(x)).alias("got"))


def let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def hypergeometric(u: Column, n: Column, k: Column, m: Column) -> Column:
    """The u-quantile of the marked among m drawn of n, k of them marked (12 deviations about the mean)."""
    n_, k_, m_ = (x.cast("double") for x in (n, k, m))
    mean = F.when(n_ > 0, m_ * k_ / n_).otherwise(0.0)
    spread = F.when(n_ > 1, F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k_ / n_) * (n_ - m_) / (n_ - 1)))).otherwise(0.0)

    def at(s):
        low = F.greatest(F.lit(0), m - (n - k), F.floor(s["mean"] - 12 * s["spread"] - 2)).cast("long")
        high = F.least(k, m, F.ceil(s["mean"] + 12 * s["spread"] + 2)).cast("long")
        return F.struct(F.least(low, high).alias("low"), high.alias("high"))

    def law(s):
        fixed = _log_factorial(k_) + _log_factorial(n_ - k_)

        def log_weight(x, f):
            return f - _log_factorial(x) - _log_factorial(k_ - x) - _log_factorial(m_ - x) - _log_factorial(n_ - k_ - m_ + x)

        logs = let(fixed, lambda f: F.transform(F.sequence(s["low"], s["high"]), lambda x: log_weight(x.cast("double"), f)))
        return let(logs, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))

    def passed(weights, goal):
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
        return F.aggregate(
            weights, start,
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["below"] + F.when(a["sum"] + x < goal, 1).otherwise(0)).alias("below")),
        )["below"]

    def drawn(s, w):
        return let(u * F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda goal: F.least(s["high"], s["low"] + passed(w, goal)))

    return let(F.struct(mean.alias("mean"), spread.alias("spread")), lambda p: let(at(p), lambda s: let(law(s), lambda w: drawn(s, w))))


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series from x + 8, taken down by the eight factors."""
    y = x + 9
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y)
    product = (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7) * (x + 8)
    return series - F.ln(product)


def blocked(rows: DataFrame, blocks: int | None) -> DataFrame:
    """rows(size, h) with their block; without a number, blocks follow the number of words."""
    if blocks is None:
        blocks = rows.select(power_of_two(BLOCKS, F.coalesce(F.sum("size"), F.lit(0)), BLOCK_WORDS)).first()[0]
    return rows.withColumn("block", F.col("h") % blocks)


@tidy
def mixing_plan(docs: DataFrame, blocks: int | None = None, shards: int | None = None, **rule) -> DataFrame:
    """Per row of docs(doc_id, source, text): size, source_size, source's target, taken and the draws of its block."""
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("h"), F.xxhash64("text").alias("tie"),
    )
    return plan_of(blocked(written(sized, "sized"), blocks), shards, **rule)


def plan_of(sized: DataFrame, shards: int | None = None, **rule) -> DataFrame:
    """The plan of rows that have doc_id, source, size, h, tie and block, and any other columns."""
    facts = written(source_targets(sized.select("source", "size"), **rule), "targets")
    draws = written(block_draws(sized.select("source", "block", "size"), facts, shards).drop("source"), "blocks")
    # the sources are a small table: Spark broadcasts it where it is small, and joins it otherwise
    named = facts.select("source", "source_no", F.col("source_size").alias("all_size"), F.col("target").alias("all_target"))
    joined = (
        sized.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
        .join(named.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source"), ["key", "none"], "left")
        .drop("key", "none")
        .join(draws.drop("source_size", "target"), ["source_no", "block"], "left")
    )
    cut = F.exists(F.coalesce("draws", F.array()), lambda d: d["words"] < d["of"])
    # only the one block of a source that is cut needs its documents in order
    inside = Window.partitionBy("source_no", "block", F.when(cut, 0).otherwise(F.xxhash64("h", "tie"))).orderBy("h", "doc_id", "size", "tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        joined.withColumn("end", F.when(cut, F.sum("size").over(inside)).otherwise(F.col("size")))
        .withColumn(
            "draws",
            F.filter(
                F.transform(
                    F.coalesce("draws", F.array()),
                    lambda d: F.struct(
                        d["pass"].alias("pass"), d["shard"].alias("shard"),
                        F.when(d["words"] == d["of"], F.col("size")).otherwise(
                            F.greatest(F.lit(0), F.least(F.col("size"), d["words"] - F.col("end") + F.col("size")))
                        ).cast("long").alias("words"),
                    ),
                ),
                lambda d: d["words"] > 0,
            ),
        )
        .withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
        .withColumnsRenamed({"all_size": "source_size", "all_target": "target"})
        .drop("h", "tie", "block", "source_no", "end")
    )


def mixed_documents(docs: DataFrame, blocks: int | None = None, shards: int | None = None, **rule) -> DataFrame:
    """The mix itself: docs' columns, a row for each draw of a document, dealt to shards and shuffled.

    A document that a target cuts keeps its first words, with the white space between them.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    sized = docs.select(
        row, "doc_id", "source", word_count(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("h"),
        F.xxhash64("text").alias("tie"),
    )
    drawn = plan_of(blocked(written(sized, "rows"), blocks), shards, **rule).select("row", "size", F.explode("draws").alias("d"))
    part = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("d.words").cast("int")), "")
    text = F.when(F.col("d.words") >= F.col("size"), F.col("row.text")).otherwise(part)
    out = {c: F.col(f"row.`{c}`") for c in names} | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return (
        drawn.repartition("d.shard").sortWithinPartitions("d.shard", F.xxhash64("row.doc_id", "d.pass"))
        .select(*[v.alias(k) for k, v in out.items()])
    )


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the shards that the tree gives a document: pass:shard:words of each draw."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    draws = F.transform("draws", lambda d: F.concat_ws(":", d["pass"].cast("string"), d["shard"].cast("string"), d["words"].cast("string")))
    return mixing_plan(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_join(draws, ",").alias("shards"))


def _sql_log_factorial(x: str) -> str:
    y = f"({x} + 9)"
    product = " * ".join(f"({x} + {i})" for i in range(1, 9))
    return f"(({y} - 0.5::DOUBLE) * ln({y}) - {y} + 0.9189385332046727::DOUBLE + 1::DOUBLE / (12 * {y}) - 1::DOUBLE / (360 * {y} * {y} * {y}) - ln({product}))"


def _sql_hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


#: The tree's draw for one node and source of an accumulator a(n, m, got, node, level) and a quota k.
_SQL_DRAW = f"""list_transform([{{'u': ({_sql_hash("'7|' || a.level || '|' || a.node || '|' || len(a.got)")} + 0.5::DOUBLE) / 4503599627370496::DOUBLE,
    'n': a.n::DOUBLE, 'm': a.m::DOUBLE, 'k': k::DOUBLE, 'mean': CASE WHEN a.n > 0 THEN a.m::DOUBLE * k / a.n ELSE 0 END}}],
  lambda s: list_transform([CASE WHEN s.n > 1 THEN sqrt(greatest(0, s.mean * (1 - s.k / s.n) * (s.n - s.m) / (s.n - 1))) ELSE 0 END],
  lambda spread: list_transform([CAST(least(s.k, s.m, ceil(s.mean + 12 * spread + 2)) AS BIGINT)],
  lambda high: list_transform([CAST(least(high, greatest(0, s.m - (s.n - s.k), floor(s.mean - 12 * spread - 2))) AS BIGINT)],
  lambda low: list_transform([list_transform(range(low, high + 1), lambda x: {_sql_log_factorial('s.k')} + {_sql_log_factorial('(s.n - s.k)')}
    - list_sum(list_transform([x::DOUBLE, s.k - x, s.m - x, s.n - s.k - s.m + x], lambda v: {_sql_log_factorial('v')})))],
  lambda logs: list_transform([list_transform(logs, lambda x: exp(x - list_max(logs)))],
  lambda w: least(high, low + len(list_filter(range(1, len(w) + 1), lambda i: list_sum(w[1:i]) < s.u * list_sum(w)))))[1])[1])[1])[1])[1])[1]"""

ORACLE_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    {_sql_hash("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents),
sized AS (
  SELECT doc_id, source, size, h, h % CAST(greatest({BLOCKS}, pow(2, ceil(log2(greatest(1, (SELECT sum(size) FROM raw) / {BLOCK_WORDS}))))) AS BIGINT) AS block FROM raw),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST(no % 3 AS INTEGER) + 1] AS wt, 2 * s AS cap FROM src),
f AS (
  SELECT *, cap / wt AS ratio,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap / wt, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filled,
    CAST(sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open,
    CAST(sum(s) OVER () AS BIGINT) AS total
  FROM w),
lv AS (
  SELECT arg_min(lvl, (ratio, no)) AS lvl
  FROM (SELECT *, (1.5::DOUBLE * total - filled) / open AS lvl FROM f) WHERE lvl <= ratio),
t AS (
  SELECT source, no, s, coalesce(least(CAST(cap AS DOUBLE), lvl * wt), CAST(cap AS DOUBLE)) AS target FROM f, lv),
g AS (
  SELECT *, CAST(round(target) AS BIGINT) AS goal,
    CASE WHEN s > 0 THEN CAST(round(target) AS BIGINT) // s ELSE 0 END AS passes FROM t),
g2 AS (SELECT *, goal - passes * s AS rest FROM g),
b AS (
  SELECT no, block, CAST(sum(size) AS BIGINT) AS words
  FROM sized JOIN g2 ON sized.source IS NOT DISTINCT FROM g2.source GROUP BY ALL HAVING sum(size) > 0),
p AS (SELECT b.*, passes, rest, unnest(range(passes + 1)) AS pass FROM b JOIN g2 USING (no)),
o AS (
  SELECT *, sum(words) OVER turn AS fin, row_number() OVER turn - 1 AS turn_no FROM p
  WINDOW turn AS (PARTITION BY no, pass ORDER BY {_sql_hash("no || '|' || block || '|' || pass")}, block ROWS UNBOUNDED PRECEDING)),
x AS (
  SELECT no, block, pass, words, CAST(CASE WHEN pass < passes THEN words ELSE greatest(0, least(words, rest - fin + words)) END AS BIGINT) AS got, turn_no FROM o),
d AS (
  SELECT *, pass * count(*) FILTER (pass = 0) OVER (PARTITION BY no) + turn_no AS draw FROM x WHERE got > 0),
quota AS (SELECT no, count(*) AS q FROM d GROUP BY no),
tree AS (
  SELECT 0 AS level, CAST(0 AS BIGINT) AS node, list(no ORDER BY no) AS nos, list(q ORDER BY no) AS q FROM quota
  UNION ALL
  SELECT level + 1, node * 2 + side, nos, CASE WHEN side = 0 THEN l ELSE list_transform(range(1, len(q) + 1), lambda i: q[i] - l[i]) END
  FROM (
    SELECT *, list_reduce(q, lambda a, k: list_transform([{_SQL_DRAW}], lambda x: {{'n': a.n - k, 'm': a.m - x, 'got': list_append(a.got, x), 'node': a.node, 'level': a.level}})[1],
      {{'n': CAST(list_sum(q) AS BIGINT), 'm': CAST((list_sum(q) + 1) // 2 AS BIGINT), 'got': CAST([] AS BIGINT[]), 'node': node, 'level': level}}).got AS l
    FROM tree WHERE level < (SELECT ceil(log2(greatest({SHARDS}, sum(target) / {SHARD_WORDS}))) FROM t)), range(2) r(side)),
leaf AS (
  SELECT node AS shard, unnest(nos) AS no, unnest(q) AS n FROM tree WHERE level = (SELECT max(level) FROM tree)),
part AS (
  SELECT no, shard, CAST(sum(n) OVER (PARTITION BY no ORDER BY shard) AS BIGINT) AS stop, n FROM leaf),
placed AS (
  SELECT d.no, d.block, d.pass, d.words, d.got, part.shard
  FROM d JOIN part ON d.no = part.no AND d.draw >= stop - n AND d.draw < stop),
r AS (
  SELECT sized.*, row_number() OVER () AS row, g2.no, g2.s, g2.target,
    CAST(sum(size) OVER (PARTITION BY g2.no, block ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin
  FROM sized JOIN g2 ON sized.source IS NOT DISTINCT FROM g2.source),
y AS (
  SELECT r.row, pass, shard, CASE WHEN got = words THEN size ELSE greatest(0, least(size, got - fin + size)) END AS n
  FROM r JOIN placed USING (no, block))
SELECT doc_id, size, s AS source_size, target, CAST(coalesce(sum(n), 0) AS BIGINT) AS taken,
  coalesce(string_agg(pass || ':' || shard || ':' || n, ',' ORDER BY pass) FILTER (n > 0), '') AS shards
FROM r LEFT JOIN y USING (row) GROUP BY r.row, doc_id, size, s, target
"""
