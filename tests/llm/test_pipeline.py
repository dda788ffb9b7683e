"""The pipeline stage by stage against plain versions, and its edges."""

import collections
import os

import pytest

import corpus_pipeline
from factorloom.llm import common, media, mixing, near_dedup, pieces, quality, secrets, token_counts, warc

from .test_operators import brute_classes, corpus, documents, near_copies


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_against_plain_versions(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    key = "k7Qx9" + "ZpL3vN8tR2wY6mB4cD1f"
    texts = [*corpus(240), *near_copies(), f"the river walks under the old bridge {key} is the bearer of stone and light", None, ""]
    docs = documents(spark, texts, extra="lang")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    folder = tables(spark, f"file://{tmp_path}/sf", docs, labels)
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        outs.append(common.written(stage(spark, outs[-1] if outs else whole, folder), name.replace(" ", "_")))
    for out in outs[:-1]:
        assert out.columns == whole.columns
    good, single, blank, mix, encoded = ([r for r in out.collect()] for out in outs)
    scores = {r.doc_id: r.predicted for r in quality.score_documents(whole, labels).collect()}
    assert sorted(r.doc_id for r in good) == sorted(i for i, p in scores.items() if p == 1) and 100 < len(good)
    kept = brute_classes([texts[r.doc_id] for r in sorted(good, key=lambda r: r.doc_id)])
    ids = sorted(r.doc_id for r in good)
    assert sorted(r.doc_id for r in single) == sorted({ids[c] for c in kept.values()})
    scanner = secrets.Scanner(secrets.names_of(outs[1]))
    assert {r.doc_id: r.text for r in blank} == {r.doc_id: secrets.redact(r.text, scanner=scanner) for r in single}
    assert not any(key in (r.text or "") for r in blank)
    sizes = {r.doc_id: len((r.text or "").split()) for r in blank}
    sources = collections.Counter()
    for r in blank:
        sources[r.source] += sizes[r.doc_id]
    taken, by_source = collections.Counter(), collections.Counter()
    before = {r.doc_id: r.text for r in blank}
    for r in mix:
        taken[r.doc_id] += len(r.text.split())
        by_source[r.source] += len(r.text.split())
        assert before[r.doc_id].startswith(r.text)
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    weights = dict(zip(sorted(sources, key=lambda s: (s is None, s)), [3, 1, 2, 3], strict=False))
    goals, left, open_ = {}, 1.5 * sum(sources.values()), set(sources)
    while True:  # filling by weight under the caps
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sources[s]}
        if not full:
            break
        for s in full:
            goals[s] = 2 * sources[s]
            left -= goals[s]
        open_ -= full
    goals |= {s: level * weights[s] for s in open_}
    assert all(abs(by_source[s] - goals[s]) <= 1 for s in sources)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded) == collections.Counter((r.doc_id, tuple(library.encode(r.text))) for r in mix)
    ran = corpus_pipeline.run(spark, folder)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in ran.collect()) == collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded)


@pytest.mark.parametrize("texts", [[], [None, None, ""]])
def test_pipeline_of_nothing(spark, tmp_path, texts):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    folder = tables(spark, f"file://{tmp_path}/sf", documents(spark, texts), labels)
    assert corpus_pipeline.run(spark, folder).count() == 0  # a document without a word is never drawn


def test_empty_tables(spark):
    none = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_documents(none, labels).count() == 0 and quality.good_documents(none, labels).count() == 0
    assert pieces.encode_documents(none).count() == 0 and token_counts.token_counts(none).count() == 0
    assert near_dedup.kept_documents(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    members, matches = media.aligned(spark.createDataFrame([], "rec_id long, pcm binary, node string, key string"), common.F.col("rec_id") % 50 == 0)
    assert members.count() == 0 and matches.count() == 0
    assert warc.first_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_and_repeated_rows(spark):
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    rows = [(1, long, "s", 1.0), (1, long, "s", 2.0), (2, long + " end", "s", 3.0), (3, "x" * 300_000, None, 4.0), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    scores = collections.defaultdict(set)
    for r in quality.score_documents(docs, labels).collect():
        scores[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and quality.good_documents(docs, labels).columns == docs.columns
    assert {(r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()} == {(1, 1), (2, 1), (3, 3), (None, None)}
    counts = {r.doc_id: r.n_bytes for r in token_counts.token_counts(docs).collect()}
    assert counts[3] == 300_000 and counts[None] == 0
    encoded = pieces.encode_documents(docs).collect()
    assert len(encoded) == 5 and all(r.round_trip for r in encoded)
    assert len({tuple(r.ids) for r in encoded if r.doc_id == 1}) == 1
    assert sum(1 for _ in secrets.redacted_documents(docs).collect()) == 5


def test_media_of_long_and_clashing_columns(spark):
    words = [f"w{i * 37 % 997}" for i in range(6000)]
    rows = [(50, " ".join(words), 1), (1, " ".join(words[2000:2100]), 2), (2, " ".join(words[2000:2100]), 3)]
    df = spark.createDataFrame(rows, "rec_id long, text string, class_id long").select("rec_id", media.recordings("text").alias("pcm"), "class_id")
    members, matches = media.aligned(df, common.F.col("rec_id") % 50 == 0)
    assert {r.rec_id: r.class_id for r in members.collect()} == {50: 50, 1: 1, 2: 1}
    assert [(r.query_class, r.class_id, r.error) for r in matches.collect()] == [(50, 1, 0.0)]


def test_tidy_frees_what_it_wrote(spark):
    folder = common.shared_dir(spark).removeprefix("file:") + "/factorloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = near_dedup.classes(documents(spark, near_copies()))
    (left,) = set(os.listdir(folder)) - before
    assert left.startswith("classes-") and found.count() > 0
