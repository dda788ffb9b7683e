"""The corpus operators against brute force, libraries and their contracts, on small tables."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
import zstandard

from factorloom.llm import common, media, mixing, near_dedup, pieces, quality, repeats, secrets, token_counts, vectors, warc
from factorloom.sources.shipping import ship


@pytest.fixture(scope="module", autouse=True)
def _workers(spark):
    ship(spark)


def documents(spark, texts, extra=""):
    rows = [(i, t, "src" + str(i % 3) if i % 7 else None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra or 'lang'} string")


# --- 1 ------------------------------------------------------------------------------------------
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string")


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u3", "same", "f"), (1, "u1", "same", None), (2, None, None, "f"), (5, "u5", "", "f"), (4, "http://a/b c", "é☃" * 5000, "f"), (6, "u6", "x\r\n\r\ny", "f"), (1, "u1", "same", None)]
    folder = f"file://{tmp_path}/archives"
    index = warc.write_archives(pages(spark, rows), folder, file_bytes=200)
    found = warc.read_records(index, folder, read_bytes=300).collect()
    texts = {i: (h or "").encode() for i, _, h, _ in rows}
    assert sorted(r.page_id for r in found) == sorted(i for i, *_ in rows)
    for r in found:
        first = min(i for i in texts if texts[i] == texts[r.page_id])
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        assert r.payload_bytes == len(texts[r.page_id]) and r.payload_digest == warc.digest(texts[r.page_id])
        assert r.payload == (texts[r.page_id] if first == r.page_id else None)


def test_warc_least_and_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    found = warc.read_records(warc.write_archives(pages(spark, [(1, "a", "xx", "f"), (2, "b", "xx", "f")]), folder, least=3), folder)
    assert {r.record_type for r in found.collect()} == {"response"}
    assert warc.read_records(warc.write_archives(pages(spark, []), folder), folder).count() == 0


def test_warc_reading_tasks_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 500, raising=False)
    folder = f"file://{tmp_path}/archives"
    index = warc.write_archives(pages(spark, [(i, f"u{i}", hashlib.sha256(b"%d" % i).hexdigest(), "f") for i in range(60)]), folder, file_bytes=1000)
    found = warc.read_records(index, folder, read_bytes=500)
    assert found.rdd.getNumPartitions() > 4 and found.count() == 60


def test_ranges_coalesce():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 200, 10), ("b", 0, 5), ("b", 5, 90)]
    assert list(warc.coalesced(rows, 60, 50)) == [("a", [(0, 10), (10, 10)]), ("a", [(200, 10)]), ("b", [(0, 5)]), ("b", [(5, 90)])]


# --- 2 ------------------------------------------------------------------------------------------
def test_recordings_align_at_their_offset(spark):
    words = [f"w{i * 37 % 101}" for i in range(120)]
    rows = [(50, " ".join(words)), (1, " ".join(words[30:])), (2, " ".join(words[30:])), (3, "hello there"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "rec_id long, text string").select("rec_id", media.recordings("text").alias("pcm"))
    members, matches = media.aligned(df, common.F.col("rec_id") % 50 == 0)
    assert {r.rec_id: r.class_id for r in members.collect()} == {50: 50, 1: 1, 2: 1, 3: 3, 4: None, 5: None}
    (match,) = matches.collect()
    assert (match.query_class, match.class_id, match.offset, match.error) == (50, 1, -30, 0.0)


def test_short_recordings_align(spark):
    """Parts of 16, 18 and 23 words, in the index and as queries, against all offsets."""
    words = [f"w{i * 37 % 101}" for i in range(120)]
    parts = [words[30:46], words[50:68], words[70:93], words[3:33]]
    other = [f"v{i * 31 % 97}" for i in range(90)]
    rows = [(50, words), *enumerate(parts, 1), (60, other), (100, other[20:36]), (150, other[40:58]), (200, other[60:83])]
    rows = [(i, " ".join(t)) for i, t in rows]
    df = spark.createDataFrame(rows, "rec_id long, text string").select("rec_id", media.recordings("text").alias("pcm"))
    _, matches = media.aligned(df, common.F.col("rec_id") % 50 == 0)
    prints = {i: media.fingerprint(media.rendered(t)) for i, t in rows}
    expected = set()
    for q, n in itertools.permutations(prints, 2):
        a, b = prints[q], prints[n]
        at = media.judged_offset(a, b, range(-len(a), len(b) + 1), media.VOTES, media.ERRORS) if q % 50 == 0 else None
        expected |= {(q, n, at[0])} if at else set()
    assert {(50, 1, -30), (50, 2, -50), (50, 3, -70), (50, 4, -3), (100, 60, 20), (150, 60, 40), (200, 60, 60)} <= expected
    assert {(r.query_class, r.class_id, r.offset) for r in matches.collect()} == expected


def test_thinning_keeps_one_of_common_runs():
    rng = np.random.default_rng(1)
    common_run = rng.integers(0, 2**32, media.KEEP, dtype=np.uint32)
    a, b = (np.concatenate([rng.integers(0, 2**32, k, dtype=np.uint32), common_run]) for k in (13, 40))
    assert set(media.thinned(a)[1].tolist()) & set(media.thinned(b)[1].tolist())


def test_keys_meet_on_equal_integers_only():
    """Fingerprints without a common integer share no key, whatever bits their integers differ in."""
    codes = np.random.default_rng(2).integers(0, 2**32, 40, dtype=np.uint32)
    kinds = [media.mixed(k, codes) for k in (media.THIN, media.SHORT, media.EVERY_PLACE)]
    for flip in range(1, 64):
        other = codes ^ np.uint32(flip)
        assert not set(media.posted(codes, True)[0].tolist()) & set(media.posted(other, False)[0].tolist())
        assert all(not set(a.tolist()) & set(media.mixed(k, other).tolist()) for a in kinds for k in (media.THIN, media.SHORT, media.EVERY_PLACE))
    assert len(np.unique(np.concatenate(kinds))) == 3 * len(codes)


# --- 3 ------------------------------------------------------------------------------------------
def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = [*base, *(base[:20] + 0.05 * rng.normal(size=(20, 16))), *(base[:1] + 0.03 * rng.normal(size=(80, 16))), base[3], base[3], 2 * base[4]]
    rows = [(i + 10, [float(v) for v in row], "c") for i, row in enumerate(x)]
    odd = [(1, None, "c"), (2, [], "c"), (3, [0.0] * 16, "c"), (4, [float("nan")] * 16, "c"), (5, [1.0] * 15 + [None], "c"), (6, [1.0, 2.0], "c")]
    found = {r.vec_id: r for r in vectors.linked(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cell string")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(u))
    for _ in range(len(u)):
        label = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(u))])
    for i in range(len(u)):
        r = found[i + 10]
        assert (r.n_links, r.component_id, r.kept) == (near[i].sum(), label[i] + 10, label[i] == i)
    assert all((found[i].n_links, found[i].component_id) == (0, i) for i in range(1, 7))


def test_vectors_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    one = rng.normal(size=8)
    rows = [(i, [float(v) for v in one + 1e-3 * rng.normal(size=8)]) for i in range(300)]
    monkeypatch.setattr(vectors, "BLOCK", 64)
    found = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(299, 0)}


def test_vectors_recall_at_the_threshold(spark):
    """Pairs whose cosine lies between 0.95 and 0.96, among many others: nearly all are found, and none below."""
    rng = np.random.default_rng(21)
    base, other = rng.normal(size=(2, 1500, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other -= (other * base).sum(axis=1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    cosines = rng.uniform(0.95 + 1e-9, 0.96, 1500)[:, None]
    x = np.vstack([base, cosines * base + np.sqrt(1 - cosines**2) * other])
    found = vectors.linked(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    near = x @ x.T >= 0.95 * np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(near, False)
    assert all(r.n_links <= near[r.vec_id].sum() for r in found)
    assert sum(r.n_links for r in found) >= 0.999 * near.sum()


def test_repeated_vec_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])]
    found = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_no_vectors(spark):
    assert vectors.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_calibration():
    bits, tables, _ = vectors.calibrated(50_000)
    assert bits >= 16 and tables > vectors.COUNT


# --- 4 ------------------------------------------------------------------------------------------
def corpus(n=240):
    rng = random.Random(6)
    good = ["the", "of", "and", "river", "stone", "walks", "under", "old", "bridge", "light"]
    texts = []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 60))]
        texts.append(" ".join(words) if i % 3 else " ".join(w.upper() + "!!" for w in words))
    return texts


def test_quality_learns_and_holds_out(spark):
    docs = documents(spark, [*corpus(), None, ""], extra="features")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(0, None, 0), (1, 7, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    held = [i for i in range(240) if found[i].held_out]
    assert len(held) > 30 and sum(found[i].predicted == (i % 3 > 0) for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    assert found[240].score == found[241].score
    flipped = labels.withColumn("quality", common.F.when(quality.held_out(common.F.col("doc_id")), 1 - common.F.col("quality")).otherwise(common.F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_documents(docs, flipped).collect()}
    assert all(abs(again[i] - found[i].score) < 1e-12 for i in again)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.predicted}


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(documents(spark, ["a b", None]), labels).collect()} == {0.5}


# --- 5 ------------------------------------------------------------------------------------------
def brute_classes(texts, threshold=0.8):
    sets = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = collections.Counter(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))) if words else None
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b]:
            both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if both >= threshold * either - 1e-9 and root(a) != root(b):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def near_copies():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    for k in range(40):
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(200)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(80)) for _ in range(20)]
    return [*texts, None, "", "!!!", "one two", "One, two", "one two three", *[texts[0]] * 5, "a b c d e " * 300, "a b c d e " * 299]


def test_near_dedup_equals_brute_force(spark):
    texts = near_copies()
    docs = documents(spark, texts, extra="bands")
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert found == brute_classes(texts)
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def test_near_dedup_in_several_blocks(spark, monkeypatch):
    """Copies of one text, too far from each other and from it to be linked by leaders alone."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "CELLS", 500)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    texts = [" ".join(f"w{rng.random()}" if rng.random() < rate else w for w in base) for rate in (0.01, 0.02, 0.03) for _ in range(25)]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, texts)).collect()}
    assert found == brute_classes(texts)


def test_common_units_and_forest():
    sets = [np.array(x, np.uint32) for x in ([1, 2, 3], [2, 3, 4], [], [9])]
    assert near_dedup.common_units(sets).tolist() == [[2, 2, 0, 0], [2, 2, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    linked = np.zeros((5, 5), bool)
    linked[[0, 1, 0, 2, 3, 4, 1, 2], [1, 0, 2, 0, 4, 3, 2, 1]] = True
    left, right = near_dedup.forest(linked)
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 1), (0, 2), (3, 4)]
    assert len(near_dedup.forest(np.zeros((2, 2), bool))[0]) == 0


def test_near_dedup_of_nothing_and_of_rows_without_id(spark):
    assert near_dedup.classes(documents(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(near_dedup.classes(rows).collect(), key=str) == sorted(near_dedup.classes(rows).collect(), key=str)
    assert near_dedup.kept_documents(rows).count() == 3


def test_rows_of_one_id_share_a_class(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_dedup.classes(rows).collect()} == {(3, 3), (5, 3), (7, 3)}
    rows = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_dedup.classes(rows).collect()} == {(3, 3), (5, 3)}
    assert [(r.doc_id, r.text) for r in near_dedup.kept_documents(rows).collect()] == [(3, a)]


def test_dart_agreement_is_similarity():
    rng = np.random.default_rng(8)
    shared, a, b = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    counts = np.array([900, 1100])
    times = near_dedup.dart_minhash(np.concatenate([shared, a, shared, b]), np.repeat([0, 1], counts), counts, 2000)
    assert np.isfinite(times).all() and abs((times[0] == times[1]).mean() - 800 / 1200) < 0.04


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    top = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in top.items() if k in found} and set(top) - set(found) <= {5}


# --- 6 ------------------------------------------------------------------------------------------
ODD = ["", " ", "  a   b ", " a\n\n b\t c", "ab▁c ▁", "日本語 テキスト☃🙂é̂", "x" * 3000, "a\x00b", "\n\n\n  \n", "ﬁ ½ Ａ", " \n a", "a \nb"]


def test_pieces_are_the_librarys(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(10)
    texts = ODD + ["".join(rng.choice("ab t\n 一éß☃▁.,0eéio") for _ in range(rng.randrange(1, 80))) for _ in range(400)] + [None]
    found = {r.doc_id: r for r in pieces.encode_documents(documents(spark, texts, extra="ids")).collect()}
    for i, t in enumerate(texts):
        assert found[i].ids == library.encode(t or "") and found[i].round_trip
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(documents(spark, texts))).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


# --- 7 ------------------------------------------------------------------------------------------
def test_secrets(spark):
    key = hashlib.sha256(b"k").hexdigest()
    texts = [f"password = 'hunter2hunter2' {key[:40]}", "AKIAABCDEFGHIJKL AKIAshort token: short", None, "", "é" * 9 + f' API_KEY:"{key[:10]}"', "password=token: abcdefghijk", "paſſword=abcdefghij",
             f"the signature Zx9{key[:6].upper()}qPw7LmTr5Vn2Bk8Yd end", "our token internationalization of things"]
    found = {r.doc_id: r for r in secrets.scan_documents(documents(spark, texts, extra="spans")).collect()}
    for i, t in enumerate(texts):
        base = []
        for kind, pattern, least, group in (("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)):
            base += [(kind, *m.span()) for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
        base.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert [tuple(s) for s in found[i].base] == base
        assert [s for s in found[i].spans if s.kind != "novel"] == found[i].base
    assert [s.kind for s in found[7].spans] == ["novel"] and not found[8].spans
    assert secrets.redact(texts[0]) == "[SECRET]' [SECRET]" and secrets.redact(None) is None


def test_copies_of_secrets_do_not_explain_them():
    rng = random.Random(13)
    for _ in range(20):
        key = "a1Z" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(29))
        twice = f"export the credential {key} now\nand send the bearer {key} along\nor {key} alone"
        assert [twice[s:e] for k, s, e in secrets.all_spans(twice)[1] if k == "novel"] == [key] * 3
        assert key not in secrets.redact(twice)
        assert key not in secrets.redact(f"token={key}\nAuthorization: Bearer {key}\nthen {key}")
        assert key not in secrets.redact(f"token={key}\n" + "words " * 300 + key)


def test_keys_of_small_alphabets_and_other_places():
    rng = random.Random(14)
    draw = lambda alphabet, n: "a1Z"[: 3 * (len(alphabet) > 16)] + "".join(rng.choice(alphabet) for _ in range(n))
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n in (32, 64, 80, 96, 128, 256):
        for _ in range(10):
            key = draw("0123456789ABCDEF", n)
            assert key not in secrets.redact(f"signature: {key}")
    for _ in range(10):
        key = draw(full, 30)
        for text in (f"signature{' ' * 70}{key}", f"secret:\n  {key}\n", f"{key} is the bearer", f'"credential":\n    "{key}",'):
            assert secrets.redact(text) == text.replace(key, "[SECRET]")


def test_secrets_take_time_in_proportion():
    for text in ("token" * 200_000, "token " * 100_000, "secret " + "a1B2" * 100_000, "a1B2" * 100_000 + " secret", "password=" * 50_000):
        began = time.time()
        secrets.all_spans(text)
        assert time.time() - began < 20


def test_novelty_and_recall_of_planted_keys(spark):
    """Each candidate's share equals a computation of its own; planted keys are found, words are not."""
    rng = random.Random(16)
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys, texts = [], []
    for i in range(300):
        key = "k7Q" + "".join(rng.choice(full) for _ in range(rng.choice((17, 29, 45))))
        keys.append(key)
        texts.append(f"{' '.join(rng.choice(('river', 'stone', 'bridge', 'light')) for _ in range(20))} the {rng.choice(('bearer', 'credential', 'signature'))} {key} is here")
    texts += [f"our secret internationalization_of_things{i % 3} and token-internationalization-{i}" for i in range(50)] + [None, ""]
    docs = documents(spark, texts, extra="spans")
    names = secrets.names_of(docs)
    found = {r.doc_id: r for r in secrets.scan_documents(docs).collect()}
    hits = sum(any(texts[i][s.start : s.end] == k and s.kind == "novel" for s in found[i].spans) for i, k in enumerate(keys))
    assert hits >= 0.98 * len(keys)
    assert not any(s.kind == "novel" for i in range(300, 352) for s in found[i].spans)
    for i in range(0, 350, 7):
        for j in found[i].judged:
            before, own, after = texts[i][: j.start], texts[i][j.start : j.end], texts[i][j.end :]
            around = (before.replace(own, "\n")[-512:] + "\n" + after.replace(own, "\n")[:512]).encode()
            press = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(names + secrets.IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            cost = len(press.compress(own.encode())) - len(press.compress(b""))
            assert abs(j.share - cost / secrets.Scanner(names).random_cost(own)) < 1e-9
    assert secrets.scan_documents(documents(spark, [])).count() == 0 and secrets.redacted_documents(documents(spark, [])).count() == 0
    mended = secrets.redacted_documents(docs)
    assert mended.columns == docs.columns and not any(k in (r.text or "") for r in mended.collect() for k in keys if k in (texts[r.doc_id] or "") and any(texts[r.doc_id][s.start : s.end] == k for s in found[r.doc_id].spans))


# --- 8 ------------------------------------------------------------------------------------------
def test_repeats_equal_brute_force(spark):
    rng = random.Random(11)
    base = "".join(rng.choice("abcdefgh é") for _ in range(2500))
    texts = [base, base[500:1500] + "xyz" + base[700:1400], "q" * 1500, None, "", base, "ab" * 600, base[:399], base[:400]]
    for _ in range(30):
        a = rng.randrange(2000)
        texts.append("".join(rng.choice("xyz") for _ in range(rng.randrange(300))) + base[a : a + rng.randrange(300, 900)] + base[max(0, a - 200) : a + rng.randrange(100, 500)])
    seen = collections.Counter(t[i : i + 400] for t in ((x or "").encode() for x in texts) for i in range(len(t) - 399))
    found = {r.doc_id: r for r in repeats.without_repeats(documents(spark, texts, extra="spans")).collect()}
    for i, t in enumerate((x or "").encode() for x in texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        r = found[i]
        assert (r.n_bytes, r.n_removed, bytes(r.kept), r.kept_sha256) == (len(t), gone.sum(), kept, hashlib.sha256(kept).hexdigest())
        assert r.n_spans == (np.diff(np.r_[0, gone.astype(int), 0]) > 0).sum()


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(15)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(900)) for _ in range(2))
    rows = [(1, a), (1, b), (1, a[200:700]), (None, b[:450]), (None, b[100:600]), (None, None), (2, "z" * 399)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=False).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in found) == sorted(
        [(1, 900, 500, 1), (1, 900, 600, 1), (1, 500, 500, 1), (0, 450, 450, 1), (0, 500, 500, 1), (0, 0, 0, 0), (2, 399, 0, 0)])


def test_shared_passages_under_400_bytes_equal_brute_force(spark, tmp_path):
    rng = random.Random(16)
    draw = lambda n: [rng.choice(["be", "the", "on", "hé", "x", "of"]) + str(rng.randrange(60)) for _ in range(n)]
    base, line = draw(400), draw(40)
    texts = [None, "", " ".join(base), "\n".join(base[:50]), "\t ".join(base[100:151]), "a " * 300, "a b " * 26, "b a " * 25, " ".join(base[200:250]) + "z"]
    for _ in range(40):
        k, n = rng.randrange(340), rng.randrange(48, 55)
        texts.append(" ".join(draw(rng.randrange(90)) + rng.choice([[], line]) + base[k : k + n] + draw(rng.randrange(90))))
    alone = " ".join(draw(60))
    texts += [alone + " " + alone, " ".join(draw(70)), " ".join(line + draw(30)), *[" ".join(draw(55))] * 2, *[" ".join(draw(50))] * 2]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    held = collections.defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - 50):
            held[tuple(w[k : k + 51])].add(i)
    wanted = {i for at in held.values() if len(at) > 1 for i in at}
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = repeats.query(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows if r.shares_passage} == wanted and len(rows) == len(texts)
    assert 10 < len([r for r in rows if r.shares_passage and not r.n_removed]) and len(wanted) < len(texts) - 10


def test_passages_of_texts_over_several_segments(spark, monkeypatch):
    rng = random.Random(17)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = draw(51)
    texts = ["\v".join(draw(330) + shared + draw(400)), " ".join(draw(500) + shared + draw(9)), " ".join(draw(800)), "y" * 5000 + " " + " ".join(draw(60))]
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    words = [repeats.word_hashes(d, np.array([0, len(d)])) for d in data]
    assert [len(set(w.tolist())) for w, _ in words] == [len(set(t.split())) for t in texts]
    for w, owner in words:
        first, last, _ = repeats.passage_runs(w, owner)
        assert first[0] == 0 and last[-1] == len(w) - 51 and (first[1:] == last[:-1] + 1).all()
    monkeypatch.undo()
    assert sorted(r.id for r in repeats.shared_passages(documents(spark, texts)).collect()) == [0, 1]


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(documents(spark, [])).count() == 0


# --- 9 ------------------------------------------------------------------------------------------
def test_token_counts_are_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(token_counts.tokenizer_path())
    texts = [*ODD, None, "a <|endoftext|> x<|endoftext|><|endoftext|>", "don't 12٣½ 'LL", "\x1c\x1d a　b ​ c\x85d", "<|endoftext|", *corpus(30)]
    for head in (0, 20):
        found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(documents(spark, texts, extra="token"), head=head).collect()}
        assert found == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert token_counts.token_counts(documents(spark, [])).count() == 0


# --- 10 -----------------------------------------------------------------------------------------
def test_mixing(spark):
    rng = random.Random(12)
    texts = [" ".join("w" for _ in range(rng.randrange(1, 90))) for _ in range(300)] + [None, "", " \t "]
    docs = documents(spark, texts, extra="draws")
    found = mixing.mixing_plan(docs, blocks=16, shards=8).collect()
    by_source = collections.defaultdict(list)
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        by_source[r.source].append(r)
    for rows in by_source.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1 and rows[0].source_size == sum(r.size for r in rows)
        assert rows[0].target <= 2 * rows[0].source_size + 1e-6
    assert abs(sum(rows[0].target for rows in by_source.values()) - 1.5 * sum(r.size for r in found)) < 1e-6
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixing_plan(docs, blocks=16, shards=8).collect()))
    mix = mixing.mixed_documents(docs, blocks=16, shards=8)
    words = collections.Counter()
    for r in mix.collect():
        words[r.doc_id] += len(r.text.split())
    assert mix.columns == docs.columns and words == collections.Counter({r.doc_id: r.taken for r in found if r.taken})
    assert mixing.mixing_plan(documents(spark, [])).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = {0: 17, 1: 400, 2: 3}
    rows = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "source_no long, quota long"), 128).collect()
    shards = collections.Counter()
    for source, quota in quotas.items():
        parts = sorted((r.start, r.end) for r in rows if r.source == source)
        assert parts[0][0] == 0 and parts[-1][1] == quota and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    for r in rows:
        shards[r.shard] += r.end - r.start
    assert len(shards) == 128 and max(shards.values()) - min(shards.values()) <= 1


def test_draws_stand_for_hypergeometric_counts(spark):
    """Means of many draws of the quantile function against m k / n."""
    rows = spark.range(4000).select(mixing.hypergeometric((common.F.col("id") + 0.5) / 4000, *[common.F.lit(v).cast("long") for v in (60, 18, 25)]).alias("x"))
    mean, spread = rows.agg(common.F.avg("x"), common.F.var_pop("x")).first()
    assert abs(mean - 25 * 18 / 60) < 0.01 and abs(spread - 25 * 0.3 * 0.7 * 35 / 59) < 0.05


def test_mixing_of_shared_ids_and_long_texts(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d " * 50_000, "s"), (None, "x y", None), (2, None, None), (3, "k " * 9, "t")]
    plan = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=4, shards=4).collect()
    assert len(plan) == len(rows) and all(0 <= r.taken <= 2 * r.size and sum(d.words for d in r.draws) == r.taken for r in plan)
    totals = {r.source: (r.target, 0) for r in plan}
    for r in plan:
        totals[r.source] = (r.target, totals[r.source][1] + r.taken)
    assert all(abs(a - b) <= 1 for a, b in totals.values())
