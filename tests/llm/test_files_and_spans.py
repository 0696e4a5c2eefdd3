"""Archives, packing, repeated strings, passages and the pipeline."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from models import best_fit, copies, near_groups, quality, repeated_bytes, runs, similar_lines, without_lines

import corpus_pipeline
from footfall.llm import packing, passages, suffix_repeats, tokens, warc_segments
from footfall.llm.tokens import WordTokenizer
from footfall.session import scratch_path
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, digest string"


def test_archives_round_trip(spark):
    rnd = random.Random(2)
    big = "".join(rnd.choice("abcé\n\r ") for _ in range(70_000))
    rows = [(1, "http://a/", big, ""), (2, None, big, ""), (3, "u\nv", None, ""), (4, "http://b/", "x" * 1000, ""), (5, "http://b/", "x" * 1000, ""), (6, "http://c/", "x" * 999, ""),
            (7, "http://c/", "x" * 999, ""), (8, "http://d/", "WARC/1.1\r\n\r\n0\r\n\r\n", ""), (None, "http://e/", "x" * 1000, ""), (9, "", "", ""), (1 << 60, "h", big, "")]
    path = scratch_path(spark, "warc")
    warc_segments.write_archives(spark.createDataFrame(rows, PAGES), path)
    records = warc_segments.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 2
    pages = warc_segments.reassemble(records)
    by_page = {r.page_id: r for r in pages.collect()}
    assert by_page[1 << 60].payload == big.encode() and by_page[8].payload == rows[7][2].encode()
    best = {}
    for i, _, html, _ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            best[html] = max(i, best.get(html, i))
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        again = i is not None and best.get(html, i) != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[html] if again else None, None))
    assert sorted(map(repr, map(tuple, warc_segments.page_digests(pages).collect()))) == sorted(map(repr, want))


def test_broken_archives_are_told(spark):
    rows = [(i, "u", chr(96 + i) * 60_000, "") for i in range(1, 4)]
    path = scratch_path(spark, "warc")
    warc_segments.write_archives(spark.createDataFrame(rows, PAGES), path)
    records = warc_segments.read_records(spark, path)
    origin = F.coalesce("origin_id", "record_id")
    lost = records.where(~(origin.startswith("urn:page:1:") & (F.col("segment") == 2)))
    short = lost.withColumn("block", F.when(origin.startswith("urn:page:2:") & (F.col("segment") == 2), F.lit(b"")).otherwise(F.col("block")))
    twice = short.unionByName(short.where("segment = 3"))
    assert {r.page_id: r.problem for r in warc_segments.reassemble(twice).collect()} == {1: "missing_segment", 2: "wrong_length", 3: None}
    assert warc_segments._decoded(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab") is None


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc_segments.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc_segments.page_digests(warc_segments.reassemble(warc_segments.read_records(spark, path))).count() == 0


def test_word_by_word_ids_are_those_of_the_text():
    words = WordTokenizer()
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "the", " ", " ", "\n", "é", "'s", "12", "\t", "\u00a0", "<|endoftext|>", "Ġ", "🙂", "x" * 70]) for _ in range(rnd.randrange(40))) for _ in range(600)]
    assert words.ids(texts) == words._encode(texts) == words.ids(texts)


@pytest.mark.parametrize("kept", [250_000, 50])
def test_ids_of_parts_are_those_of_the_text(monkeypatch, kept):
    monkeypatch.setattr(tokens, "CACHE_PARTS", kept)
    monkeypatch.setattr(tokens, "BUFFER", 700)
    words = WordTokenizer()
    assert words.splits
    rnd = random.Random(14)
    bits = ["a", "The", " ", " b", "\n", "é", "ſ×÷", "'ll", "'", "7", ".", "$$$", "<|endoftext|>", "–", "ж", "\u0085", "\u00a0", "\r", "\x1c", "Ç?", "\n\n", "\x00", "Y" * 70, "\u0301", "½", "_-"]
    texts = ["".join(rnd.choices(bits[: rnd.randrange(3, 27)], k=rnd.randrange(12))) for _ in range(4000)]
    assert words.ids(texts) == words._encode(texts) == words.ids(texts)
    words.splits = False
    words.known, words.before = {}, {}
    assert words.ids(texts) == words._encode(texts)


def test_words_that_differ_in_signs_are_encoded_once(monkeypatch):
    words, size = WordTokenizer(), []
    plain = words._encode
    monkeypatch.setattr(words, "_encode", lambda texts: size.append(sum(map(len, texts))) or plain(texts))
    rnd = random.Random(3)
    stems = ["".join(rnd.choices("abcdeü", k=12)) for _ in range(50)]
    text = " ".join(s + tail for s in stems for tail in ["", ",", ".", "!!", "$$$", ".\nIn", ".\nOr"])
    assert words.ids([text]) == plain([text])
    assert 4 * sum(size) < len(text)


@pytest.mark.parametrize("sweep_rows", [200_000, 40])
def test_packing_is_gapless_and_tight(spark, monkeypatch, sweep_rows):
    monkeypatch.setattr(packing, "SWEEP_ROWS", sweep_rows)
    rnd = random.Random(6)
    sizes = [rnd.choice([rnd.randrange(1, 101), rnd.randrange(1, 20), 7, 50]) for _ in range(900)]
    placed = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, size int"), 100).collect()
    assert sorted(r.id for r in placed) == list(range(len(sizes)))
    rows = defaultdict(list)
    for r in placed:
        rows[r.sequence_id].append((r.offset, sizes[r.id]))
    for row in rows.values():
        at = 0
        for offset, size in sorted(row):
            assert offset == at
            at += size
        assert at <= 100
    assert len(rows) <= 1.03 * best_fit(sizes, 100) + 1


def test_pieces(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "word " * 2500, 9), (None, "a b", 9), (1, None, 9), ((1 << 60) + 1, "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = packing.packed_pieces(packing.token_pieces(docs)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.length for r in by[1]] == [1, 1] and [r.length for r in by[2]] == [1] and len(by[(1 << 60) + 1]) == len(by[None]) == 1
    long = sorted(by[3], key=lambda r: r.piece)
    assert [r.length for r in long][1:] == [1024] * (len(long) - 1) and [r.start for r in long] == [sum(x.length for x in long[:k]) for k in range(len(long))]
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in long])
    assert ids[-1] == 2 and ids[:-1].tolist() == WordTokenizer().tokenizer.encode(rows[2][1], add_special_tokens=False).ids
    assert packing.packed_pieces(packing.token_pieces(docs.limit(0))).count() == 0


@pytest.mark.parametrize("bucket_rows", [500_000, 300])
def test_repeats_are_the_model(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(suffix_repeats, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(30), text(16)
    docs = [text(40) + passage + text(rnd.randrange(30)) for _ in range(20)] + [text(20) + other[: rnd.randrange(30, 90)] + text(5) for _ in range(20)]
    docs += [docs[0], docs[0], "", None, "ab" * 400, "xyz", passage[:41], text(300)]
    rows = [(i, t, 1) for i, t in enumerate(docs)] + [(0, docs[0], 1), (None, passage, 1), (1, "q" + passage, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = suffix_repeats.without_repeats(frame, span=40, window=25).collect()
    data = [(r[1] or "").encode() for r in rows]
    want = sorted(repr((r[0], runs(m), bytes(np.frombuffer(t, np.uint8)[~m]))) for r, t, m in zip(rows, data, repeated_bytes(data, 40)))
    assert sorted(repr((r.doc_id, [(x.low, x.high) for x in r["__runs"]], bytes(r["__kept"]))) for r in got) == want
    assert suffix_repeats.without_repeats(frame.limit(0)).count() == 0


def test_multikey_order_sorts():
    rnd = np.random.default_rng(0)
    tokens = [rnd.integers(0, 5, 20_000), rnd.integers(0, 1000, 20_000)]
    order = suffix_repeats.multikey_order(tokens)
    assert sorted(order.tolist()) == list(range(20_000))
    pairs = list(zip(tokens[0][order].tolist(), tokens[1][order].tolist()))
    assert pairs == sorted(pairs)


def test_compact_windows_are_the_tree():
    values = np.random.default_rng(1).permutation(200).astype(np.uint64)
    want = set()
    for low in range(200):
        for high in range(low + 11, 200):
            at = low + int(values[low : high + 1].argmin())
            a, b = low, high
            while a and values[a - 1] > values[at]:
                a -= 1
            while b < 199 and values[b + 1] > values[at]:
                b += 1
            want.add((a, at, b))
    assert set(passages.compact_windows(values, 12)) == want


@pytest.mark.parametrize("task_rows", [500_000, 60])
def test_passages_are_found(spark, monkeypatch, task_rows):
    monkeypatch.setattr(passages, "TASK_ROWS", task_rows)
    rnd = random.Random(12)
    fresh = lambda n: [f"w{rnd.randrange(100_000)}" for _ in range(n)]
    shared, edited = fresh(54), fresh(160)
    docs = {i: fresh(200) for i in range(60)}
    for i in range(10):
        docs[i] = fresh(rnd.randrange(60)) + shared + fresh(rnd.randrange(60))
    for i in range(10, 16):
        w = list(edited)
        w[80 + i % 3] = f"e{i}"
        docs[i] = fresh(50) + w + fresh(20)
    docs[20] = docs[21] = fresh(90)
    rows = [(i, " ".join(w), 1) for i, w in docs.items()] + [(100, None, 1), (101, "", 1), (102, "la " * 5000, 1), (20, " ".join(docs[20]), 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    by = defaultdict(list)
    for r in passages.near_duplicate_passages(frame).collect():
        by[r.doc_id].append(r)
    assert {i for i in by if i != 102} == {*range(16), 20, 21}
    assert {r.class_id for i in range(10) for r in by[i]} == {0} and {r.class_id for i in range(10, 16) for r in by[i]} == {10} and by[21][0].class_id == 20
    for i in range(10):
        start = docs[i].index(shared[0])
        assert any(abs(r.start_word - start) <= 5 and abs(r.end_word - start - 54) <= 5 for r in by[i])
    assert passages.near_duplicate_passages(frame.limit(0)).count() == 0


def test_pipeline_is_the_model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i: r.text for i, r in rows.items() if quality(r.text)[-1] == 0}
    gone = similar_lines(kept)
    cut = {i: without_lines(t, gone[i]) for i, t in kept.items()}
    groups = near_groups(cut)
    first = {i: t for i, t in cut.items() if groups[i][1] == i}
    taken, _ = copies([(i, t, rows[i].source) for i, t in first.items()])
    out = corpus_pipeline.run(spark, small).collect()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "mixing sources", "best-fit packing"]
    tokens = WordTokenizer()
    want = defaultdict(int)
    for i, n in taken.items():
        size = len(tokens.ids([first[i]])[0]) // 4 + 1
        for piece in range(-(-size // 1024)):
            want[i, piece] += n
    got, rows_of = defaultdict(int), defaultdict(list)
    for r in out:
        got[r.doc_id, r.piece] += 1
        rows_of[r.sequence_id].append((r.offset, r.length))
    assert got == {k: n for k, n in want.items() if n}
    for row in rows_of.values():
        assert sum(n for _, n in row) <= 1024 and sorted(o for o, _ in row) == [sum(n for _, n in sorted(row)[:k]) for k in range(len(row))]
    assert len(rows_of) <= 1.02 * best_fit([r.length for r in out], 1024) + 1
