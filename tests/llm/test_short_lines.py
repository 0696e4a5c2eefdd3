"""op5_line_dedup next to all pairs of lines, with those of one to four words."""

import random

import pandas as pd
import pytest
from models import words

from footfall.llm import line_dedup
from footfall.llm.queries import QUERIES


def similar(docs):
    """docs: {id: text} to {id: numbers of lines that an earlier line of any length resembles}."""
    seen, out = {}, {}
    for i in sorted(docs):
        out[i] = []
        for k, line in enumerate((docs[i] or "").split("\n")):
            s = frozenset(words(line))
            if not s:
                continue
            if s in seen or any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                out[i].append(k)
            seen[s] = True
    return out


def test_short_lines_are_the_model(spark):
    rnd = random.Random(4)
    names = [f"w{i}" for i in range(12)]
    docs = {i: "\n".join(" ".join(rnd.choice(names) for _ in range(rnd.randrange(8))) for _ in range(6)) for i in range(60)}
    docs |= {90: "a b c d", 91: "a b c d e", 92: "q\n\nq", 93: "e d c b"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = {r.doc_id: list(r["__removed"]) for r in line_dedup.without_repeated_lines(frame, min_words=1).collect()}
    assert out == similar(docs) and out[91] == [0] and out[92] == [2]


def test_query_removes_short_lines(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = {r.doc_id: list(r.removed) for r in QUERIES["op5_line_dedup"](spark, small).collect()}
    want = similar(docs)
    assert out == want
    assert any(len(words(docs[i].split("\n")[k])) < 5 for i, gone in want.items() for k in gone)


def posting_list(*lines):
    """One list of lines given by their number of words and the first part of their bitmap."""
    rows = [{"token": 1, "tile_a": 0, "tile_b": 0, "part": 0, "doc": i, "row": 0, "line": 0, "n": n, "pos": 0, "w0": bits, "w1": 0, "w2": 0, "w3": 0} for i, (n, bits) in enumerate(lines)]
    return pd.DataFrame(rows)


def test_sets_that_could_only_be_equal_are_no_candidates():
    # First lines of their sets differ; 5 and 5 words differ in two at least, which is 4 of 6.
    assert len(line_dedup._named(posting_list((5, 0), (5, 0)), 1)) == 0
    assert len(line_dedup._named(posting_list((5, 0), (6, 1)), 1)) == 1


def test_only_lines_with_another_candidate_are_marked():
    far = (1 << 40) - 1
    found = line_dedup._named(posting_list((20, far), (20, far), (20, 0), (20, 0)), 1)
    assert [(r.doc, r.other_doc, r.more) for r in found.itertuples()] == [(1, 0, False), (3, 2, False)]
    found = line_dedup._named(posting_list((20, 0), (20, 0), (20, 0)), 1)
    assert [(r.doc, r.other_doc, r.more) for r in found.itertuples()] == [(1, 0, False), (2, 1, True)]


def test_later_rounds_read_earlier_lines_of_like_size_only(spark):
    rows = [(i, 0, 0, n, 0, 0, 0, 0, [7]) for i, n in enumerate([20, 5, 40, 21, 20, 20])]
    heads = spark.createDataFrame(rows, "doc long, row long, line int, n int, w0 long, w1 long, w2 long, w3 long, prefix array<long>")
    seek = heads.where("doc = 4").select("doc", "row", "line")
    read = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "_named_pairs", lambda some, tries, hot: read.append(sorted(r.doc for r in some.collect())))
        line_dedup._candidates(heads, None, seek)
        assert read == [[0, 3, 4]]
        patch.setattr(line_dedup, "BROADCAST_WORDS", 0)
        line_dedup._candidates(heads, None, seek)
    assert len(read) == 1 + line_dedup.PASSES and sum(read[1:], []) == [0, 3, 4]


def test_folded_bitmaps_lose_no_pair():
    """Lines of every size on both sides of the folds, one word apart or many."""
    rnd = random.Random(8)

    def bits(tokens):
        out = [0, 0, 0, 0]
        for t in tokens:
            out[t % 256 // 64] ^= 1 << t % 64
        return [w - (1 << 64) if w >> 63 else w for w in out]

    for n in (20, line_dedup.NARROW, line_dedup.MEDIUM, 200):
        base = rnd.sample(range(1 << 20), n)
        sets = [base, base + [1 << 21], rnd.sample(range(1 << 20), n)]
        rows = [(i, 0, 0, len(s), 0, 1, *bits(s)) for i, s in enumerate(sets)]
        frame = pd.DataFrame(rows, columns=["doc", "row", "line", "n", "pos", "token", *line_dedup.BITMAP]).assign(tile_a=0, tile_b=0, part=0)
        for i, s in enumerate(sets):
            w = frame.loc[i, line_dedup.BITMAP].astype("int64").tolist()
            if len(s) <= line_dedup.NARROW:
                w = [w[0] ^ w[1] ^ w[2] ^ w[3], 0, 0, 0]
            elif len(s) <= line_dedup.MEDIUM:
                w = [w[0] ^ w[2], w[1] ^ w[3], 0, 0]
            frame.loc[i, line_dedup.BITMAP] = w
        found = line_dedup._named(frame, 8)
        assert [(r.doc, r.other_doc) for r in found.itertuples()] == [(1, 0)]


def test_postings_of_short_lines_carry_a_folded_bitmap(spark):
    docs = {1: " ".join(f"a{i}" for i in range(40)), 2: " ".join(f"b{i}" for i in range(100)), 3: " ".join(f"c{i}" for i in range(180))}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    sets = line_dedup.line_sets(line_dedup.identified(frame, "doc_id"), "text")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "_named_pairs", lambda some, tries, hot: seen.extend(some.collect()))
        line_dedup._candidates(sets, 8)
    used = {r.doc: sum(r[w] != 0 for w in line_dedup.BITMAP) for r in seen}
    assert used == {1: 1, 2: 2, 3: 4} and len(seen) == 9 + 21 + 37


def test_repeats_inside_a_document_are_marked_before_the_shuffle(spark):
    frame = spark.createDataFrame([(1, "a b\nc\nb a\nb a a\n\nc d"), (2, "a b\nc c\nd")], "doc_id long, text string")
    sets = line_dedup.line_sets(line_dedup.identified(frame, "doc_id"), "text")
    assert {(r.doc, r.line) for r in sets.where("again").collect()} == {(1, 2), (1, 3)}


def test_word_counts_leave_a_task_in_one_frame(spark, monkeypatch):
    frames = []
    frame = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20_000)),)], "text string")
    kept = type(frame).mapInPandas
    monkeypatch.setattr(type(frame), "mapInPandas", lambda df, fn, schema: frames.append(fn) or kept(df, fn, schema))
    table = line_dedup.word_ranks(frame, "text")
    found = list(frames[0](iter([pd.DataFrame({"text": [b"a b a"]}), pd.DataFrame({"text": [b"c"]})])))
    assert len(found) == 1 and 1 <= len(found[0]) <= 3 and (table > 0).sum() > 19_000
