"""Vectors, SimHash, lines and components."""

import random

import numpy as np
import pytest
from models import components as model_components, fingerprint, near_groups, similar_lines, without_lines

from footfall.llm import line_dedup, simhash_trees, vector_blocks
from footfall.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int, links string"


def vector_rows():
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(12, 24))
    rows = []
    for i in range(260):
        k = i % 12
        noise = rnd.normal(size=24) * (0.02, 0.12, 0.5)[i % 3]
        rows.append((i, [float(x) for x in (base[k] + noise) * (1 + i % 5)], k % 3, "x"))
    rows += [(300 + i, rows[0][1], rows[0][2], "") for i in range(30)] + [rows[1], rows[1]]
    rows += [(400, None, 1, ""), (401, [0.0] * 24, 1, ""), (402, [float("nan")] * 24, 1, ""), (403, [None] + [1.0] * 23, 1, ""), (404, [float("inf")] * 24, 1, "")]
    rows += [(405, rows[0][1], None, ""), (None, rows[0][1], rows[0][2], ""), (406, [1.0], 1, ""), (407, [2.0], 1, ""), (408, [-2.0], 1, ""), (409, [], 1, "")]
    return rows


@pytest.mark.parametrize("cell_rows", [2048, 7])
def test_vectors_are_the_model(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(vector_blocks, "CELL_ROWS", cell_rows)
    rows = vector_rows()
    got = sorted((tuple(r)[:4] for r in vector_blocks.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    ok = [k for k, (_, v, label, _) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(np.float32(rows[k][1]), dtype=float) / np.linalg.norm(np.float32(rows[k][1]).astype(float)) for k in ok}
    links = [(a, b) for a in ok for b in ok if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    comp, low = model_components(range(len(rows)), [p for p in links if p[0] < p[1]]), {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[comp[k]] = min(low.get(comp[k], r[0]), r[0])
    count = np.bincount([a for a, _ in links], minlength=len(rows))
    want = [(r[0], int(count[k]), low.get(comp[k]), r[0] is not None and r[0] == low.get(comp[k])) for k, r in enumerate(rows)]
    assert got == sorted(want, key=repr)


def test_no_vectors(spark):
    assert vector_blocks.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 500), (None, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = model_components({x for p in links if None not in p and p[0] != p[1] for x in p}, [p for p in links if None not in p and p[0] != p[1]])
    assert got == want


def test_forest_finds_what_all_pairs_find():
    rnd = np.random.default_rng(1)
    values = np.unique(np.concatenate([rnd.integers(0, 1 << 63, 50, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rnd.integers(0, 64, (50, 12), dtype=np.uint64))]).ravel())
    group = np.sort(rnd.integers(0, 4, len(values)))
    forest = simhash_trees.Forest(values, group, 4)
    got = {(int(q), int(n)) for a, b in forest.search(values, group, 3) for q, n in zip(a, b)}
    away = np.bitwise_count(values[:, None] ^ values[None, :])
    assert got == {(int(a), int(b)) for a, b in np.argwhere((away <= 3) & (group[:, None] == group[None, :]))}


def near_texts():
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(300)}" for _ in range(200)] for _ in range(6)]
    docs = {}
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(i // 6 % 4):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(50)}"
        docs[i] = " ".join(w)
    return docs | {900: None, 901: "", 902: "one two", 903: "One TWO", 904: "ÄB c d", 905: "äB c d", 906: "long " * 40_000}


@pytest.mark.parametrize("tree_rows", [2048, 5])
def test_simhash_is_the_model(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(simhash_trees, "TREE_ROWS", tree_rows)
    docs = near_texts()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, fingerprint string")
    got = {r[0]: (r[1] & (1 << 64) - 1, r[2]) for r in simhash_trees.near_duplicates(frame).collect()}
    want = near_groups(docs)
    assert got == want
    kept = simhash_trees.first_of_each(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_simhash_edges(spark):
    assert simhash_trees.fingerprint("A b c".encode()) & (1 << 64) - 1 == fingerprint("a b c")
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (None, "a b c d"), (3, "x y z"), (3, "q r s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, (r[2] for r in simhash_trees.near_duplicates(frame).collect()))) == sorted(map(repr, [1, 1, 1, 1, 3, 3]))
    assert sorted((r.doc_id, r.text) for r in simhash_trees.first_of_each(frame).collect()) == [(1, "a b c d"), (3, "q r s"), (3, "x y z")]
    assert simhash_trees.near_duplicates(frame.limit(0)).count() == 0
    # A row is judged by its own text: what shares its key with a copy of another document stays.
    rows = [(2, "two one"), (2, "entirely else text"), (1, "two one"), (None, "null a b"), (None, "null a b"), (None, "of its own")]
    left = simhash_trees.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in left) == ["entirely else text", "null a b", "of its own", "two one"]
    assert [r.doc_id for r in left if r.text == "two one"] == [1]


def line_texts():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(4, 30))] for _ in range(25)]
    docs = {}
    for i in range(120):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            lines.append(" ".join(w))
        docs[i] = "\n".join(lines + ["the most common line of them all"] * (i % 2) + [""] * (i % 3))
    return docs | {700: None, 701: "", 702: "\n\n", 703: "a a a a a a\na a a a a b", 704: " ".join(words * 800)}


@pytest.mark.parametrize("tries,posting", [(1, 8192), (2, 20)])
def test_lines_are_the_model(spark, monkeypatch, tries, posting):
    monkeypatch.setattr(line_dedup, "FIRST_TRIES", tries)
    monkeypatch.setattr(line_dedup, "POSTING_ROWS", posting)
    docs = line_texts()
    frame = spark.createDataFrame([(t, i, 1, "b") for i, t in docs.items()], "text string, doc_id long, line int, bits string")
    out = {r.doc_id: r for r in line_dedup.without_repeated_lines(frame).collect()}
    want = similar_lines(docs)
    assert {i: list(r["__removed"]) for i, r in out.items()} == want
    assert all(out[i].text == without_lines(docs[i], want[i]) for i in docs)


def test_lines_edges(spark):
    rows = [(1, "one two three four five"), (1, "one two three four five"), (None, "one two three four five"), (2, "one two three four five\nx")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, ((r.doc_id, r.text) for r in line_dedup.without_repeated_lines(frame).collect()))) == sorted(
        map(repr, [rows[0], (1, ""), (None, ""), (2, "x")])
    )
    assert line_dedup.without_repeated_lines(frame.limit(0)).count() == 0
    rows = [(None, "a b c\nq"), (None, "a b c\nr"), (None, "a b c\nq"), (None, None), (7, "x\ny"), (7, "x\nz"), (7, "x\nz")]
    left = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lines = [x for r in left for x in (r.text or "").split("\n") if x]
    assert sorted(lines) == ["a b c", "q", "r", "x", "y", "z"] and len(left) == 7
    named = spark.createDataFrame([("k1", "a b"), ("k2", "b a"), ("5", "a a b")], "doc_id string, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.without_repeated_lines(named).collect())[0] == ("5", "a a b")


def test_families_of_lines_below_the_threshold_are_decided_by_all_pairs(spark, monkeypatch):
    """Lines that resemble many others just not enough go through all rounds."""
    monkeypatch.setattr(line_dedup, "SECOND_TRIES", 1)
    rnd = random.Random(6)
    stem = [f"s{i}" for i in range(26)]
    docs = {i: " ".join(rnd.sample(stem, rnd.choice([22, 23, 24])) + [f"t{rnd.randrange(60)}" for _ in range(2)]) for i in range(150)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = {r.doc_id: list(r["__removed"]) for r in line_dedup.without_repeated_lines(frame).collect()}
    assert out == similar_lines(docs) and 10 < sum(map(len, out.values())) < 140
