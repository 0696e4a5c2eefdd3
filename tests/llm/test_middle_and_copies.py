"""Fill-in-middle, whitening and exact dedup."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from footfall.llm import exact_copies, middle_frames, symmetric_eigen, whitening

DOCS = "doc_id long, text string, units string, keep_id int"
TEXTS = [None, "", "a", "  ", "word", "Zwei  Wörter, naïve 𝒳 x", "has <M> inside", "<P>", "ab" * 700 + "é" * 40 + "\n" + "cd 12" * 90, "x\x0b\x0cy", "one two\tthree\n\nfour " * 60]


def rows():
    out = [(k, t, "u", k % 3) for k, t in enumerate(TEXTS * 9)]
    return out + [(None, "null key here", "", 1), (None, None, None, None), (3, "a again", "", None), (3, "a again", "", None)]


def model(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("frame_chars", [1, 7, 1 << 14])
def test_middles_are_the_model(spark, frame_chars):
    docs = rows()
    made = middle_frames.fill_in_middle(spark.createDataFrame(docs, DOCS), frame_chars=frame_chars)
    assert made.columns[:3] == ["doc_id", "units", "keep_id"]
    made = made.withColumn("text", middle_frames.plain_text("__output")).withColumn("d", middle_frames.digests("__output", "__form"))
    got = [tuple(r) for r in made.select("doc_id", "__n", "__form", "__prefix_chars", "__middle_chars", "text", "d.output_sha256", "d.restored_sha256").collect()]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, *(m := model(i, t)), sha(m[-1]), sha(t)) for i, t, *_ in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_no_texts(spark):
    assert middle_frames.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    assert exact_copies.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abZ <PSM>\né𝒳", max_size=60), st.integers(1, 9))
def test_frames_read_back_by_place_and_unit(text, size):
    writer = middle_frames.Writer(size)
    for k in range(0, len(text), 5):
        writer.write(text[k : k + 5])
    reader = middle_frames.Reader(*writer.close())
    assert "".join(reader.stream(0, len(text))) == text
    assert "".join(reader.stream(2, 9)) == text[2:9]
    places = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    assert [reader.place(k) for k in range(len(places))] == places
    for mark in ("<P>", "<S>", "ab"):
        if text.find(mark, 1) >= 0:
            assert reader.find(mark, 1) == text.find(mark, 1)


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("digest", [exact_copies.content_hash, lambda c: F.unhex(F.substring(F.md5(c), 1, 1)), lambda c: F.unhex(F.lit("00"))])
def test_equal_texts_are_the_model_whatever_the_hash(spark, digest):
    rnd = random.Random(2)
    docs = rows() + [(100 + k, rnd.choice(["same  text", "same\ttext", "same text ", "other"]), "u", k) for k in range(300)] + [(7, "same\ntext", "z", 0)] * 3
    got = exact_copies.exact_groups(spark.createDataFrame(docs, DOCS), digest=digest).collect()
    groups = defaultdict(list)
    for i, t, *_ in docs:
        groups[plain(t)].append(i)
    assert len(got) == len(docs)
    kept = defaultdict(list)
    for r in got:
        group = groups[plain(r.text)]
        known = [i for i in group if i is not None]
        assert (r["__keep"], r["__group_size"], r["__sha256"]) == (min(known) if known else None, len(group), hashlib.sha256(plain(r.text).encode()).hexdigest())
        if r["__kept"]:
            kept[plain(r.text)].append(r.doc_id)
            assert r.doc_id == r["__keep"]
    assert {t: len(v) for t, v in kept.items()} == dict.fromkeys(groups, 1)


def test_kept_rows_have_their_columns(spark):
    left = exact_copies.without_copies(spark.createDataFrame(rows(), DOCS))
    assert left.columns == ["doc_id", "text", "units", "keep_id"]
    assert left.count() == len({plain(t) for _, t, *_ in rows()})


def test_eigenpairs_of_clusters_and_splits():
    rnd = np.random.default_rng(4)
    turn, _ = np.linalg.qr(rnd.normal(size=(40, 40)))
    wide = rnd.normal(size=(90, 40))
    for matrix in (np.diag([3.0, 3.0, 1.0, 0.0]), np.zeros((5, 5)), np.eye(30), (turn * np.repeat(np.arange(20), 2)) @ turn.T, wide.T @ wide, np.array([[2.0]]), np.ones((6, 6))):
        matrix = (matrix + matrix.T) / 2
        values, vectors = symmetric_eigen.leading_pairs(matrix, 16)
        scale = max(np.abs(matrix).max(), 1) * len(matrix)
        assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:16]).max() < 1e-14 * scale
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-14 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


VECTORS = "vec_id long, embedding array<float>, component int, n string"


def vector_rows():
    rnd = np.random.default_rng(8)
    mix = rnd.normal(size=(20, 20))
    out = [(k, [float(c) for c in rnd.normal(size=20) @ mix], k, "n") for k in range(200)]
    out += [(1000 + k, out[0][1], 0, "") for k in range(60)] + [out[5], out[5], (None, out[6][1], None, None)]
    bad = [None, [None] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [1e30] * 20, []]
    out += [(2000 + k, v, 0, "") for k, v in enumerate(bad)]
    return out + [(3000, [1.0, 2.0, 3.0], 0, ""), (3001, [2.0, 2.0, 5.0], 0, ""), (3002, [4.0], 0, "")]


def test_whitened_vectors_are_the_model(spark):
    docs = vector_rows()
    got = defaultdict(list)
    for r in whitening.whiten(spark.createDataFrame(docs, VECTORS)).collect():
        got[(r.vec_id, r.n)].append(r)
    checked = 0
    for dims in (20, 3):
        some = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int) + 1_000_000) for i, v, *_ in docs if v and len(v) == dims and all(c is not None and abs(c) < 1e29 for c in v)]
        fit = np.unique(np.array([x for _, x in some]), axis=0)
        n, sums = len(fit), fit.sum(axis=0)
        centred = (fit * n - sums) / n
        cov = centred.T @ centred / n
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
        real = values > 1e-9 * values[0]
        values, vectors = values[real], vectors[:, real]
        assert len(values) == (16 if dims == 20 else 1)
        for i, x in dict(some).items():
            found = [r for r in got[(i, n)]]
            times = sum(a == i for a, _ in some)
            assert len(found) == times * len(values)
            want = ((x * n - sums) / n) @ vectors / np.sqrt(values)
            for r in found:
                k = r.component - 1
                assert int(r.deviation) == int(((n * x - sums) ** 2).sum())
                assert abs(abs(r.whitened) - abs(want[k])) < 1e-9
                assert abs(r.explained / (values[k] / np.trace(cov)) - 1) < 1e-9
                assert r.identity_error < 1e-9
                checked += 1
    assert checked == sum(len(v) for v in got.values())


def test_signs_are_the_same_for_all_rows_and_large_counts_stay_exact(spark):
    found = whitening.whiten(spark.createDataFrame(vector_rows(), VECTORS)).where("n > 100").toPandas().drop_duplicates(["vec_id", "component"])
    table = found.dropna(subset=["vec_id"]).pivot(index="vec_id", columns="component", values="whitened")
    fit = table[table.index < 200].to_numpy()
    assert np.abs(fit.T @ fit / len(fit) - np.eye(16)).max() < 1e-9
    big = whitening._centred(np.array([[1 << 40]]), 1 << 40, np.array([3]))
    assert big[0, 0] == (1 << 80) - 3


def test_no_vectors_no_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], VECTORS)).count() == 0
