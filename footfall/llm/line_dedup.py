"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words.  It is removed if an earlier line, by document id
and line number, has Jaccard similarity of 4/5 or more with it.  Words are put
in one global order, rare ones first; similar sets then share a word among the
first n - ceil(4n/5) + 1 of each.  Lines meet at such words, pass a length, a
position and a bitmap filter, and are verified on their words.

Equal sets are settled first, by one aggregate; only the first line of each set is joined.  The order
comes from counts in hashed buckets, a fixed number of them, so it can
be broadcast; any one order gives exact results.  Words with long posting
lists are tiled, and the lists are joined in a few passes over hash ranges of the words, so that only a share of
them is on the disks at a time.  One earlier match is enough for a line, so the rounds go from few candidates to all:
the nearest few lines that pass the filters; for lines whose candidates fail and that have others, the closest few
by the bitmap; then all that are left.  Later rounds name pairs only for lines still open, and
meet only at their words with earlier lines of like size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from footfall.llm.arrays import group_numbers, joined_texts, mixed, whole_groups, word_hashes
from footfall.llm.common import bucket_split, identified, materialize, release, step
from footfall.llm.tiles import hot_groups, tiled

# Lines with fewer words are not removed; 1 takes all but blank lines.
MIN_WORDS = 1
# Buckets of the word counts that are broadcast, one byte each.
COUNT_BUCKETS = 1 << 20
CHUNK = 1 << 12
# Bytes of text hashed at a time; its arrays fit the processor's cache.
BUFFER = 1 << 18
# Lines of one posting list that are compared in a tile.
POSTING_ROWS = 8192
TASK_ROWS = 100_000
# Earlier lines of a posting list that are named for a line in the first two rounds.
FIRST_TRIES, SECOND_TRIES = 8, 4
# Words of open lines up to which their table is broadcast; beyond that a later round goes in passes too.
BROADCAST_WORDS = 100_000
# Columns of 64 bits of the bitmap.
BITMAP = ["w0", "w1", "w2", "w3"]
# Words of a line up to which 64 and 128 bits of it go to the posting lists.
NARROW, MEDIUM = 64, 128
# Lines that a task hands on at a time.
LINES_AT_ONCE = 8192
# Passes of a round over all lists.
PASSES = 4
_KEYS = ["token", "tile_a", "tile_b"]
_PLACE = ["doc", "row", "line"]
_PAIR = "doc long, row long, line int, other_doc long, other_row long, other_line int, more boolean"


def word_ranks(docs: DataFrame, text: str) -> np.ndarray:
    """A byte per bucket that grows with the count of the words in it.

    Counts travel as arrays, a row per task and chunk of buckets, all of a task in one frame, and are added chunk by chunk.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNT_BUCKETS, dtype=np.int64)
        for batch in batches:
            hashes = [word_hashes(data)[0] for _, _, data in joined_texts([t or b"" for t in batch["text"]], BUFFER)]
            places = np.concatenate(hashes or [np.zeros(0, np.uint64)]) & np.uint64(COUNT_BUCKETS - 1)
            counts += np.bincount(places.astype(np.int64), minlength=COUNT_BUCKETS)
        used = [np.flatnonzero(some).astype(np.int32) for some in counts.reshape(-1, CHUNK)]
        found = [chunk for chunk, places in enumerate(used) if len(places)]
        sums = [counts[chunk * CHUNK + used[chunk]].tobytes() for chunk in found]
        yield pd.DataFrame({"chunk": found, "places": [used[chunk].tobytes() for chunk in found], "counts": sums}).astype({"chunk": "int32"})

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, places, counts in zip(batch["chunk"], batch["places"], batch["counts"]):
                some = sums.setdefault(chunk, np.zeros(CHUNK, dtype=np.int64))
                some[np.frombuffer(places, dtype=np.int32)] += np.frombuffer(counts, dtype=np.int64)
        ranks = [np.minimum(255, np.round(8 * np.log2(s + 1))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pd.DataFrame({"chunk": list(sums), "ranks": ranks}).astype({"chunk": "int32"})

    counted = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInPandas(count, "chunk int, places binary, counts binary")
    ranked = materialize(counted.repartition("chunk").mapInPandas(rank, "chunk int, ranks binary"), "ranks")
    table = np.zeros(COUNT_BUCKETS, dtype=np.uint8)
    for row in ranked.toLocalIterator():
        table[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.ranks, dtype=np.uint8)
    return table


class _Sets:
    """The word sets of the lines of a buffer that have words enough."""

    def __init__(self, data: bytes, ranks: np.ndarray | None = None, min_words: int = MIN_WORDS):
        token, line = word_hashes(data)
        wide = np.bincount(line, minlength=1) >= min_words
        token, line = token[wide[line]], line[wide[line]]
        key = line.astype(np.uint64) << np.uint64(8)
        if ranks is not None:
            key |= ranks[(token & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)]
        # One sort by line, rank and as many first bits of the word as there is room for; those that agree there are sorted in full.
        room = np.uint64(64 - max(int(key.max(initial=0)).bit_length(), 8))
        brief = (key << room) | (token >> (np.uint64(64) - room))
        order = np.argsort(brief)
        brief = brief[order]
        if np.any((brief[1:] == brief[:-1]) & (token[order[1:]] != token[order[:-1]])):
            order = np.lexsort((token, key))
        token, line = token[order], line[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        self.token, line = token[new], line[new]
        self.first = np.flatnonzero(np.diff(line, prepend=-1))
        self.line = line[self.first]
        self.n = np.diff(np.append(self.first, len(line)))
        self.whole = np.add.reduceat(mixed(self.token), self.first) if len(line) else np.zeros(0, np.uint64)


def line_sets(docs: DataFrame, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc, row, line, n, w0 to w3, whole, again, prefix, busy) of all lines of identified documents.

    The bitmap has the parity of the words by 8 bits of their hash, whole is a hash of the set, and again
    tells that an earlier line of the document has the same set, by 192 bits and the size.
    Sets of up to three words resemble equal ones only, so they need no prefix.  busy are the buckets of
    those words of the prefix whose posting list may have more than POSTING_ROWS rows.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text))
    names = [*_PLACE, "n", *BITMAP, "whole", "again", "prefix", "busy"]
    busy_rank = int(8 * np.log2(POSTING_ROWS + 1))

    def some(texts: list[bytes], docs: np.ndarray, rows: np.ndarray) -> Iterator[list]:
        for lo, hi, data in joined_texts(texts, BUFFER):
            sets = _Sets(data, ranks.value, min_words)
            if not len(sets.line):
                continue
            base = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts[lo:hi]])
            owner = np.searchsorted(base, sets.line, "right") - 1
            place = (sets.token >> np.uint64(40)) & np.uint64(64 * len(BITMAP) - 1)
            bit = np.uint64(1) << (place & np.uint64(63))
            bitmap = [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), sets.first).view(np.int64) for k in range(len(BITMAP))]
            alike = [sets.n, bitmap[1], bitmap[0], sets.whole, owner]
            order = np.lexsort(alike)
            again = np.zeros(len(owner), bool)
            again[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in alike])
            length = np.where(sets.n > 3, sets.n - (4 * sets.n + 4) // 5 + 1, 0)
            ahead = np.arange(len(sets.token)) < np.repeat(sets.first + length, sets.n)
            prefix = sets.token[ahead].view(np.int64)
            buckets = (prefix & (COUNT_BUCKETS - 1)).astype(np.int32)
            is_busy = ranks.value[buckets] >= busy_rank
            busy = np.bincount(np.repeat(np.arange(len(length)), length)[is_busy], minlength=len(length))
            yield [docs[lo + owner], rows[lo + owner], (sets.line - base[owner]).astype(np.int32), sets.n.astype(np.int32), *bitmap, sets.whole.view(np.int64), again,
                   (length, prefix), (busy, buckets[is_busy])]

    def column(parts: list) -> pa.Array:
        if not isinstance(parts[0], tuple):
            return pa.array(np.concatenate(parts))
        size, values = (np.concatenate(x) for x in zip(*parts))
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), values)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = []
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for found in some(texts, batch.column("doc").to_numpy(), batch.column("row").to_numpy()):
                held.append(found)
                if sum(len(h[0]) for h in held) >= LINES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([column(c) for c in zip(*held)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([column(c) for c in zip(*held)], names)

    slim = docs.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    return slim.mapInArrow(build, "doc long, row long, line int, n int, w0 long, w1 long, w2 long, w3 long, whole long, again boolean, prefix array<long>, busy array<int>")


def _folded(sets: DataFrame) -> DataFrame:
    """Line sets with the halves of the bitmap laid over each other for shorter lines; what is left over is 0."""
    w0, w1, w2, w3 = (F.col(w) for w in BITMAP)
    half, half_too = w0.bitwiseXOR(w2), w1.bitwiseXOR(w3)
    narrow, medium, none = F.col("n") <= NARROW, F.col("n") <= MEDIUM, F.lit(0).cast("long")
    return sets.withColumns({
        "w0": F.when(narrow, half.bitwiseXOR(half_too)).when(medium, half).otherwise(w0),
        "w1": F.when(narrow, none).when(medium, half_too).otherwise(w1),
        "w2": F.when(medium, none).otherwise(w2),
        "w3": F.when(medium, none).otherwise(w3),
    })


def _named(frame: pd.DataFrame, tries: int | None) -> pd.DataFrame:
    """Earlier lines that may match, for the lines of whole posting lists; at most so many for each, the closest ones.

    Lists are sorted by place.  The first round takes the nearest lines before that pass the filters;
    later ones look at all, for the rows marked ``seek``.  ``more`` marks lines with candidates that were not named.
    All lines are first ones of their sets, so sets that could only be equal do not pass.
    """
    group = group_numbers(frame, _KEYS)
    several = np.bincount(group)[group] > 1
    frame, group = frame[several], group[several]
    later = "seek" in frame
    n, pos, part = (frame[c].to_numpy().astype(np.int64) for c in ("n", "pos", "part"))
    w0, w1, w2, w3 = (frame[w].to_numpy().view(np.uint64) for w in BITMAP)
    # Bitmaps of shorter lines are folded; laid over each other further, all can be compared.
    folds = [(0, [w0 ^ w1 ^ w2 ^ w3]), (NARROW, [w0 ^ w2, w1 ^ w3]), (MEDIUM, [w0, w1, w2, w3])]
    mixed_tiles = frame["tile_a"].to_numpy() != frame["tile_b"].to_numpy()
    start = np.zeros(len(frame), dtype=np.int64)
    if len(frame):
        opens = np.flatnonzero(np.diff(group, prepend=-1))
        start = np.repeat(opens, np.diff(np.append(opens, len(frame))))
    index, step = np.flatnonzero(frame["seek"].to_numpy()) if later else np.arange(len(frame)), 1
    count, more = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        index = index[index - step >= start[index]]
        if not len(index):
            break
        a, b = index, index - step
        need = -(-4 * (n[a] + n[b]) // 9)
        ok = (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need) & (n[a] + n[b] > 2 * need)
        ok &= ~mixed_tiles[a] | (part[a] != part[b])
        a, b, need = a[ok], b[ok], need[ok]
        apart = np.zeros(len(a), dtype=np.int64)
        for least, fold in folds:
            wide = np.minimum(n[a], n[b]) > least
            apart[wide] = sum(np.bitwise_count(w[a[wide]] ^ w[b[wide]]).astype(np.int64) for w in fold)
            ok = apart <= n[a] + n[b] - 2 * need
            a, b, need, apart = a[ok], b[ok], need[ok], apart[ok]
        count[a] += 1
        if not later:
            # One more than is named is looked for, so that only lines with another candidate are marked.
            over = count[a] > tries
            more[a[over]] = True
            a, b, apart = a[~over], b[~over], apart[~over]
            index = index[~more[index]]
        found.append((a, b, apart))
        step += 1
    a, b, apart = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
    if later and tries is not None:
        order = np.lexsort((apart, a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        more[a[rank >= tries]] = True
        a, b = a[rank < tries], b[rank < tries]
    columns = {c: frame[c].to_numpy() for c in _PLACE}
    return pd.DataFrame({c: columns[c][a] for c in _PLACE} | {f"other_{c}": columns[c][b] for c in _PLACE} | {"more": more[a]})


def _hot_words(sets: DataFrame) -> DataFrame:
    """Buckets of the words whose posting lists are cut into tiles."""
    return hot_groups(sets.select(F.explode("busy").alias("bucket")), ["bucket"], POSTING_ROWS)


def _candidates(sets: DataFrame, tries: int | None, seek: DataFrame | None = None, hot: DataFrame | None = None) -> list[DataFrame]:
    """Pairs of lines that pass the filters, for the lines in ``seek`` or for all, by shares of the words.

    ``hot`` are the hot words of all lines if they are known; in a later round they cut its shorter lists as well.
    """
    extra, asked, passes = [], None, PASSES
    if seek is not None:
        marked = sets.join(seek.withColumn("seek", F.lit(True)), _PLACE, "left")
        sets, extra = marked.withColumn("seek", F.coalesce("seek", F.lit(False))), ["seek"]
    rows = _folded(sets).select(*_PLACE, "n", *BITMAP, *extra, F.posexplode("prefix").alias("pos", "token"))
    if seek is not None:
        # Lists without a line that is still open are of no use, nor are lines that no open one can resemble or that come later.
        size, place = F.col("n"), F.struct(*_PLACE)
        bounds = [F.min(F.ceil(size * 4 / 5)).alias("least"), F.max(F.floor(size * 5 / 4)).alias("most"), F.max(place).alias("last")]
        asked = materialize(rows.where("seek").groupBy("token").agg(*bounds), "open_words")
        if asked.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
            asked, passes = F.broadcast(asked), 1
        fits = F.col("seek") | (F.col("n").between(F.col("least"), F.col("most")) & (place < F.col("last")))
    rows = rows.withColumn("bucket", F.col("token").bitwiseAND(F.lit(COUNT_BUCKETS - 1)).cast("int"))
    if hot is None and asked is None:
        hot = _hot_words(sets)
    out = []
    for share in range(passes):
        some = rows.where(F.pmod("token", F.lit(passes)) == share) if passes > 1 else rows
        if asked is not None:
            some = some.join(asked, "token").where(fits).drop("least", "most", "last")
        out.append(_named_pairs(some, tries, hot))
    return out


def _named_pairs(rows: DataFrame, tries: int | None, hot: DataFrame | None) -> DataFrame:
    rows = tiled(rows.withColumn("spread", F.xxhash64(*_PLACE)), ["bucket"], "spread", POSTING_ROWS, hot).drop("bucket", "spread")

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["token"], TASK_ROWS):
            token = frame["token"].to_numpy()
            new = np.concatenate([[True], token[1:] != token[:-1], [True]])
            frame = frame[~(new[:-1] & new[1:])]
            order = np.lexsort([frame[c].to_numpy() for c in ["token", *_PLACE][::-1]])
            yield _named(frame.iloc[order].assign(tile_a=0, tile_b=(frame["part"].to_numpy()[order] >= 0).astype(int)), tries)

    # A list or tile is told by one number, which is sorted faster than all its keys; its rows are put in order in the task.
    # Parts matter in tiles of two parts only; -1 stands for the others.
    side = F.when(F.col("tile_a") != F.col("tile_b"), F.col("part")).otherwise(-1).alias("part")
    dealt = rows.repartition(*_KEYS).withColumn("key", F.xxhash64(*_KEYS))
    dealt = dealt.select(F.col("key").alias("token"), side, *[c for c in rows.columns if c not in (*_KEYS, "part")])
    return dealt.sortWithinPartitions("token").mapInPandas(name, _PAIR).distinct()


def _texts_of_lines(docs: DataFrame, text: str, lines: DataFrame) -> tuple[DataFrame, str]:
    """Rows (doc, row, line, words) of the given lines, as a step."""
    wanted = lines.groupBy("doc", "row").agg(F.collect_set("line").alias("wanted"))
    slim = docs.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    near, _ = bucket_split(slim, "doc", lines.select("doc").distinct())

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = []
                for row in batch.iloc[start : start + 256].itertuples(index=False):
                    split = (row.text or b"").split(b"\n")
                    rows += [(row.doc, row.row, i, split[i]) for i in row.wanted]
                yield pd.DataFrame(rows, columns=[*_PLACE, "words"])

    picked = near.join(wanted.hint("merge"), ["doc", "row"]).select("doc", "row", "text", "wanted").mapInPandas(pick, "doc long, row long, line int, words binary")
    return step(picked, "words")


@pandas_udf(T.BooleanType())
def _alike(lines: pd.Series, others: pd.Series) -> pd.Series:
    """Jaccard similarity of 4/5 or more of the words of two lines."""
    out = []
    for line, other in zip(lines, others):
        a, b = set(line.split()), set(other.split())
        shared = len(a & b)
        out.append(5 * shared >= 4 * (len(a) + len(b) - shared))
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rows (doc, row, line) of the lines that have a similar line among their pairs."""
    other = [f"other_{c}" for c in _PLACE]
    ends = pairs.select(*_PLACE).unionByName(pairs.select(*[F.col(o).alias(c) for o, c in zip(other, _PLACE)])).distinct()
    words, path = _texts_of_lines(docs, text, materialize(ends, "ends"))
    others = words.select(*[F.col(c).alias(o) for o, c in zip(other, _PLACE)], F.col("words").alias("other_words"))
    both = pairs.select(*_PLACE, *other).join(words.hint("merge"), _PLACE).join(others.hint("merge"), other)
    found = materialize(both.where(_alike("words", "other_words")).select(*_PLACE).distinct(), "verified")
    release(docs.sparkSession, path)
    return found


def _first_lines(docs: DataFrame, text: str, min_words: int) -> tuple[DataFrame, str]:
    """Line sets with ``head``, true for the first line of each set, as a step; equal sets are told by 192 bits and the size.

    A document's further lines of a set are marked before, so that documents are compared here, by their numbers alone unless rows share a key.
    """
    spark = docs.sparkSession
    place = F.col("doc") if docs.where("__row <> 0").isEmpty() else F.struct("doc", "row")
    sets, path = step(line_sets(docs, text, min_words), "line_sets")
    several = sets.where("not again").groupBy("whole", "w0", "w1", "n").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    # Written before it is joined, so that a hot set's partition can be split.
    several, aside = step(several, "equal_sets")
    # Sets that surely occur once need no partner.
    near, far = bucket_split(sets, "whole", several)
    met = near.join(several, ["whole", "w0", "w1", "n"], "left").unionByName(far, allowMissingColumns=True)
    head = ~F.col("again") & F.coalesce(place == F.col("least"), F.lit(True))
    found = step(met.withColumn("head", head).drop("least", "whole", "again"), "first_lines")
    release(spark, path, aside)
    return found


def removed_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, list[str]]:
    """Rows (doc, row, line) of the lines of identified documents to remove, and the steps they are read from."""
    sets, path = _first_lines(docs, text, min_words)
    steps = [path]

    def kept(df: DataFrame, label: str) -> DataFrame:
        out, path = step(df, label)
        steps.append(path)
        return out

    removed = sets.where("not head").select(*_PLACE)
    heads = sets.where("head and size(prefix) > 0")

    def named(tries: int | None, seek: DataFrame | None = None) -> DataFrame:
        passes = [kept(p, "line_pairs") for p in _candidates(heads, tries, seek, hot)]
        return kept(reduce(DataFrame.unionByName, passes).distinct(), "line_pairs") if len(passes) > 1 else passes[0]

    hot = _hot_words(heads)
    pairs = named(FIRST_TRIES)
    other = [f"other_{c}" for c in _PLACE]
    tried, done = pairs.drop("more").distinct(), _verified(pairs, docs, text)
    for tries in (SECOND_TRIES, None):
        open_ = pairs.where("more").select(*_PLACE).distinct().join(done, _PLACE, "left_anti")
        open_ = kept(open_, "open_lines")
        if open_.isEmpty():
            break
        pairs = named(tries, open_)
        again = kept(pairs.join(tried, [*_PLACE, *other], "left_anti"), "new_pairs")
        tried = tried.unionByName(again.drop("more"))
        done = done.unionByName(_verified(again, docs, text))
    return removed.unionByName(done), steps


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later similar lines cut out of the text, and __n_lines, __removed.

    Lines are what stands between line feeds; the others keep their order.  Lines of
    fewer than ``min_words`` words and blank ones stay.  A null text stays null and has no lines.  A key that is null or
    no whole number counts as the largest.  Every row is a document of its own: of rows that share a key, equal ones
    included, one comes first, the same for all their lines.  Other columns stay, but for names
    that begin with two underscores.
    """
    named = identified(docs, key)
    lines, steps = removed_lines(named, text, min_words)
    gone = lines.groupBy("doc", "row").agg(F.collect_set("line").alias("__gone"))
    gone = materialize(gone.withColumnsRenamed({"doc": "__doc", "row": "__row"}), "gone")
    release(docs.sparkSession, *steps)
    near, far = bucket_split(named, "__doc", gone)

    @pandas_udf(T.BinaryType())
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for data, lines in zip(texts, gone):
            if data is not None and lines is not None:
                skip = set(lines)
                data = b"\n".join(x for i, x in enumerate(data.split(b"\n")) if i not in skip)
            out.append(data)
        return pd.Series(out, dtype="object")

    breaks = F.octet_length(F.col(f"`{text}`")) - F.octet_length(F.replace(F.col(f"`{text}`"), F.lit("\n"), F.lit("")))
    lines = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(breaks + 1).alias("__n_lines")
    near = near.join(gone.hint("merge"), ["__doc", "__row"], "left").withColumn("__cut", cut(F.col(f"`{text}`").cast("binary"), F.col("__gone")))
    cleaned = [F.col("__cut").cast("string").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    near = near.select(*cleaned, lines, F.coalesce(F.array_sort("__gone"), F.array().cast("array<int>")).alias("__removed"))
    far = far.select(*[F.col(f"`{c}`") for c in docs.columns], lines, F.array().cast("array<int>").alias("__removed"))
    return far.unionByName(near)
