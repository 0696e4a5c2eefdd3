"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of a fixed number of code points, with
running totals of bytes, code points and units after each frame.  A unit is a run of
A-Z and a-z or any other single character, and it is counted in the frame where it starts; so a unit of any
length spans frames and no frame grows with it.

A cut after so many units needs the one frame where the next unit starts: only that is
decompressed to find the place.  The output is written as frames again, from frames
in order, and digests read frames one at a time; no step holds more than a frame
of plain text beside the compressed ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from footfall.llm.common import materialize

FRAME_CHARS = 1 << 14
LEVEL = 3
SEED = 1
# The marks of the parts and the shares of the forms, in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

OUTPUT = T.StructType([T.StructField("data", T.BinaryType())] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("bytes", "chars", "units")])
FRAMES = T.StructType([*OUTPUT.fields, T.StructField("marked", T.BooleanType())])
_MADE = T.StructType([T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("frames", OUTPUT)])
_DIGESTS = T.StructType([T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return (codes | 32) - np.uint32(97) < 26


def unit_starts(text: str, after_letter: bool = False) -> np.ndarray:
    """True where a unit starts; ``after_letter`` says what stands before the text."""
    letter = _letters(text)
    before = np.empty_like(letter)
    before[:1], before[1:] = after_letter, letter[:-1]
    return ~(letter & before)


class Writer:
    """Pieces of text to frames."""

    def __init__(self, frame_chars: int):
        self.size = frame_chars
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.data: list[bytes] = []
        self.totals: list[tuple[int, int, int]] = []
        self.held: list[str] = []
        self.held_chars = 0
        self.after_letter = False

    def _frame(self, text: str) -> None:
        data = self.zip.compress(text.encode())
        starts = unit_starts(text, self.after_letter)
        last = text[-1]
        self.after_letter = last.isascii() and last.isalpha()
        b, c, u = self.totals[-1] if self.totals else (0, 0, 0)
        self.data.append(data)
        self.totals.append((b + len(data), c + len(text), u + int(np.count_nonzero(starts))))

    def write(self, text: str) -> None:
        for at in range(0, len(text), self.size):
            piece = text[at : at + self.size]
            self.held.append(piece)
            self.held_chars += len(piece)
            if self.held_chars >= self.size:
                whole = "".join(self.held)
                self._frame(whole[: self.size])
                rest = whole[self.size :]
                self.held, self.held_chars = [rest] if rest else [], len(rest)

    def close(self) -> tuple[bytes, list[int], list[int], list[int]]:
        if self.held_chars:
            self._frame("".join(self.held))
        columns = [list(c) for c in zip(*self.totals)] or [[], [], []]
        return (b"".join(self.data), *columns)


class Reader:
    """Access to a text by code points and units, a frame at a time."""

    def __init__(self, data: bytes, bytes_: Iterable[int], chars: Iterable[int], units: Iterable[int]):
        self.data = data
        self.bytes, self.chars, self.units = (np.concatenate([[0], np.asarray(x, dtype=np.int64)]) for x in (bytes_, chars, units))
        self.unzip = zstandard.ZstdDecompressor()

    def _frame(self, k: int) -> bytes:
        return self.unzip.decompress(self.data[self.bytes[k] : self.bytes[k + 1]])

    def place(self, unit: int) -> int:
        """Code points before the unit of this number; those of the whole text if there are not so many."""
        if unit >= self.units[-1]:
            return int(self.chars[-1])
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        starts = np.flatnonzero(unit_starts(self._frame(k).decode()))
        # Taken by itself a frame starts with a unit; it may also go on with the last one.
        extra = len(starts) - int(self.units[k + 1] - self.units[k])
        return int(self.chars[k] + starts[extra + unit - int(self.units[k])])

    def stream(self, low: int, high: int) -> Iterator[str]:
        """The text between two places, frame by frame."""
        for k in range(int(np.searchsorted(self.chars, low, "right")) - 1, len(self.chars) - 1):
            start = int(self.chars[k])
            if start >= high:
                return
            yield self._frame(k).decode()[max(0, low - start) : high - start]

    def find(self, mark: str, low: int) -> int:
        """Place of the first mark from a place on; it may lie across frames."""
        tail, at = "", low
        for piece in self.stream(low, int(self.chars[-1])):
            joined = tail + piece
            found = joined.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = joined[-(len(mark) - 1) :]
        raise ValueError(f"no {mark} in the output")


@pandas_udf(FRAMES)
def _framed(texts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = []
    for text, size in zip(texts, sizes):
        writer, text = Writer(int(size)), text or ""
        writer.write(text)
        rows.append((*writer.close(), any(m in text for m in (PREFIX, SUFFIX, MIDDLE))))
    return pd.DataFrame(rows, columns=FRAMES.fieldNames())


def framed(docs: DataFrame, text: str = "text", frame_chars: int = FRAME_CHARS) -> DataFrame:
    """``docs`` with the text replaced by __frames, written to the shared folder; a null text is empty."""
    names = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return materialize(docs.select(*names, _framed(F.col(f"`{text}`"), F.lit(frame_chars)).alias("__frames")), "frames")


def units(frames: Column) -> Column:
    return F.coalesce(F.try_element_at(frames["units"], F.lit(-1)), F.lit(0).cast("long"))


def chosen(stored: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Adds __n, __low and __high (units before the cuts) and __form, all drawn from the seed and the key."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))).cast("binary"), 256)
    h = [F.conv(F.substring("__draw", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    n = F.col("__n")
    rows = stored.withColumns({"__draw": draw, "__n": units(F.col("__frames"))})
    plain = (n == 0) | F.col("__frames.marked") | (h[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    return rows.withColumns({"__form": form, "__low": F.least(h[0] % (n + 1), h[1] % (n + 1)), "__high": F.greatest(h[0] % (n + 1), h[1] % (n + 1))}).drop("__draw")


@pandas_udf(_MADE)
def _written(frames: pd.DataFrame, forms: pd.Series, low: pd.Series, high: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    cuts, out = [], []
    for data, bytes_, chars, units_, form, a, b, size in zip(frames["data"], frames["bytes"], frames["chars"], frames["units"], forms, low, high, sizes):
        if form == "plain":
            cuts.append((None, None))
            out.append({"data": data, "bytes": bytes_, "chars": chars, "units": units_})
            continue
        text = Reader(data, bytes_, chars, units_)
        a, b, end = text.place(int(a)), text.place(int(b)), int(text.chars[-1])
        parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, end)}
        writer = Writer(int(size))
        for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
            writer.write(mark)
            for piece in text.stream(*parts[mark]):
                writer.write(piece)
        cuts.append((a, b - a))
        out.append(dict(zip(("data", "bytes", "chars", "units"), writer.close())))
    found = pd.DataFrame({"prefix_chars": pd.array([c[0] for c in cuts], dtype="Int64"), "middle_chars": pd.array([c[1] for c in cuts], dtype="Int64")})
    return found.assign(frames=pd.DataFrame(out).to_dict("records") if out else [])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """``docs`` without the text, with __n, __form, __prefix_chars, __middle_chars and the output as __output (frames).

    A null text is empty, and an empty text or one that holds a mark stays as it is (plain); so does a share of
    the others.  The draws depend on seed and key alone, so rows that repeat a key share
    their draws, each taken to the length of its own text; a null key draws as the word null.  Other columns stay, but for names that begin with two underscores.
    An empty table gives an empty result.
    """
    rows = chosen(framed(docs, text, frame_chars), key, seed)
    rows = rows.withColumn("__made", _written(F.col("__frames"), "__form", "__low", "__high", F.lit(frame_chars)))
    return rows.withColumns({"__prefix_chars": F.col("__made.prefix_chars"), "__middle_chars": F.col("__made.middle_chars"), "__output": F.col("__made.frames")}).drop("__made", "__frames", "__low", "__high")


def restored(output: Reader, form: str) -> Iterator[str]:
    """The text that an output was made of, frame by frame."""
    end = int(output.chars[-1])
    if form == "plain":
        yield from output.stream(0, end)
        return
    places, at = {}, 0
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        at = output.find(mark, at)
        places[mark] = at
        at += len(mark)
    edges = sorted([*places.values(), end])
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(places[mark] + len(mark), edges[edges.index(places[mark]) + 1])


@pandas_udf(_DIGESTS)
def digests(frames: pd.DataFrame, forms: pd.Series) -> pd.DataFrame:
    """SHA-256 of an output and of the text restored from it, both read frame by frame."""

    def digest(pieces: Iterator[str]) -> str:
        h = hashlib.sha256()
        for piece in pieces:
            h.update(piece.encode())
        return h.hexdigest()

    out = []
    for data, bytes_, chars, units_, form in zip(frames["data"], frames["bytes"], frames["chars"], frames["units"], forms):
        text = Reader(data, bytes_, chars, units_)
        out.append((digest(text.stream(0, int(text.chars[-1]))), digest(restored(text, form))))
    return pd.DataFrame(out, columns=["output_sha256", "restored_sha256"])


@pandas_udf(T.StringType())
def plain_text(frames: pd.DataFrame) -> pd.Series:
    """Frames as one string, for those who want the output itself."""
    return pd.Series(["".join((r := Reader(*row)).stream(0, int(r.chars[-1]))) for row in zip(frames["data"], frames["bytes"], frames["chars"], frames["units"])], dtype="object")
