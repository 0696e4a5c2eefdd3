"""Array helpers that run inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

_BREAK = re.compile(rb"[ \t-\r]")


def text_blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in blocks cut at white space, so that a very long one is never worked on as a whole."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = _BREAK.search(data, end)
            end = found.end() if found else len(data)
        yield data[start:end]
        start = end


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, block by block."""
    for block in text_blocks(data):
        yield block.split()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a buffer, and the number of the line that each is in."""
    found, start = placed_words(data)
    return found, np.searchsorted(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), start)


def placed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a buffer, and the byte at which each starts.

    A word's hash is a difference of prefix sums of byte * BASE**position, moved
    to position 0 by the inverse power, so the buffer is hashed in a few passes.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), out=sums[1:])
    found = (sums[end] - sums[start]) * _powers(pow(_BASE, -1, 1 << 64), len(raw))[start]
    return mixed(found + (end - start).astype(np.uint64)), start


_BASE = 0x9E3779B97F4A7C15
# Powers that a task keeps, for buffers up to the length of KEPT_POWERS.
KEPT_POWERS = 1 << 20
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    if count <= KEPT_POWERS:
        if len(_kept.get(base, ())) < count:
            _kept[base] = _made_powers(base, min(KEPT_POWERS, 2 * count))
        return _kept[base][: max(count, 1)]
    return _made_powers(base, count)


def _made_powers(base: int, count: int) -> np.ndarray:
    out = np.ones(max(count, 1), dtype=np.uint64)
    done = 1
    while done < count:
        step = np.uint64(pow(base, done, 1 << 64))
        part = out[: min(done, count - done)]
        out[done : done + len(part)] = part * step
        done += len(part)
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """Hash of 64-bit values in which every bit depends on all bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def joined_texts(texts: list[bytes], size: int = 1 << 22) -> Iterator[tuple[int, int, bytes]]:
    """(first, last + 1, texts joined by line feeds) of runs of about ``size`` bytes."""
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= size or i == len(texts) - 1:
            yield first, i + 1, b"\n".join(texts[first : i + 1])
            first, held = i + 1, 0


def local_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links a-b, given earlier labels."""
    labels = np.arange(n) if labels is None else labels
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ranges [low, high) one after the other, and the range of each."""
    count = high - low
    owner = np.repeat(np.arange(len(low)), count)
    return owner, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[owner]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches into frames of about ``rows`` rows that cut no group."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[keys] != frame[keys].iloc[-1].values).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held = [frame.iloc[cut:]]
        size = len(frame) - cut
    if size:
        yield pd.concat(held, ignore_index=True)


def group_numbers(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """0, 1, 2, ... for the groups of a frame sorted by the keys."""
    changed = np.zeros(len(frame), dtype=np.int64)
    for key in keys:
        values = frame[key].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.cumsum(changed)
