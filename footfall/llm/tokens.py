"""Token ids of texts by a public tokenizer."""

from __future__ import annotations

import itertools
import os
import string
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"
# Parts remembered in each of two generations, and the longest such part in bytes.
CACHE_PARTS, CACHE_LENGTH = 250_000, 64
# Bytes of text whose parts are told apart at a time.
BUFFER = 1 << 22
# Kinds of bytes; those of Latin letters beyond ASCII come in two bytes.
_OTHER, _LETTER, _DIGIT, _SIGN, _FEED, _BLANK = range(6)
_LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if chr(c) not in "×÷")
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, dtype=np.uint8)
    for kind, chars in ((_LETTER, (string.ascii_letters + _LATIN).encode()), (_DIGIT, string.digits.encode()), (_SIGN, _SIGNS.encode()), (_FEED, b"\n"), (_BLANK, b" ")):
        kinds[list(chars)] = kind
    return kinds


_KINDS = _kinds()


class WordTokenizer:
    """Ids as little-endian 32-bit bytes, equal to those of the whole text.

    The tokenizer splits a text before merging.  A blank between two characters that are
    not white space always begins a new part, so the words can be encoded alone
    and remembered.  If the tokenizer also splits between letters, digits, signs and a line feed, so are
    the parts of words of such Latin characters.  Texts with other white space next to a blank
    and those with a token of the tokenizer's own are encoded as a whole.
    """

    def __init__(self, path: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path if os.path.isabs(path) else public_tokenizers.path(path))
        self.opens = None
        self.own = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splits = self._splits()
        self.known: dict[bytes, bytes | None] = {}
        self.before: dict[bytes, bytes | None] = {}

    def _splits(self) -> bool:
        """Does the tokenizer split between parts of a word, and only there?"""
        before = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or before is None:
            return False
        kinds = [string.ascii_letters + _LATIN, string.digits, _SIGNS]
        rows = [(a, b, c) for a in kinds for b in (*kinds, "\n") for c in kinds if a != b != c]
        for lead, row in itertools.product(("", " "), rows):
            found = [part for part, _ in before.pre_tokenize_str(lead + "".join(row))]
            if found != [before.pre_tokenize_str(lead * (not k) + part)[0][0] for k, part in enumerate(row)]:
                return False
        return True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that each begin with a blank, many words a call: a word's first token begins with its blank."""
        if self.opens is None:
            size = self.tokenizer.get_vocab_size()
            blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
            self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(blank) for i in range(size)])
        groups = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        out = []
        for group, data in zip(groups, self._encode(["".join(g) for g in groups])):
            starts = np.flatnonzero(self.opens[np.frombuffer(data, dtype="<u4")])
            if len(starts) != len(group):
                raise ValueError("the tokenizer doesn't begin a token at every blank")
            edges = [4 * i for i in starts.tolist()] + [len(data)]
            out += [data[a:b] for a, b in zip(edges, edges[1:])]
        return out

    def _starts(self, data: bytes, heads: np.ndarray) -> np.ndarray:
        """Where the parts of texts begin that stand one after the other and begin at ``heads``."""
        raw = np.frombuffer(data, dtype=np.uint8)
        kinds = _KINDS[raw]
        new = kinds == _BLANK
        if self.splits:
            lead = np.flatnonzero(raw[:-1] == 0xC3)
            kinds[lead[(raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)]] = _OTHER
            # A line feed stands alone only between parts of other kinds.
            head = np.zeros(len(raw) + 1, dtype=bool)
            head[heads] = head[-1] = True
            feeds = np.flatnonzero(kinds == _FEED)
            lone = ~head[feeds] & ~head[feeds + 1]
            lone[lone] = (kinds[feeds[lone] - 1] < _FEED) & (kinds[feeds[lone] + 1] < _FEED)
            kinds[feeds[~lone]] = _OTHER
            inner = (kinds[1:] != kinds[:-1]) & ~new[:-1]
            others = np.flatnonzero(kinds == _OTHER)
            if len(others):
                # Words with other characters stay whole.
                words = np.append(np.flatnonzero(new | head[:-1]), len(raw))
                odd = np.searchsorted(words, others, "right") - 1
                odd = odd[np.flatnonzero(np.diff(odd, prepend=-1))]
                change = np.zeros(len(raw) + 1, dtype=np.int8)
                change[words[odd]] += 1
                change[words[odd + 1]] -= 1
                inner &= np.cumsum(change[:-1], dtype=np.int8)[1:] == 0
            new[1:] |= inner
        new[heads] = True
        return np.flatnonzero(new)

    def _learn(self, parts: list[bytes]) -> dict[bytes, bytes | None]:
        """Ids of parts; None if white space touches the ends of one that has other characters or a blank."""
        known, before = self.known, self.before
        words, others = [], []
        for part in parts:
            if part in known:
                continue
            if part in before:
                known[part] = before[part]
            else:
                text = part.decode()
                word = text[1:] if text[0] == " " else text
                if part != b"\n" and (not word or word[0].isspace() or word[-1].isspace()):
                    known[part] = None
                else:
                    (others if word is text else words).append((part, text))
        for some, encode in ((words, self._encode_words), (others, self._encode)):
            known.update(zip([p for p, _ in some], encode([t for _, t in some])))
        return known

    def _forget(self, parts: list[bytes]) -> None:
        for part in parts:
            if len(part) > CACHE_LENGTH:
                self.known.pop(part, None)
        if len(self.known) > CACHE_PARTS:
            self.known, self.before = {}, self.known

    def _ids(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of texts that are not empty, None for those to be encoded as a whole."""
        edges = np.cumsum([0] + [len(t) for t in texts])
        data = b"".join(texts)
        starts = self._starts(data, edges[:-1])
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        known = self._learn(parts)
        ids = pa.array([known[p] for p in parts], pa.binary()).take(coded.indices)
        self._forget(parts)
        first = np.searchsorted(starts, edges)
        cuts = np.frombuffer(ids.buffers()[1], dtype=np.int32)[first].tolist()
        out = ids.buffers()[2].to_pybytes()
        apart = np.zeros(len(texts), dtype=bool)
        if ids.null_count:
            apart[np.searchsorted(first, np.flatnonzero(ids.is_null()), "right") - 1] = True
        apart |= np.isin(np.frombuffer(data, dtype=np.uint8)[edges[:-1]], [10, 32])
        for token in self.own:
            if token in data:
                apart |= [token in t for t in texts]
        return [None if a else out[lo:hi] for a, lo, hi in zip(apart.tolist(), cuts, cuts[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        data, out = [t.encode() for t in texts], [b""] * len(texts)
        held = [i for i, t in enumerate(data) if t]
        size = np.cumsum([len(data[i]) for i in held])
        for group in np.split(np.array(held, dtype=np.int64), np.flatnonzero(np.diff(size // BUFFER)) + 1):
            group = group.tolist()
            for i, found in zip(group, self._ids([data[i] for i in group]) if group else []):
                out[i] = found if found is not None else self._encode([texts[i]])[0]
        return out


@lru_cache(maxsize=1)
def word_tokenizer(path: str = TOKENIZER) -> WordTokenizer:
    """One for all tasks of a Python process, with what it remembers."""
    return WordTokenizer(path)
