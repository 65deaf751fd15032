"""Byte-level BPE encoding of many whole texts, word by word.

The pre-tokenizer of such a vocabulary always cuts before a space that is
followed by a visible character, whatever stands around it.  A text may
therefore be cut there first and its pieces encoded alone.  The different pieces are
cut further as the pre-tokenizer does, so that a word and the marks after it count apart,
and the library's model encodes each distinct token once per worker; the ids of
whole texts are gathered with numpy.  Pieces with characters whose kind is not sure
here go through the library's pre-tokenizer, and texts that hold the string of a special
token go to the library whole.

Texts are split and their pieces numbered by Arrow, so that Python cuts and looks up the
different pieces of a group of texts only.  What a worker remembers is bounded in
bytes and kept in two generations: when the younger is full it becomes the older one,
from which tokens that are met again are taken over.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of tokens and ids that a generation of one Python worker's memory may hold, with
# what Python needs for an entry besides the token itself.
CACHE_BYTES = 16 << 20
ENTRY_BYTES = 150
# Longer texts are encoded part by part.
LONG_TEXT = 1 << 20
# Texts are encoded together up to this many characters, and the library's pre-tokenizer gets this
# many of new pieces at once: what it returns takes a hundred times their room for a moment.
GROUP_TEXT = 1 << 23
LEARN_TEXT = 1 << 16
# Pieces whose ids are gathered at once.
GATHER = 1 << 18

_ID = attrgetter("id")
_NONE, _SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
_CUT = re.compile(r"(?= \S)")
# A space before white space of any kind, or at the end; wider classes only cost time.
_ODD_SPACE = (
    r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|$)"
)
# Letters of any version of Unicode, and with them the characters whose kind is sure: digits, marks
# and white space are those of ASCII, further marks are neither letters nor numbers nor space.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ\u0400-\u0481\u048a-\u052f"
_MARKS = "¡-©«¬®-±´¶-¸»¿×÷\u2010-\u2027\u2030-\u205e"
_SURE = rf"^[\t\n\r -~{_LETTERS}{_MARKS}]*$"
_WORD = f"^ [{_LETTERS}]+$"
_SURE_PIECE = re.compile(_SURE[1:-1])
_TOKEN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
)
# The vocabulary's letters for bytes: the character of that number, or one from 256 on for those
# without a visible one.
_BYTES = np.arange(256, dtype="<u4")
_BYTES[[*range(33), *range(127, 161), 173]] = np.arange(256, 256 + 68)


def _spelled(tokens: list[str]) -> list[str]:
    """Tokens without the character 0 in the vocabulary's letters."""
    letters = np.frombuffer("\0".join(tokens).encode(), np.uint8)
    return _BYTES[letters].tobytes().decode("utf-32-le").split(chr(_BYTES[0]))


def _runs(pieces: list[str]) -> Iterator[list[str]]:
    """Consecutive pieces of LEARN_TEXT characters together, or one that is longer."""
    first = size = 0
    for k, piece in enumerate(pieces):
        if size and size + len(piece) > LEARN_TEXT:
            yield pieces[first:k]
            first, size = k, 0
        size += len(piece)
    if first < len(pieces):
        yield pieces[first:]


def parts(text: str) -> Iterator[str]:
    """Cut a long text before spaces that are followed by a visible character."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + LONG_TEXT // 2)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


def _strings(column: pa.Array) -> list[str]:
    """What to_pylist gives, in a fifth of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _gather(pool: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the numbered entries of a pool in one array, and where each stops, from 0 on."""
    starts = ends[at]
    sizes = ends[at + 1] - starts
    stops = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.arange(stops[-1]) + np.repeat(starts - stops[:-1], sizes)
    return pool[flat], stops


class _Generation:
    """Tokens by number, and the ids of each in one pool."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.bytes = 0

    def find(self, tokens: list[str]) -> np.ndarray:
        """Numbers of the tokens; -1 for unknown ones."""
        return np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))

    def add(self, tokens: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new tokens, in their order."""
        first = len(self.index)
        self.index.update(zip(tokens, range(first, first + len(tokens)), strict=True))
        self.pool = np.concatenate([self.pool, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.bytes += ENTRY_BYTES * len(tokens) + sum(map(len, tokens)) + 4 * len(ids)
        return np.arange(first, first + len(tokens))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gather(self.pool, self.ends, at)


class Encoder:
    """Token ids of texts, with a bounded memory of tokens already encoded."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.model, cut = self.library.model, self.library.pre_tokenizer
        # Only with this pre-tokenizer does _TOKEN give what it gives.
        self.known_cut = (
            isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.library.normalizer is None
        )
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.opens = np.zeros(self.size, bool)  # ids whose bytes begin with a space
        self.opens[[i for s, i in vocabulary.items() if s.startswith("Ġ")]] = True
        self.cache_bytes = cache_bytes
        self.young, self.old = _Generation(), _Generation()

    def _modelled(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of tokens that the pre-tokenizer would not cut, and the number of each."""
        sizes: list[int] = []
        found: list[int] = []
        for token in _spelled(tokens):
            got = self.model.tokenize(token)
            sizes.append(len(got))
            found.extend(map(_ID, got))
        return np.array(found, np.uint32), np.array(sizes, np.int64)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any pieces with one space, which they begin with."""
        sizes, found = [], []
        for run in _runs(pieces):
            got = self.library.encode_batch_fast(["".join(run)], add_special_tokens=False)
            ids = np.asarray(got[0].ids, np.uint32)
            starts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            sizes.append(np.diff(starts))
            found.append(ids)
        return np.concatenate(found), np.concatenate(sizes)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any pieces."""
        sizes, found = [], []
        for run in _runs(pieces):
            got = self.library.encode_batch_fast(run, add_special_tokens=False)
            sizes += [len(e.ids) for e in got]
            found += [np.asarray(e.ids, np.uint32) for e in got]
        return np.concatenate(found), np.array(sizes, np.int64)

    def _numbers(self, tokens: list[str], uncut: set[str]) -> np.ndarray:
        """Numbers of different tokens in the younger generation, which gets what it lacks.

        Those in ``uncut`` are pieces that only the library can cut.
        """
        if self.young.bytes > self.cache_bytes:
            self.young, self.old = _Generation(), self.young
        at = self.young.find(tokens)
        lost = np.flatnonzero(at < 0)
        wanted = [tokens[k] for k in lost.tolist()]
        before = self.old.find(wanted)
        known = np.flatnonzero(before >= 0)
        if len(known):
            ids, stops = self.old.ids(before[known])
            at[lost[known]] = self.young.add([wanted[k] for k in known.tolist()], ids, np.diff(stops))
        kinds: dict[Callable, list[int]] = {self._modelled: [], self._joined: [], self._apart: []}
        for k in np.flatnonzero(before < 0).tolist():
            p = wanted[k]
            if p not in uncut:
                kinds[self._modelled].append(k)
            else:
                kinds[self._joined if p[0] == " " and p.rfind(" ") == 0 else self._apart].append(k)
        for learn, some in kinds.items():
            if some:
                fresh = [wanted[k] for k in some]
                at[lost[some]] = self.young.add(fresh, *learn(fresh))
        return at

    def _pool(self, whole: pa.Array, joined: str, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``whole``, of the pieces in ``joined`` and of ``pieces``, and where each stops.

        Those in ``whole`` are tokens.  Those in ``joined`` are sure, and begin with the one
        space that they hold and a visible character.
        """
        tokens = _TOKEN.findall(joined)
        opens = np.fromiter((t[0] == " " for t in tokens), bool, len(tokens))
        sizes = np.diff(np.append(np.flatnonzero(opens), len(tokens)))
        uncut: set[str] = set()
        counts: list[int] = []
        for piece in pieces:
            if self.known_cut and _SURE_PIECE.fullmatch(piece):
                own = _TOKEN.findall(piece)
            else:
                own = [piece]
                uncut.add(piece)
            tokens += own
            counts.append(len(own))
        column = pa.concat_arrays([whole, pa.array(tokens, pa.large_string())])
        del tokens
        different = column.dictionary_encode()
        numbers = self._numbers(_strings(different.dictionary), uncut)
        ids, stops = self.young.ids(numbers[different.indices.to_numpy()])
        sizes = np.concatenate([np.ones(len(whole), np.int64), sizes, np.array(counts, np.int64)])
        return ids, stops[np.concatenate([[0], np.cumsum(sizes)])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text (null: none)."""
        whole: dict[int, np.ndarray] = {}
        rest: list[str] = []
        for k, text in enumerate(texts):
            if text and any(s in text for s in self.special):
                got = self.library.encode(text, add_special_tokens=False)
                whole[k] = np.asarray(got.ids, np.uint32)
            elif text and len(text) > LONG_TEXT:
                whole[k] = np.concatenate([self._group([p])[0] for p in parts(text)])
            rest.append("" if k in whole or text is None else text)
        ids, upto = self._group(rest)
        if not whole:
            return ids, np.diff(upto)
        found = [whole.get(k, ids[upto[k] : upto[k + 1]]) for k in range(len(texts))]
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text stops."""
        column = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(column, _ODD_SPACE).to_numpy(zero_copy_only=False))
        if len(odd):
            column = pa.array(
                np.where(np.isin(np.arange(len(texts)), odd), "", np.array(texts, object)), pa.large_string()
            )
        split = pc.split_pattern(column, " ")
        words = split.flatten().dictionary_encode()
        codes, values = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        spaced = pc.binary_join_element_wise(_NONE, values, _SPACE)  # nothing, space, word
        offsets = split.offsets.to_numpy()
        # The first word of a text has no space before it; an empty one is no piece.
        opening = np.zeros(len(codes), bool)
        opening[offsets[:-1]] = True
        used = np.zeros((2, len(values)), bool)
        used[0, codes[opening]] = True
        used[1, codes[~opening]] = True
        used[0] &= pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
        sure = np.zeros(len(values), bool)
        if self.known_cut:
            sure = pc.match_substring_regex(values, _SURE).to_numpy(zero_copy_only=False)
        word = pc.match_substring_regex(spaced, _WORD).to_numpy(zero_copy_only=False) & sure
        first, other = np.flatnonzero(used[0]), np.flatnonzero(used[1] & ~sure)
        plain, easy = np.flatnonzero(used[1] & word), np.flatnonzero(used[1] & sure & ~word)
        pieces = _strings(values.take(first)) + _strings(spaced.take(other))
        cuts = {int(k): [x for x in _CUT.split(texts[k]) if x] for k in odd}
        extra = list(set().union(*cuts.values()).difference(pieces))
        whole, joined = spaced.take(plain), "".join(_strings(spaced.take(easy)))
        table = np.full((2, len(values)), -1, np.int64)
        del column, split, words, values, spaced
        pool, ends = self._pool(whole, joined, pieces + extra)
        of_words = np.concatenate([plain, easy])
        table[1, of_words] = np.arange(len(of_words))
        table[0, first] = len(of_words) + np.arange(len(first))
        table[1, other] = len(of_words) + len(first) + np.arange(len(other))
        at = np.where(opening, table[0, codes], table[1, codes])
        counts = np.add.reduceat((at >= 0).astype(np.int64), offsets[:-1]) if len(texts) else np.zeros(0, np.int64)
        if cuts:
            named = {x: k for k, x in enumerate(pieces + extra, len(of_words))}
            bounds = np.split(at, offsets[1:-1])
            for k, own in cuts.items():
                bounds[k] = np.array([named[x] for x in own], np.int64)
                counts[k] = len(own)
            at = np.concatenate(bounds)
        at = at[at >= 0]
        cut = range(0, max(len(at), 1), GATHER)
        ids = np.concatenate([_gather(pool, ends, at[k : k + GATHER])[0] for k in cut])
        sizes = np.concatenate([[0], np.cumsum((ends[1:] - ends[:-1])[at])])
        return ids, sizes[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker; its memory is bounded by CACHE_BYTES."""
    return Encoder(path)


def encoded(encoder: Encoder, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(position, ids) of every text, encoding groups of bounded size."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first] or "")
        while last < len(texts) and (size := size + len(texts[last] or "")) <= GROUP_TEXT:
            last += 1
        ids, counts = encoder.encode(texts[first:last])
        at = 0
        for k, n in enumerate(counts):
            yield first + k, ids[at : at + n]
            at += n
        first = last


def encoded_column(encoder: Encoder, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The same for an Arrow column, of which one group at once becomes Python strings."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + GROUP_TEXT, side="right")))
        for k, ids in encoded(encoder, column.slice(first, last - first).to_pylist()):
            yield first + k, ids
        first = last
