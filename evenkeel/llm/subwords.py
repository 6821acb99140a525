"""Batch encoding of whole texts with a public tokenizer, one distinct piece at a time.

Both byte-level tokenizers split a text before a space that follows a
non-space, so a text's ids are those of its space-separated pieces in
order. Arrow splits the texts and numbers their distinct pieces; a piece of
letters and closing marks is taken as its letters and its marks. A task
encodes each distinct one of these once, keeps the ids in one flat array and
gathers them per text with numpy. Texts with runs of spaces are encoded whole
where a piece owns its leading space, since the run's split depends on its
length there.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces kept per Python worker before those used only once go.
MAX_PIECES = 900_000

_WORD_END = "</w>"
#: Byte-level tokenizers write bytes as printable characters: the printable Latin-1 ones as
#: themselves, the others, in order, as the characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
_CHAR_OF = {**{b: chr(b) for b in _SHOWN}, **{b: chr(256 + i) for i, b in enumerate(_HIDDEN)}}
_SPACE_CHAR = _CHAR_OF[32]
_BYTE_CHARS = {c: "".join(_CHAR_OF[b] for b in chr(c).encode()) for c in range(256)}
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
#: Letters whose pre-token is the same in any context, at the start of a line or not; marks may close them.
_LETTERS, _LINE_START = f"^{_LETTER}+$", f"^\n{_LETTER}+$"
_LETTER_CHARS = "".join(c for c in map(chr, range(256)) if re.match(_LETTER, c))
_WORD_CHARS = {_SPACE_CHAR, *(c for letter in _LETTER_CHARS for c in _BYTE_CHARS[ord(letter)])}
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLOSED = f"^\n?{_LETTER}+[!-/:-@\\[-`{{-~]+$"
#: Runs of white space whose split depends on their length, and what every text with such a run holds.
_RUNS = re.compile(r"\s[^\S\n ]|[^\S\n ]\s|  | \n|\n[ \n]|\n$")
_MAY_RUN = ("[\t\v\f\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
            "|  | \n|\n[ \n]|\n\\z")

_ENCODERS: dict[tuple[str, bool], "PieceEncoder"] = {}


class PieceEncoder:
    """``spaced``: a piece is encoded with the space before it (byte-level BPE without normaliser)."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # control strings in a text are ordinary text
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = spaced
        # The same model fed with ready pre-tokens: bytes as the characters that stand for them.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.edge = np.zeros(self.vocab, bool)
        joined = spaced
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith(_SPACE_CHAR) if spaced else token.endswith(_WORD_END)
            inner = _SPACE_CHAR in token.lstrip(_SPACE_CHAR)
            joined &= not (inner and _WORD_CHARS.issuperset(token))
        # Where no token goes on past a word's end, no merge does: many words are then one string to the model.
        self.between = "" if joined else " "
        self.newline = (self._raw(["\n"])[0] or [-1])[0]
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.stored = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.uses = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _forget(self) -> None:
        """Keep only pieces met again since they were stored."""
        at = np.fromiter(self.index.values(), np.int64, len(self.index))
        again = self.uses[at] > 1
        keys = [k for k, kept in zip(self.index, again.tolist()) if kept]
        sizes = self.sizes[at[again]]
        ids = _gather(self.ids, self.starts[at[again]], sizes)
        self._reset()
        if 2 * len(keys) < MAX_PIECES:
            self._store(self.index, keys, ids, sizes)

    def _raw(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _store(self, index: dict[str, int], keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first, n = self.stored, len(keys)
        self.starts = _room(self.starts, first + n)
        self.sizes = _room(self.sizes, first + n)
        self.uses = _room(self.uses, first + n)
        self.ids = _room(self.ids, self.used + len(flat))
        self.sizes[first:first + n] = sizes
        self.starts[first:first + n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.stored += n
        index.update(zip(keys, range(first, first + n)))

    def _learn_words(self, words: list[str]) -> None:
        """Pieces of plain letters: one pre-token each, given to the library's BPE model many at a time."""
        start = _SPACE_CHAR if self.spaced else ""
        for at in range(0, len(words), 8192):
            part = words[at:at + 8192]
            lines = [" ".join(part[i:i + 64]) for i in range(0, len(part), 64)]
            if not self.spaced:
                lines = [line.lower() for line in lines]
            lines = [start + (line if line.isascii() else _shown(line)).replace(" ", self.between + start)
                     for line in lines]
            got = [e.ids for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)]
            flat = _flat(got)
            edge = np.flatnonzero(self.edge[flat])
            if self.spaced:
                sizes = np.diff(np.append(edge, len(flat)))
            else:
                sizes = np.diff(np.concatenate(([-1], edge)))
            if len(sizes) != len(part):
                raise ValueError("a piece of plain letters is not one pre-token of this tokenizer")
            self._store(self.index, part, flat, sizes)

    def _learn_line_starts(self, keys: list[str]) -> None:
        """Words after a newline: encoded many at a time, cut at the ids of the newlines."""
        for at in range(0, len(keys), 4096):
            part = keys[at:at + 4096]
            flat = _flat(self._raw(["".join(part[i:i + 64]) for i in range(0, len(part), 64)]))
            sizes = np.diff(np.append(np.flatnonzero(flat == self.newline), len(flat)))
            if len(sizes) != len(part):
                raise ValueError("a newline before a word is not one token of this tokenizer")
            self._store(self.index, part, flat, sizes)

    def _learn_rest(self, keys: list[str]) -> None:
        """A key that starts with a space is the first piece of a text; no piece holds a space itself."""
        for at in range(0, len(keys), 4096):
            part = keys[at:at + 4096]
            got = self._raw([k[1:] if k[:1] == " " else " " + k if self.spaced and k[:1] != "\n" else k for k in part])
            self._store(self.index, part, _flat(got), np.fromiter(map(len, got), np.int64, len(got)))

    def _stored_at(self, keys: list[str], kinds: np.ndarray, tails: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the keys (different ones; kind 1: letters, 2: letters that start a line, 0: others) and
        of marks that follow letters (pre-tokens of their own) are stored."""
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        missed = np.flatnonzero(at < 0)
        if len(missed) + self.stored > MAX_PIECES and self.index:
            self._forget()
            at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
            missed = np.flatnonzero(at < 0)
        for kind, learn in enumerate((self._learn_rest, self._learn_words, self._learn_line_starts)):
            new = missed[kinds[missed] == kind]
            at[new] = self.stored + np.arange(len(new))
            learn([keys[i] for i in new.tolist()])
        self.uses[at] += 1
        new = [t for t in tails if t not in self.tails]
        if new:
            got = [ids[1:] for ids in self._raw(["a" + t for t in new])]
            self._store(self.tails, new, _flat(got), np.fromiter(map(len, got), np.int64, len(got)))
        return at, np.fromiter(map(self.tails.__getitem__, tails), np.int64, len(tails))

    def encode(self, texts: list[str], end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text); ``end`` closes every text."""
        column = pa.array(texts, pa.large_string())
        whole: dict[int, np.ndarray] = {}
        if self.spaced:
            for i in np.flatnonzero(pc.match_substring_regex(column, _MAY_RUN).to_numpy(zero_copy_only=False)).tolist():
                if _RUNS.search(texts[i]):
                    whole[i] = np.array(self._raw([texts[i]])[0], np.uint32)
            if whole:
                column = pa.array(["" if i in whole else t for i, t in enumerate(texts)], pa.large_string())
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " \n" if self.spaced else " "), " ")
        bound = parts.offsets.to_numpy()  # every text has a piece
        numbered = parts.values.dictionary_encode()
        piece, names = numbered.indices.to_numpy(), numbered.dictionary
        # A piece is its letters and its marks, or is taken whole.
        closed = pc.match_substring_regex(names, _CLOSED)
        stems = pc.if_else(closed, pc.ascii_rtrim(names, characters=_MARKS), names).dictionary_encode()
        closed = np.flatnonzero(closed.to_numpy(zero_copy_only=False))
        stem = stems.indices.to_numpy()
        keys = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        marks = pc.utf8_ltrim(names.take(pa.array(closed)), characters="\n" + _LETTER_CHARS).dictionary_encode()
        tails = marks.dictionary.to_pylist()
        firsts = []
        if self.spaced:  # the first piece of a text has no space before it
            firsts = [" " + p for p in parts.values.take(pa.array(bound[:-1])).to_numpy(zero_copy_only=False)]
        own = {k: i for i, k in enumerate(dict.fromkeys(firsts), len(keys))}
        kinds = np.zeros(len(keys) + len(own), np.int8)
        for kind, pattern in enumerate((_LETTERS, _LINE_START), 1):
            matches = pc.match_substring_regex(stems.dictionary, pattern).to_numpy(zero_copy_only=False)
            kinds[:len(keys)][matches] = kind
        at, tail = self._stored_at(keys + list(own), kinds, tails)
        of_name = np.concatenate((at[stem], at[[own[k] for k in firsts]] if firsts else at[:0]))
        runs = np.zeros((len(of_name), 2), np.int64)
        sizes = np.zeros(runs.shape, np.int64)
        runs[:, 0], sizes[:, 0] = self.starts[of_name], self.sizes[of_name]
        tail = tail[marks.indices.to_numpy()]
        runs[closed, 1], sizes[closed, 1] = self.starts[tail], self.sizes[tail]
        ids = _gather(self.ids, runs.ravel(), sizes.ravel())
        sizes = sizes.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        if firsts:
            piece = piece.copy()
            piece[bound[:-1]] = len(names) + np.arange(len(firsts))
        sizes = sizes[piece]
        flat = _gather(ids, starts[piece], sizes)
        bound = np.concatenate(([0], np.cumsum(sizes)))[bound]
        lens = np.diff(bound)
        for i, own in whole.items():
            lens[i] = len(own)
        out = np.empty(int(lens.sum()) + len(texts), np.uint32)
        stops = np.cumsum(lens + 1)
        out[stops - 1] = end
        if whole:
            for i in range(len(texts)):
                src = whole.get(i)
                out[stops[i] - 1 - lens[i]:stops[i] - 1] = flat[bound[i]:bound[i + 1]] if src is None else src
        else:
            keep = np.ones(len(out), bool)
            keep[stops - 1] = False
            out[keep] = flat
        return out, lens + 1


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.uint32)


def _shown(line: str) -> str:
    """A line of words as the characters that stand for their bytes; spaces stay."""
    return " ".join(word.translate(_BYTE_CHARS) for word in line.split(" "))


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    grown = np.zeros(max(n, 2 * len(a)), a.dtype)
    grown[:len(a)] = a
    return grown


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The worker's encoder for a vocabulary file (loaded once per Python worker)."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, spaced)
    return _ENCODERS[key]
