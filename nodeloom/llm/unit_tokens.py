"""Token ids of whole texts with the tokenizers library, each distinct unit encoded once.

The library spends its time on merges, and natural text repeats its words. A text is cut only where
the tokenizer's own pre-tokenization always cuts, whatever stands around the place, so that the ids of
a text are the ids of its units in a row:

* byte-level vocabulary: before a single space or line feed with a non-space on either side. No token
  reaches over such a place, and the look-ahead for white space never leaves its unit;
* word vocabulary, which drops white space: at spaces and line feeds.

Arrow cuts the texts and finds the distinct units of a chunk, so that Python sees each of those once. Units are encoded by ``encode_batch_fast``, words of plain letters many at a time. A worker remembers up to ``REMEMBER`` of them; beyond that it forgets those
that it has met once; ``settle`` forgets all but the ``KEPT`` that it has met most, for workers that go on to other work. A full stop or comma after a letter is a token of its own, so a unit that ends with one
takes the ids of the word before it.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

REMEMBER = 800_000
#: Units that a worker keeps between tasks.
KEPT = 20_000
#: Bytes above which a text is encoded in parts.
LONG = 1 << 23
#: Words encoded as one text.
JOINED = 64

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class UnitTokens:
    """Encoder for one vocabulary file. drops_space: the vocabulary ignores white space."""

    def __init__(self, path: str, drops_space: bool, remember: int = REMEMBER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space, self.remember = drops_space, remember
        #: Tokens at which a word of letters ends (or, with spaces, starts), so that many words can be encoded in one go.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.endswith("</w>") if drops_space else token.startswith("\u0120")
        self.stops = {x: self._encode([x])[0][0] for x in ".,"}
        self._forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 12, np.int32)
        self.size = np.zeros(1 << 12, np.int32)
        self.met = np.zeros(1 << 12, np.int64)
        self.unsure = np.zeros(1 << 12, bool)

    def settle(self) -> None:
        """Keep the ``KEPT`` units met most, so that the worker's memory is free for other work."""
        if len(self.index) > KEPT:
            self._make_room(KEPT, 0)
        common.hand_back()

    def _make_room(self, most: int = REMEMBER // 2, least: int = 1) -> None:
        """Forget the units met ``least`` times or less since the last time, and all but ``most`` of the others."""
        known = len(self.index)
        keep = np.flatnonzero(self.met[:known] > least)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(self.met[keep], kind="stable")[-most:]])
        units = list(self.index)
        sizes = self.size[keep]
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = self.ids[_spans(self.start[keep], sizes)]
        met, unsure = self.met[keep] // 2, self.unsure[keep]
        self._forget()
        # new strings side by side: old ones would hold on to the memory around them
        self.index = {units[i].encode().decode(): n for n, i in enumerate(keep.tolist())}
        self.ids = np.concatenate([ids, np.zeros(1 << 16, np.uint32)])
        self.used = len(ids)
        self.start, self.size, self.met, self.unsure = (np.concatenate([x, np.zeros(1 << 12, x.dtype)]) for x in ((ends - sizes).astype(np.int32), sizes, met, unsure))

    def _ids_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each) of units that aren't known, those that end with a stop from the word before it."""
        stem, end = [], []
        for x in units:
            stop = self.stops.get(x[-1:], -1)
            if stop >= 0 and x[-2:-1].isalpha() and x[-2] < "\u0130":
                stem.append(x[:-1])
                end.append(stop)
            else:
                stem.append(x)
                end.append(-1)
        place = dict.fromkeys(stem)
        words, single = [], []
        for x in place:
            (words if x.isalpha() and (x.isascii() or max(x) < "\u0130") else single).append(x)
        parts = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        order, flat, sizes = [], [], []
        for part, got in zip(parts, self._encode([" " + " ".join(x) for x in parts]), strict=True):
            ids = np.array(got, np.uint32)
            edge = np.flatnonzero(self.edge[ids])
            if len(edge) != len(part):
                single += part
                continue
            order += part
            flat.append(ids)
            sizes.append(np.diff(edge, prepend=-1) if self.drops_space else np.diff(edge, append=len(ids)))  # a word's last token, or its first
        got = self._encode(single if self.drops_space else [_spelled(x) for x in single])
        order += single
        sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        flat.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        place.update(zip(order, range(len(order)), strict=True))
        end, flat, sizes = np.array(end, np.int64), np.concatenate(flat), np.concatenate(sizes)
        at = np.fromiter(map(place.__getitem__, stem), np.int64, len(stem))
        counts = sizes[at] + (end >= 0)
        ids = np.empty(int(counts.sum()), np.uint32)
        last = np.cumsum(counts) - 1
        body = np.ones(len(ids), bool)
        body[last[end >= 0]] = False
        ids[body] = flat[_spans((np.cumsum(sizes) - sizes)[at], sizes[at])]
        ids[last[end >= 0]] = end[end >= 0]
        return ids, counts

    def _learn(self, units: list[str]) -> None:
        for at in range(0, len(units), 20_000):
            part = units[at : at + 20_000]
            flat, sizes = self._ids_of(part)
            first, n = len(self.index), len(part)
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
            if first + n > len(self.start):
                self.start, self.size, self.met, self.unsure = (np.concatenate([x, np.zeros(max(len(x), n), x.dtype)]) for x in (self.start, self.size, self.met, self.unsure))
            self.ids[self.used : self.used + len(flat)] = flat
            self.size[first : first + n] = sizes
            self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            self.unsure[first : first + n] = False if self.drops_space else [self._unsure(x) for x in part]
            self.index.update(zip(part, range(first, first + n), strict=True))

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(units of all texts in a row, number of units of each). A unit is named by what follows its space; \\x00 stands for a line feed, and \\x00\\x00 opens a text."""
        if self.drops_space:
            texts = pc.replace_substring(texts, "\n", " ")
        else:
            texts = pc.binary_join_element_wise("\x00\x00", pc.replace_substring(texts, "\n", " \x00"), "")
        split = pc.split_pattern(texts, " ")
        return split.flatten(), np.diff(split.offsets.to_numpy())

    def _unsure(self, unit: str) -> bool:
        """Whether white space touches an end of the unit, so that the places where it was cut may not be cuts."""
        bare = unit.lstrip("\x00")
        return not bare or bare[0].isspace() or bare[-1].isspace()

    def _places(self, units: list[str]) -> np.ndarray:
        """Place of each of the distinct units in the memory; unknown ones are learned."""
        at = np.fromiter(map(self.index.get, units, itertools.repeat(-1)), np.int32, len(units))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            first = len(self.index)
            self._learn([units[i] for i in missing.tolist()])
            at[missing] = np.arange(first, first + len(missing))
        return at

    def _encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.remember:
            self._make_room(self.remember // 2)
        units, counts = self._units(texts)
        coded = units.dictionary_encode()
        places, codes = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        self.met[places] += np.bincount(codes, minlength=len(places))
        at = places[codes]
        if not self.drops_space:
            owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
            care = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
            care[owner[self.unsure[places][codes]]] = True
            if care.any():
                # such texts are cut again, only where white space stands alone
                found = [["\x00\x00" + x for x in _CUT.split(texts[i].as_py())] for i in np.flatnonzero(care).tolist()]
                again = pa.array(list(itertools.chain.from_iterable(found)), pa.string()).dictionary_encode()
                plain = at[~care[owner]]
                counts = counts.copy()
                counts[care] = [len(x) for x in found]
                at = np.empty(int(counts.sum()), np.int32)
                here = np.repeat(care, counts)
                at[~here] = plain
                at[here] = self._places(again.dictionary.to_numpy(zero_copy_only=False).tolist())[again.indices.to_numpy()]
        sizes = self.size[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
        return self.ids[_spans(self.start[at], sizes)], np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text). A null text has none. A text above ``LONG`` bytes is encoded in parts, cut where the tokenizer cuts."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        long = np.flatnonzero(pc.binary_length(texts).to_numpy() > LONG)
        if not len(long):
            return self._encode_some(texts)
        ids, counts, at = [], np.zeros(len(texts), np.int64), 0
        for i in [*long.tolist(), len(texts)]:
            if i > at:
                got, counts[at:i] = self._encode_some(texts.slice(at, i - at))
                ids.append(got)
            if i < len(texts):
                for part in _parts(texts[i].as_py()):
                    got, n = self._encode_some(pa.array([part], pa.string()))
                    ids.append(got)
                    counts[i] += int(n[0])
            at = i + 1
        return np.concatenate(ids), counts


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` places of each."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((start - (ends - size)).astype(kind), size)


def _parts(text: str):
    """The text in parts of about ``LONG`` characters, cut where a single space or line feed stands between others; without such a place it stays whole."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + LONG) if at + LONG < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def _spelled(unit: str) -> str:
    if unit.startswith("\x00\x00"):
        return unit[2:]
    return "\n" + unit[1:] if unit.startswith("\x00") else " " + unit


_workers: dict[tuple[str, bool], UnitTokens] = {}


def encoder(path: str, drops_space: bool, remember: int = REMEMBER) -> UnitTokens:
    """The worker's encoder for a file: kept between tasks, since Spark reuses its Python workers."""
    key = (path, drops_space)
    if key not in _workers:
        _workers[key] = UnitTokens(path, drops_space, remember)
    return _workers[key]


def chunks(texts: pa.Array, most: int):
    """(from, to) of runs of texts with at most ``most`` bytes, or one text."""
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if len(texts):
        yield at, len(texts)
