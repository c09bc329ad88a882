"""Token ids of whole texts, with a bounded cache of word encodings.

The BPE pre-tokenizers of the supported vocabularies never join characters across most blanks,
so a text is cut at points where its encoding falls apart, and each piece is encoded once per
worker. Texts with blanks or punctuation for which a cut could change ids are encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlens.llm.common import slices

CACHE_WORDS = 1_000_000
"""Pieces a worker remembers; when there are more, the half that most batches held stays."""

AT_ONCE = 32_000
"""Characters given to the tokenizer together; what it returns is many times the
size of the ids."""

TOGETHER = 64
"""Pieces that are encoded as one text."""

FIRST = "\x00"
"""Stands before the first piece of a text, whose key would mean another text without it."""

# Runs of blanks that one cut would split into other tokens than the whole run.
_UNSAFE_BLANK = re.compile(r"\s{3}|\s{2}\Z")
# Without these and without other blanks than space and line end, no run can be that long.
_STOPS = ("\n", ",", ".")
_DOUBLE = ("  ", " \n", "\n ", "\n\n")
_OTHER_BLANK = re.compile(
    "[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# What is noted about a piece: it is cut off before a stop or comma, which is no safe cut after it
# (only letters and digits are safe, and blanks where these go), or it holds other blanks.
BEGINS, ENDS, BLANK = 1, 2, 4


def vocabulary(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with one tokenizer file; ids come back in the smallest unsigned type.

    Texts are cut and their pieces numbered in Arrow, so that Python sees each piece once in a
    batch. The ids of the pieces known so far lie one behind the other in one array, and the ids
    of a batch are gathered from there.
    """

    def __init__(self, path: str):
        # One thread for each task: Spark runs as many tasks as there are cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # Vocabularies with word ends drop blanks; byte-level ones keep them in front of words.
        suffix = self.tokenizer.model.end_of_word_suffix
        self.drops_blanks = bool(suffix)
        # Byte-level ids that begin with a blank: each piece with its blank has exactly one.
        known = self.tokenizer.get_vocab()
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for token, i in known.items() if token[:1] == "\u0120"]] = True
        # Where blanks go, a rare word of one id stands between pieces instead.
        words = [t for t in known if suffix and re.fullmatch("[a-z]{4,}", t.removesuffix(suffix))]
        words = [t for t in words if t.endswith(suffix)]
        rare = max(words, key=known.get, default="")
        self.between, self.mark = f" {rare.removesuffix(suffix or '')} ", known.get(rare, -1)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, self.kind)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.note = np.zeros(1 << 12, np.uint8)
        self.seen = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _halve(self) -> None:
        """Forget the pieces that the fewest batches held."""
        held, seen = list(self.slot), self.seen[: len(self.slot)]
        at = np.sort(np.argsort(-seen, kind="stable")[: CACHE_WORDS // 2])
        lengths, seen = self.length[at], seen[at]
        ids = self._gathered(at, lengths)
        self._forget()
        self._keep([held[i] for i in at.tolist()], ids, lengths)
        self.seen[: len(at)] = seen

    def _noted(self, piece: str) -> int:
        last = piece[-1:]
        if self.drops_blanks:
            safe = last.isalnum() or last.isspace() or not last
        else:
            safe = last.isalnum() or piece == FIRST
        found = 0 if safe else ENDS
        if piece[:1] in (",", "."):
            found |= BEGINS
        if not piece.isalnum() and _OTHER_BLANK.search(piece):
            found |= BLANK
        return found

    def _keep(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember the ids of new pieces."""
        known, wanted = len(self.slot), len(self.slot) + len(pieces)
        while len(self.start) < wanted:
            self.start, self.length, self.note, self.seen = (
                np.append(a, np.zeros_like(a))
                for a in (self.start, self.length, self.note, self.seen)
            )
        while len(self.ids) < self.used + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.start[known:wanted] = self.used + np.cumsum(lengths) - lengths
        self.length[known:wanted] = lengths
        self.note[known:wanted] = np.fromiter(map(self._noted, pieces), np.uint8, len(pieces))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slot.update(zip(pieces, range(known, wanted), strict=True))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [f.ids for f in found]

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and the number of each; some units are encoded as one text."""
        groups = [units[at : at + TOGETHER] for at in range(0, len(units), TOGETHER)]
        between = self.between if self.drops_blanks else ""
        ids, lengths = [], []
        for group, found in zip(groups, self._whole([between.join(g) for g in groups]), strict=True):
            own = np.array(found, np.int64)
            if self.drops_blanks:
                at = np.flatnonzero(own == self.mark)
                counts = np.diff(at, prepend=-1, append=len(own)) - 1
                own = np.delete(own, at)
            else:
                at = np.flatnonzero(self.begins[own])
                counts = np.diff(at, append=len(own))
            if len(counts) != len(group):
                # A unit holds the mark itself.
                own, counts = self._apart(group)
            ids.append(own)
            lengths.append(counts)
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, lengths))

    def _apart(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole(units)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, lengths.sum()), lengths

    def _cut(self, text: str) -> str:
        """The text with a blank at each cut."""
        if self.drops_blanks:
            return text.replace("\n", " ").replace(",", " ,").replace(".", " .")
        # The first piece has no blank before it: mark it, as its key means another text.
        return FIRST + text.replace("\n", " \n").replace(",", " ,").replace(".", " .")

    def _learn(self, pieces: list[str]) -> None:
        """Encode the pieces that are not known; lots bound what the tokenizer returns."""
        new = [p for p in pieces if p not in self.slot]
        if self.drops_blanks:
            alone = []
        else:
            alone = [p for p in new if p[:1] in _STOPS or p[:1] == FIRST]
            new = [p for p in new if p[:1] not in _STOPS and p[:1] != FIRST]
        for lot in slices([len(p) for p in alone], AT_ONCE):
            self._keep(alone[lot], *self._apart([p.removeprefix(FIRST) for p in alone[lot]]))
        for lot in slices([len(p) for p in new], AT_ONCE):
            units = new[lot] if self.drops_blanks else [f" {p}" for p in new[lot]]
            self._keep(new[lot], *self._together(units))

    def encode_flat(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, each with ``end_id``, and the number of each."""
        if not texts:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        lists = pc.split_pattern(pa.array(map(self._cut, texts), pa.large_string()), " ")
        pieces = lists.flatten().dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) + len(names) > CACHE_WORDS:
            self._halve()
        self._learn(names)
        slots = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        self.seen[slots] += 1
        slots, ends = slots[pieces.indices.to_numpy()], lists.offsets.to_numpy()
        whole = self._unsafe(texts, self.note[slots], ends)
        lengths = self.length[slots]
        for i in whole:
            lengths[ends[i] : ends[i + 1]] = 0
        ids = self._gathered(slots, lengths)
        counts = np.diff(np.append(0, np.cumsum(lengths))[ends])
        for lot in slices([len(texts[i]) for i in whole], AT_ONCE):
            found = self._whole([texts[i] for i in whole[lot]])
            place = np.cumsum(counts) - counts
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, sizes.sum())
            ids = np.insert(ids, np.repeat(place[whole[lot]], sizes), flat)
            counts[whole[lot]] = sizes
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1

    def _unsafe(self, texts: list[str], note: np.ndarray, ends: np.ndarray) -> list[int]:
        """Texts for which a cut could change ids."""
        stop = np.flatnonzero((note[1:] & BEGINS) & ((note[:-1] & ENDS) >> 1)) + 1
        found = set((np.searchsorted(ends, stop, "right") - 1).tolist())
        if not self.drops_blanks:
            at = np.searchsorted(ends, np.flatnonzero(note & BLANK), "right") - 1
            other = set(at.tolist())
            for i, text in enumerate(texts):
                if i in other or any(d in text for d in _DOUBLE):
                    if _UNSAFE_BLANK.search(text):
                        found.add(i)
                if FIRST in text:
                    found.add(i)
        return sorted(found)

    def _gathered(self, slots: np.ndarray, length: np.ndarray) -> np.ndarray:
        before = np.cumsum(length) - length
        at = np.repeat(self.start[slots] - before, length)
        return self.ids[at + np.arange(len(at))]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, kept across tasks."""
    return Encoder(path)


def batches(texts: list[str], chars: int = 4_000_000):
    """Consecutive slices of ``texts`` of about ``chars`` characters, one text at least."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def encode_all(path: str, texts: list[str], end_id: int):
    """Ids of each text followed by ``end_id``, as unsigned 32-bit arrays, one after another."""
    own = encoder(path)
    for some in batches(texts):
        ids, lengths = own.encode_flat(some, end_id)
        yield from np.split(ids.astype("<u4"), np.cumsum(lengths)[:-1])


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
