"""Token counts of whole texts under a SentencePiece BPE model, without building the tokens.

A text becomes pre-tokens (a word with the blank in front of it). The pre-tokens of a batch that a
worker has not met before lie one behind the other in ragged numpy arrays. In every round each of
them applies its own pair of the lowest rank, all of them at once, until no pair is left; what
counts is the number of symbols that survive. Characters without a piece count their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, slices
from ledgerlens.llm.tokens import vocabulary

LIMIT = 4096
BLANK = "▁"
CACHE_WORDS = 400_000
"""Pre-tokens a worker remembers; when there are more, those of the batch at hand stay."""
AT_ONCE = 4 << 20
"""Bytes of text that are cut into pre-tokens together; a longer text is cut into such parts."""
SYMBOLS_AT_ONCE = 1 << 20
"""Characters of new pre-tokens that are merged together."""
NEVER = np.int32(2**31 - 1)

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
"""Kinds of pieces in the model format (fixed values)."""


class Merger:
    """Merges ragged sequences of symbols by the ranks of one model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rule = proto.normalizer_spec
        plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        if proto.trainer_spec.model_type != 2 or rule.precompiled_charsmap or not plain:
            raise ValueError("only BPE models that leave texts as they are can be counted")
        if {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with pieces of users cannot be counted")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback can be counted")
        scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self._pairs(scores)
        self._blanks(scores)

    def _pairs(self, scores: dict[str, float]) -> None:
        """Symbols, ranks of all pairs whose union is a piece, and what they become."""
        symbols = {p: i for i, p in enumerate([*scores, *sorted(set("".join(scores)) - set(scores))])}
        order = sorted(set(scores.values()), reverse=True)
        place = {s: i for i, s in enumerate(order)}
        at, rank, into = [], [], []
        self.size = len(symbols) + 1
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    at.append(left * self.size + right)
                    rank.append(place[score])
                    into.append(symbols[piece])
        at = np.array(at, np.int64)
        by = np.argsort(at)
        # One key above all others, so that a search always ends inside.
        self.at = np.append(at[by], np.int64(self.size) * self.size)
        self.rank = np.append(np.array(rank, np.int32)[by], NEVER)
        self.into = np.append(np.array(into, np.int32)[by], 0)
        shared = np.zeros(len(order) + 1, np.int64)
        np.add.at(shared, [place[s] for s in scores.values()], 1)
        self.shared = shared > 1
        # The last symbol stands for every character that has no piece.
        self.of = np.full(0x110000, self.size - 1, np.int32)
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.of[ord(piece)] = i
        self.costs_bytes = np.ones(self.size, bool)
        self.costs_bytes[[symbols[p] for p in scores]] = False
        self.blank = symbols.get(BLANK, -1)
        # Where each piece alone comes out as itself, over ever higher ranks, a pair that arises
        # from a merge never precedes the rest of that rank: its pairs can be merged at once.
        self.together = False
        many = [p for p in scores if len(p) > 1 and p.strip(BLANK)]
        self.together = bool((self.count(many)[0] == 1).all()) and self._rising(symbols, scores, many)

    def _rising(self, symbols: dict, scores: dict, pieces: list[str]) -> bool:
        """Whether every piece has parts that both come before it."""

        def before(part: str, score: float) -> bool:
            return part in symbols and (len(part) == 1 or scores[part] > score)

        return all(
            any(before(p[:c], scores[p]) and before(p[c:], scores[p]) for c in range(1, len(p)))
            for p in pieces
        )

    def _blanks(self, scores: dict[str, float]) -> None:
        """Symbols of runs of blanks, and whether texts may be cut before blanks and line ends."""
        runs = [p for p in scores if len(p) > 1 and not p.strip(BLANK)]
        words = [s for p, s in scores.items() if len(p) > 1 and p.strip(BLANK)]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p or " " in p for p in scores):
            raise ValueError("models with blanks or line ends inside pieces cannot be counted")
        if runs and max(scores[p] for p in runs) >= min(words, default=0.0):
            raise ValueError("models that prefer runs of blanks to words cannot be counted")
        if any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in scores):
            raise ValueError("models with several blanks before a word cannot be counted")
        self.longest_run = max(map(len, runs), default=1)
        self.run = [0, *self.count([BLANK * n for n in range(1, 4 * self.longest_run)])[0].tolist()]
        # The leftmost run grows first, up to the longest one, to which nothing can be added.
        if any(
            self.run[n] != 1 + self.run[n - self.longest_run]
            for n in range(self.longest_run, len(self.run))
        ):
            raise ValueError("runs of blanks do not fall apart at the longest one")

    def blanks(self, n: int) -> int:
        """Symbols of ``n`` blanks in a row with no word after them."""
        full = max(0, n // self.longest_run - 1)
        return full + self.run[n - full * self.longest_run]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        i = np.searchsorted(self.at, key)
        return np.where(self.at[i] == key, self.rank[i], NEVER), self.into[i]

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of each word, and whether a blank alone is the first of them."""
        counts, bare = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.flatnonzero(lens)
        lens = lens[word]
        symbol = self.of[chars]
        # A character without a piece of its own counts its bytes, less the one counted below.
        wide = self.costs_bytes[symbol]
        if wide.any():
            owner = np.repeat(word, lens)[wide]
            size = (chars[wide, None] >= np.array([0x80, 0x800, 0x10000], np.uint32)).sum(axis=1)
            np.add.at(counts, owner, size)
        # The pair of a symbol with the next one; the last symbol of a word has none.
        ends = np.cumsum(lens)
        rank, into = self._ranked(symbol, np.append(symbol[1:], 0))
        rank[ends - 1] = NEVER
        while len(word):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            over = low == NEVER
            if over.any():
                counts[word[over]] += lens[over]
                bare[word[over]] = symbol[starts[over]] == self.blank
                stay = np.repeat(~over, lens)
                symbol, rank, into = symbol[stay], rank[stay], into[stay]
                word, lens, low = word[~over], lens[~over], low[~over]
                if not len(word):
                    break
                starts = np.cumsum(lens) - lens
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            hit = self._apart(hit, starts, low)
            symbol[hit] = into[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, rank, into = symbol[stay], rank[stay], into[stay]
            owner = np.searchsorted(starts, hit, "right") - 1
            lens = lens - np.bincount(owner, minlength=len(lens))
            hit -= np.arange(len(hit))
            last = np.cumsum(lens) - 1
            first = np.zeros(len(symbol), bool)
            first[last - lens + 1] = True
            anew = np.concatenate([hit, hit[~first[hit]] - 1])
            rank[anew], into[anew] = self._ranked(symbol[anew], np.append(symbol, 0)[anew + 1])
            rank[last] = NEVER
        return counts, bare

    def _apart(self, hit: np.ndarray, starts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Pairs that can be merged together: from left to right, none shares a symbol."""
        near = np.append(False, np.diff(hit) == 1)
        if near.any():
            head = np.flatnonzero(~near)
            offset = hit - np.repeat(hit[head], np.diff(np.append(head, len(hit))))
            hit = hit[offset % 2 == 0]
        # Pieces of equal score go strictly from left to right, one in a round.
        alone = np.ones(len(low), bool) if not self.together else self.shared[low]
        if alone.any():
            owner = np.searchsorted(starts, hit, "right") - 1
            leading = np.append(True, np.diff(owner) != 0)
            hit = hit[leading | ~alone[owner]]
        return hit


class Counter:
    """Counts of whole texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.known: dict[bytes, int] = {b"": 0}
        self.bare: set[bytes] = set()

    def _learn(self, wanted: set[bytes]) -> None:
        if len(self.known) + len(wanted) > CACHE_WORDS:
            self.known = {w: self.known[w] for w in wanted if w in self.known} | {b"": 0}
            self.bare &= wanted
        new = [w for w in wanted if w not in self.known]
        # The blank is left away where a line end stands before the word.
        words = [w.decode("utf-8", "replace") for w in new]
        words = [w if w[0] == "\n" else BLANK + w for w in words]
        for part in slices([len(w) for w in words], SYMBOLS_AT_ONCE):
            counts, bare = self.merger.count(words[part])
            self.known.update(zip(new[part], counts.tolist(), strict=True))
            self.bare.update(w for w, b in zip(new[part], bare, strict=True) if b)

    def _parts(self, text: bytes) -> Iterator[list[bytes]]:
        """Pre-tokens of a text; an empty one is a blank more. Long texts come in several parts."""
        text = (b" " + text).replace(BLANK.encode(), b" ").replace(b"\n", b" \n")
        at = 0
        while len(text) - at > AT_ONCE:
            # Between a word and a blank, so that runs of blanks stay whole.
            cut = text.find(b" ", at + AT_ONCE)
            while cut > 0 and text[cut - 1] == 0x20:
                cut = text.find(b" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut].split(b" ")[1:]
            at = cut
        yield text[at:].split(b" ")[1:]

    def _more(self, words: list[bytes]) -> int:
        """Symbols of the blanks beside those that stand directly before words."""
        more = run = 0
        for word in words:
            if not word:
                run += 1
            elif run:
                if word in self.bare:
                    more += self.merger.blanks(run + 1) - 1
                else:
                    more += self.merger.blanks(run)
                run = 0
        return more + self.merger.blanks(run)

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text; those of an empty one are none."""
        found = [0] * len(texts)
        for some in slices([len(t) for t in texts], AT_ONCE):
            if some.stop - some.start > 1:
                cut = [next(self._parts(t)) if t else [] for t in texts[some]]
                self._learn(set().union(*cut))
                found[some] = [self._sum(words) for words in cut]
            elif texts[some.start]:
                for words in self._parts(texts[some.start]):
                    self._learn(set(words))
                    found[some.start] += self._sum(words)
        return found

    def _sum(self, words: list[bytes]) -> int:
        total = sum(map(self.known.__getitem__, words))
        return total + self._more(words) if b"" in words else total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The worker's counter for a model, kept across tasks."""
    return Counter(path)


def _counted(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            tokens = np.array(own.count(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs (doc_id, text)``.

    ``path`` names a SentencePiece BPE model with byte fallback. Counts are those of its library,
    without begin, end or other added tokens; strings such as ``<s>`` are ordinary text. A null or
    empty text has no bytes and no tokens. Repeated rows are counted each, a null doc_id stays
    null, and other columns are not looked at. The rows stay where they are: nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(_counted(path, limit), schema)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
