"""Words as bags of hashed character n-grams, for the averaged-embedding classifiers.

Every word is taken with boundary marks; its subwords are its character n-grams and
the word itself, each hashed to a bucket. All text is read: long texts are cut at
white space into pieces of bounded size, which only bounds memory.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

PIECE_CHARS = 1 << 20
# Words that a task remembers at once; beyond that it forgets all and goes on.
REMEMBERED_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces that end at white space (a word longer than a piece is cut)."""
    start = 0
    while len(text) - start > size:
        end = next((i for i in range(start + size, start, -1) if text[i].isspace()), start + size)
        yield text[start:end]
        start = end
    yield text[start:]


def subword_buckets(words: Sequence[str], sizes: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword of the words."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = ["<" + w + ">" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), lengths)
    owners, hashes = [], []
    rolling = codes.copy()
    for n in range(2, sizes[1] + 1):
        rolling = rolling[:-1] * np.uint64(0x100000001B3) + codes[n - 1:]
        if n >= sizes[0]:
            inside = owner[:len(rolling)] == owner[n - 1:]
            owners.append(owner[:len(rolling)][inside])
            hashes.append(rolling[inside] + np.uint64(n))
    # The word itself: a position-weighted sum of its characters.
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(codes)) - np.repeat(starts, lengths)).astype(np.uint64)
    mixed = (codes + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    owners.append(np.arange(len(marked)))
    hashes.append(np.add.reduceat(mixed, starts))
    found = np.concatenate(hashes)
    found ^= found >> np.uint64(33)
    found *= np.uint64(0xFF51AFD7ED558CCD)
    found ^= found >> np.uint64(33)
    return np.concatenate(owners), (found % np.uint64(buckets)).astype(np.int64)


class WordTable:
    """What a linear layer over subword vectors gives for each word, remembered by word.

    ``weights`` has a row for each bucket: embedding times output layer, which is all
    that averaging needs, as both steps are linear. A row of the table is the sum over
    the word's subwords, and in the last column their number.
    """

    def __init__(self, weights: np.ndarray, sizes: tuple[int, int], fold=None):
        """``fold`` maps a word to the spelling that is hashed."""
        self.weights, self.sizes, self.fold = weights, sizes, fold
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, self.weights.shape[1] + 1), np.float32)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words in ``rows``."""
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        new = [w for w in set(words) if w not in self.known]
        if new:
            spelled = [self.fold(w) for w in new] if self.fold else new
            owner, bucket = subword_buckets(spelled, self.sizes, len(self.weights))
            first, total = len(self.known), len(self.known) + len(new)
            if total > len(self.rows):
                grown = np.zeros((max(total, 2 * len(self.rows)), self.rows.shape[1]), np.float32)
                grown[:first] = self.rows[:first]
                self.rows = grown
            for c in range(self.weights.shape[1]):
                self.rows[first:total, c] = np.bincount(owner, self.weights[bucket, c], len(new))
            self.rows[first:total, -1] = np.bincount(owner, minlength=len(new))
            self.known.update(zip(new, range(first, total)))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def in_batches(texts: Iterable[str | None], chars: int = 4 * PIECE_CHARS) -> Iterator[list[str]]:
    """Texts (null as empty) in groups of bounded length."""
    group, length = [], 0
    for text in texts:
        group.append(text or "")
        length += len(group[-1])
        if length >= chars:
            yield group
            group, length = [], 0
    if group:
        yield group


def hashed_counts(texts: Sequence[str], words_of, sizes: tuple[int, int], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and how often each occurs."""
    out = []
    for text in texts:
        times = Counter(w for piece in pieces(text) for w in words_of(piece))
        owner, bucket = subword_buckets(list(times), sizes, buckets)
        hit, where = np.unique(bucket, return_inverse=True)
        counts = np.fromiter(times.values(), np.float32, len(times))
        out.append((hit, np.bincount(where, counts[owner], len(hit)).astype(np.float32)))
    return out
