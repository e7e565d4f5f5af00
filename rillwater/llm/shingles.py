"""Hashes of word n-grams, computed in numpy over batches of texts.

Words are what ASCII white space and control characters separate, in lower case. A text of
fewer words than the n-gram has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

GROUP_BYTES = 1 << 20
_LONGEST = 1 << 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_PLACES = _mix(np.arange(1, _LONGEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


VISIBLE = np.arange(256) > 32


def _cuts(data: bytes, letters: np.ndarray) -> Iterator[bytes]:
    """The bytes of a text in groups that end between words (a word longer than a group stays whole)."""
    start = 0
    while len(data) - start > GROUP_BYTES:
        codes = np.frombuffer(data, np.uint8, GROUP_BYTES, start)
        gaps = np.flatnonzero(~letters[codes[::-1]][:GROUP_BYTES - 1])
        if len(gaps):
            end = start + GROUP_BYTES - 1 - int(gaps[0])
        else:
            after = np.flatnonzero(~letters[np.frombuffer(data, np.uint8, offset=start + GROUP_BYTES)])
            end = start + GROUP_BYTES + int(after[0]) if len(after) else len(data)
        yield data[start:end]
        start = end
    yield data[start:]


def _word_hashes(data: bytes, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word: a sum of its bytes, each times a number of its place."""
    codes = np.frombuffer(data, np.uint8)
    letters = letters[codes]
    edges = np.flatnonzero(np.diff(letters, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(letters)
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    value = codes[at].astype(np.uint64) * _PLACES[place % _LONGEST]
    if sizes.max() > _LONGEST:
        value *= (place // _LONGEST * 2 + 1).astype(np.uint64)
    return _mix(np.add.reduceat(value, firsts) + sizes.astype(np.uint64)), starts


def _all_words(data: Iterable[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and how many each text has."""
    hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
    counts: list[int] = []
    group: list[bytes] = []
    owners: list[int] = []
    size = 0

    def settle() -> None:
        nonlocal size
        if group:
            found, starts = _word_hashes(b" ".join(group), letters)
            ends = np.cumsum([len(g) + 1 for g in group])
            for owner, n in zip(owners, np.diff(np.searchsorted(starts, ends), prepend=0).tolist()):
                counts[owner] += n
            hashes.append(found)
        group.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(data):
        counts.append(0)
        for part in _cuts(text, letters):
            group.append(part)
            owners.append(i)
            size += len(part)
            if size >= GROUP_BYTES:
                settle()
    settle()
    return np.concatenate(hashes), np.array(counts, np.int64)


def word_hashes(texts: Sequence[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of the given bytes, A-Z lowered, of all texts end to end, and how many each text has."""
    return _all_words((text.encode("utf-8", "surrogatepass").lower() for text in texts), letters)


def shingle_hashes(texts: Sequence[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts end to end (with repetitions), and how many each text has."""
    return word_runs(*_all_words((text.lower().encode("utf-8", "surrogatepass") for text in texts), VISIBLE), words)


def word_runs(hashed: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of so many words of texts given by their words' hashes, and how many each text has."""
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    padded = np.concatenate([hashed, np.zeros(words, np.uint64)])
    ends = np.repeat(starts + counts, n)
    total = np.zeros(len(at), np.uint64)
    for k in range(words):
        word = padded[at + k] * _PLACES[k]
        total += np.where(at + k < ends, word, np.uint64(0))
    return _mix(total), n


def distinct(hashes: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text."""
    at = 0
    for n in counts:
        yield np.unique(hashes[at:at + n])
        at += n
