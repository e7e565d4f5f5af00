"""Hierarchical packing of token streams into windows of several lengths.

Documents are routed to tiers by length: as many whole long windows as a document fills, and
its rest to the shortest tier that holds it. Tiers are packed from long to short: the pieces
of a tier open its windows, gaps are filled with whole pieces of shorter tiers, largest first,
and what is then still open with the head of one more piece, whose tail stays in the pool.
Windows are dealt into steps so that every step has about the same number of tokens.

Every task packs its own partition, batch after batch, and hands what is left at the end of a
batch to the next one. At the end of a partition the rest, less than the longest tier, is cut
into windows of powers of two. So no window is padded, no shuffle is needed, and memory is
bounded by the batch.

Defined results: null and empty texts have the end token only. Rows that repeat are packed
as often as they occur; texts are tokenised whole.
An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from rillwater.llm.tables import col, small_batches

END_TOKEN = 1
TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 8 * 2048
# Pieces that a task remembers at once; beyond that it forgets all and goes on.
REMEMBERED_CHUNKS = 250_000
CHUNK_BATCH = 2000
SEQUENCE_BITS = 33

# White space that str.split() knows but the tokenizer's pattern does not.
OTHER_SPACE = re.compile("[\x1c-\x1f]")
# Chunks for which lower case and composition are character by character, and the pattern is ASCII plus Latin letters.
PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ]+")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+| ")


class _Store:
    """Id sequences one after the other, found by number."""

    def __init__(self):
        self.ids, self.starts, self.used, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Adds sequences given end to end; their numbers."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used:self.used + len(ids)] = ids
        first, self.count = self.count, self.count + len(sizes)
        self.starts[first + 1:self.count + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        return range(first, self.count)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of these numbers end to end, and their sizes."""
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(starts - before, sizes) + np.arange(sizes.sum())], sizes


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the first counts[0] values, of the next counts[1], and so on."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class ChunkTokenizer:
    """The ids that the tokenizer gives, with the ids of repeated words remembered.

    White space is dropped and no token spans it, so the ids of a text are those of its
    chunks. Chunks of ASCII and Latin letters are cut further as the tokenizer does, and
    many cut parts are encoded in one call: each ends with the one token that is marked as
    the end of a word. All other chunks are encoded one by one.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_CHUNKS):
        from tokenizers import Tokenizer

        self.remembered = remembered

        self.encoder = Tokenizer.from_file(path)
        vocabulary = self.encoder.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.part_ids, self.chunk_ids = _Store(), _Store()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), CHUNK_BATCH):
            group = parts[at:at + CHUNK_BATCH]
            ids = self._encode(" ".join(group))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                each = [self._encode(p) for p in group]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            self.parts.update(zip(group, self.part_ids.append(ids, np.diff(cuts, prepend=0))))

    def _learn(self, chunks: list[str]) -> None:
        plain = chunks
        joined = " ".join(chunks)
        if not PLAIN.fullmatch(joined) or "<|" in joined:
            plain = [c for c in chunks if PLAIN.fullmatch(c) and "<|" not in c]
            others = sorted(set(chunks).difference(plain))
            each = [self._encode(c) for c in others]
            if each:
                self.chunks.update(zip(others, self.chunk_ids.append(np.concatenate(each), np.array([len(x) for x in each]))))
            joined = " ".join(plain)
        if not plain:
            return
        cut = PART.findall(joined.lower())
        new = set(cut)
        new.discard(" ")
        self._learn_parts([p for p in new if p not in self.parts])
        numbers = np.fromiter((self.parts.get(p, -1) for p in cut), np.int64, len(cut))  # -1: the blank between chunks
        ends = np.append(np.flatnonzero(numbers < 0), len(numbers))
        ids, sizes = self.part_ids.get(numbers[numbers >= 0])
        self.chunks.update(zip(plain, self.chunk_ids.append(ids, _sums(sizes, np.diff(ends, prepend=-1) - 1))))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        whole = {i: self._encode(t) for i, t in enumerate(texts) if OTHER_SPACE.search(t)}
        words = [[] if i in whole else t.split() for i, t in enumerate(texts)]
        flat = list(chain.from_iterable(words))
        if len(self.chunks) > self.remembered:
            self.forget()
        if new := [w for w in set(flat) if w not in self.chunks]:
            self._learn(new)
        numbers = np.fromiter(map(self.chunks.__getitem__, flat), np.int64, len(flat))
        out, sizes = self.chunk_ids.get(numbers)
        lengths = _sums(sizes, np.array([len(ws) for ws in words], np.int64))
        return [whole.get(i, ids) for i, ids in enumerate(np.split(out, np.cumsum(lengths)[:-1]))] if texts else []


class Packer:
    """Packs pieces (document number, start, length) into windows, longest tier first."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # by tier: (length, document, start)

    def add(self, document: int, length: int) -> list[list[tuple[int, int, int]]]:
        """Windows that the document fills alone; its rest goes to a pool."""
        longest = self.tiers[0]
        whole = length // longest
        if rest := length - whole * longest:
            self._pool(document, whole * longest, rest)
        return [[(document, k * longest, longest)] for k in range(whole)]

    def _pool(self, document: int, start: int, length: int) -> None:
        insort(self.pools[min(t for t in self.tiers if t >= length)], (length, document, start))

    def _take(self, gap: int, cut: bool) -> tuple[int, int, int] | None:
        """The largest piece of a pool that fits the gap, or the head of the smallest that does not."""
        for tier in self.tiers:
            pool = self.pools[tier]
            k = bisect_left(pool, (gap + 1,))
            if k:
                return pool.pop(k - 1)
        if cut:
            for tier in reversed(self.tiers):
                if self.pools[tier]:
                    length, document, start = self.pools[tier].pop(0)
                    self._pool(document, start + gap, length - gap)
                    return gap, document, start
        return None

    def windows(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows from the pools; with ``last`` until nothing is left."""
        for tier in self.tiers:
            while self.pools[tier] and (self.left_at_least(tier)):
                length, document, start = self.pools[tier].pop()
                window, gap = [(document, start, length)], tier - length
                while gap:
                    length, document, start = self._take(gap, True)
                    window.append((document, start, length))
                    gap -= length
                yield window
        if last:
            tail = sorted((d, s, n) for pool in self.pools.values() for n, d, s in pool)
            rest, size = sum(n for _, _, n in tail), 0
            window: list[tuple[int, int, int]] = []
            while tail:
                size = size or 1 << (rest.bit_length() - 1)
                document, start, length = tail.pop(0)
                used = min(length, size)
                window.append((document, start, used))
                if length > used:
                    tail.insert(0, (document, start + used, length - used))
                size -= used
                rest -= used
                if not size:
                    yield window
                    window = []
            self.pools = {t: [] for t in self.tiers}

    def left_at_least(self, tokens: int) -> bool:
        found = 0
        for pool in self.pools.values():
            for p in pool:
                found += p[0]
                if found >= tokens:
                    return True
        return False


class Steps:
    """Deals windows into steps of about the same number of tokens."""

    def __init__(self, tokens: int):
        self.tokens, self.made, self.open = tokens, 0, []  # open: [step, tokens still free]

    def deal(self, sizes: list[int]) -> list[int]:
        """Step of each window: long windows first, each to the first step with room, so that
        short ones fill what is open. Steps that are not full wait for the next windows."""
        out = [0] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            step = next((s for s in self.open if s[1] >= sizes[k]), None)
            if step is None:
                step = [self.made, max(self.tokens, sizes[k])]
                self.open.append(step)
                self.made += 1
            step[1] -= sizes[k]
            if not step[1]:
                self.open.remove(step)
            out[k] = step[0]
        return out


def pack(docs: DataFrame, tokenizer_path: str, keep: Column, text_col: str = "text", tiers: tuple[int, ...] = TIERS,
         end_token: int = END_TOKEN, step_tokens: int = STEP_TOKENS, with_ids: bool = False,
         remembered: int = REMEMBERED_CHUNKS) -> DataFrame:
    """A row for each piece: the ``keep`` column, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length, step_id (and with ``with_ids`` the piece's ids).

    ``remembered`` is how many words a task keeps with their ids; fewer take less memory and more time."""
    if list(tiers) != sorted(set(tiers), reverse=True) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are different powers of two, longest first")
    given = docs.select(keep.alias("_key_"), col(text_col).alias("_text_"))
    name = docs.select(keep).columns[0]
    fields = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
              "sequence_length bigint, step_id bigint") + (", ids array<int>" if with_ids else "")
    key_type = given.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer, steps = ChunkTokenizer(tokenizer_path, remembered), Packer(tiers), Steps(step_tokens)
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        sequence = number = 0
        keys: dict[int, object] = {}  # of documents with pieces that are not placed yet
        streams: dict[int, np.ndarray] = {}
        kind = pa.int64()

        def placed(windows: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal sequence
            sizes = [sum(n for _, _, n in w) for w in windows]
            rows: list[list] = [[] for _ in range(10 if with_ids else 9)]
            for window, size, step in zip(windows, sizes, steps.deal(sizes)):
                offset = 0
                for document, start, length in window:
                    ids = streams[document]
                    piece = ids[start:start + length]
                    row = (keys[document], start, length, zlib.crc32(piece.astype("<u4", copy=False).tobytes()), len(ids), base + sequence, offset, size, base + step)
                    for column, value in zip(rows, row):
                        column.append(value)
                    if with_ids:
                        rows[9].append(piece.astype(np.int32))
                    offset += length
                sequence += 1
            columns = [pa.array(rows[0], key_arrow), *[pa.array(r, kind) for r in rows[1:9]]]
            if with_ids:
                columns.append(pa.array(rows[9], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = ["_key_", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id"] + ["ids"] * with_ids
        key_arrow = None
        for batch in batches:
            key_arrow = batch.schema.field(0).type
            texts, at = batch.column(1), 0
            while at < len(texts):
                group, chars = [], 0
                while at < len(texts) and chars < 2_000_000:
                    group.append(texts[at].as_py() or "")
                    chars += len(group[-1])
                    at += 1
                windows = []
                for key, ids in zip(batch.column(0)[at - len(group):at].to_pylist(), tokenizer.ids(group)):
                    keys[number], streams[number] = key, np.append(ids, np.uint32(end_token))
                    windows += packer.add(number, len(streams[number]))
                    number += 1
                windows += packer.windows(False)
                if windows:
                    yield placed(windows)
                open_now = {d for pool in packer.pools.values() for _, d, _ in pool}
                keys = {d: keys[d] for d in open_now}
                streams = {d: streams[d] for d in open_now}
        windows = list(packer.windows(True))
        if windows:
            yield placed(windows)

    out = small_batches(given).mapInArrow(run, f"_key_ {key_type}, {fields}")
    return out.withColumnRenamed("_key_", name)
