"""Byte-level BPE: encoding and decoding of whole texts with a public vocabulary (operator 2).

A text is cut into words by the vocabulary's pattern; each word is merged by itself. All words of a
slice that the worker has not met yet are merged together: their parts and the ranks of adjacent
parts lie in rectangular arrays, one row a word. Each round scans every row for its smallest rank,
deletes that boundary, and looks up the two ranks beside it. Words too long for that (the scan is
quadratic) take their smallest rank from a heap instead, with the same result.

There is no shuffle: each row is encoded where it is read. Memory is bounded by the slice, the
longest text and the worker's caches: when the younger is full it becomes the older one, which goes.

Nulls count as empty texts; an empty text has no ids and decodes to an empty text. Repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from ranlens.llm.common import mapped, sha256, slices, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a word that is merged in the rectangular arrays, and kept in the cache.
SHORT_WORD = 64
#: Words the two caches of a worker take up before one is dropped.
CACHE_WORDS = 300_000
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary, by the public rule."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, ranks and bytes of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, ids = byte_letters(), content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in self.special
        } | {i: text.encode() for text, i in self.special.items()}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
        pairs = np.array([(ids[a] << 20) | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_ranks = pairs[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        self.rank_of = dict(zip(pairs.tolist(), range(len(merges))))
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of adjacent ids; NO_RANK where no merge joins them."""
        pairs = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pairs) & (right >= 0), self.pair_ranks[at], NO_RANK)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of similar length, merged in step: one row of the arrays a word."""
        width = max(map(len, words))
        parts = np.full((len(words), width + 1), -1, dtype=np.int32)
        filled = np.frombuffer(b"".join(word.ljust(width, b"\0") for word in words), dtype=np.uint8)
        sizes = np.array([len(word) for word in words])
        columns = np.arange(width)
        parts[:, :width] = np.where(columns < sizes[:, None], self.byte_ids[filled].reshape(-1, width), -1)
        ranks = self.ranks(np.maximum(parts[:, :-1], 0), parts[:, 1:])
        done, rows = parts.copy(), np.arange(len(words))
        while True:
            own = np.arange(len(rows))
            at = ranks.argmin(axis=1)
            best = ranks[own, at]
            found = best < NO_RANK
            if not found.all():  # words whose parts are final leave the arrays
                done[rows[~found]] = parts[~found]
                rows, parts, ranks, at, best = rows[found], parts[found], ranks[found], at[found], best[found]
                own = own[: len(rows)]
            if not len(rows):
                break
            parts[own, at] = self.merged[best]
            moved = columns + (columns > at[:, None])
            parts[:, :width] = np.take_along_axis(parts, moved, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(moved, width - 1), axis=1)
            ranks[:, -1] = NO_RANK
            before = np.maximum(at - 1, 0)
            left = np.concatenate([parts[own, at], parts[own, before]])
            fresh = self.ranks(left, np.concatenate([parts[own, at + 1], parts[own, before + 1]]))
            ranks[own, before] = fresh[len(rows) :]
            ranks[own, at] = fresh[: len(rows)]
        ends = (done >= 0).sum(axis=1) * 4
        data, step = done.astype("<u4").tobytes(), 4 * (width + 1)
        return [data[k * step : k * step + end] for k, end in enumerate(ends.tolist())]

    def merge_long(self, word: bytes) -> bytes:
        """The ids of one long word, its smallest rank taken from a heap."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank_of = self.rank_of
        heap = [
            (rank, i, a, b)
            for i, (a, b) in enumerate(zip(ids, ids[1:]))
            if (rank := rank_of.get((a << 20) | b)) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (r := rank_of.get((ids[a] << 20) | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def merge(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words."""
        pending: dict[int, list[tuple[str, bytes]]] = {}
        done = {}
        for word in words:
            data = word.encode()
            if len(data) > SHORT_WORD:
                done[word] = self.merge_long(data)
            else:
                pending.setdefault((len(data) + 3) // 4, []).append((word, data))
        for group in pending.values():
            done.update(zip((word for word, _ in group), self.merge_short([data for _, data in group])))
        return done

    def ids_of(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word, from the caches or merged; what is met again stays in the caches longer."""
        if len(self.cache) > CACHE_WORDS // 2:
            self.older, self.cache = self.cache, {}
        again = {w: self.older[w] for w in words - self.cache.keys() if w in self.older}
        fresh = self.merge([w for w in words - self.cache.keys() if w not in again])
        known = {w: self.cache[w] for w in words if w in self.cache} | again | fresh
        room = max(0, CACHE_WORDS // 2 - len(again))
        self.cache.update(again)
        self.cache.update((w, fresh[w]) for w in islice((w for w in fresh if len(w) <= SHORT_WORD), room))
        return known

    def forget(self) -> None:
        """Empty the caches, as a worker does at the end of a task; it may have other work next."""
        self.cache, self.older = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        cut = [self.cut.split(text) if self.cut else [text] for text in texts]
        words = [[p if p in self.special else self.words.findall(p) for p in parts] for parts in cut]
        met = set()
        for parts in words:
            for p in parts:
                if type(p) is list:
                    met.update(p)
        known = self.ids_of(met)
        special = {text: i.to_bytes(4, "little") for text, i in self.special.items()}
        return [
            b"".join(special[p] if type(p) is str else b"".join(map(known.__getitem__, p)) for p in parts)
            for parts in words
        ]

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no valid UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once a worker."""
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str = "", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids``, the token ids of each whole text as an array of integers."""
    path = path or tokenizer_path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in slices(batches, text):
            ids = own.encode([t or "" for t in batch.column(text).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"]
            )
        own.forget()

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), encode, f"`{key}` {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str = "", ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text``, the text that the ids of each row stand for; null and no ids give an empty text."""
    path = path or tokenizer_path(VOCABULARY)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return mapped(rows.select(key, ids), decode, f"`{key}` {kind}, text string")


def round_trips(docs: DataFrame, path: str = "", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the number of ids of its whole text, the digest of the ids, and that of the text decoded from them."""
    path = path or tokenizer_path(VOCABULARY)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in slices(batches, text):
            ids = own.encode([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(map(sha256, ids), pa.string()),
                    pa.array([sha256(own.decode(x).encode()) for x in ids], pa.string()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        own.forget()

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), both, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
