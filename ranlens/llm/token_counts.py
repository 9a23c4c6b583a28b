"""Token counts of whole texts by a two-tier lookup on the map side (operator 3).

A text is cut into pre-tokens at places no piece of the vocabulary crosses, so the tokens of a text are
those of its pre-tokens, and its count is a sum of looked-up counts. Tier one is a compact hash table of
the most frequent pre-tokens and their counts, sent to every worker. Tier two is a cache of each
worker, filled by the tokenizer with what tier one lacks. Pre-tokens are never shuffled.

The table is made from a bounded sample: SAMPLE_TASKS tasks at most, spread over the table, read the first SAMPLE_BYTES of
their texts or so, and each gives its SUMMARY_ENTRIES most frequent pre-tokens, which the driver adds up. Other tasks stop before
their first text. What the table lacks costs time, never correctness; every text is counted whole in one pass without a shuffle.

Nulls count as empty texts, which have no tokens. Repeated rows give repeated rows; other columns are
not read. A text of any length is counted whole; a long pre-token goes to the tokenizer uncached.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ranlens.llm.common import mapped, slices, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
#: Entries of the table that is broadcast, and characters of a pre-token in it: a few megabytes at most.
TABLE_ENTRIES, TABLE_CHARS = 32_768, 48
#: The sample the table is made from: tasks, bytes of text each reads (and the rest of a batch), and words each gives.
SAMPLE_TASKS, SAMPLE_BYTES, SUMMARY_ENTRIES = 64, 2_000_000, 4_096
#: Entries of a worker's cache.
CACHE_ENTRIES = 200_000
TOKEN_LIMIT = 4_096
SPACE = "▁"


class Counts(dict):
    """Pre-token to number of tokens: tier one, then the cache, which the tokenizer fills."""

    def __init__(self, path: str):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        joined = {c for i, p in enumerate(pieces) if len(p) > 1 and not self.special(i) for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of the vocabulary crosses the start of a word")
        # The tokenizer marks the start of what it encodes as a word; a line end before it takes that mark.
        if "\n" in joined:
            raise ValueError("a piece of the vocabulary crosses the end of a line")
        self.start = len(self.model.encode("\n"))
        self.cut = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        self.table_size = 0

    def special(self, i: int) -> bool:
        return self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)

    def pre_tokens(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def use_table(self, table: dict[str, int]) -> None:
        self.clear()
        self.update(table)
        self.table, self.table_size = table, len(table)

    def lengths(self, words: list[str]) -> list[int]:
        return [len(ids) - self.start for ids in self.model.encode(["\n" + w for w in words], num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        cut = [self.pre_tokens(t) for t in texts]
        missed = list({w for words in cut for w in words if w not in self})
        if len(self) - self.table_size + len(missed) > CACHE_ENTRIES:
            self.use_table(self.table)
            missed = list({w for words in cut for w in words if w not in self})
        fresh = dict(zip(missed, self.lengths(missed)))
        self.update(fresh)
        counts = [sum(map(self.__getitem__, words)) for words in cut]
        for word in fresh:
            if len(word) > TABLE_CHARS:
                del self[word]
        return counts


@lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    """Read once a worker."""
    return Counts(path)


def frequent_pre_tokens(docs: DataFrame, path: str, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of a sample of the texts, at most TABLE_ENTRIES of them."""
    every = max(1, docs.rdd.getNumPartitions() // SAMPLE_TASKS)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % every or TaskContext.get().partitionId() // every >= SAMPLE_TASKS:
            return
        own, kept, read = counts_of(path), Counter(), 0
        for batch in slices(batches, text):
            for t in batch.column(text).to_pylist():
                kept.update(own.pre_tokens(t or ""))
                read += len(t or "")
            if read >= SAMPLE_BYTES:
                break
        found = [(w, n) for w, n in kept.most_common(SUMMARY_ENTRIES) if len(w) <= TABLE_CHARS]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found]), pa.array([n for _, n in found], pa.int64())], ["word", "n"]
            )

    total: Counter = Counter()
    for row in mapped(docs.select(text), summarise, "word string, n long").collect():
        total[row.word] += row.n
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]]


def token_counts(docs: DataFrame, path: str = "", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the bytes of its whole text, the number of its tokens, and whether that is above TOKEN_LIMIT."""
    path = path or tokenizer_path(VOCABULARY)
    words = frequent_pre_tokens(docs, path, text)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(words, counts_of(path).lengths(words))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts_of(path)
        own.use_table(table.value)
        for batch in slices(batches, text):
            n = own.count([t or "" for t in batch.column(text).to_pylist()])
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), sizes, pa.array(n, pa.int64()), pa.array([x > TOKEN_LIMIT for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )
        own.use_table({})  # the worker may have other work next

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
