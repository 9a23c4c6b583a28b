"""Language of whole texts by error-correcting output codes (operator 10).

Each language has a codeword. For every bit a binary classifier over hashed letter n-grams (one to three
letters of the lowered text, what is no letter being a gap) tells the languages with a one from those with
a zero; its weights are the smoothed log ratios of both sides' n-gram frequencies, every language counting
alike. Decoding chooses the codeword of least loss, each bit's exponential loss weighted by the bit's
reliability. The score compares the least loss with the next; a low one marks the text as ambiguous.

Every language of the training rows is learned, however many there are; the code grows with the logarithm of their number.
Learning uses a sample that is bounded for each: the ``SAMPLE_ROWS`` training rows that hashes of their ids choose.
A quarter of it is kept from the counts, and of that quarter about ``MEASURED_ROWS``, at least one a language, measure
the bits. Counts are taken a language at a time and reach the driver in turn. Training rows have a text, a language, and an id whose crc32 leaves no 1 when divided by 3; the
others are held out. Predictions read nothing but the text, in the task that reads the row.

A text that is null or has no letter is ``und`` with score 0, and so is every text when nothing could be
learned. With one language learned, every other text is of that one. A row with a null id is
neither held out nor learned from. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ranlens.llm.common import mapped, slices, written

SAMPLE_ROWS, MEASURED_ROWS = 1_000, 16_000
#: Languages whose counts the driver holds at once, and losses that a task does.
TOGETHER, LOSSES = 64, 1 << 20
#: Hashed n-grams that the classifiers know; n-grams of a text from which they are counted before they are weighed.
BUCKETS, COUNT_FROM = 1 << 14, 4_096
#: Score under which a text is ambiguous.
AMBIGUOUS_UNDER = 0.05
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def n_grams(text: str) -> np.ndarray:
    """The buckets of a text's n-grams; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.array([], dtype=np.int64)
    before = np.concatenate([[True], is_letter[:-1]])
    codes = np.where(is_letter, codes, 32)[is_letter | before].astype(np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    one = codes * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + codes[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(37) + codes[2:] * np.uint32(3266489917)
    mixed = np.concatenate([one, two, three])
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(18)).astype(np.int64)


def least_distance(code: np.ndarray) -> float:
    """The least number of bits in which two rows differ."""
    least = np.inf
    for begin in range(0, len(code), 1_024):
        same = code[begin : begin + 1_024] @ code.T
        own = np.arange(len(same))
        same[own, begin + own] = -np.inf
        least = min(least, (code.shape[1] - same.max()) / 2)
    return least


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: all ways to part few languages, else a wide random code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if (c >> i) & 1 else -1 for c in range(1, 2 ** (n - 1))] for i in range(n)], dtype=float)
    random, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, reach = None, -1.0
    for _ in range(min(50, max(2, 3_200 // n))):
        code = random.choice([-1.0, 1.0], size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = least_distance(code)
        if apart > reach:
            best, reach = code, apart
    return best


@dataclass
class Model:
    """Languages, their codewords, and each bit's n-gram weights, scale and reliability."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    reliability: np.ndarray

    def margins(self, grams: np.ndarray) -> np.ndarray:
        """Each bit's mean weight over the n-grams: positive for a one."""
        if len(grams) < COUNT_FROM:
            return self.weights[grams].mean(axis=0)
        return np.bincount(grams, minlength=BUCKETS).astype(np.float32) @ self.weights / len(grams)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of margins: the place of the language of least loss, and the score."""
        signed = np.clip(margins * self.scale, -8, 8)
        best, score = np.zeros(len(signed), dtype=np.int64), np.ones(len(signed))
        if len(self.languages) == 1:
            return best, score
        of_one, of_zero = np.exp(-signed) * self.reliability, np.exp(signed) * self.reliability
        ones, zeros = np.maximum(self.code, 0).T, np.maximum(-self.code, 0).T
        step = max(1, LOSSES // len(self.languages))
        for at in range(0, len(signed), step):
            losses = of_one[at : at + step] @ ones + of_zero[at : at + step] @ zeros
            best[at : at + step] = losses.argmin(axis=1)
            least, second = np.partition(losses, 1, axis=1)[:, :2].T
            score[at : at + step] = 1 - least / second
        return best, score


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, text: str, key: str, language: str) -> DataFrame:
    """``language``, ``text``, ``place`` (from 1 in a language) and ``measure`` (kept from the counts) of the sampled training rows."""
    trained = F.col(language).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)
    labelled = docs.where(trained).select(key, F.col(language).alias("language"), text)
    counts = written(labelled.groupBy("language").count(), "counts")
    # The hash leaves about three times the rows wanted of a language to be ranked, however many it has.
    share = F.ceil(3.0 * SAMPLE_ROWS * (1 << 30) / F.col("count"))
    few = labelled.join(counts, "language").where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), 1 << 30) < share)
    order = Window.partitionBy("language").orderBy(F.xxhash64(key), key)
    # Both tables that are joined are written, so Spark knows their sizes: with few languages it broadcasts them.
    chosen = (
        few.select(key, "language")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLE_ROWS)
        .groupBy(key, "language")
        .agg(F.min("place").alias("place"))
        .select(key, "language", "place", (F.col("place") % 4 == 0).alias("measure"))
    )
    found = few.select(key, "language", text).join(written(chosen, "chosen"), [key, "language"])
    return written(found.select("language", text, "place", "measure"), "languages")


def learned(docs: DataFrame, text: str = "text", key: str = "doc_id", language: str = "lang") -> Model:
    """The model of the training rows of the table."""
    sample = training_sample(docs, text, key, language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(name: str, total: np.ndarray) -> pa.RecordBatch:
            shares = (total / total.sum()).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shares], pa.binary())], ["language", "shares"])

        own, total = None, np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches, text):
            for name, t in zip(batch.column("language").to_pylist(), batch.column(text).to_pylist()):
                if name != own:
                    if total.any():
                        yield row(own, total)
                    own, total = name, np.zeros(BUCKETS, dtype=np.int64)
                total += np.bincount(n_grams(t), minlength=BUCKETS)
        if total.any():
            yield row(own, total)

    # A task has whole languages, one after the other.
    by_language = sample.where("not measure").select("language", text).repartition("language").sortWithinPartitions("language")
    counted = written(mapped(by_language, count, "language string, shares binary"), "shares")
    languages = sorted(row.language for row in counted.select("language").collect())
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.ones(1))
    place = {name: i for i, name in enumerate(languages)}
    ones, zeros = np.maximum(code, 0), np.maximum(-code, 0)
    ones, zeros = (part / np.maximum(part.sum(axis=0), 1) for part in (ones, zeros))
    of_ones, of_zeros = np.zeros((BUCKETS, code.shape[1])), np.zeros((BUCKETS, code.shape[1]))
    rows = counted.orderBy("language").toLocalIterator()
    while some := list(islice(rows, TOGETHER)):
        at, shares = [place[row.language] for row in some], np.array([np.frombuffer(row.shares) for row in some])
        of_ones += shares.T @ ones[at]
        of_zeros += shares.T @ zeros[at]
    smooth = 0.1 / BUCKETS
    weights = (np.log(of_ones + smooth) - np.log(of_zeros + smooth)).astype(np.float32)
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            grams = [n_grams(t) for t in batch.column(text).to_pylist()]
            kept = [(name, model.margins(g)) for name, g in zip(batch.column("language").to_pylist(), grams) if len(g)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in kept], pa.string()), pa.array([m.astype(float).tobytes() for _, m in kept], pa.binary())],
                ["language", "margins"],
            )

    of_each = -(-MEASURED_ROWS // len(languages))
    measuring = sample.where(F.col("measure") & (F.col("place") <= 4 * of_each)).select("language", text)
    measured = [
        (place[row.language], np.frombuffer(row.margins))
        for row in mapped(measuring, measure, "language string, margins binary").collect()
        if row.language in place
    ]
    if measured:
        bits, margins = code[[i for i, _ in measured]], np.array([m for _, m in measured])
        model.scale = 2 / np.maximum(np.median(np.abs(margins), axis=0), 1e-6)
        model.reliability = np.clip((bits * margins > 0).mean(axis=0), 0.5, 0.999)
        model.reliability = np.log(model.reliability / (1.001 - model.reliability)) + 0.01
    return model


def predictions(docs: DataFrame, model: Model, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, ``lang_pred``, ``score`` and ``ambiguous`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[name] for name in carried]
    rows = docs.select(*carried, *([] if text in carried else [text]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, text):
            grams = [n_grams(t or "") for t in batch.column(text).to_pylist()]
            known = np.array([bool(len(g) and own.languages) for g in grams])
            names, scores = np.full(len(grams), UNKNOWN, dtype=object), np.zeros(len(grams))
            if known.any():
                best, score = own.decode(np.array([own.margins(g) for g, k in zip(grams, known) if k]))
                names[known], scores[known] = np.array(own.languages, dtype=object)[best], score
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in carried),
                    pa.array(names.tolist(), pa.string()),
                    pa.array(scores),
                    pa.array(known & (scores < AMBIGUOUS_UNDER)),
                ],
                [*carried, "lang_pred", "score", "ambiguous"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return mapped(rows, predict, f"{kinds}, lang_pred string, score double, ambiguous boolean")
