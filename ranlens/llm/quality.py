"""Quality rules: boosted trees over document statistics, with monotonic constraints (operator 4).

Each document's statistics are computed where its row is read. A gradient-boosted ensemble learns from
labelled rows which statistics mean quality; on the features in ``FALLING`` the score may only fall as the
feature rises, so a text is never rescued by more symbols, repeats or shouting. The trees are flattened
into arrays of nodes and a batch of documents walks all trees at once.

The ensemble is fitted on a bounded sample of labelled rows: ``SAMPLE_ROWS`` chosen by hashes of
their ids (the sample is the same in every run). The statistics and the verdicts cover all rows.
Without labels of both kinds every document that passes the base rules is kept.

Nulls and empty texts have no words and fail the base rules. Repeated rows give repeated rows; other
columns are not read. Labels that are null, or contradict each other for one id, count as they come: null
ones are left out, others each as a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ranlens.llm.common import WORD, mapped, slices

SYMBOLS = frozenset("#*$%&|<>")
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Labelled rows the ensemble is fitted on, at most.
SAMPLE_ROWS = 6_000
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "repeated_lines", "repeated_words", "capitals",
    "exclamations_per_word", "distinct_words", "letters", "digits", "words_per_line", "ended_lines", "top_word",
)
FALLING = ("symbols_per_word", "repeated_lines", "repeated_words", "exclamations_per_word")
#: Score from which a document is kept.
KEEP_FROM = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in a window of three that occurs twice or more."""
    if len(ids) < 4:
        return 0
    size = int(ids.max()) + 1
    pairs = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
    _, place, count = np.unique(pairs * size + ids[2:], return_inverse=True, return_counts=True)
    again = np.zeros(len(ids), dtype=bool)
    twice = count[place] > 1
    for offset in range(3):
        again[offset : offset + len(twice)] |= twice
    return int(again.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts named in COUNTS, and the features named in FEATURES."""
    words = WORD.findall(text)
    if not words:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    n = len(words)
    chars = sum(map(len, words))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    duplicates = len(lines) - len(set(lines))
    symbols = sum(map(text.count, SYMBOLS))
    repeated = repeated_words(ids)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    capital = int(np.count_nonzero((codes - 65 < 26) | ((codes - 192 < 31) & (codes != 215))))
    letter = capital + int(np.count_nonzero((codes - 97 < 26) | (codes > 222)))
    digit = int(np.count_nonzero(codes - 48 < 10))
    ended = sum(line.rstrip()[-1:] in (".", "!", "?", '"', ":", ";") for line in lines)
    features = [
        np.log1p(n), chars / n, symbols / n, duplicates / len(lines), repeated / n, capital / max(letter, 1),
        text.count("!") / n, len(known) / n, letter / chars, digit / chars, np.log1p(n / len(lines)),
        ended / len(lines), np.bincount(ids).max() / n,
    ]
    return [n, chars, symbols, duplicates, repeated], features


@dataclass(frozen=True)
class Trees:
    """An ensemble as arrays over all nodes; a leaf's branches lead to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of quality of each row of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-self.base - self.value[at].sum(axis=1)))


def fit(
    x: np.ndarray, y: np.ndarray, falling: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 32, least: float = 2.0, ridge: float = 1.0,
) -> Trees:
    """Gradient boosting on the logistic loss over binned features; the score falls with the features in ``falling``."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    raw = np.full(len(y), base)

    def leaf(gradient: float, weight: float, low: float, high: float) -> float:
        return float(np.clip(gradient / (weight + ridge), low, high))

    def split(rows: np.ndarray, low: float, high: float):
        """The best feature, bin and middle value, or None; ``low`` and ``high`` bound the values of the leaves."""
        g, h = gradient[rows], weight[rows]
        best, own = None, g.sum() ** 2 / (h.sum() + ridge) + 1e-6
        for j, e in enumerate(edges):
            gs = np.cumsum(np.bincount(binned[rows, j], g, len(e) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, j], h, len(e) + 1))[:-1]
            gr, hr = g.sum() - gs, h.sum() - hs
            a, b = np.clip(gs / (hs + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
            gain = gs**2 / (hs + ridge) + gr**2 / (hr + ridge)
            fits = (hs >= least) & (hr >= least) & ((a >= b) if j in falling else True)
            gain = np.where(fits, gain, -np.inf)
            if len(gain) and gain.max() > own:
                k = int(gain.argmax())
                best, own = (j, k, (a[k] + b[k]) / 2), gain[k]
        return best

    def grow(rows: np.ndarray, low: float, high: float, level: int) -> int:
        node = len(feature)
        for array, initial in ((feature, 0), (threshold, np.inf), (left, node), (right, node), (value, 0.0)):
            array.append(initial)
        best = split(rows, low, high) if level < depth else None
        if best is None:
            value[node] = rate * leaf(gradient[rows].sum(), weight[rows].sum(), low, high)
            raw[rows] += value[node]
            return node
        j, k, middle = best
        under = binned[rows, j] <= k
        feature[node], threshold[node] = j, edges[j][k]
        falls = j in falling
        left[node] = grow(rows[under], middle if falls else low, high, level + 1)
        right[node] = grow(rows[~under], low, middle if falls else high, level + 1)
        return node

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        roots.append(grow(np.arange(len(y)), -np.inf, np.inf, 0))
    arrays = (roots, feature, threshold, left, right, value)
    return Trees(*map(np.array, arrays), depth=depth, base=base)


def sample_features(docs: DataFrame, labels: DataFrame, text: str, key: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, chosen by hashes of their ids."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = [statistics(t or "")[1] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column("quality"), batch.column("place")],
                ["x", "quality", "place"],
            )

    place = F.xxhash64(F.col(key).cast("string"))
    labelled = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull())
    # The hash leaves about twice the rows wanted to be ordered, however many labels there are.
    share = 1.0 if (n := labelled.count()) <= 2 * rows else 2 * rows / n
    chosen = (
        labelled.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), 1 << 30) < int(share * (1 << 30)))
        .select(key, F.col("quality").cast("int").alias("quality"))
        .orderBy(place, key, "quality")
        .limit(rows)
    )
    # At most ``rows`` pairs of an id and a label, by the limit above.
    joined = docs.select(key, text).join(F.broadcast(chosen), key).withColumn("place", place)
    measured = mapped(joined.select(text, "quality", "place"), measure, "x array<double>, quality int, place long")
    found = measured.orderBy("place", "quality", "x").limit(rows).collect()
    return np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.quality for r in found], dtype=float)


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Per row: its counts, whether it fails the base rules, whether it is kept, and its score."""
    x, y = sample_features(docs, labels, text, key, rows)
    falling = [FEATURES.index(name) for name in FALLING]
    trees = fit(x, y, falling) if 0 < y.sum() < len(y) else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [statistics(t or "") for t in batch.column(text).to_pylist()]
            counts = np.array([c for c, _ in found], dtype=np.int64)
            scores = trees.score(np.array([f for _, f in found])) if trees else np.ones(len(found))
            n, repeats = counts[:, 0], counts[:, 4]
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEATED_PERCENT * n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    *(pa.array(counts[:, i]) for i in range(len(COUNTS))),
                    pa.array(failed),
                    pa.array(~failed & (scores >= KEEP_FROM)),
                    pa.array(scores),
                ],
                [key, *COUNTS, "base_failed", "kept", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"{name} long" for name in COUNTS)
    return mapped(docs.select(key, text), judge, f"`{key}` {kind}, {counts}, base_failed boolean, kept boolean, score double"
    )
