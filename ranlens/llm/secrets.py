"""Secrets in whole texts, with the parts of a credential linked (operator 6).

Base findings: assignments of a secret to a name, access identifiers, and long hexadecimal runs. Each
kind is matched leftmost and without overlap; matches that are too short are dropped.

Linked findings: weaker candidates (named identifiers, mixed runs of high entropy, endpoints) are parts
of a credential only beside their complement. An interval join within scopes decides: each candidate's
surroundings (``reach`` code points either way, not beyond its scope) are joined with the intervals of
the parts it needs. A scope is a section: it ends at a heading between blank lines, at a line of dashes, equals signs or stars, at a
line with a name in square brackets, and at more than ``blank_lines`` blank lines in a row. Paragraphs, code blocks and
blank lines between the parts of a key file do not end it. An identifier needs a secret, a secret an identifier, an endpoint both. The join looks
up sorted starts and the furthest end so far, so it never forms pairs, however many parts a text holds.

Every row is scanned where it is read; nothing is shuffled. Nulls and empty texts have no spans. Repeated
rows give repeated rows; other columns are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ranlens.llm.common import mapped, sha256, slices

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
#: A maximal run that is long enough is what remains of all maximal runs once short ones are dropped.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SECRET_CHARS = 12
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE_KINDS = KINDS[:3]

WEAK_ID = re.compile(
    r"""(?<![a-z])(?:client|account|user|access|key)[ _-]?(?:id|name|key)["']?\x20*[:=]\x20*["']?[a-z0-9._-]{4,}""",
    re.ASCII | re.IGNORECASE,
)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![a-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])""")
#: Code points from a candidate within which its complement must lie, and blank lines in a row that may stand between them.
REACH, BLANK_LINES = 400, 3
#: Bits a character of a weak secret.
ENTROPY = 3.5

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= SECRET_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def is_mixed(run: str) -> bool:
    """Whether a run has small and capital letters and digits, spread as in a random key."""
    if not (re.search("[a-z]", run) and re.search("[A-Z]", run) and re.search("[0-9]", run)):
        return False
    n = len(run)
    return -sum(k / n * math.log2(k / n) for k in Counter(run).values()) >= ENTROPY


@lru_cache(maxsize=8)
def boundary(blank_lines: int) -> re.Pattern:
    """What ends a scope; the next one begins at the end of the match."""
    last = r"[\x20\t\r]*(?:\n|\Z)"
    return re.compile(
        rf"""\n(?:[\x20\t\r]*\n){{{blank_lines + 1},}} | (?:\A|\n[\x20\t\r]*\n)(?=\#{{1,6}}[\x20\t][^\n]*(?:\n{last}|\Z))
        | \n(?=[\x20\t]*(?:-{{3,}}|={{3,}}|\*{{3,}}){last}) | \n(?=\[[^]\n]{{1,80}}\]{last})""",
        re.VERBOSE,
    )


def near(
    spans: list[Span], parts: list[Span], ends_of_scopes: np.ndarray = np.array([], dtype=np.int64), reach: int = REACH
) -> list[bool]:
    """Interval semi-join: for each span, whether a part meets its surroundings."""
    if not parts or not spans:
        return [False] * len(spans)
    parts = sorted(parts)
    starts = np.array([p[0] for p in parts])
    furthest = np.maximum.accumulate([p[2] for p in parts])
    begin, end = np.array([s[0] for s in spans]), np.array([s[2] for s in spans])
    scope = np.searchsorted(ends_of_scopes, begin, side="right")
    low = np.maximum(begin - reach, np.concatenate([[0], ends_of_scopes])[scope])
    high = np.minimum(end + reach, np.concatenate([ends_of_scopes, [np.iinfo(np.int64).max]])[scope])
    last = np.searchsorted(starts, high, side="left") - 1
    return list((last >= 0) & (furthest[np.maximum(last, 0)] > low))


def linked_spans(text: str, base: list[Span], reach: int = REACH, blank_lines: int = BLANK_LINES) -> list[Span]:
    """The weak candidates of a text whose complementary parts are near."""
    named = [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)] if ":" in text or "=" in text else []
    identifiers = [s for s in base if s[1] == 1] + named
    if not identifiers:  # every link needs one
        return []
    mixed = [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text) if is_mixed(m.group())]
    mixed = [s for s, held in zip(mixed, near(mixed, base + named, reach=0)) if not held]
    endpoints = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    secrets = [s for s in base if s[1] != 1] + mixed
    ends = np.array([m.end() for m in boundary(blank_lines).finditer(text)], dtype=np.int64)
    found = [s for s, ok in zip(named, near(named, secrets, ends, reach)) if ok]
    found += [s for s, ok in zip(mixed, near(mixed, identifiers, ends, reach)) if ok]
    both = zip(endpoints, near(endpoints, identifiers, ends, reach), near(endpoints, secrets, ends, reach))
    return found + [s for s, one, other in both if one and other]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def found_secrets(
    docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = REACH, blank_lines: int = BLANK_LINES
) -> DataFrame:
    """Per row: how many base findings of each kind, the digest of their places, and the places of all findings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts, digests, spans = [], [], []
            for t in batch.column(text).to_pylist():
                base = sorted(base_spans(t or ""))
                counts.append([sum(s[1] == kind for s in base) for kind in range(len(BASE_KINDS))])
                digests.append(sha256(joined(base).encode()))
                spans.append(joined(sorted(base + linked_spans(t or "", base, reach, blank_lines))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    *(pa.array([c[kind] for c in counts], pa.int64()) for kind in range(len(BASE_KINDS))),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                ],
                [key, *(f"n_{kind}" for kind in BASE_KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return mapped(docs.select(key, text), scan, schema)
