"""SentencePiece encoding and decoding by a table of last tokens (operator 12).

A merge-type vocabulary joins neighbouring pieces, the best rank first and the leftmost of equals, until no two
neighbours form a piece. For such a vocabulary every prefix of a word has one encoding, whose last token alone, kept in a
table, describes it: token t ends the encoding of a prefix if it is a piece that ends there and the pair (u, t) is
compatible, where u is the last token of the prefix before t. The automaton of all pieces gives the pieces that end at
a place, and exactly one of them passes. The ids are recovered from the end of the table backwards: the last token, then that of
the prefix before it. The work grows with the length of the word times the longest piece.

A pair is compatible if the two pieces side by side stay as they are: while the rule makes each of them, no join
across their border comes first. A piece that starts a word must be one the rule makes. Answers are remembered by pair.

Texts are cut into words first, at places no piece crosses: before a run of spaces, and around characters that are in
no longer piece. A worker keeps the ids of words it has met. A character without a piece is written as its bytes.
Spaces become the mark U+2581, and a text that is not empty gets one more in front; decoding takes one off again.
Texts that hold special strings such as ``</s>`` hold ordinary text. The end id is added last.

Nulls count as empty texts (the end id alone). Repeated rows give repeated rows; other columns are not read unless they
are named. Texts of any length are encoded whole. Every row is encoded where it is read, without a shuffle, so a
lost executor costs the tasks it held.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ranlens.llm.common import mapped, sha256, slices, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
#: What a worker remembers: words with at most WORD_CHARS characters, and answers on pairs.
CACHE_WORDS, WORD_CHARS, CACHE_PAIRS = 400_000, 64, 1_000_000
#: The mark of a space, in texts and in pieces.
SPACE = "▁"
UNKNOWN_BYTES = "�"


class Pieces:
    """The vocabulary, its automaton, and the caches of a worker."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end_id = model.eos_id()
        special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        self.names = {i: model.id_to_piece(i) for i in range(size)}
        self.ids = {name: i for i, name in self.names.items() if i not in special}
        self.lengths = {i: len(name) for name, i in self.ids.items()}
        self.scores = {name: model.get_score(i) for name, i in self.ids.items()}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        longer = {c for name in self.ids if len(name) > 1 for c in name}
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("a piece of the vocabulary crosses the start of a word")
        if any(not model.is_byte(i) for i in self.byte_ids):
            raise ValueError("the vocabulary has no pieces for bytes")
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in longer)
        self.cut = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, (len(name), i))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.edges: dict[tuple[str, int], list[str] | None] = {}
        # What an id adds to the decoded bytes; control ids add nothing.
        self.bytes = {i: name.replace(SPACE, " ").encode() for i, name in self.names.items() if i not in special}
        self.bytes |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.bytes |= {i: " ⁇ ".encode() if model.is_unknown(i) else b"" for i in special if not model.is_byte(i)}
        self.byte_values = set(self.byte_ids)
        self.spaced = {i for i, name in self.names.items() if i not in special and name.startswith(SPACE)}
        self.silent = {i for i in special if model.is_control(i)}

    def best(self, parts: list[str]) -> int:
        """The place of the pair the rule joins next, or -1: the best rank, the leftmost of equals."""
        place, best = -1, 0.0
        for i in range(len(parts) - 1):
            score = self.scores.get(parts[i] + parts[i + 1])
            if score is not None and (place < 0 or score > best):
                place, best = i, score
        return place

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the rule itself."""
        parts = list(text)
        while (place := self.best(parts)) >= 0:
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces the rule joins last to make a piece; None for one character, or if the rule does not make it."""
        if piece not in self.splits:
            self.splits[piece] = None
            parts = list(piece)
            while len(parts) > 1:
                place = self.best(parts)
                if place < 0:
                    break
                if len(parts) == 2:
                    self.splits[piece] = (parts[0], parts[1])
                parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return self.splits[piece]

    def edge(self, piece: str, side: int) -> list[str] | None:
        """What stands at one edge (0 left, 1 right) while the rule makes a piece: from the single character to the piece.

        None if the rule does not make the piece, or joins a part of it no earlier than what it becomes a part of.
        """
        key = (piece, side)
        if key not in self.edges:
            chain: list[str] | None = [piece]
            while chain is not None and len(chain[-1]) > 1:
                parts = self.split(chain[-1])
                late = parts is None or any(len(p) > 1 and self.scores[p] <= self.scores[chain[-1]] for p in parts)
                chain = None if late else [*chain, parts[side]]
            self.edges[key] = chain and chain[::-1]
        return self.edges[key]

    def compatible(self, before: str, piece: str) -> bool:
        """Whether a piece may follow another; after nothing (""), whether the rule leaves it whole.

        The rule makes both side by side, each by its own joins from the best rank downward, unless it joins what
        meets at the border before one of the two grows there. Pieces made otherwise are put to the rule itself.
        """
        left, right = self.edge(before, 1) if before else None, self.edge(piece, 0)
        if left is None or right is None:
            return self.merged(before + piece) == ([before, piece] if before else [piece])
        return self.apart(left, right)

    def remembered(self, key: int, before: int, piece: int) -> bool:
        """The answer on a pair of ids, kept under its key."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        answer = self.pairs[key] = self.compatible(self.names[before] if before >= 0 else "", self.names[piece])
        return answer

    def apart(self, left: list[str], right: list[str]) -> bool:
        """Whether no join crosses the border while its two sides grow."""
        scores, i, j = self.scores, 0, 0
        while True:
            left_next = scores[left[i + 1]] if i + 1 < len(left) else None
            right_next = scores[right[j + 1]] if j + 1 < len(right) else None
            across = scores.get(left[i] + right[j])
            # Of equal ranks the leftmost goes first: the left side, then the border, then the right side.
            if across is not None and (left_next is None or across > left_next) and (right_next is None or across >= right_next):
                return False
            if left_next is None and right_next is None:
                return True
            if right_next is None or (left_next is not None and left_next >= right_next):
                i += 1
            else:
                j += 1

    def last_tokens(self, word: str) -> list[int]:
        """For each prefix of the word, by its length, the id of the last token of its encoding; -1 after a character without a piece."""
        last = [-1] * (len(word) + 1)
        known, remembered = self.pairs.get, self.remembered
        for at, (length, piece) in self.automaton.iter(word):
            at += 1
            if last[at] < 0:
                # Nothing joins a character that has no piece: what follows it begins anew.
                before = last[at - length]
                key = (before + 1 << 24) + piece
                answer = known(key)
                if remembered(key, before, piece) if answer is None else answer:
                    last[at] = piece
        return last

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of a word, recovered from the table backwards."""
        last, at, found = self.last_tokens(word), len(word), []
        while at:
            piece = last[at]
            if piece >= 0:
                found.append(piece)
                at -= self.lengths[piece]
            else:
                found += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
                at -= 1
        found.reverse()
        return tuple(found)

    def encode(self, text: str, end: bool = True) -> list[int]:
        found: list[int] = []
        known = self.words
        for word in self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else ():
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= WORD_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = ids
            found += ids
        if end:
            found.append(self.end_id)
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: marks become spaces, the one in front goes, bytes that are no UTF-8 become U+FFFD each."""
        ids = list(ids)
        while ids and ids[-1] in self.silent:
            ids.pop()
        if self.silent.isdisjoint(ids):
            try:
                return b"".join(map(self.bytes.__getitem__, ids)).decode()[bool(ids) and ids[0] in self.spaced :]
            except UnicodeDecodeError:
                pass
        # A run of bytes ends at any other id, one that adds nothing included.
        runs = [(is_byte, list(run)) for is_byte, run in groupby(ids, lambda i: i in self.byte_values)]
        parts = [(self.decode_bytes if is_byte else bytes.decode)(b"".join(map(self.bytes.__getitem__, run))) for is_byte, run in runs]
        first = next((i for i in ids if i not in self.silent), None)
        return "".join(parts)[first in self.spaced :]

    @staticmethod
    def decode_bytes(data: bytes) -> str:
        parts = []
        while data:
            try:
                parts.append(data.decode())
                break
            except UnicodeDecodeError as error:
                parts += [data[: error.start].decode(), UNKNOWN_BYTES]
                data = data[error.start + 1 :]
        return "".join(parts)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """Read once a worker."""
    return Pieces(path)


def encoded(docs: DataFrame, path: str = "", text: str = "text", key: str = "doc_id", end: bool = True) -> DataFrame:
    """Per row: the key and ``ids``, the token ids of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path or tokenizer_path(VOCABULARY))
        for batch in slices(batches, text):
            ids = [own.encode(t or "", end) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"`{key}` {kind}, ids array<int>")


def decoded(tokens: DataFrame, path: str = "", ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Per row: the key and ``text``, what its ids stand for; null ids give an empty text, null elements add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path or tokenizer_path(VOCABULARY))
        for batch in batches:
            texts = [own.decode(i for i in (row or ()) if i is not None) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return mapped(tokens.select(key, ids), run, f"`{key}` {kind}, text string")


def round_trips(docs: DataFrame, path: str = "", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the number of its ids, the end id included, and the digests of the ids and of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path or tokenizer_path(VOCABULARY))
        for batch in slices(batches, text):
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(text).to_pylist():
                ids = own.encode(t or "")
                counts.append(len(ids))
                ids_sha.append(sha256(" ".join(map(str, ids)).encode()))
                text_sha.append(sha256(own.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
