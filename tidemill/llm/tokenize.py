"""Byte-pair encoding of a whole corpus by dynamic programming over prefixes.

The encoding of a prefix of a word ends in one token only: the one token that is a
suffix of the prefix, may follow the last token of what is left of it, and stays apart
from it when merges run by rank. So each prefix stores its last token, found among the
suffix matches of an automaton by a test on pairs of tokens, and following the back
pointers from the whole word gives the ids, in time linear in the word. Words, and
lines of text (between which no word can reach), are encoded once and remembered in
bounded caches.

Defined cases: a NULL text and an empty one give an empty list; strings of special
tokens are ordinary text; texts of any length are encoded whole; repeated rows come out
repeatedly; a NULL identifier stays. Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: how this family of vocabularies cuts a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_VOCABULARY_BYTES = 64 << 20  # of a vocabulary file, which every worker gets
WORD_CACHE = 400_000  # words
LINE_CACHE_CHARS = 12_000_000
LONGEST_KEPT_WORD, LONGEST_KEPT_LINE = 256, 100_000  # characters; longer ones are encoded each time
OUT_IDS = 2_000_000  # ids in a batch of results
_NEVER = 1 << 40


def default_vocabulary() -> str:
    """The public byte-level vocabulary of 50k tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> bytes:
    """The file's bytes, refused beyond the bound."""
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary file may be")
    return data


class Encoder:
    """Encodes texts with a vocabulary given as lines of base64 token and rank."""

    def __init__(self, vocabulary: bytes, pattern: str = WORD_PATTERN):
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.words_of = regex.compile(pattern).findall
        #: When each token is formed: bytes are there from the start.
        self.formed = [-1 if len(t) == 1 else r for r, t in enumerate(self.token)]
        self.halves: list[tuple[int, int] | None] = [None] * len(self.token)
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(t) > 1:
                self.halves[r] = self._halves(t)
        self._apart: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (r, len(t)))
        self.automaton.make_automaton()
        self._words: dict[str, bytes] = {}
        self._lines: dict[str, bytes] = {}
        self._line_chars = 0

    def _halves(self, t: bytes) -> tuple[int, int]:
        """The two tokens whose merge forms a token: those that stay apart until then."""
        for i in range(1, len(t)):
            a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
            if a is not None and b is not None and max(self.formed[a], self.formed[b]) < self.rank[t] and self._stay_apart(a, b, self.rank[t]):
                return a, b
        raise ValueError(f"no merge forms {t!r}")

    def _stay_apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge of rank below ``until`` crosses the border of two adjacent tokens.

        Going back in time, the side of the border formed later falls into its halves. Two
        pieces stand side by side until one of them is merged away from the border; a
        merge of the two themselves crosses the border if its turn comes before that. Of
        equal ranks the left one comes first.
        """
        a_gone = b_gone = until
        while True:
            joint = self.rank.get(self.token[a] + self.token[b])
            if joint is not None and joint < a_gone and (joint <= b_gone if b_gone != until else joint < until):
                return False
            if self.formed[a] > self.formed[b]:
                a_gone = self.formed[a]
                a = self.halves[a][1]
            elif self.formed[b] >= 0:
                b_gone = self.formed[b]
                b = self.halves[b][0]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        size = len(word)
        last = [-1] * (size + 1)
        back = [0] * (size + 1)
        apart = self._apart
        known = -1
        for end, (t, length) in self.automaton.iter(word.decode("latin-1")):
            end += 1  # matches of one end come longest first
            if end == known:
                continue
            begin = end - length
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                pair = before << 20 | t
                ok = apart.get(pair)
                if ok is None:
                    if len(apart) > 1_000_000:
                        apart.clear()
                    ok = apart[pair] = self._stay_apart(before, t)
                if not ok:
                    continue
            last[end], back[end], known = t, begin, end
        ids = []
        while size:
            ids.append(last[size])
            size = back[size]
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            found = np.array(self.encode_word(word.encode()), dtype=np.int32).tobytes()
            if len(word) <= LONGEST_KEPT_WORD:
                if len(self._words) >= WORD_CACHE:
                    self._words.clear()
                self._words[word] = found
        return found

    def _line(self, line: str) -> bytes:
        get = self._words.get
        words = self.words_of(line)
        parts = [get(w) for w in words]
        if None in parts:
            parts = [self._word(w) for w in words]
        return b"".join(parts)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as bytes of int32."""
        out = []
        lines = text.split("\n")
        held = lines[0]
        for line in [*lines[1:], None]:
            # A word never holds a line break after a character that is no white space.
            if line is not None and (not held or held[-1].isspace()):
                held = f"{held}\n{line}"
                continue
            found = self._lines.get(held)
            if found is None:
                found = self._line(held)
                if len(held) <= LONGEST_KEPT_LINE:
                    self._line_chars += len(held)
                    if self._line_chars > LINE_CACHE_CHARS:
                        self._lines.clear()
                        self._line_chars = len(held)
                    self._lines[held] = found
            out.append(found)
            held = f"\n{line}"
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token[i] for i in ids).decode()


_encoders: dict[int, Encoder] = {}


def worker_encoder(vocabulary: bytes) -> Encoder:
    """The encoder of this Python worker, made once."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _ids_of(shared, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for b in batches:
            begin, held, sizes, total = 0, [], [], 0
            texts = b.column(text_col)
            for i in range(b.num_rows):
                ids = encoder.encode_bytes(texts[i].as_py() or "")
                held.append(ids)
                sizes.append(len(ids) // 4)
                total += len(ids) // 4
                if total >= OUT_IDS or i + 1 == b.num_rows:
                    offsets = pa.array(np.cumsum([0, *sizes], dtype=np.int64).astype(np.int32))
                    flat = pa.array(np.frombuffer(b"".join(held), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(id_col).slice(begin, len(sizes)), pa.ListArray.from_arrays(offsets, flat)], [id_col, "ids"])
                    begin, held, sizes, total = i + 1, [], [], 0

    return run


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every document, without special tokens; no exchange."""
    data = read_vocabulary(vocabulary or default_vocabulary())
    shared = documents.sparkSession.sparkContext.broadcast(data)
    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(_ids_of(shared, id_col, text_col), f"`{id_col}` {kind}, ids array<int>")


def _sizes_of(shared, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for b in batches:
            n = [len(encoder.encode_bytes(t.as_py() or "")) // 4 for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return run


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens) of every document, by the same encoding."""
    data = read_vocabulary(vocabulary or default_vocabulary())
    shared = documents.sparkSession.sparkContext.broadcast(data)
    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(_sizes_of(shared, id_col, text_col), f"`{id_col}` {kind}, n_tokens bigint")
