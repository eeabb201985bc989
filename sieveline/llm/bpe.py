"""Encoding texts with a public byte-level BPE vocabulary.

A text is first cut by the vocabulary's public pattern. Each piece is mapped to Latin-1, one character for each
byte, and run through an Aho-Corasick automaton of the vocabulary, which gives the longest token at each place.
The encoder takes the longest token, then shorter ones, and steps back where it gets stuck. A token may follow
another only if the merges applied to both together leave exactly these two; that is looked up in a memo. The
sequence in which all neighbours agree is the one that the merges give, so the ids are exact, in time linear in
the piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the rank file of byte_bpe_50k lies by default.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The public pattern that cuts a text before the merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = regex.compile(PATTERN).findall
#: The same for texts of ASCII only, where it is twice as fast.
_CUT_ASCII = re.compile(PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII).findall

#: Entries of a memo; a full one starts anew, so memory is bounded and results are the same.
MEMO = 150_000
#: Pieces above so many characters aren't kept in the memo.
LONG = 64


class _Memo(dict):
    """Ids by piece; a piece that isn't there is encoded, and kept if it is short."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.encode(piece.encode("utf-8").decode("latin-1"))
        if len(piece) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Encodes pieces and texts; one in each Python worker."""

    def __init__(self, rank_file: bytes) -> None:
        lines = (x.split() for x in rank_file.splitlines() if x)
        self.ids: dict[str, int] = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in lines}
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()}
        if missing := [b for b in range(256) if chr(b) not in self.ids]:
            raise ValueError(f"the vocabulary lacks single bytes, {missing[:3]} first")
        self.lengths = np.zeros(max(self.tokens) + 1, np.int32)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.lengths[i] = len(t)
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.agree: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self.encode_bytes)

    def merged(self, text: str) -> list[str]:
        """The merges applied one after the other, lowest rank first: for pairs of tokens, and for tests."""
        parts, ids = list(text), self.ids
        while len(parts) > 1:
            ranks = [ids.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 30:
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def agrees(self, a: int, b: int) -> bool:
        found = self.agree.get((a, b))
        if found is None:
            if len(self.agree) >= 2 * MEMO:
                self.agree.clear()
            x, y = self.tokens[a], self.tokens[b]
            found = self.agree[a, b] = self.merged(x + y) == [x, y]
        return found

    def cut_back(self, i: int) -> int:
        """The longest token that is a true prefix of a token, -1 if there is none."""
        found = self.shorter.get(i)
        if found is None:
            t = self.tokens[i]
            found = self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        return found

    def encode_bytes(self, text: str) -> tuple[int, ...]:
        """Ids of one piece in Latin-1."""
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        n = len(text)
        longest = [0] * n
        for end, (i, size) in self.automaton.iter(text):  # at a place the longest token is the last one told
            longest[end - size + 1] = i
        lengths, closed = self.lengths, bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + int(lengths[token])
                if not closed[end] and (last < 0 or self.agrees(last, token)):
                    break
                token = self.cut_back(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                # nothing leads on from here: never come back to this place, try a shorter last token
                closed[at] = 1
                token = out.pop()
                at -= int(lengths[token])
        return tuple(out)

    def pieces(self, text: str) -> list[str]:
        return _CUT_ASCII(text) if text.isascii() else _CUT(text)

    def encode_pieces(self, text: str) -> list[tuple[int, ...]]:
        return list(map(self.memo.__getitem__, self.pieces(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encode_pieces(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.encode_pieces(text))) if text else 0

    def decode(self, ids: list[int]) -> str:
        return "".join(map(self.tokens.__getitem__, ids)).encode("latin-1").decode("utf-8", errors="replace")


_encoders: dict[str, Encoder] = {}


def worker_encoder(digest: str, rank_file) -> Encoder:
    """This worker's encoder; rank_file is called for the file's bytes when there is none yet."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(rank_file())
    return _encoders[digest]


def shared_encoder(df: DataFrame, vocabulary: str):
    """A function for tasks that gives the worker's encoder; the rank file (under 1 MB) is broadcast.

    The driver reads the file, so executors need no copy of it.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError("a rank file of more than 16 MB isn't broadcast")
    digest, sent = hashlib.sha256(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)
    return lambda: worker_encoder(digest, lambda: sent.value)


#: Ids that an output batch holds at most, but for a single longer text.
_BATCH_IDS = 2_000_000


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """One row for each row: its id column and the list of its text's token ids, without special tokens.

    Null and empty texts give an empty list, not null. Texts are encoded exactly as they stand and whole;
    strings that look like special tokens are ordinary text. A null id is kept, repeated rows come out each,
    an empty table gives none; columns other than the two aren't carried, so their names can't clash. An id
    column named as the list raises ValueError. No shuffle.
    """
    if id_col == ids:
        raise ValueError("the id column has the name of the list")
    get = shared_encoder(df, vocabulary)
    schema = T.StructType([df.schema[id_col], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = get().encode_pieces
        for b in batches:
            begin, sizes, found, held = 0, [], [], 0

            def batch(stop: int) -> pa.RecordBatch:
                offsets = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int32, count=int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                return pa.RecordBatch.from_arrays([b.column(0).slice(begin, stop - begin), lists], names=[id_col, ids])

            for k, text in enumerate(b.column(1)):
                text = text.as_py()
                words = encode(text) if text else []
                size = sum(map(len, words))
                sizes.append(size)
                found.append(words)
                held += size
                if held >= _BATCH_IDS:
                    yield batch(k + 1)
                    begin, sizes, found, held = k + 1, [], [], 0
            if sizes:
                yield batch(b.num_rows)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """The kept columns of each row and the number of tokens of its text; 0 for null and empty texts.

    keep: all columns but the text by default; one named as the count raises ValueError. No shuffle.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    if out in keep:
        raise ValueError("a kept column has the name of the count")
    get = shared_encoder(df, vocabulary)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = get().count
        for b in batches:
            counts = pa.array([count(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], counts], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)
