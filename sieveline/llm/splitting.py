"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.logfields import WHITE
from sieveline.llm.bpe import VOCABULARY, Encoder, count_tokens, shared_encoder

#: Strength of a cut: after an empty line, a line, a sentence, a clause, a word, a piece of the public pattern,
#: a token within such a piece, and within a character (never chosen).
EMPTY_LINE, LINE, SENTENCE, CLAUSE, WORD, PIECE, TOKEN, NONE = 7, 6, 5, 4, 3, 2, 1, 0

#: Ends of sentences and clauses where white space follows, and those that need none after them. Fixed values.
SENTENCE_ENDS, CLAUSE_ENDS = ".!?\u2026\u203c\u2047\u061f\u06d4\u0964\u0965\u0589", ",;:\u060c\u061b"
WIDE_SENTENCE_ENDS, WIDE_CLAUSE_ENDS = "\u3002\uff01\uff1f\uff61", "\u3001\uff0c\uff1b\uff1a\uff64"
LINE_ENDS = "\n\r\x85\u2028\u2029"
_WHITE, _LINE, _SENTENCE, _CLAUSE, _WIDE_SENTENCE, _WIDE_CLAUSE = (1 << k for k in range(6))


def _kinds() -> np.ndarray:
    """Bits of what each code point of the basic plane is; those above it are none of these."""
    out = np.zeros(1 << 16, np.uint8)
    for bit, chars in ((_WHITE, WHITE), (_LINE, LINE_ENDS), (_SENTENCE, SENTENCE_ENDS), (_CLAUSE, CLAUSE_ENDS), (_WIDE_SENTENCE, WIDE_SENTENCE_ENDS), (_WIDE_CLAUSE, WIDE_CLAUSE_ENDS)):
        out[[ord(c) for c in chars]] |= bit
    return out


_KINDS = _kinds()


class StrongestCut:
    """Sparse table for range maxima: any window's strongest cut in two look-ups, ties to the right."""

    def __init__(self, strengths: np.ndarray) -> None:
        # strength first, place second: the largest of these is the rightmost of the strongest
        n = len(strengths)
        self.levels = [strengths.astype(np.int64) * n + np.arange(n)]
        self.n = n
        while 2 << (len(self.levels) - 1) <= n:
            half = 1 << (len(self.levels) - 1)
            low = self.levels[-1]
            self.levels.append(np.maximum(low[:-half], low[half:]))

    def at(self, first: int, last: int) -> int:
        """Place of the strongest cut in first..last, both included."""
        k = (last - first + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[first], level[last + 1 - (1 << k)])) % self.n


def cut_strengths(points: np.ndarray, places: np.ndarray, inside: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Strength of a cut before each token and after the last.

    points: the text's code points. places: how many of them lie before each cut. inside: which cuts lie within a
    character. whole: which end a piece of the public pattern. A line counts as empty if there is nothing but
    white space in it; the cut stands before the next line that isn't.
    """
    n = len(points)
    kinds = _KINDS[np.minimum(points, 0xFFFF)]
    white, lines = kinds & _WHITE != 0, kinds & _LINE != 0
    lines[:-1] &= ~((points[:-1] == 13) & (points[1:] == 10))
    seen = np.concatenate([[0], np.cumsum(~white)])
    at = np.flatnonzero(lines)
    last, following = np.concatenate([[-1], at[:-1]]), np.append(at[1:], n)[: len(at)]
    blank = (last[: len(at)] >= 0) & (seen[at] == seen[last[: len(at)] + 1])
    more = (following < n) & (seen[following] == seen[np.minimum(at + 1, n)])
    empty = np.zeros(n, bool)
    empty[at[blank & ~more]] = True
    before, after = np.clip(places - 1, 0, n - 1), np.clip(places, 0, n - 1)
    b, spaced = kinds[before], white[after]
    ends = lambda wide, narrow: (b & wide != 0) | (spaced & (b & narrow != 0))
    s = np.where(whole, PIECE, TOKEN)
    s = np.where(whole & (white[before] | spaced), WORD, s)
    s = np.where(whole & ends(_WIDE_CLAUSE, _CLAUSE), CLAUSE, s)
    s = np.where(whole & ends(_WIDE_SENTENCE, _SENTENCE), SENTENCE, s)
    s = np.where(lines[before], LINE, s)
    s = np.where(empty[before], EMPTY_LINE, s)
    s = np.where(inside, NONE, s)
    s[(places == 0) | (places == n)] = EMPTY_LINE
    s[inside] = NONE
    return s


def split_text(text: str, encoder: Encoder, most: int = 1024, overlap: int = 64, least: int | None = None) -> list[tuple[int, int, int, int]]:
    """(first token, end token, first character, end character) of each piece of a text.

    A text of at most `most` tokens is one piece, an empty one none. Each other piece ends at the strongest cut
    that leaves it `least` to `most` tokens (half of most by default), of equal ones at the rightmost, and the
    next one begins `overlap` tokens before that: at the nearest place before it at which a character begins,
    if the token there begins within one; where that is not after the last beginning, at the next character
    after it. The last piece ends with the text.
    """
    least = most // 2 if least is None else least
    if not 0 <= overlap < least <= most:
        raise ValueError("0 <= overlap < least <= most must hold")
    if not text:
        return []
    words = encoder.encode_pieces(text)
    sizes = np.fromiter(map(len, words), np.int64, count=len(words))
    n = int(sizes.sum())
    if n <= most:
        return [(0, n, 0, len(text))]
    ids = np.fromiter(chain.from_iterable(words), np.int64, count=n)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.concatenate([[0], np.cumsum(encoder.lengths[ids], dtype=np.int64)])
    whole = np.zeros(n + 1, bool)
    whole[np.concatenate([[0], np.cumsum(sizes)])] = True
    # characters that begin before each byte
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    inside = (data[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80
    inside[-1] = False
    strengths = cut_strengths(np.frombuffer(text.encode("utf-32-le"), "<u4"), chars[ends], inside, whole)
    strongest = StrongestCut(strengths)
    out: list[tuple[int, int, int, int]] = []
    begin = 0
    while True:
        room = most
        while True:
            if n - begin <= room:
                end = n
            else:
                end = strongest.at(min(begin + least, begin + room), begin + room)
                if strengths[end] == NONE:
                    end = begin + room
                    while strengths[end] == NONE:
                        end -= 1
                    if end <= begin:  # one character of more tokens than there is room for
                        end = begin + 1
                        while strengths[end] == NONE:
                            end += 1
            # tokens may join in another way only where a piece of the pattern was cut
            first, last = int(ends[begin]), int(ends[end])
            if (whole[begin] and whole[end]) or room <= 1 or encoder.count(data[first:last].tobytes().decode("utf-8")) <= most:
                break
            room -= 1
        out.append((begin, end, int(chars[first]), int(chars[last])))
        if end == n:
            return out
        last_begin, begin = begin, end - overlap
        while strengths[begin] == NONE:
            begin -= 1
        if begin <= last_begin:  # a short piece: go on by one character at least
            begin = last_begin + 1
            while strengths[begin] == NONE:
                begin += 1


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, overlap: int = 64, least: int | None = None, vocabulary: str = VOCABULARY, only_split: bool = False) -> DataFrame:
    """(id, piece, n_pieces, first_token, end_token, first_char, end_char, text) of each piece of each text.

    piece counts from 1. Texts within the limit come out as one piece, or not at all with only_split; null and
    empty texts give none. Whole texts are encoded and split, however long. Repeated rows are split each; a
    null id is kept; other columns aren't carried, so their names can't clash. No shuffle. An id column
    named as another column of the result raises ValueError.
    """
    get = shared_encoder(df, vocabulary)
    names = ["piece", "n_pieces", "first_token", "end_token", "first_char", "end_char"]
    if id_col in (*names, "text"):
        raise ValueError("the id column has the name of a column of the result")
    schema = T.StructType([df.schema[id_col], *(T.StructField(x, T.IntegerType()) for x in names), T.StructField("text", T.StringType())])
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text")).filter(F.length("__text") > 0)
    if only_split:
        # a token is at least a byte, so shorter texts need no encoding to be known as within the limit
        rows = rows.filter(F.octet_length("__text") > most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for b in batches:
            at, cols, texts, held = [], [], [], 0

            def batch() -> pa.RecordBatch:
                ints = np.array(cols, np.int32).reshape(-1, len(names))
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(ints[:, k]) for k in range(len(names))), pa.array(texts, pa.string())], names=schema.names)

            for row, text in enumerate(b.column(1)):
                text = text.as_py()
                pieces = split_text(text, encoder, most, overlap, least)
                if only_split and len(pieces) < 2:
                    continue
                for k, p in enumerate(pieces):
                    at.append(row)
                    cols.append((k + 1, len(pieces), *p))
                    texts.append(text[p[2] : p[3]])
                held += len(text)
                if held > 8_000_000:
                    yield batch()
                    at, cols, texts, held = [], [], [], 0
            if at:
                yield batch()

    return rows.mapInArrow(run, schema)


def piece_violations(pieces: DataFrame, lengths: DataFrame, id_col: str = "doc_id", most: int = 1024, overlap: int = 64, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, problem) of pieces that break a rule of split_documents; no rows if all is right.

    lengths: (id, n_chars) of every text in code points. Each piece encoded anew must have at most `most` tokens and
    as many characters as its bounds say; a text's pieces must begin at its first and end at its last character,
    each after the last one's beginning and, but for short ones, `overlap` to overlap + 3 tokens before its end.
    Ids must tell texts apart. Texts aren't shuffled, only the bounds of their pieces.
    """
    named = pieces.select(F.col(f"`{id_col}`").alias("__id"), *[c for c in pieces.columns if c != id_col], F.length("text").alias("__length"))
    sized = count_tokens(named, "text", vocabulary=vocabulary, out="__tokens")
    w = Window.partitionBy("__id").orderBy("piece")
    last = lambda c: F.lag(c).over(w)
    seen = sized.join(lengths.select(F.col(f"`{id_col}`").alias("__id"), "n_chars"), "__id")
    seen = seen.select("*", last("first_token").alias("a0"), last("end_token").alias("a1"), last("end_char").alias("c1"), last("first_char").alias("c0"))
    back = F.col("a1") - F.col("first_token")
    problem = (
        F.when(F.col("__tokens") > most, "too large")
        .when(F.col("__length") != F.col("end_char") - F.col("first_char"), "other text")
        .when((F.col("piece") == 1) & ((F.col("first_char") != 0) | (F.col("first_token") != 0)), "late beginning")
        .when((F.col("piece") == F.col("n_pieces")) & (F.col("end_char") != F.col("n_chars")), "early end")
        .when((F.col("piece") > 1) & (F.col("a0").isNull() | (F.col("first_char") > F.col("c1")) | (F.col("first_char") <= F.col("c0"))), "gap")
        .when((F.col("a1") - F.col("a0") > overlap + 3) & ~back.between(overlap, overlap + 3), "other overlap")
    )
    return seen.select(F.col("__id").alias(id_col), "piece", problem.alias("problem")).filter("problem IS NOT NULL")
