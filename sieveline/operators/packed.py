"""Several values packed in one field: a quote-aware finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.logfields import WHITE

_SPACE = frozenset(WHITE)


@dataclass(frozen=True)
class Packing:
    """How values are packed.

    delimiters: each character separates values. quotes: a value that begins with one of them ends at the same
    one. doubled: quotes of which two within a quoted value stand for one. escape: a character that takes the
    next one literally, in or out of quotes ("" for none). brackets: opening and closing characters in turn,
    such as "()[]"; delimiters within them belong to the value. no_values: unquoted values that stand for nothing.
    decode: "percent" decodes %XX as UTF-8 before the split, with "+" left alone.
    """

    delimiters: str = ",;|\t"
    quotes: str = "\"'"
    doubled: str = '"'
    escape: str = ""
    brackets: str = ""
    no_values: tuple[str, ...] = ()
    decode: str = ""


def tokenize(text: str | None, how: Packing = Packing()) -> list[str]:
    """The values of a packed field, in order.

    States: before a value, in a plain value (with nesting depth), in a quoted value. White space around a
    value is dropped, white space within quotes is kept; a blank value gives nothing and takes no position. A
    value ends at its closing quote: text between that and the next delimiter is the next value. A quote
    without its partner is an ordinary character, as is any quote inside a plain value. An unclosed bracket
    doesn't hide the delimiters after it.
    """
    if not text:
        return []
    if how.decode == "percent":
        text = unquote(text, errors="replace")
    delimiters, quotes, doubled, escape = how.delimiters, how.quotes, how.doubled, how.escape
    opening, closing = how.brackets[::2], how.brackets[1::2]
    out: list[str] = []
    i, n = 0, len(text)
    unpaired = ""
    while i < n:
        c = text[i]
        if c in _SPACE or c in delimiters:
            i += 1
            continue
        if c in quotes and c not in unpaired:
            j, parts, begin = i + 1, [], i + 1
            while True:
                k = text.find(c, j)
                if escape and (e := text.find(escape, j, k if k >= 0 else n)) >= 0 and e + 1 < n:
                    parts.append(text[begin:e])
                    begin, j = e + 1, e + 2
                    continue
                if k < 0:
                    break
                if c in doubled and text[k + 1 : k + 2] == c:
                    parts.append(text[begin : k + 1])
                    begin = j = k + 2
                    continue
                parts.append(text[begin:k])
                break
            if k >= 0:
                if (value := "".join(parts)).strip(WHITE):
                    out.append(value)
                i = k + 1
                continue
            unpaired += c
        begin, depth, chars, restart = i, 0, None, -1
        while i < n:
            c = text[i]
            if escape and c == escape and i + 1 < n:
                chars = [*text[begin:i]] if chars is None else chars
                chars.append(text[i + 1])
                i += 2
                continue
            if c in delimiters:
                if not depth:
                    break
                if restart < 0:
                    restart = i
                    held = None if chars is None else len(chars)
            elif opening and c in opening:
                depth += 1
            elif opening and c in closing and depth:
                depth -= 1
                if not depth:
                    restart = -1
            if chars is not None:
                chars.append(c)
            i += 1
        if depth and restart >= 0:
            i = restart
            chars = None if chars is None or held is None else chars[:held]
        value = (text[begin:i] if chars is None else "".join(chars)).strip(WHITE)
        if value and value not in how.no_values:
            out.append(value)
    return out


def split_packed(df: DataFrame, column: str, keep: list[str], how: Packing = Packing(), pos: str = "pos", val: str = "val", only: Column | None = None) -> DataFrame:
    """One row for each value packed in a column: the kept columns, the place from 1 and the value.

    Null, empty and blank fields and fields of nothing but delimiters give no rows. Only the kept columns are
    carried, so extra columns of df can't clash; a kept column named as pos or val raises ValueError. Repeated
    rows are split each on its own. No shuffle: each Arrow batch is split where it lies, and a text that
    repeats within a batch is tokenized once. only: rows for which this is false or null hold a single value,
    which comes out as it stands; so fields of both kinds can be read in one pass.
    """
    if {pos, val} & set(keep):
        raise ValueError(f"kept columns clash with {pos} or {val}")
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField(pos, T.IntegerType()), T.StructField(val, T.StringType())])
    fields = F.col(f"`{column}`")
    is_packed = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    inner = df.select(*[F.col(f"`{c}`") for c in keep], is_packed.alias("__only"), fields.cast("string").alias("__packed")).filter(F.length("__packed") > 0)
    n_kept, names = len(keep), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(n_kept)
            if packed.true_count < b.num_rows:
                single = b.filter(pc.invert(packed))
                yield pa.RecordBatch.from_arrays([*single.columns[:n_kept], pa.array([1] * single.num_rows, pa.int32()), single.column(n_kept + 1)], names=names)
                b = b.filter(packed)
            texts = b.column(n_kept + 1).dictionary_encode()
            split = [tokenize(t, how) for t in texts.dictionary.to_pylist()]
            rows, places, values = [], [], []
            for row, code in enumerate(texts.indices.to_pylist()):
                found = split[code]
                rows += [row] * len(found)
                places += range(1, len(found) + 1)
                values += found
            if rows:
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(at) for k in range(n_kept)), pa.array(places, pa.int32()), pa.array(values, pa.string())],
                    names=names,
                )

    return inner.mapInArrow(run, schema)
