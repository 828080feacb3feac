"""Several values packed in one field, split into one row per value.

Works on Arrow buffers: quote parity is a cumulative sum over the bytes of a whole batch, delimiters are a mask over the
bytes outside quotes, and child offsets follow from the delimiters' places. No loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE = 34
# Bytes that stand for delimiters of more than one byte while a batch is scanned, with what they stand for inside quotes.
MARKS = {"\x01": " aka ", "\x02": " / ", "\x03": "、", "\x04": "•", "\x06": " a.k.a. ", "\x07": " also known as ", "\x0e": "；", "\x0f": "，", "\x10": "·"}
ESCAPED = "\x05"
DELIMITERS = np.frombuffer(b",;|\n\r\t\x01\x02\x03\x04\x06\x07\x0e\x0f", dtype=np.uint8)

# Words that only introduce or join names, and words that stand for nothing.
JOINERS = [(r"(?i)\s+aka:?\s+", "\x01"), (r"(?i)\s+a\.k\.a\.:?\s+", "\x06"), (r"(?i)\s+also known as:?\s+", "\x07"), (r"\s+/\s*|\s*/\s+", "\x02"), ("、", "\x03"), ("[•●▪]", "\x04"), ("；", "\x0e"), ("，", "\x0f")]
INTRODUCERS = r"(?i)^(?:(?:aka\b|a\.k\.a\.?|also known as\b|(?:alias(?:es)?|formerly|names?):)\s*:?\s*)+"
NOTHING = ["", "-", "--", "?", "n/a", "na", "none", "null", "nil", "unknown", "tba", "tbd", "nan", "undefined", "[]", '""', "n.a."]


def _offsets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, from 0."""
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, dtype=np.int32)[arr.offset : arr.offset + len(arr) + 1]
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return d, (o - o[0]).astype(np.int64)


def split_strings(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A string array -> parents (row numbers), positions from 1, values. Nulls and rows without a value have none."""
    text = pc.fill_null(text.cast(pa.string()), "")
    trimmed = pc.utf8_trim_whitespace(text)
    # a JSON list is a quoted list in brackets with another escape
    listed = pc.and_(pc.starts_with(trimmed, "["), pc.ends_with(trimmed, "]"))
    inner = pc.utf8_slice_codeunits(trimmed, 1, -1)
    if pc.any(listed).as_py():
        inner = pc.replace_substring_regex(inner, r"\\u([0-9a-fA-F]{4})", r"\\u\1")
        coded = pc.and_(listed, pc.match_substring_regex(inner, r"\\u[0-9a-fA-F]{4}"))
        if pc.any(coded).as_py():
            import re

            plain = [re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x) if c else x for x, c in zip(inner.to_pylist(), coded.to_pylist(), strict=True)]
            inner = pa.array(plain, pa.string())
        inner = pc.replace_substring(pc.replace_substring(inner, '\\"', ESCAPED), "\\\\", "\\")
    s = pc.if_else(listed, inner, trimmed)
    s = pc.replace_substring_regex(s, "[“”„‟«»]", '"')
    for rx, mark in JOINERS:
        s = pc.replace_substring_regex(s, rx, mark)
    s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
    data, offs = _offsets(s)
    n = len(s)
    row_of = np.repeat(np.arange(n), np.diff(offs))
    quotes = data == QUOTE
    total = np.concatenate([[0], np.cumsum(quotes)])
    per_row = total[offs[1:]] - total[offs[:-1]]
    # a row with an odd number of quotes: its last one quotes nothing
    where = np.flatnonzero(quotes)
    odd = np.flatnonzero(per_row % 2)
    if len(odd):
        quotes = quotes.copy()
        quotes[where[total[offs[1:]][odd] - 1]] = False
        total = np.concatenate([[0], np.cumsum(quotes)])
    inside = ((total[:-1] - total[offs[:-1]][row_of]) & 1).astype(bool)
    cut = np.isin(data, DELIMITERS) & ~inside
    # a row with k delimiters has k + 1 children, which lie one after the other once the delimiters are taken out
    cuts = np.concatenate([[0], np.cumsum(cut)])
    children = (cuts[offs[1:]] - cuts[offs[:-1]] + 1).astype(np.int64)
    parents = np.repeat(np.arange(n), children)
    kept = np.concatenate([[0], np.cumsum(~cut)])
    ends = np.sort(np.concatenate([kept[np.flatnonzero(cut)], kept[offs[1:]]]))
    child_offs = np.concatenate([[0], ends]).astype(np.int32)
    values = pa.StringArray.from_buffers(len(parents), pa.py_buffer(child_offs.tobytes()), pa.py_buffer(data[~cut].tobytes()))
    values = pc.utf8_trim_whitespace(values)
    values = pc.utf8_trim_whitespace(pc.replace_substring_regex(values, INTRODUCERS, ""))
    # quoting around a value goes, with the doubling inside it; quotes within a name stay
    body = pc.utf8_slice_codeunits(values, 1, -1)
    bare = pc.replace_substring(body, '""', "")
    around = pc.and_(pc.and_(pc.starts_with(values, '"'), pc.ends_with(values, '"')), pc.and_(pc.greater(pc.binary_length(values), 1), pc.invert(pc.match_substring(bare, '"'))))
    values = pc.if_else(around, pc.utf8_trim_whitespace(pc.replace_substring(body, '""', '"')), values)
    single = pc.and_(pc.match_substring_regex(values, r"^'[^']*'$"), pc.invert(around))
    values = pc.if_else(single, pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(values, 1, -1)), values)
    values = pc.replace_substring(values, ESCAPED, '"')
    for mark, meant in MARKS.items():
        values = pc.replace_substring(values, mark, meant)
    real = pc.invert(pc.is_in(pc.utf8_lower(values), value_set=pa.array(NOTHING)))
    keep = np.flatnonzero(real.to_numpy(zero_copy_only=False))
    parents = parents[keep]
    first = np.searchsorted(parents, parents, side="left")
    return parents, (np.arange(len(parents)) - first + 1).astype(np.int32), values.take(pa.array(keep))


def split_packed(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, once: bool = True) -> DataFrame:
    """df -> (row_id, pos int, value string, kept columns): one row per value packed in `text_col`, in its order, pos from 1.

    Delimiters may be mixed: comma, semicolon, bar, tab, line break, bullets, spaced slash, words such as "aka".
    Quoted text is never split and loses the quotes around it; JSON lists are read as such. Empty places, stand-ins and
    null fields give no row. Rows that arrive twice count once (`id_col` names the record), unless `once` is False. Extra
    columns that are not to be kept are not read.
    """
    keep = keep or []
    rows = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"), *keep).where("row_id is not null and text is not null")
    if once:
        rows = rows.dropDuplicates(["row_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parents, pos, values = split_strings(b.column(1))
            at = pa.array(parents)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(pos), values.cast(pa.string()), *[b.column(2 + i).take(at) for i in range(len(keep))]], names=["row_id", "pos", "value", *keep])

    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, "row_id bigint, pos int, value string" + kinds)
