"""Token counts of a document's sections, from one encoding of the whole document.

The document is encoded once. Each token has a span of characters: the first one
is the character that holds its first byte, the last one that which holds its
last byte (a token may be a part of a character). The sorted spans of tokens and
sections are joined by binary search.

Rule for tokens that cross a boundary: such a token counts, whole, for the section
that holds its first character ("first") or its last ("last"). So the counts of all
sections add up to the count of the document.

By default the sections are the document's lines, each with the newline that ends
it. Other sections, or fields that were put together into one text, are given as a
column of starts in characters. They are taken in the order of their values, each
once; a start that is null or negative is left out, and without any the whole text
is one section. Tokens before the first start count for no section, only for the
document.

Defined cases: a null or empty text has no tokens and no sections; starts beyond
the text get no tokens; very long texts are encoded whole, in pieces that end
where the tokenizer's pattern always ends a word only if they exceed PIECE
characters; repeated rows are counted one by one; an empty table gives an empty
result; other columns pass through, and one that bears the name of an output gives
way.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabguard.llm.common import map_arrow, quoted, slices

PIECE = 1_000_000
#: A place where the pattern always ends a word: between a letter or digit and one space before a letter.
_SAFE = re.compile(r"(?<=[0-9A-Za-z])(?= [A-Za-z])")


class Counter:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PIECE:
            return self.coder.encode_to_numpy(text, disallowed_special=())
        out, at = [], 0
        while at < len(text):
            m = _SAFE.search(text, at + PIECE)
            end = m.start() if m else len(text)
            out.append(self.coder.encode_to_numpy(text[at:end], disallowed_special=()))
            at = end
        return np.concatenate(out)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token."""
        sizes = self.bytes[self.encode(text)]
        ends = np.cumsum(sizes)
        first, last = ends - sizes, ends - 1
        if not text.isascii():
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            character = np.cumsum((data & 0xC0) != 0x80) - 1
            first, last = character[first], character[last]
        return first, last

    def count(self, text: str, starts: np.ndarray, rule: str) -> tuple[int, np.ndarray, int]:
        """Tokens in all, in each section, and how many cross a boundary; starts ascend."""
        first, last = self.spans(text)
        # place 0 is what lies before the first start
        a, b = np.searchsorted(starts, first, "right"), np.searchsorted(starts, last, "right")
        each = np.bincount(a if rule == "first" else b, minlength=len(starts) + 1)[1:]
        return len(first), each, int((a != b).sum())


@lru_cache(maxsize=1)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def line_starts(text: str) -> list[int]:
    out, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def section_starts(given: list[int | None] | None) -> list[int]:
    """The starts that count, ascending."""
    return sorted({x for x in given or () if x is not None and x >= 0}) or [0]


def token_counts(docs: DataFrame, path: str, pattern: str, starts: str | None = None, rule: str = "first") -> DataFrame:
    """docs with n_tokens, n_sections, section_tokens and n_crossing."""
    if rule not in ("first", "last"):
        raise ValueError(f"rule must be 'first' or 'last', not {rule!r}")
    new = {
        "n_tokens": (T.LongType(), pa.int64()),
        "n_sections": (T.LongType(), pa.int64()),
        "section_tokens": (T.ArrayType(T.LongType(), False), pa.list_(pa.int64())),
        "n_crossing": (T.LongType(), pa.int64()),
    }
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in new])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(k, t) for k, (t, _) in new.items()]])
    at, given = kept.columns.index("text"), starts and kept.columns.index(starts)

    def run(batches):
        tool = counter(path, pattern)
        for batch in batches:
            for part in slices(batch, at):
                bounds = part.column(given) if starts else [None] * part.num_rows
                found = [[] for _ in new]
                for value, own in zip(part.column(at), bounds):
                    text = value.as_py() or ""
                    if text:
                        begin = section_starts(own.as_py()) if starts else line_starts(text)
                        n, each, crossing = tool.count(text, np.asarray(begin, np.int64), rule)
                    else:
                        n, each, crossing = 0, np.zeros(0, np.int64), 0
                    for out, x in zip(found, (n, len(each), each, crossing)):
                        out.append(x)
                arrays = [pa.array(x, t) for x, (_, t) in zip(found, new.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[f.name for f in schema.fields])

    return map_arrow(kept, run, schema)
