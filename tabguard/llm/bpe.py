"""Byte-pair encoding and decoding with a published vocabulary.

A word is cut into single symbols whose ids stand in one array; beside it stands
an array with the rank of merging each symbol with its right neighbour. The
least rank is searched, that boundary deleted and the ranks to its left and
right are looked up anew, until no pair is left that may merge. Words of more
than SHORT symbols, where the repeated search would be quadratic, get the same
merges in the same order from a heap over a linked list.

The text is cut at white space, which no token crosses, and what a piece became
is remembered, as packed 32-bit ids, in tables that are bounded in bytes and are
given up when a task ends.

Defined cases: a null text is the empty text and has no tokens; very long texts
and words are encoded whole; repeated rows are encoded alike; an empty table
gives an empty result; other columns pass through, and one that bears the name
of an output gives way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabguard.llm.common import map_arrow, quoted, slices

#: Fixed value: the tokenizer's white space, the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the tokenizer's pattern for words.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
SHORT = 96
#: Bytes, about, of each of the two generations of the tables of known pieces and words.
KNOWN_BYTES = 12 << 20
NO_MERGE = 1 << 60
_ID = (1 << 20) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Known:
    """A table of texts and their packed ids, bounded in bytes, in two generations.

    What is asked for again outlives the older generation.
    """

    #: What an entry takes besides its text and ids.
    EACH = 160

    def __init__(self, most: int):
        self.most, self.young, self.old, self.size = most, {}, {}, 0

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if self.size >= self.most:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[key] = value
        self.size += self.EACH + 4 * len(key) + len(value)


class Tokenizer:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in vocab.items()}
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[a] << 20) | vocab[b], (rank, vocab[a + b]))
        # rank and id of what the pair becomes in one number, in the order of the ranks
        self.rank = {k: (r << 20) | i for k, (r, i) in self.merge.items()}
        del self.merge
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in special.items()}
        self.special = special
        self.specials = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) or r"(?!)")
        self.pieces = regex.compile(PIECES)
        self.gaps = regex.compile(f"[{SPACE}]+")
        self.forget()

    def forget(self) -> None:
        self.known_pieces, self.known_words = Known(KNOWN_BYTES), Known(KNOWN_BYTES)

    def word(self, symbols: bytes) -> list[int]:
        """The ids of one word, given in UTF-8."""
        if not symbols:
            return []
        ids = [self.inner[b] for b in symbols[:-1]]
        ids.append(self.last[symbols[-1]])
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        rank = self.rank.get
        ranks = [rank((a << 20) | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_MERGE:
                break
            i = ranks.index(least)
            ids[i] = new = least & _ID
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((new << 20) | ids[i + 1], NO_MERGE)
            if i:
                ranks[i - 1] = rank((ids[i - 1] << 20) | new, NO_MERGE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank
        heap = [(rank[k], i, k) for i in range(n - 1) if (k := (ids[i] << 20) | ids[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or (ids[i] << 20) | ids[j] != k:
                continue
            ids[i], ids[j] = rank[k] & _ID, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (k := (ids[a] << 20) | ids[b]) in rank:
                    heapq.heappush(heap, (rank[k], a, k))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        """The packed ids of a text without white space."""
        if piece.isascii():
            plain = piece.lower()
        else:
            # lower() alone would give the final sigma where the tokenizer maps each character by itself
            plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        if plain.isalpha():  # one word of letters, the most frequent case
            ids = self._word(plain)
        elif plain[:-1].isalpha() and plain[-1] in ".,":
            ids = self._word(plain[:-1]) + self._word(plain[-1])
        else:
            ids = b"".join(map(self._word, self.pieces.findall(plain)))
        if len(piece) <= SHORT:
            self.known_pieces.put(piece, ids)
        return ids

    def _word(self, w: str) -> bytes:
        ids = self.known_words.get(w)
        if ids is None:
            ids = array("i", self.word(w.encode())).tobytes()
            if len(w) <= SHORT:
                self.known_words.put(w, ids)
        return ids

    def _ordinary(self, text: str) -> list[bytes]:
        known = self.known_pieces.young.get
        older = self.known_pieces.get
        pieces = text.split() if not _ODD.search(text) else self.gaps.split(text)
        out: list[bytes] = []
        for p in pieces:
            ids = known(p)
            if ids is None:
                ids = older(p)
                if ids is None:
                    ids = self._piece(p)
                known = self.known_pieces.young.get
            out.append(ids)
        return out

    def pack(self, text: str) -> bytes:
        """The ids of a text, 32 bits each."""
        if "<|" not in text:
            return b"".join(self._ordinary(text))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._ordinary(text[at : m.start()])
            out.append(array("i", [self.special[m[0]]]).tobytes())
            at = m.end()
        return b"".join(out + self._ordinary(text[at:]))

    def encode(self, text: str) -> list[int]:
        return unpacked(self.pack(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by a space: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def spelled(self, ids: Iterable[int]) -> str:
        return " ".join(map(str, ids))


def unpacked(ids: bytes) -> memoryview:
    return memoryview(ids).cast("i")


#: Where str.split() would cut and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


#: What bpe() can add: the ids, their number, the text they stand for, and digests of both.
OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    "n_tokens": (T.LongType(), pa.int64()),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def bpe(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), text: str = "text") -> DataFrame:
    """docs with the outputs named, each computed from the whole text."""
    kept = [c for c in docs.columns if c.lower() not in outputs]
    carried = docs.select(*[quoted(c) for c in kept])
    schema = T.StructType([*carried.schema.fields, *[T.StructField(k, OUTPUTS[k][0]) for k in outputs]])
    at, names = kept.index(text), [f.name for f in schema.fields]

    def run(batches):
        coder = tokenizer(path)
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, *_coded(coder, part.column(at), outputs)], names=names)
        coder.forget()

    return map_arrow(carried, run, schema)


def _coded(coder: Tokenizer, texts: pa.Array, outputs: tuple[str, ...]) -> list[pa.Array]:
    found = {k: [] for k in outputs}
    for value in texts:
        packed = coder.pack(value.as_py() or "")
        ids = unpacked(packed)
        back = coder.decode(ids) if {"decoded", "decoded_sha256"} & found.keys() else ""
        for k, out in found.items():
            if k == "ids":
                out.append(packed)
            elif k == "n_tokens":
                out.append(len(ids))
            elif k == "decoded":
                out.append(back)
            else:
                out.append(_digest(coder.spelled(ids) if k == "ids_sha256" else back))
    return [_lists(found[k]) if k == "ids" else pa.array(found[k], OUTPUTS[k][1]) for k in outputs]


def _lists(packed: list[bytes]) -> pa.Array:
    """Lists of 32-bit numbers over one buffer."""
    ends = array("i", accumulate((len(x) // 4 for x in packed), initial=0))
    values = b"".join(packed)
    flat = pa.Array.from_buffers(pa.int32(), len(values) // 4, [None, pa.py_buffer(values)])
    offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends.tobytes())])
    return pa.ListArray.from_arrays(offsets, flat)
