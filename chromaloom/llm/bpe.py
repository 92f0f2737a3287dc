"""Byte-pair encoding by a queue of merge ranks over linked symbols, and decoding from vocabulary strings.

The tokenizer is a file in the public JSON form of byte-level BPE: vocabulary, ranked merges, added tokens. The
file's pre-tokenizer only cuts texts into pieces; merging and decoding are done here.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from chromaloom.llm.common import kept

# Texts are cut before these blanks and line ends, and their parts looked up: one of them alone between two characters
# that are no white space in any sense. The pre-tokenizer always starts a piece there.
SAFE_CUT = re.compile(r"(?<=[!-~À-ɏ])(?=[ \n][!-~À-ɏ])")
# Chunks whose pieces need no closer look: a line end, a word of Latin letters with the blank before it, marks.
PLAIN = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")
# Chunks whose ids a Python worker remembers in each of two generations, and the longest chunk (in characters) of them.
CACHE_CHUNKS, CACHE_CHARS = 1 << 19, 64


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {byte: chr(byte) for byte in prints}
    for byte in range(256):
        letters.setdefault(byte, chr(0x100 + byte - sum(p < byte for p in prints)))
    return letters


class Tokenizer:
    """Vocabulary, merge ranks and added tokens of a byte-level BPE file.

    Files with a normaliser, another pre-tokenizer or decoder, or added tokens that take in neighbours are refused.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model, cut, back = spec["model"], spec["pre_tokenizer"], spec["decoder"]
        plain = [spec["normalizer"], *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))]
        if any(plain) or model.get("byte_fallback") or model.get("ignore_merges") or model["type"] != "BPE":
            raise ValueError("only plain byte-level BPE files are read")
        if cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or back["type"] != "ByteLevel":
            raise ValueError("the pre-tokenizer and decoder have to work on bytes, without a blank put before")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens have to stand for themselves")
        self.vocabulary: dict[str, int] = model["vocab"]
        # Symbols are ids throughout. A pair of symbols gives its rank and the merged symbol, packed into one number.
        self.bits = max(self.vocabulary.values()).bit_length()
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = self.vocabulary[left] << self.bits | self.vocabulary[right]
            self.merges.setdefault(pair, rank << self.bits | self.vocabulary[left + right])
        self.cutter = tokenizers.Tokenizer.from_str(text).pre_tokenizer
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        # A byte outside the vocabulary has no id, as there is no unknown token.
        self.byte_ids = [self.vocabulary.get(letter, -1) for _, letter in sorted(byte_alphabet().items())]
        byte_of = {letter: byte for byte, letter in byte_alphabet().items()}
        strings = {**{v: k for k, v in self.vocabulary.items()}, **{v: k for k, v in added.items()}}
        # By id; ids without a string give nothing.
        self.bytes_of = [b""] * (max(strings) + 1)
        for k, s in strings.items():
            self.bytes_of[k] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.whole = min(self.byte_ids) >= 0
        # Ids of a chunk as four bytes each: a text's ids are these put together.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids of one piece, from those of its bytes.

        Symbols are a doubly linked list, the queue holds merges and their places by rank, then place. An entry is stale
        if another merge or none is due at its place by now, and is skipped.
        """
        count, bits, get = len(symbols), self.bits, self.merges.get
        if count < 2:
            return symbols
        mask, wide, push, pop = (1 << bits) - 1, count.bit_length(), heapq.heappush, heapq.heappop
        places = (1 << wide) - 1
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        due = [get(a << bits | b, -1) for a, b in zip(symbols, symbols[1:])]
        due.append(-1)
        queue = [merge << wide | at for at, merge in enumerate(due) if merge >= 0]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            at = entry & places
            if due[at] != entry >> wide:
                continue
            right = after[at]
            symbols[at] = merged = due[at] & mask
            symbols[right] = due[right] = -1
            after[at] = right = after[right]
            fresh = -1
            if right >= 0:
                before[right] = at
                fresh = get(merged << bits | symbols[right], -1)
                if fresh >= 0:
                    push(queue, fresh << wide | at)
            due[at] = fresh
            left = before[at]
            if left >= 0:
                due[left] = fresh = get(symbols[left] << bits | merged, -1)
                if fresh >= 0:
                    push(queue, fresh << wide | left)
        return [k for k in symbols if k >= 0]

    def piece(self, symbols: list[int]) -> bytes:
        return array("i", self.merge(symbols if self.whole else [k for k in symbols if k >= 0])).tobytes()

    def chunk(self, text: str) -> bytes:
        """The ids of a chunk, remembered; those of a plain chunk's parts are remembered too."""
        ids = self.cache.get(text) or self.older.get(text)
        if ids is None:
            plain = PLAIN.fullmatch(text)
            if plain is None:
                letters = (piece for piece, _ in self.cutter.pre_tokenize_str(text))
                ids = b"".join([self.piece([self.vocabulary.get(letter, -1) for letter in piece]) for piece in letters])
            elif plain[1] or plain[3]:
                ids = b"".join(map(self.chunk, filter(None, plain.groups())))
            else:
                ids = self.piece(list(map(self.byte_ids.__getitem__, text.encode())))
        if len(text) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_CHUNKS:
                # What was not met for a whole generation is forgotten.
                self.older, self.cache = self.cache, {}
            self.cache[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of added tokens become their ids."""
        parts = self.added_pattern.split(text) if self.added_pattern and any(a in text for a in self.added) else [text]
        ids: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(array("i", [self.added[part]]).tobytes())
            elif part:
                chunks = SAFE_CUT.split(part)
                found = list(map(self.cache.get, chunks))
                if None in found:
                    found = [self.chunk(c) if f is None else f for c, f in zip(chunks, found)]
                ids += found
        return np.frombuffer(b"".join(ids), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings put together; ids without one are skipped, broken UTF-8 becomes U+FFFD."""
        known = ids[(ids >= 0) & (ids < len(self.bytes_of))].tolist()
        return b"".join(map(self.bytes_of.__getitem__, known)).decode("utf-8", "replace")

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}, "older": {}}


def load(path: str) -> Tokenizer:
    """Read a tokenizer file on the driver: a model of fixed size."""
    with open(path, encoding="utf-8") as file:
        return Tokenizer(file.read())


def _strings(column: pa.Array) -> Iterator[str]:
    """Texts one by one, without nulls; bytes that are not UTF-8 become U+FFFD."""
    for text in column.cast(pa.binary()):
        yield (text.as_py() or b"").decode("utf-8", "replace")


def _listed(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = np.concatenate(found) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode_column(spark: SparkSession, tokenizer: Tokenizer, text_col: str = "text") -> Column:
    """array<int> of the ids of a whole text. Null and empty texts have no ids; every row is encoded on its own.

    The text must fit a row, its ids take four bytes each. Other columns are not looked at.
    """
    held = kept(spark, tokenizer)

    def encode(column: pa.Array) -> pa.Array:
        # Nothing made here refers back to itself; the collector would only walk the remembered chunks again and again.
        gc.disable()
        try:
            return _listed([held().encode(text) for text in _strings(column)])
        finally:
            gc.enable()

    # Not deterministic in name only: the planner then computes the ids once, however often they are used.
    once = F.arrow_udf(encode, "array<int>", ArrowUDFType.SCALAR).asNondeterministic()
    return once(F.col(text_col).cast("string"))


def both_ways_column(spark: SparkSession, tokenizer: Tokenizer, text_col: str = "text") -> Column:
    """struct of the ids of a whole text, as ``encode_column`` has them, and the text decoded from just these ids."""
    held = kept(spark, tokenizer)

    def there_and_back(column: pa.Array) -> pa.Array:
        gc.disable()
        try:
            ids = [held().encode(text) for text in _strings(column)]
            return pa.StructArray.from_arrays([_listed(ids), pa.array(map(held().decode, ids), pa.string())], ["ids", "decoded"])
        finally:
            gc.enable()

    once = F.arrow_udf(there_and_back, "ids array<int>, decoded string", ArrowUDFType.SCALAR).asNondeterministic()
    return once(F.col(text_col).cast("string"))


def decode_column(spark: SparkSession, tokenizer: Tokenizer, ids_col: str = "ids") -> Column:
    """The text of an array of ids. Null and empty arrays give the empty text; null and unknown ids are skipped."""
    held = kept(spark, tokenizer)

    def decode(column: pa.Array) -> pa.Array:
        none = np.empty(0, np.int32)
        lists = (ids.values.drop_null().to_numpy() if ids.is_valid else none for ids in column)
        return pa.array([held().decode(ids) for ids in lists], pa.string())

    once = F.arrow_udf(decode, "string", ArrowUDFType.SCALAR).asNondeterministic()
    return once(F.col(ids_col).cast("array<int>"))
