"""Byte-pair encoding with a merge queue over a linked symbol list, and decoding by vocabulary strings.

A pre-token starts as one symbol per byte (the last one carries the word end). All adjacent pairs that have a
merge rank go to a priority queue keyed by (rank, position). The lowest entry is popped; it is stale, and skipped,
if either symbol has changed or gone since it was pushed. Otherwise the right symbol is unlinked, the left one
becomes the merged symbol, and the two new neighbouring pairs are pushed. This is O(n log n) in the length of a
pre-token, however long it is.

``encode`` appends the ids of each whole text to a frame, ``decode`` the text of ids, ``round_trip`` both in one pass
over Arrow batches. Texts never leave their task; there is no shuffle.

Nulls encode as the empty text: no ids, and an empty decoded text. Columns named like an output column are replaced.
Repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cattedra.llm.common import no_clash, ship, slices
from cattedra.llm.pretokens import PretokenCoder, split_words, unsettled


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges lowest rank first, leftmost first. ``merges``: (left, right) -> (rank, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        hit = merges.get((sym[i], sym[i + 1]))
        if hit:
            queue.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, merged = heapq.heappop(queue)
        j = after[i]
        if sym[i] != left or j < 0 or sym[j] != right:
            continue  # stale: a neighbour was merged since this entry was pushed
        k = after[j]
        sym[i], sym[j], after[i] = merged, -1, k
        if k >= 0:
            before[k] = i
            hit = merges.get((merged, sym[k]))
            if hit:
                heapq.heappush(queue, (hit[0], i, merged, sym[k], hit[1]))
        h = before[i]
        if h >= 0:
            hit = merges.get((sym[h], merged))
            if hit:
                heapq.heappush(queue, (hit[0], h, sym[h], merged, hit[1]))
    out, i = [], 0
    while i >= 0:
        out.append(sym[i])
        i = after[i]
    return out


class WordBpe:
    """A word-end BPE vocabulary file (tokenizers JSON layout), with its own encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        symbols = byte_symbols()
        self.path, self.library, self.byte_of = path, None, {s: b for b, s in enumerate(symbols)}
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in special.items()}
        self.coder = PretokenCoder(self.split, self._encode_new,
                                   {s: np.int32(i).tobytes() for s, i in special.items()})

    def split(self, text: str) -> list[str]:
        """Pre-tokens. Characters newer than the Unicode tables here go by the tables of the tokenizers library."""
        if not unsettled(text):
            return split_words(text)
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return merge_symbols([self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]], self.merges)

    def _encode_new(self, words: list[str]) -> list[bytes]:
        return [np.asarray(self.encode_word(w), dtype="<i4").tobytes() for w in words]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b, dtype="<i4") for b in self.coder.encode(texts)]

    def decode(self, ids) -> str:
        """Vocabulary strings joined by one blank: this vocabulary names no decoder, and word ends stay visible."""
        return " ".join(map(self.strings.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One instance for each vocabulary and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def _mapped(df: DataFrame, column: str, add: list[tuple[str, T.DataType]], work) -> DataFrame:
    """``df`` with columns that ``work`` computes from slices of ``column``; other columns pass through."""
    ship(df.sparkSession)
    base = no_clash(df, *[n for n, _ in add if n != column])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t in add]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            made = work(part.column(part.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return base.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Append ``ids`` (array of int): the token ids of each whole text."""
    return _mapped(df, text, [(ids, T.ArrayType(T.IntegerType()))],
                   lambda col: [_lists(load(path).encode(col.to_pylist()))])


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids",
               decoded: str = "decoded") -> DataFrame:
    """Append the ids of each whole text and what those ids decode to, in one pass."""
    def work(col):
        bpe = load(path)
        arrays = bpe.encode(col.to_pylist())
        return [_lists(arrays), pa.array([bpe.decode(a.tolist()) for a in arrays], type=pa.string())]

    return _mapped(df, text, [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())], work)


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Append the text of an array of token ids (null ids: the empty text). An unknown id stops the job."""
    ship(df.sparkSession)
    base = no_clash(df, decoded)
    schema = T.StructType([*base.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([bpe.decode(x or ()) for x in col], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.fieldNames())

    return base.mapInArrow(run, schema)
