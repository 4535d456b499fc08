"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for every frame.

File layout, all numbers little-endian:

- frames: each one zstandard frame with its own content checksum, holding the ids of whole consecutive documents
  as unsigned 32-bit integers (a frame closes once it holds ``FRAME_IDS`` ids);
- a zstandard skippable frame (magic 0x184D2A5E, payload length) that any zstandard reader steps over, with the seek
  table: per frame compressed size, ids, crc32 of the ids, documents (4 x u32); then, as one zstandard frame, per
  document its id (i64), null mark (u8) and number of ids (u64);
- footer, the last 20 bytes of that payload: frames (u32), documents (u64), length of the compressed document table
  (u32), magic 0x4B4F5431 (u32).

Documents are range-partitioned and sorted by id (null ids first), one file for each partition. A task writes to a
name of its own and returns it as a manifest row; only rows of successful tasks reach the stored manifest, so a
retried or speculative task cannot damage a file. Readers fetch the footer and the table, then only the frames that
hold requested documents, and check each frame's checksum.

A null or empty text holds just the end id. Repeated rows and repeated ids are kept, ties in the order of the text's
hash. An empty table gives no file and no rows. Extra columns are ignored.
Ids (doc_id) are whole numbers within a long, or texts of such; any other id stops the query.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cattedra.llm.bpe import byte_symbols
from cattedra.llm.common import ship, slices, write_shared
from cattedra.llm.pretokens import unsettled
from cattedra.session import scratch_path

FRAME_IDS = 1 << 16
SKIPPABLE, MAGIC = 0x184D2A5E, 0x4B4F5431
# Fixed value: the split pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level BPE vocabulary file; ids of whole texts as the tokenizers library gives them.

    Ids are in merge order, so they serve as ranks. Texts with characters that Unicode versions class differently
    go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], {s: b for b, s in enumerate(byte_symbols())}
        if any(vocab["".join(pair)] != 256 + i for i, pair in enumerate(spec["model"]["merges"])):
            raise ValueError(f"{path}: ids are not in merge order")
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in vocab.items() if s not in special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.library = path, None  # most workers never need the library's own, larger tables

    def exact(self) -> Tokenizer:
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library

    def encode(self, text: str) -> np.ndarray:
        if unsettled(text):
            return np.asarray(self.exact().encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


_LOADED: dict[str, ByteLevel] = {}


def load(path: str) -> ByteLevel:
    if path not in _LOADED:
        _LOADED[path] = ByteLevel(path)
    return _LOADED[path]


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder by its scheme (file, hdfs, s3, gs, abfs as far as pyarrow has it)."""
    return pafs.FileSystem.from_uri(_uri(path))


def write_file(out, documents: Iterable[tuple[int | None, np.ndarray]], frame_ids: int = FRAME_IDS) -> tuple[int, int]:
    """Write documents in the given order; returns how many documents and ids went in."""
    press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    frames: list[tuple[int, int, int, int]] = []
    doc_ids, nulls, counts = [], [], []
    held: list[bytes] = []
    size = docs = total = 0

    def close() -> None:
        nonlocal held, size, docs
        raw = b"".join(held)
        body = press.compress(raw)
        out.write(body)
        frames.append((len(body), len(raw) // 4, zlib.crc32(raw), docs))
        held, size, docs = [], 0, 0

    for doc_id, ids in documents:
        held.append(np.ascontiguousarray(ids, dtype="<u4").tobytes())
        doc_ids.append(doc_id or 0)
        nulls.append(doc_id is None)
        counts.append(len(ids))
        size, docs, total = size + len(ids), docs + 1, total + len(ids)
        if size >= frame_ids:
            close()
    if docs:
        close()
    table = press.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(nulls, "u1").tobytes()
                           + np.asarray(counts, "<u8").tobytes())
    payload = (np.asarray(frames, "<u4").tobytes() + table
               + struct.pack("<IQII", len(frames), len(doc_ids), len(table), MAGIC))
    out.write(struct.pack("<II", SKIPPABLE, len(payload)) + payload)
    return len(doc_ids), total


class TokenFile:
    """Random access to one file."""

    def __init__(self, source, size: int):
        self.source = source
        n_frames, n_docs, n_table, magic = struct.unpack("<IQII", self._at(size - 20, 20))
        if magic != MAGIC:
            raise ValueError("not a token file")
        body = self._at(size - 20 - n_table - 16 * n_frames, 16 * n_frames + n_table)
        self.frames = np.frombuffer(body[:16 * n_frames], "<u4").reshape(-1, 4).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        raw = zstandard.ZstdDecompressor().decompress(body[16 * n_frames:])
        self.nulls = np.frombuffer(raw, "u1", n_docs, 8 * n_docs)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(raw, "<i8", n_docs).tolist(), self.nulls)]
        self.counts = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.first_doc = np.concatenate([[0], np.cumsum(self.frames[:, 3])])

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(int(offset))
        data = self.source.read(int(length))
        if len(data) != length:
            raise ValueError("token file is cut short")
        return data

    def frame(self, k: int) -> bytes:
        packed, n_ids, crc, _ = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[k], packed), max_output_size=int(n_ids) * 4)
        if len(raw) != 4 * n_ids or zlib.crc32(raw) != crc:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, int, bytes]]:
        """(doc id, ids before it in the file, number of ids, ids); only frames with wanted documents are read."""
        for k in range(len(self.frames)):
            at = range(int(self.first_doc[k]), int(self.first_doc[k + 1]))
            take = [i for i in at if wanted is None or self.doc_ids[i] in wanted]
            if take:
                raw, base = self.frame(k), int(self.starts[at.start])
                for i in take:
                    a, n = int(self.starts[i]) - base, int(self.counts[i])
                    yield self.doc_ids[i], base + a, n, raw[4 * a: 4 * (a + n)]


def write_tokens(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                 folder: str | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending id order. Returns the stored manifest:
    part, path, n_docs, n_ids and base (ids in the files before)."""
    spark = df.sparkSession
    ship(spark)
    folder = _uri(folder or scratch_path(spark, "tokens"))
    order = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))]
    ranged = (df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
              .repartitionByRange(*order).sortWithinPartitions(*order))

    def run(batches):
        coder, n_docs = load(path), 0
        end = np.asarray([end_id], "<u4")

        def documents():
            for part in slices(batches, "text"):
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    yield d, np.concatenate([coder.encode(t or ""), end])

        rows = documents()
        first = next(rows, None)
        if first is None:
            return
        fs, at = open_folder(folder)
        fs.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            n_docs, n_ids = write_file(out, (x for y in ((first,), rows) for x in y))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [n_docs],
                                          "n_ids": [n_ids]})

    manifest = write_shared(ranged.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Documents out of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit). ``wanted``: only these ids (a parameter list), by decompressing only their frames."""
    ship(manifest.sparkSession)
    keep = None if wanted is None else set(wanted)
    files = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = open_folder(path)
                with fs.open_input_file(at) as source:
                    rows, held = [], 0
                    for d, start, n, raw in TokenFile(source, source.size()).documents(keep):
                        rows.append((d, base + start, n, raw))
                        held += len(raw)
                        if held > 4 << 20 or len(rows) >= 2048:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    schema = "doc_id long, start long, n_tokens long, ids binary"
    return manifest.select("path", "base").repartitionByRange(files, "path").mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values())], names=list(kinds))
