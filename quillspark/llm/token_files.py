"""Token-id files: one zstandard frame per document, one shared dictionary.

File layout, little-endian: the magic bytes, one frame per document, then an
index of four arrays (document id int64, frame start uint64, frame length
uint32, ids before the document in this file uint64), then a JSON footer
(``dictionary`` sha256, ``width`` of an id in bytes, ``documents``, ``tokens``,
``index`` start) and its length as uint32. A reader needs the footer, one index
entry and one frame to get one short document. The dictionary is a file of its
own, named by its hash, and a reader refuses one whose bytes do not match.

Defined cases: a null text is the empty text, whose document is the end id
alone; a very long text is one frame, encoded whole; repeated ids are separate
documents, in any order among themselves; a null id sorts first and is kept as
null; other columns, whatever their names, are not looked at; a sample too small
to train on is the dictionary itself; an empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import filesystem, new_folder
from .words import cached_tokenizer, hash_sample, id_and_text, raw_texts, slices

MAGIC = b"QTOK0001"
NULL_ID = -(2**63)

#: The dictionary is fitted on about this many documents (at most twice as many),
#: those with the smallest hash of their id, of at most so many bytes of text each.
TRAINING_DOCUMENTS, TRAINING_TEXT_BYTES, DICTIONARY_BYTES = 800, 32_768, 65_536
LEVEL = 3
#: Smaller samples are no training set for the library: they are the dictionary themselves.
LEAST_TRAINING_BYTES, LEAST_TRAINING_ARRAYS = 2 * DICTIONARY_BYTES, 16


def _serialized(packed: bytes, width: int) -> bytes:
    """Ids in as few whole bytes as the vocabulary needs."""
    return np.frombuffer(packed, dtype="<u4").astype("<u2").tobytes() if width == 2 else packed


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """Dictionary over serialized id arrays of a bounded sample; empty only if there is no text at all."""
    sample = hash_sample(docs.where(F.octet_length("text").between(1, TRAINING_TEXT_BYTES)), TRAINING_DOCUMENTS).select("text").collect()
    tok, end = cached_tokenizer(tokenizer), struct.pack("<I", end_id)
    return dictionary_of([_serialized(x + end, width) for x in tok.packed_batch([r.text.encode() for r in sample])])


def dictionary_of(arrays: list[bytes]) -> bytes:
    """A trained dictionary; from a sample too small to train on, its own bytes, which the codec takes as raw content."""
    import zstandard

    if sum(map(len, arrays)) >= LEAST_TRAINING_BYTES and len(arrays) >= LEAST_TRAINING_ARRAYS:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    return b"".join(arrays)[-DICTIONARY_BYTES:]


def _write_file(path: str, batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, width: int, dictionary: bytes) -> dict | None:
    import zstandard

    system, where = filesystem(path)
    tok, end = cached_tokenizer(tokenizer), struct.pack("<I", end_id)
    codec = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    ids, starts, lengths, counts, at = [], [], [], [], len(MAGIC)
    out = None
    part = f"{where}.{uuid.uuid4().hex}"
    for batch in slices(batches):
        if out is None:
            out = system.open_output_stream(part, compression=None)
            out.write(MAGIC)
        packed = tok.packed_batch(raw_texts(batch.column("text")))
        frames = [codec.compress(_serialized(x + end, width)) for x in packed]
        out.write(b"".join(frames))
        sizes = np.fromiter(map(len, frames), dtype=np.int64, count=len(frames))
        ids.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy())
        starts.append((at + np.cumsum(sizes) - sizes).astype("<u8"))
        lengths.append(sizes.astype("<u4"))
        counts.append(np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4 + 1)
        at += int(sizes.sum())
    if out is None:
        return None
    n = np.concatenate(counts)
    for array in (np.concatenate(ids).astype("<i8"), np.concatenate(starts), np.concatenate(lengths), (np.cumsum(n) - n).astype("<u8")):
        out.write(array.tobytes())
    footer = {"dictionary": hashlib.sha256(dictionary).hexdigest(), "width": width, "documents": len(n), "tokens": int(n.sum()), "index": at}
    raw = json.dumps(footer).encode()
    out.write(raw + struct.pack("<I", len(raw)))
    out.close()
    system.move(part, where)  # a repeated attempt replaces the file by an equal one
    return footer


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts and write them in ascending id order; returns the folder.

    Documents are dealt out by ranges of ids, so file k holds smaller ids than
    file k + 1. Every task writes one file under a name of its attempt and moves
    it into place, so lost executors and repeated attempts do no harm. The
    manifest, one entry per file, is written last.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    system, where = filesystem(folder)
    system.create_dir(where)
    texts = id_and_text(docs, id_col, text_col)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 65_536 else 4
    dictionary = train_dictionary(texts, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    with system.open_output_stream(f"{where}/{digest}.dictionary", compression=None) as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        raw = _dictionary(folder, digest)
        name = f"part-{part:06d}.tokens"
        if footer := _write_file(f"{folder}/{name}", batches, tokenizer, end_id, width, raw):
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "documents": [footer["documents"]], "tokens": [footer["tokens"]]})

    files = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(write, "part long, name string, documents long, tokens long").collect()
    base, entries = 0, []
    for f in sorted(files):
        entries.append({"name": f.name, "documents": f.documents, "tokens": f.tokens, "start": base})
        base += f.tokens
    with system.open_output_stream(f"{where}/manifest.json", compression=None) as f:
        f.write(json.dumps({"dictionary": digest, "width": width, "end_id": end_id, "tokens": base, "files": entries}).encode())
    return folder


def _dictionary(folder: str, digest: str) -> bytes:
    system, where = filesystem(folder)
    with system.open_input_stream(f"{where}/{digest}.dictionary", compression=None) as f:
        raw = f.read()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError("the dictionary file is not the one the token files were written with")
    return raw


class TokenFile:
    """One file, opened by its footer and index; documents are read one at a time."""

    def __init__(self, folder: str, name: str):
        import zstandard

        system, where = filesystem(folder)
        self.file = system.open_input_file(f"{where}/{name}")
        size = self.file.size()
        [n] = struct.unpack("<I", self.file.read_at(4, size - 4))
        self.footer = json.loads(self.file.read_at(n, size - 4 - n))
        docs, at = self.footer["documents"], self.footer["index"]
        raw = self.file.read_at(size - 4 - n - at, at)
        self.ids = np.frombuffer(raw, "<i8", docs, 0)
        self.starts = np.frombuffer(raw, "<u8", docs, 8 * docs).astype(np.int64)
        self.lengths = np.frombuffer(raw, "<u4", docs, 16 * docs).astype(np.int64)
        self.before = np.frombuffer(raw, "<u8", docs, 20 * docs).astype(np.int64)
        dictionary = _dictionary(folder, self.footer["dictionary"])
        self.codec = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))

    def __len__(self) -> int:
        return self.footer["documents"]

    def decode(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.codec.decompress(frame), dtype=f"<u{self.footer['width']}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document: one read of its frame alone."""
        return self.decode(self.file.read_at(int(self.lengths[k]), int(self.starts[k])))

    def runs(self, limit: int = 4 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, read in runs of about ``limit`` bytes."""
        k, n = 0, len(self)
        ends = self.starts + self.lengths
        while k < n:
            stop = max(k + 1, int(np.searchsorted(ends, self.starts[k] + limit, side="right")))
            base = int(self.starts[k])
            raw = self.file.read_at(int(ends[stop - 1]) - base, base)
            yield k, [self.decode(raw[s - base : s - base + m]) for s, m in zip(self.starts[k:stop].tolist(), self.lengths[k:stop].tolist(), strict=True)]
            k = stop


def manifest(folder: str) -> dict:
    system, where = filesystem(folder)
    with system.open_input_stream(f"{where}/manifest.json", compression=None) as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a folder: doc_id, start, n_tokens, ids_crc32, and ids if asked.

    One task per file. ``start`` counts the ids of all documents before in id
    order, and ``ids_crc32`` is taken over the ids that were read back.
    """
    meta = manifest(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    files = [(f["name"], f["start"]) for f in meta["files"]]
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = TokenFile(folder, name)
                for k, docs in file.runs():
                    stop = k + len(docs)
                    own = file.ids[k:stop]
                    arrays = [
                        pa.array(own, mask=own == NULL_ID),
                        pa.array(file.before[k:stop] + base),
                        pa.array([len(x) for x in docs], pa.int64()),
                        pa.array([zlib.crc32(x) for x in docs], pa.int64()),
                    ]
                    if with_ids:
                        arrays.append(pa.array([x.astype(np.int32) for x in docs], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    listed = spark.createDataFrame(files, "name string, start long").repartition(len(files), "name")
    return listed.mapInArrow(read, schema)
