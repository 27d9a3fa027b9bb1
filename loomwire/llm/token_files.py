"""Operator 12, token ids in binary files: one Zstandard frame for each document, all with one dictionary.

A file is a header (magic, version, width of an id in bytes, SHA-256 of the dictionary), the documents' frames, and a
footer: for each document its id, the ids before it in the file, and where its frame begins, then the length of that
table and the magic again. The dictionary is trained on a bounded sample of id arrays and lies beside the files. A
document of any file costs one read of the footer, one of its frame, and the dictionary, which is held by its hash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwire.llm.columns import table
from loomwire.llm.tokens import word_encoder, word_path
from loomwire.session import cut, drop_folder, new_folder

END, LEVEL, FILE_BYTES = 2, 3, 1 << 26
#: The dictionary's size, the documents it is trained on at most, and the ids that each of them gives at most.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_IDS = 1 << 16, 2000, 2048
MAGIC, VERSION, NO_ID = b"LWTOKENS", 1, -(1 << 63)
HEAD, ENTRY, TAIL = struct.Struct("<8sHH32s"), np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("start", "<i8"), ("frame", "<i8")]), struct.Struct("<qqq8s")
DICTIONARY = "dictionary.zdict"


def narrow(ids: bytes, width: int) -> bytes:
    """Unsigned 32-bit ids as ids of ``width`` bytes, all little-endian."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on serialised id arrays; from samples too few or too small for that their own bytes."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Dictionary:
    """A dictionary's bytes with their hash, ready to pack and unpack. Empty bytes: none."""

    def __init__(self, data: bytes):
        self.sha = hashlib.sha256(data).digest()
        self.held = zstandard.ZstdCompressionDict(data) if data else None

    def packer(self) -> zstandard.ZstdCompressor:
        if self.held is not None:
            self.held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=self.held, write_content_size=True, write_dict_id=False)

    def unpacker(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=self.held)


def load_dictionary(fs: pafs.FileSystem, root: str) -> Dictionary:
    with fs.open_input_stream(f"{root}/{DICTIONARY}") as f:
        return Dictionary(f.read())


class TokenFile:
    """Writes one file under a name of its own and renames it when whole, so a retried task leaves one file."""

    def __init__(self, fs: pafs.FileSystem, root: str, name: str, mark: str, width: int, dictionary: Dictionary):
        self.fs, self.name, self.path, self.hidden, self.width = fs, name, f"{root}/{name}", f"{root}/.{name}.{mark}", width
        self.pack, self.out = dictionary.packer(), fs.open_output_stream(self.hidden)
        self.out.write(HEAD.pack(MAGIC, VERSION, width, dictionary.sha))
        self.at, self.ids, self.entries = HEAD.size, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids, unsigned 32-bit."""
        frame = self.pack.compress(narrow(ids, self.width))
        self.out.write(frame)
        self.entries.append((NO_ID if doc_id is None else doc_id, doc_id is not None, self.ids, self.at))
        self.at, self.ids = self.at + len(frame), self.ids + len(ids) // 4

    def close(self) -> tuple[str, int, int]:
        self.out.write(np.array(self.entries, ENTRY).tobytes())
        self.out.write(TAIL.pack(len(self.entries), self.ids, self.at, MAGIC))
        self.out.close()
        self.fs.move(self.hidden, self.path)
        return self.name, len(self.entries), self.ids


class TokenReader:
    """Random access to a file's documents by their place."""

    def __init__(self, fs: pafs.FileSystem, root: str, name: str, dictionary: Dictionary):
        self.f = fs.open_input_file(f"{root}/{name}")
        total = self.f.size()
        magic, version, self.width, sha = HEAD.unpack(self.f.read_at(HEAD.size, 0))
        n, self.ids, self.table, end = TAIL.unpack(self.f.read_at(TAIL.size, total - TAIL.size))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError(f"{name} is no token file of version {VERSION}")
        if sha != dictionary.sha:
            raise ValueError(f"{name} was written with another dictionary")
        self.entries = np.frombuffer(self.f.read_at(n * ENTRY.itemsize, self.table), ENTRY)
        self.unpack = dictionary.unpacker()

    def bounds(self, low: int, high: int) -> tuple[int, int]:
        return int(self.entries["frame"][low]), int(self.entries["frame"][high]) if high < len(self.entries) else self.table

    def ids_of(self, place: int) -> np.ndarray:
        """The ids of one document, read by its offset."""
        start, stop = self.bounds(place, place + 1)
        return self.decoded(self.f.read_at(stop - start, start))

    def decoded(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}").astype("<u4")

    def each(self, low: int, high: int, block: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
        """``(place, ids)`` of a range of documents, the file read in blocks."""
        while low < high:
            first, stop = low, self.bounds(low, low + 1)[0] + block
            low = min(high, max(low + 1, int(np.searchsorted(self.entries["frame"], stop, "right")) - 1))
            start, end = self.bounds(first, low)
            data = memoryview(self.f.read_at(end - start, start))
            for place in range(first, low):
                a, b = self.bounds(place, place + 1)
                yield place, self.decoded(data[a - start : b - start])

    def close(self) -> None:
        self.f.close()


def sample_dictionary(docs: DataFrame, path: str, width: int, most: int = SAMPLE_DOCS) -> bytes:
    """Trained on the documents of least hash, ``most`` of them, each by its first SAMPLE_IDS ids: at most 16 MB come here."""
    picked = docs.select(F.xxhash64("doc_id", F.lit(END)).alias("h")).distinct().orderBy("h").limit(most)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(path).encode
        for batch in batches:
            yield pd.DataFrame({"ids": [narrow(encode(t), width)[: width * SAMPLE_IDS] for t in batch["text"]]})

    drawn = docs.withColumn("h", F.xxhash64("doc_id", F.lit(END))).join(F.broadcast(picked), "h").select("doc_id", "text").dropDuplicates(["doc_id"])
    return train([bytes(r["ids"]) for r in drawn.mapInPandas(some, "ids binary").orderBy("ids").limit(most).collect()])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ``folder``, in ascending order of doc_id over all files.

    Returns ``(file, n_docs, n_ids, start)``, one row a file, ``start`` being the ids of all files before it; written once. Rows are
    dealt by ranges of doc_id and hash of the text, so neither a long nor a repeated id makes a range large; a task streams its
    range into files of about FILE_BYTES. Null ids come first, rows of one id in the order of their texts' hash; null
    texts are empty. ``folder`` is one that all executors share.
    """
    path = path or word_path()
    store, root_path = pafs.FileSystem.from_uri(folder)
    width = 2 if word_encoder(path).size <= 1 << 16 else 4
    store.create_dir(root_path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    with store.open_output_stream(f"{root_path}/{DICTIONARY}") as f:
        f.write(sample_dictionary(rows, path, width))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (fs, root) = TaskContext.get(), pafs.FileSystem.from_uri(folder)
        encode, dictionary, file, done, end = word_encoder(path).encode, load_dictionary(fs, root), None, [], struct.pack("<I", END)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if file is None:
                    file = TokenFile(fs, root, f"part-{task.partitionId():06d}-{len(done):04d}.tokens", str(task.taskAttemptId()), width, dictionary)
                file.add(doc_id, encode(text) + end)
                if file.at >= FILE_BYTES:
                    done.append(file.close())
                    file = None
        if file is not None:
            done.append(file.close())
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "n_docs", "n_ids"])

    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = cut(dealt.mapInArrow(write, "file string, n_docs long, n_ids long"))
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read_tokens(files: DataFrame, folder: str, docs_a_task: int = 20_000) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents in ``files`` (file, n_docs, start), from the files themselves. A task
    reads a range of one file's documents."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        dictionary = load_dictionary(fs, root)
        for batch in batches:
            for name, start, low, high in zip(batch["file"], batch["start"].tolist(), batch["low"].tolist(), batch["high"].tolist(), strict=True):
                file, found = TokenReader(fs, root, name, dictionary), []
                for _, ids in file.each(low, high):
                    found.append((len(ids), zlib.crc32(ids.tobytes())))
                part = file.entries[low:high]
                sizes, sums = zip(*found, strict=True)
                named = pd.Series(part["doc_id"], dtype="Int64").mask(part["known"] == 0)
                yield pd.DataFrame({"doc_id": named, "start": start + part["start"], "n_tokens": sizes, "ids_crc32": sums})
                file.close()

    ranges = files.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(docs_a_task).cast("long"))))
    ranges = cut(ranges.select("file", "start", "low", F.least(F.col("low") + docs_a_task, "n_docs").alias("high")))
    tasks = max(1, ranges.count())
    return ranges.repartition(tasks, "file", "low").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back; the files are removed when the result is safe."""
    folder = new_folder(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents"), folder)
    found = cut(read_tokens(files, folder))
    drop_folder(spark, folder)
    return found
