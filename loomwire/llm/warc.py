"""Operator 9, WARC: records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding some whole WARC records, closed by a seek table
in a skippable frame (the public seekable format). The index maps a record to its bundle, its frame and its offset in
the frame's content, so that one record costs one ranged read and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwire.llm.columns import sized, table
from loomwire.session import cut, drop_folder, new_folder

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 1 << 28, 3
#: Frames that a task reads back.
FRAMES_READ = 8
# The seekable format's numbers and the WARC profile of a repeated payload.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "bundle string, page_id long, copy int, frame int, frame_start long, frame_size long, frame_content long, offset long, length long"
RECORDS = "page_id long, copy int, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{copy}>"


def page_of(urn: str) -> tuple[int | None, int]:
    page, copy = urn.strip("<>").split(":")[2:]
    return None if page == "none" else int(page), int(copy)


def encode_record(page_id: int | None, copy: int, uri: str | None, payload: bytes, digest: str, first: tuple[int | None, int] | None, date: str) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit of ``first`` with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"WARC-Refers-To: {record_id(*first)}", f"WARC-Profile: {PROFILE}"]
    block = http if first is not None else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` as a dict of RECORDS' columns, and where the next begins. A payload whose digest is not the
    one in its header is an error."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    block = data[end + 4 : stop]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or sha1_32(payload) != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not fit its digest")
    page, copy = page_of(head["WARC-Record-ID"])
    return {
        "page_id": page, "copy": copy, "uri": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
        "refers_to": page_of(head["WARC-Refers-To"])[0] if revisit else None, "payload_bytes": size, "payload_digest": digest,
        "payload": None if revisit else payload,
    }, stop + 4


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Bundle:
    """Writes one bundle file under a name of its own and renames it when whole, so a retried task leaves one file."""

    def __init__(self, folder: str, name: str, mark: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.name, self.path, self.hidden = name, f"{self.root}/{name}", f"{self.root}/.{name}.{mark}"
        self.out, self.pack = self.fs.open_output_stream(self.hidden), zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.sizes, self.at, self.held, self.waiting, self.rows = [], 0, 0, [], []

    def add(self, page_id, copy, record: bytes) -> None:
        self.rows.append((self.name, page_id, copy, len(self.sizes), self.at, 0, 0, self.held, len(record)))
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if not self.waiting:
            return
        frame = self.pack.compress(b"".join(self.waiting))
        self.out.write(frame)
        n = len(self.waiting)
        self.rows[-n:] = [(*r[:5], len(frame), self.held, *r[7:]) for r in self.rows[-n:]]
        self.sizes.append((len(frame), self.held))
        self.at, self.held, self.waiting = self.at + len(frame), 0, []

    def close(self) -> list[tuple]:
        """The index rows of the bundle, once its seek table is written."""
        self.close_frame()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.fs.move(self.hidden, self.path)
        return self.rows


def seek_table(fs: pafs.FileSystem, path: str) -> list[tuple[int, int, int]]:
    """``(start, size, content size)`` of a bundle's frames, read from its end."""
    with fs.open_input_file(path) as f:
        total = f.size()
        f.seek(total - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{path} has no seek table")
        f.seek(total - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", f.read(8 * n)))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``records`` (page_id, copy, uri, payload, digest, first_page, first_copy) to bundles in ``folder``.

    Returns the index, one row per record, computed once: writing happens here and not when the index is read. Each
    partition streams its rows into bundles of about BUNDLE_BYTES of content; ``folder`` must be one that all
    executors share, by a URI that pyarrow's file systems open.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, mark, bundle, number, content = task.partitionId(), task.taskAttemptId(), None, 0, 0
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "copy", "uri", "payload", "digest", "first_page", "first_copy")]
            for page, copy, uri, payload, digest, first_page, first_copy in zip(*columns, strict=True):
                if bundle is None:
                    bundle, number, content = Bundle(folder, f"part-{part:06d}-{number:04d}.warc.zst", str(mark)), number + 1, 0
                first = None if first_copy is None else (first_page, first_copy)
                data = encode_record(page, copy, uri, payload, digest, first, date)
                bundle.add(page, copy, data)
                content += len(data)
                if content >= BUNDLE_BYTES:
                    yield rows(bundle.close())
                    bundle = None
        if bundle is not None:
            yield rows(bundle.close())

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return cut(records.mapInArrow(write, INDEX))


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names (all or a selection), one row each, frame by frame. A task reads about FRAMES_READ
    frames: the index is small beside what it points to, so its own size must not decide on the tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, start, size, offsets in zip(batch["bundle"], batch["frame_start"], batch["frame_size"], batch["offsets"], strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(int(start))
                    data = unpack.decompress(f.read(int(size)))
                found = pd.DataFrame([decode_record(data, int(at))[0] for at in offsets])
                found["refers_to"] = found["refers_to"].astype("Int64")
                found["page_id"] = found["page_id"].astype("Int64")
                yield found if payloads else found.assign(payload=None)

    tasks = -(-index.select("bundle", "frame_start").distinct().count() // FRAMES_READ)
    dealt = index.repartition(max(1, tasks), "bundle", "frame_start")
    frames = dealt.groupBy("bundle", "frame_start", "frame_size").agg(F.collect_list("offset").alias("offsets"))
    return frames.mapInPandas(read, RECORDS)


def archive_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as records for :func:`write_bundles`.

    Of rows with equal payloads of at least ``least`` bytes the first by page_id (null last) is the response and the
    others revisit it; a row that repeats id and payload is a further copy. Null html is an empty payload. Only ids and
    digests are shuffled to find the roles; the payloads stay where they are while the revisits are few enough to
    broadcast (counted), and are joined by shuffle beyond that.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    copies = cut(rows.select("page_id", "sha", F.octet_length("payload").alias("size")).groupBy("page_id", "sha", "size").agg(F.count("*").alias("n")))
    groups = copies.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first_page"), F.count("*").alias("ids"), F.sum("n").alias("all"))
    shared = groups.filter("all > 1").drop("ids", "all")
    roles = cut(copies.join(shared, ["sha", "size"]).select("page_id", "sha", "n", "first_page").filter("n > 1 OR NOT page_id <=> first_page"))
    count, repeated = roles.agg(F.count("*"), F.count(F.when(F.col("n") > 1, 1))).first()
    mine = roles.select(F.col("page_id").alias("_p"), F.col("sha").alias("_s"), "n", "first_page")
    on = rows["page_id"].eqNullSafe(mine["_p"]) & (rows["sha"] == mine["_s"])
    once = rows.join(sized(mine, count), on, "left").filter("n IS NULL OR n = 1").withColumn("copy", F.lit(0))
    every = once
    if repeated:
        some = mine.filter("n > 1")
        more = rows.join(sized(some, repeated), rows["page_id"].eqNullSafe(some["_p"]) & (rows["sha"] == some["_s"])).dropDuplicates(["page_id", "sha"])
        every = once.unionByName(more.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))))
    revisits = F.col("n").isNotNull() & ~((F.col("copy") == 0) & F.col("page_id").eqNullSafe(F.col("first_page")))
    return every.select(
        "page_id", "copy", "uri", "payload", base32("sha").alias("digest"),
        F.when(revisits, F.col("first_page")).alias("first_page"), F.when(revisits, F.lit(0)).alias("first_copy"),
    )


def base32(sha: str):
    """Forty hex digits as thirty-two base-32 digits: five hex digits are four of the others."""
    part = lambda i: F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to bundles and read back; the bundles are removed when the result is safe."""
    folder = new_folder(spark, "warc")
    index = write_bundles(archive_records(table(spark, sf_dir, "pages")), folder)
    read = cut(read_bundles(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    drop_folder(spark, folder)
    return read


OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first_page FROM h),
k AS (SELECT page_id, list_transform(range(0, 40, 5), lambda i: ('0x' || x[i+1:i+5])::BIGINT) AS parts FROM f),
d AS (SELECT page_id, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31)::INT + 1]), '')), '') AS payload_digest FROM k)
SELECT f.page_id, payload_bytes, payload_digest, CASE WHEN f.page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.page_id <> first_page THEN first_page END AS refers_to
FROM f JOIN d USING (page_id)
"""
