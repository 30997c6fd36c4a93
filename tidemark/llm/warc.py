"""WARC archives: writing, normalising monolithic gzip files into a member per record, sidecar indexes, reading back."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, split_join, written

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
LENGTH_HEADER = "X-Payload-Length"
CHUNK = 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def response(identity: str, url: str, payload: bytes, digest: str, date: str) -> bytes:
    return record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", identity), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{digest}"), (LENGTH_HEADER, str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
        ],
        HTTP_HEAD + payload,
    )


def open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder given as URI or plain path; the folder is one that all executors share."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, read once from front to back."""
    engine = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
    if tail := engine.flush():
        yield tail


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an inflated stream; no more than one record is held."""
    buffer = bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while fill(1):
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("a WARC record has no end of headers")
            end = buffer.find(b"\r\n\r\n")
        headers = parse_head(bytes(buffer[:end]))
        size = int(headers["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a WARC record is cut off")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]
        yield headers, block


def record_id(page_id: str, archive: str, ordinal: int) -> str:
    """A record's id: the page and, as rows may repeat a page, the place where it was first written."""
    return f"<{ID_PREFIX}{page_id}:{archive}:{ordinal}>"


def page_of(record_id: str) -> int | None:
    page = record_id[1:-1].removeprefix(ID_PREFIX).split(":", 1)[0]
    return None if page == "null" else int(page)


def as_revisit(headers: dict[str, str], refers_to: str) -> bytes:
    """The record as a revisit of the record of that id, whose payload is the same and whose target and date it names."""
    keep = [(k, v) for k, v in headers.items() if k not in ("WARC-Type", "Content-Length", "Content-Type")]
    target, _, url = refers_to.partition(" ")
    extra = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", target), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", headers.get("WARC-Date", "")), ("Content-Type", "application/http; msgtype=response")]
    return record([("WARC-Type", "revisit"), *keep, *extra], HTTP_HEAD)


def member(data: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def normalise_archive(source: BinaryIO, target: BinaryIO, revisits: dict[int, str], level: int = 1) -> Iterator[tuple[str, int, int]]:
    """Rewrite a gzip WARC of any member layout: (record id, offset, length) of the members written.

    The input is inflated once as a stream; records whose ordinal is in ``revisits`` become revisits of the record
    named there, an id and the target after a blank.
    """
    offset = 0
    for ordinal, (headers, block) in enumerate(records(inflate(source))):
        of = revisits.get(ordinal)
        if of is None:
            kept = [(k, v) for k, v in headers.items() if k != "Content-Length"]
            data = member(record(kept, block), level)
        else:
            data = member(as_revisit(headers, of), level)
        target.write(data)
        yield headers["WARC-Record-ID"], offset, len(data)
        offset += len(data)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2020-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write each input partition's rows as one monolithic gzip stream; returns the written manifest.

    Manifest: archive, ordinal, page_id, url, payload_bytes, payload_digest.  A file gets its final name when it is
    complete, so a retried task replaces it by equal content.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.warc.gz"
        part = f"{base}/{name}.{context.taskAttemptId()}"
        out, engine, ordinal = None, zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for batch in batches:
            rows = []
            for id_, url, html in zip(batch["id"], batch["url"], batch["html"], strict=True):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(part)
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                clean = "".join((url or "").split("\r")).replace("\n", "")
                out.write(engine.compress(response(record_id(id_ if id_ is not None else "null", name, ordinal), clean, payload, digest, date)))
                rows.append((name, ordinal, int(id_) if id_ is not None else None, clean, len(payload), digest))
                ordinal += 1
            frame = pd.DataFrame(rows, columns=["archive", "ordinal", "page_id", "url", "payload_bytes", "payload_digest"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.write(engine.flush())
            out.close()
            system.move(part, f"{base}/{name}")

    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("html"))
    return written(rows.mapInPandas(write, "archive string, ordinal long, page_id long, url string, payload_bytes long, payload_digest string"))


def revisit_plan(manifest: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """(archive, ordinal, refers_to) of the manifest: the record, with its target, that has the same payload first; null for that one itself.

    First is the smallest page_id, null last; of repeated rows of one page the first written.  Payloads under
    ``least_bytes`` never refer.  The first of each payload is an aggregate, and the payloads that very many pages share
    are joined without a shuffle (split_join).
    """
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "archive", "ordinal")
    key = ["payload_digest", "payload_bytes"]
    firsts = manifest.where(F.col("payload_bytes") >= least_bytes).groupBy(*key)
    firsts = firsts.agg(F.min(F.struct(*[order[c].alias(c) for c in ("last", "page_id", "archive", "ordinal")], F.col("url"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = split_join(manifest, written(firsts), key, "n", "left")
    own = (F.col("archive") == F.col("first.archive")) & (F.col("ordinal") == F.col("first.ordinal"))
    page = F.coalesce(F.col("first.page_id").cast("string"), F.lit("null"))
    named = F.concat(F.lit(f"<{ID_PREFIX}"), F.concat_ws(":", page, "first.archive", F.col("first.ordinal").cast("string")), F.lit("> "), F.col("first.url"))
    return joined.select("archive", "ordinal", F.when(F.col("first").isNotNull() & ~own, named).alias("refers_to"))


def normalise(plan: DataFrame, source: str, target: str, *, level: int = 1) -> DataFrame:
    """Normalise the archives named in ``plan`` (archive, ordinal, refers_to); returns the written index.

    One task per archive inflates it once, writes the same records as members of their own to ``target`` and beside
    them a sidecar index ``<archive>.idx`` with lines "record id, offset, length".
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(source)
        _, out_base = open_folder(target)
        attempt = TaskContext.get().taskAttemptId()
        name, revisits = None, {}

        def run() -> pd.DataFrame:
            system.create_dir(out_base, recursive=True)
            part = f"{out_base}/{name}.{attempt}"
            with system.open_input_stream(f"{base}/{name}", compression=None) as src, system.open_output_stream(part, compression=None) as dst:
                found = list(normalise_archive(src, dst, revisits, level))
            with system.open_output_stream(f"{part}.idx") as side:
                side.write("".join(f"{i}\t{o}\t{n}\n" for i, o, n in found).encode())
            system.move(part, f"{out_base}/{name}")
            system.move(f"{part}.idx", f"{out_base}/{name}.idx")
            return pd.DataFrame({"archive": name, "offset": [o for _, o, _ in found], "length": [n for *_, n in found]})

        for batch in batches:
            for archive, ordinal, of in zip(batch["archive"], batch["ordinal"], batch["of"], strict=True):
                if archive != name:
                    if name is not None:
                        yield run()
                    name, revisits = archive, {}
                if of is not None:
                    revisits[int(ordinal)] = of
        if name is not None:
            yield run()

    archives = max(1, plan.select("archive").distinct().count())
    rows = plan.select("archive", "ordinal", F.col("refers_to").alias("of")).repartition(archives, "archive").sortWithinPartitions("archive", "ordinal")
    return written(rows.mapInPandas(rewrite, "archive string, offset long, length long"))


def read_members(index: DataFrame, folder: str) -> DataFrame:
    """Read records by the index, each from its offset: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(batch["archive"], batch["offset"], batch["length"], strict=True):
                if archive != name:
                    name, file = archive, system.open_input_file(f"{base}/{archive}")
                file.seek(int(offset))
                headers, block = next(records(iter([zlib.decompress(file.read(int(length)), 31)])))
                kind = headers["WARC-Type"]
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size, digest, of = len(payload), payload_digest(payload), None
                else:
                    size, digest = int(headers[LENGTH_HEADER]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    of = page_of(headers["WARC-Refers-To"])
                rows.append((page_of(headers["WARC-Record-ID"]), size, digest, kind, of))
            frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = index.repartition(F.col("archive"), F.floor(F.col("offset") / (1 << 23))).sortWithinPartitions("archive", "offset")
    return dealt.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, *, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as monolithic archives, normalise them, and read every record back.

    Null html: an empty payload; null url: an empty target; null page_id: kept, last among equal payloads; if all
    of them are null, the first written is the response and the others are revisits whose refers_to is null; repeated
    rows: one response, the others revisits of it; an empty table: no archive and no row.  A very long html is one record,
    held whole by one task at a time.  Other columns are not read.  The archives and their
    indexes stay in ``folder``/normalised, a new folder of the shared one unless it is given.
    """
    folder = folder or shared_dir(small_batches(pages.sparkSession))
    manifest = write_archives(pages, f"{folder}/monolithic")
    index = normalise(revisit_plan(manifest, least_bytes=least_bytes), f"{folder}/monolithic", f"{folder}/normalised")
    system, base = open_folder(f"{folder}/monolithic")
    if system.get_file_info(base).type != arrow_fs.FileType.NotFound:
        system.delete_dir(base)
    return read_members(index, f"{folder}/normalised")
