"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

An archive is read in ranges. A task lists every place in its range at which a record could begin
(the magic of a record and a whole header with a length), real or inside a payload, and where that
record's successor would begin. Following the links inside the range by pointer jumping, each
candidate gets its exit, the first place beyond the range. Records begin at the start of the
archive and where a record's successor begins, and nowhere else; so the ranges' entries are found
by pointer jumping from the start of the file over the exits, and only the candidates on the chain
from a range's entry are records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, scratch, slices, width, written

RANGE_BYTES = 8 << 20    # of an archive that one task reads
FILE_BYTES = 256 << 20   # after which an archive is closed
MARGIN_BYTES = 1 << 16   # read beyond a range at first; a header that is longer is read on to its end
#: Fixed values of the format.
MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_ID = re.compile(r"<urn:page:(-?\d+|none)>")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing
def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit record, which has no block but names the response."""
    revisit = refers_to is not None
    target = re.sub(r"[\r\n]", " ", uri or "")
    block = b"" if revisit else payload
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + END + block + END


_FILE = pa.schema([("file", pa.string()), ("bytes", pa.int64())])


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages whose payload another page's response holds."""
    digests = written(pages.filter(F.coalesce(F.octet_length("html"), F.lit(0)) >= least).select("page_id", "sha1"), "digests")
    # a row for each payload that several pages have: map-side combined, however many copies
    groups = digests.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and refers_to is not null")
    return digests.join(groups, "sha1").filter("page_id is null or page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each page to archives in ``folder``; returns (file, bytes).

    The table of revisits is written first, so that Spark knows its size and brings it to the pages
    if it is small, and else joins both by page. An archive has the records that one task reads.
    """
    rows = narrow(pages, page_id=id_col, uri=uri_col, html=payload_col)
    rows = rows.select(F.col("page_id").cast("long"), "uri", F.col("html").cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.coalesce("html", F.lit(b""))))
    again = written(revisits(rows, least), "revisits").select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "refers_to")
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["_page"]) & (rows["sha1"] == again["_sha1"]), "left")
    rows = rows.select("page_id", "uri", "html", "refers_to", F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def close() -> pa.RecordBatch:
            out[2].close()
            out[0].move(out[1], out[3])  # whole, or not there: tasks may run again
            return pa.RecordBatch.from_arrays([pa.array([out[4]]), pa.array([out[5]], pa.int64())], schema=_FILE)

        seq = 0
        for batch in slices(batches, "html"):
            for page, uri, html, refers, part in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "html", "refers_to", "part")), strict=True):
                if out is None:
                    system, root = pafs.FileSystem.from_uri(folder)
                    system.create_dir(root, recursive=True)
                    name, own = f"part-{part:06d}-{seq:06d}.warc", f".part-{part:06d}-{uuid.uuid4().hex}"
                    out = [system, f"{root}/{own}", system.open_output_stream(f"{root}/{own}"), f"{root}/{name}", f"{folder}/{name}", 0]
                    seq += 1
                payload = html or b""
                data = record(page, uri, payload, sha1_base32(payload), refers)
                out[2].write(data)
                out[5] += len(data)
                if out[5] >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.mapInArrow(write, "file string, bytes long")


# ---------------------------------------------------------------- reading
def header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header that begins at ``at``, and where its block begins; None if there is none.
    Raises EOFError if the data ends before that is known."""
    if not data.startswith(MAGIC, at):
        return None
    fields, line = {}, at + len(MAGIC)
    while (stop := data.find(b"\r\n", line)) != line:
        if stop < 0:
            raise EOFError
        name, colon, value = data[line:stop].partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace").strip()
        line = stop + 2
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        return None
    return fields, line + 2


def candidates(data: bytes, start: int, end: int, size: int, read: Callable[[int, int], bytes]) -> list[tuple[int, int, dict[str, str], int, int]]:
    """Of the range [start, end) of a file of ``size`` bytes, of which ``data`` begins at ``start``:
    (place, successor, fields, block's place, its length). ``read(bytes, place)`` gets what a header
    has beyond the data, however long it is."""
    found = []
    at = data.find(MAGIC, 0)
    while 0 <= at < end - start:
        try:
            parsed = header(data, at)
        except EOFError:
            have = start + len(data)
            if have < size:
                data += read(min(max(MARGIN_BYTES, have - end), size - have), have)
                continue
            parsed = None
        if parsed:
            fields, block = parsed
            length = int(fields["content-length"])
            successor = start + block + length + len(END)
            if successor <= size:
                found.append((start + at, successor, fields, start + block, length))
        at = data.find(MAGIC, at + 1)
    return found


def jump(places: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """Exit of each candidate: the first place from ``end`` on that its chain leads to, or -1 if the
    chain breaks before. Pointers double their reach until none stays inside."""
    target = np.searchsorted(places, successors)
    target = np.minimum(target, len(places) - 1)
    inside = successors < end
    broken = inside & (places[target] != successors)
    exit_ = np.where(broken, -1, successors)
    step = np.where(inside & ~broken, target, np.arange(len(places)))
    while True:
        reached = exit_[step]
        further = step[step]
        if (further == step).all():
            return reached
        step = further


_CANDIDATES = pa.schema([("file", pa.string()), ("range", pa.int64()), ("place", pa.int64()), ("successor", pa.int64()), ("exit", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()),
                         ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("uri", pa.string()), ("sound", pa.bool_())])


def _page(text: str | None) -> int | None:
    m = _ID.fullmatch(text or "")
    return int(m[1]) if m and m[1] != "none" else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, number, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("file", "range", "start", "end", "bytes")), strict=True):
            system, path = pafs.FileSystem.from_uri(file)
            with system.open_input_file(path) as f:
                data = f.read_at(min(end + MARGIN_BYTES, size) - start, start)
                found = candidates(data, start, end, size, f.read_at)
                if not found:
                    continue
                place, successor = (np.array([c[k] for c in found], np.int64) for k in (0, 1))
                rows = []
                for _, _, fields, block, length in found:
                    digest, kind = fields.get("warc-payload-digest", ""), fields.get("warc-type", "")
                    sound = True
                    if kind == "response":  # the block is checked against the digest
                        inside = block + length <= start + len(data)
                        payload = data[block - start:block - start + length] if inside else f.read_at(length, block)
                        sound = digest == "sha1:" + sha1_base32(payload)
                    full = fields.get("x-payload-length", "")
                    rows.append((_page(fields.get("warc-record-id")), kind, digest.removeprefix("sha1:"), length if kind == "response" else int(full) if full.isdigit() else None, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), sound))
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([number] * len(rows), pa.int64()), pa.array(place), pa.array(successor), pa.array(jump(place, successor, end)),
                                              *(pa.array([r[k] for r in rows], _CANDIDATES.field(5 + k).type) for k in range(7))], schema=_CANDIDATES)


def entries(candidates: DataFrame) -> DataFrame:
    """(file, place) at which the chain from the start of each file enters a range: pointer jumping
    over candidates and exits, whose rounds grow as the logarithm of a file's ranges."""
    jumps = written(candidates.select("file", "place", F.col("exit").alias("to")).filter("exit >= 0"), "jumps")
    reached = written(jumps.select("file").distinct().withColumn("place", F.lit(0).cast("long")), "reached")
    while True:
        # all that is reached goes as far as the pointers reach, and the pointers double their reach
        new = reached.join(jumps, ["file", "place"]).select("file", F.col("to").alias("place"))
        more = written(reached.union(new).distinct(), "reached")
        ahead = jumps.select("file", F.col("place").alias("to"), F.col("to").alias("_next"))
        jumps = written(jumps.join(ahead, ["file", "to"]).select("file", "place", F.col("_next").alias("to")), "jumps")
        reached = more
        if not jumps.head(1):
            return reached


def _on_chain(group: pa.Table) -> pa.Table:
    """Records of one range of a file: the candidates on the chain from the range's entry."""
    group = group.sort_by("place")
    place, successor = group.column("place").to_numpy(), group.column("successor").to_numpy()
    entry = group.column("entry").to_numpy()[0]
    keep, at = np.zeros(len(place), bool), int(np.searchsorted(place, entry))
    while at < len(place) and place[at] == entry:
        keep[at] = True
        entry = successor[at]
        at = int(np.searchsorted(place, entry))
    return group.select(_RECORD).filter(pa.array(keep))


_RECORD = ["file", "place", "page_id", "kind", "digest", "payload_bytes", "refers_to", "uri", "sound"]


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives (file, bytes): (file, place, page_id, kind, digest, payload_bytes,
    refers_to, uri, sound: whether a response's block has the digest that its header names).
    An archive whose chain of records does not reach its last byte is an error."""
    spark = files.sparkSession
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("bytes", F.lit(1)) - 1) / range_bytes))).alias("range"))
    ranges = ranges.withColumn("start", F.col("range") * range_bytes).withColumn("end", F.least("bytes", F.col("start") + range_bytes)).repartition(width(spark), "file", "range")
    found = written(ranges.mapInArrow(_scan, "file string, range long, place long, successor long, exit long, page_id long, kind string, digest string, payload_bytes long, refers_to long, uri string, sound boolean"), "candidates")
    reached = entries(found)
    for broken in files.filter("bytes > 0").join(reached.withColumnRenamed("place", "bytes"), ["file", "bytes"], "left_anti").head(1):
        raise RuntimeError(f"{broken['file']}: the records' chain ends before the last of its {broken['bytes']} bytes")
    entry = reached.withColumn("range", F.floor(F.col("place") / range_bytes)).groupBy("file", "range").agg(F.min("place").alias("entry"))
    return found.join(entry, ["file", "range"]).groupBy("file", "range").applyInArrow(
        _on_chain, "file string, place long, page_id long, kind string, digest string, payload_bytes long, refers_to long, uri string, sound boolean")


def archive_roundtrip(pages: DataFrame, least: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages and read the archives back: (page_id, payload_bytes, payload_digest,
    record_type, refers_to, target_uri, sound).

    Of pages with equal payloads of ``least`` bytes or more, the one with the largest id is written
    as response, the others revisit it. Null and empty payloads are payloads of 0 bytes; line ends
    inside a URI become spaces. Pages with a null id have null ids and, with an equal payload of a
    page with an id, revisit that; among themselves all are responses. Rows that repeat the
    response's id and payload are responses too. Other columns are ignored; an empty table gives
    no rows. The archives stay in the shared folder.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archives(pages, f"{folder}/data", least, id_col, uri_col, payload_col).write.parquet(f"{folder}/files")
    files = spark.read.schema("file string, bytes long").parquet(f"{folder}/files")
    return read_archives(files).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", F.col("uri").alias("target_uri"), "sound")
