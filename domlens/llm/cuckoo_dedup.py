"""Exact duplicates through a bucketed cuckoo-filter index of live digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, width, written

SLOTS = 4           # entries of a filter bucket
MAX_KICKS = 200     # moves before an insertion counts as overflow
BUCKET_KEYS = 50_000  # digests that one index bucket is meant to hold
FLUSH = 50_000      # digests that a task combines before it passes them on


class CuckooIndex:
    """Cuckoo filter whose slots also hold the full key and its entry.

    A lookup compares 16-bit fingerprints in two buckets and verifies every hit against the stored
    key, so that fingerprints that are equal by chance do no harm. An insertion that finds no slot
    after ``MAX_KICKS`` moves doubles the table, which is filled again from the stored keys.
    """

    def __init__(self, buckets: int = 16):
        self._clear(buckets)
        self.resizes = 0

    def _clear(self, buckets: int) -> None:
        self.buckets, self.used = buckets, 0
        self.prints = [0] * (buckets * SLOTS)
        self.entries: list = [None] * (buckets * SLOTS)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[-2:], "little") or 1
        first = int.from_bytes(key[-10:-2], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 + 1) & (self.buckets - 1))

    def find(self, key: bytes) -> int:
        mark, first, second = self._place(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.entries[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self.find(key)
        return None if slot < 0 else self.entries[slot]

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        self.prints[slot], self.entries[slot] = 0, None
        self.used -= 1
        return True

    def insert(self, entry: tuple) -> None:
        """``entry`` begins with its key, which must not be in the index."""
        if self.used >= self.buckets * SLOTS * 0.94:
            self._resize()
        while (entry := self._put(entry)) is not None:
            self._resize()

    def _put(self, entry: tuple):
        """None, or the entry that is left without a slot."""
        mark, first, second = self._place(entry[0])
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    self.used += 1
                    return None
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            (mark, entry), (self.prints[slot], self.entries[slot]) = (self.prints[slot], self.entries[slot]), (mark, entry)
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    self.used += 1
                    return None
        return entry

    def _resize(self) -> None:
        kept = [e for e in self.entries if e is not None]
        self.resizes += 1
        size = self.buckets
        while True:
            size *= 2
            self._clear(size)
            if all(self._put(e) is None for e in kept):
                return

    def __iter__(self):
        return (e for e in self.entries if e is not None)

    def __len__(self) -> int:
        return self.used


def digest(text: str | None) -> bytes:
    """SHA-256 of the text in UTF-8 with A-Z in lower case; null counts as empty."""
    return hashlib.sha256((text or "").encode().lower()).digest()


_ROWS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
_CHANGES = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("gone", pa.bool_())])
_INDEX = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([digest(t) for t in batch.column("text").to_pylist()], pa.binary())], schema=_ROWS)


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row."""
    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(_digests, "doc_id long, digest binary")


def insertions(rows: DataFrame, buckets: int) -> DataFrame:
    """Changes that insert ``rows`` (doc_id, digest): a task combines what it reads of a digest, so
    that copies without number reach the index as one change from each task."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(k[:4], "big") % buckets for k in keys], pa.int32()), pa.array(keys, pa.binary()),
                pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([False] * len(keys), pa.bool_())], schema=_CHANGES)

        for batch in batches:
            for doc, key in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if (have := found.get(key)) is None:
                    found[key] = [doc, 1]
                else:
                    have[1] += 1
                    if have[0] is None or doc is not None and doc > have[0]:
                        have[0] = doc
            if len(found) >= FLUSH:
                yield flush()
                found.clear()
        if found:
            yield flush()

    return rows.mapInArrow(combine, "bucket int, digest binary, doc_id long, n long, gone boolean")


def removals(digests: DataFrame, buckets: int) -> DataFrame:
    """Changes that delete live digests (column ``digest``) from the index."""
    return digests.select(F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket"), "digest",
                          F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("gone"))


def _maintain(group: pa.Table) -> pa.Table:
    index = CuckooIndex()
    changes = list(zip(*(group.column(c).to_pylist() for c in ("digest", "doc_id", "n", "gone")), strict=True))
    for key, doc, n, gone in sorted(changes, key=lambda c: c[3]):  # insertions, then deletions
        live = index.get(key)
        if gone:
            index.delete(key)
        elif live is None:
            index.insert((key, doc, n))
        else:  # the newer document takes the place of the live one
            index.delete(key)
            index.insert((key, live[1] if doc is None or live[1] is not None and live[1] >= doc else doc, live[2] + n))
    entries = list(index)
    return pa.Table.from_arrays([pa.array([e[i] for e in entries], t.type) for i, t in enumerate(_INDEX)], schema=_INDEX)


def maintain(changes: DataFrame) -> DataFrame:
    """Apply changes (see ``insertions`` and ``removals``): one cuckoo index for each bucket of
    digests. Returns (digest, keep_id, group_size) of the live digests."""
    return changes.groupBy("bucket").applyInArrow(_maintain, "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical after lower-casing A-Z only (null counts as empty). Of
    equal texts the row with the largest id stays; null ids are smaller than any other (a group of
    null ids alone has ``keep_id`` null and all its rows kept). Rows that repeat
    the kept id with an equal text are all marked kept, as nothing tells them apart. Other columns
    are ignored; an empty table gives no rows.

    The digests (never the texts) are dealt to index buckets, whose number grows with the rows.
    """
    rows = written(text_digests(docs, id_col, text_col), "digests")
    buckets = max(width(docs.sparkSession), -(-rows.count() // BUCKET_KEYS))
    index = maintain(insertions(rows, buckets))
    return rows.join(index, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
