"""Token ids in directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has
one, and a bitmap that says which of them go on to level k + 1. The place of an id's next chunk is
the number of set bits before it (its rank), which a directory gives for every block of bits; so
any token is read from a few bytes of each level, and nothing else is decoded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import narrow, scratch, slices, width

MAGIC = b"DACTOK01"
BLOCK = 512                 # bits for each entry of a rank directory
FILE_TOKENS = 4_000_000     # tokens after which a file is closed (a longer document has its own)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


# ---------------------------------------------------------------- one segment
def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A segment of the ids of some documents, one after the other."""
    ids = np.ascontiguousarray(ids, np.uint32)
    levels = []
    while True:
        rest = ids >> np.uint32(8)
        more = rest != 0
        bits = np.packbits(more, bitorder="little")
        blocks = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        blocks[:len(bits)] = _ONES[bits]
        counts = blocks.reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        levels.append((ids.astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()))
        ids = rest[more]
        if not len(ids):
            break
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes()]
    for level in levels:
        parts += level
    head = struct.pack("<8sqqq", MAGIC, len(doc_ids), int(np.sum(lengths)), len(levels))
    return head + struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


class Segment:
    """Random access to the tokens of a packed segment."""

    def __init__(self, data: bytes | pa.Buffer):
        view = memoryview(data)
        magic, docs, self.tokens, levels = struct.unpack_from("<8sqqq", view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        sizes = struct.unpack_from(f"<{3 + 3 * levels}q", view, 32)
        at, parts = 32 + 8 * len(sizes), []
        for n in sizes:
            parts.append(view[at:at + n])
            at += n
        if at != len(view):
            raise ValueError("token file is cut off")
        known = np.frombuffer(parts[1], np.uint8)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(parts[0], "<i8"), known, strict=True)]
        self.offsets = np.frombuffer(parts[2], "<i8")
        self.levels = [(np.frombuffer(parts[i], np.uint8), np.frombuffer(parts[i + 1], np.uint8), np.frombuffer(parts[i + 2], "<i8")) for i in range(3, len(parts), 3)]

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, at: int) -> int:
        """Set bits before place ``at``: the directory's entry and the rest of one block."""
        block, byte = at // BLOCK, at >> 3
        ones = int(directory[block]) + int(_ONES[bits[block * (BLOCK // 8):byte]].sum())
        return ones + (int(_ONES[bits[byte] & ((1 << (at & 7)) - 1)]) if at & 7 else 0)

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        value = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * k)
            if not bits[at >> 3] >> (at & 7) & 1:
                return value
            at = self._rank(bits, directory, at)
        return value

    def read(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end, from these places of each level alone."""
        out = np.zeros(max(0, end - start), np.uint32)
        into: np.ndarray | slice = slice(None)
        for k, (chunks, bits, directory) in enumerate(self.levels):
            if start >= end:
                break
            part = chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            out[into] |= part
            more = np.unpackbits(bits[start >> 3:(end + 7) >> 3], bitorder="little")[start & 7:(start & 7) + end - start].view(bool)
            place = np.flatnonzero(more)
            into = place if isinstance(into, slice) else into[place]
            start = self._rank(bits, directory, start)
            end = start + len(place)
        return out

    def document(self, n: int) -> np.ndarray:
        return self.read(int(self.offsets[n]), int(self.offsets[n + 1]))


# ---------------------------------------------------------------- encoding
#: Fixed value: the bytes that start every combining mark which may merge with an ASCII letter (U+0300 to U+033F).
_MARKS = b"\xcc"


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file whose normaliser and splitter never join what
    white space separates, so that a text's ids are its words' ids in a row. The library encodes
    each word once, plain ones many in a call; ``limit`` bounds how many are remembered."""

    def __init__(self, path: str, limit: int = 1_200_000, at_once: int = 64):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit, self.at_once = limit, at_once
        self.known: dict[bytes, bytes] = {}
        self.special = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values()]
        # what the short cuts rest on: else whole texts go to the library
        same = self._ids(["Ab cd\nef", "ab", "cd", "ef", "ab.", "ab .", ",", "."])
        self.by_word = same[0] == same[1] + same[2] + same[3]
        self.any_case = self.by_word and same[4] == same[5] and self._ids(["AB"]) == same[1:2]
        self.stops = {",": np.array(same[6], "<u4").tobytes(), ".": np.array(same[7], "<u4").tobytes()}
        # a word of letters alone is one piece, whose last token alone bears the end mark
        import json

        model = json.loads(self.library.to_str())["model"]
        self.ends, mark = np.zeros(self.library.get_vocab_size(), bool), model.get("end_of_word_suffix")
        if mark:
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(mark)]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        # a full stop or comma after a letter is a piece of its own (a letter that stays one: U+0130
        # and some beyond U+0250 leave a mark behind when normalised)
        stem = {w: w[:-1] if self.any_case and len(w) > 1 and w[-1] in ".," and w[-2].isalpha() and w[-2] < "\u0250" and w[-2] != "\u0130" else w for w in words}
        learn = [w for w in dict.fromkeys(stem.values()) if w.encode() not in self.known]
        plain = [w for w in learn if self.any_case and w.isalpha() and max(w) < "\u0250" and "\u0130" not in w]
        if self.ends.any():
            joined = [" ".join(plain[i:i + self.at_once]) for i in range(0, len(plain), self.at_once)]
            for k, ids in enumerate(self._ids(joined)):
                ids = np.array(ids, "<u4")
                stops, data, start = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes(), 0
                for w, stop in zip(plain[k * self.at_once:(k + 1) * self.at_once], stops, strict=True):
                    self.known[w.encode()] = data[start:stop]
                    start = stop
            learn = list(set(learn).difference(plain))
        for w, ids in zip(learn, self._ids(learn), strict=True):
            self.known[w.encode()] = np.array(ids, "<u4").tobytes()
        for w, s in stem.items():
            if w is not s:
                self.known[w.encode()] = self.known[s.encode()] + self.stops[w[-1]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text (UTF-8) its ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.array(i, "<u4").tobytes() for i in self._ids([t.decode() for t in texts])]
        split, missing, known = [], {}, self.known
        for text in texts:
            low = text.lower()
            if any(s in low for s in self.special):  # its string may be spelled as it is only in one case
                words = text.split()
            elif self.any_case and _MARKS not in text:
                words = low.split()
            else:
                words = text.split()
            split.append(words)
            found = list(map(known.get, words))
            if None in found:
                for w, f in zip(words, found, strict=True):
                    if f is None:
                        missing[w] = None
        if missing:
            self._learn([w.decode() for w in missing])
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > self.limit:
            known.clear()
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    return WordEncoder(path)


# ---------------------------------------------------------------- files
_FILE = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def put(folder: str, name: str, data: bytes) -> str:
    """Write a file under a name of its own, then give it its place: a task that runs again, or
    twice at once, leaves the same file whole."""
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{root}/{name}")
    return f"{folder}/{name}"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write segments in ascending id order to ``folder``.

    Returns the files: (file, part, seq, n_docs, n_tokens), in the order (part, seq). The texts are
    dealt out by range of the id; a row that repeats another is dealt anywhere among its equals.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        parts: list[bytes] = []
        seq = size = 0
        part = -1

        def close() -> pa.RecordBatch:
            nonlocal seq, size
            tokens = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            file = put(folder, f"part-{part:06d}-{seq:06d}.dac", pack(tokens, ids, lengths))
            row = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((file, part, seq, len(ids), len(tokens)), _FILE, strict=True)], schema=_FILE)
            seq, size = seq + 1, 0
            ids.clear()
            parts.clear()
            return row

        for batch in slices(batches, "text"):
            part = batch.column("part")[0].as_py()
            texts = [t if t is not None else b"" for t in batch.column("text").to_pylist()]
            for doc, own in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids.append(doc)
                parts.append(own + end)
                size += len(own) // 4 + 1
                if size >= FILE_TOKENS:
                    yield close()
        if ids:
            yield close()

    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int"))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit(b""))), F.col("salt")]
    dealt = rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(write, "file string, part int, seq int, n_docs long, n_tokens long")


def with_starts(files: DataFrame) -> DataFrame:
    """Add ``start``, the tokens of all files before each (one row for each file)."""
    before = W.partitionBy().orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            system, path = pafs.FileSystem.from_uri(file)
            with system.open_input_file(path) as f:
                segment = Segment(f.read_buffer())
            crc = [zlib.crc32(segment.document(n).astype("<u4")) for n in range(len(segment.doc_ids))]
            yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids, pa.int64()), pa.array(segment.offsets[:-1] + start), pa.array(np.diff(segment.offsets)), pa.array(crc, pa.int64())], schema=_DOC)


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of ``with_starts``."""
    spread = files.select("file", "start").repartition(width(files.sparkSession), "file")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_roundtrip(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids and read them back.

    Null and empty texts have the end id alone. Null ids come first; rows with equal ids follow one
    another. Other columns are ignored; an empty table gives no files and no rows. The files are in
    the shared folder and stay there.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    listed = f"{folder}/files"
    write_tokens(docs, tokenizer, end_id, f"{folder}/data", id_col, text_col).write.parquet(listed)
    files = with_starts(spark.read.schema("file string, part int, seq int, n_docs long, n_tokens long").parquet(listed))
    return read_documents(files)
