"""SentencePiece encoding with source alignment, and decoding.

A text is normalised here: at each place the longest prefix that the model's compiled character map
knows is replaced, and every normalised byte records the byte of the text that it stems from. The
library, with its own normaliser turned off, segments the result; the cumulative lengths of the
pieces, looked up in the alignment, are their spans in the text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, narrow, release, slices

SPACE = "▁".encode()  # fixed value: the library's mark for a space


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys (longest prefix wins) and the
    zero-terminated replacements that its leaves point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of text[at:] and its replacement."""
        best, node = None, 0
        node ^= self._offset(self.units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                best = k + 1 - at, self.texts[value:self.texts.index(b"\0", value)]
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


def compile_map(rules: dict[bytes, bytes]) -> bytes:
    """A compiled character map for ``rules`` (the counterpart of ``CharacterMap``)."""
    texts, places = b"", {}
    for new in rules.values():
        if new not in places:
            places[new] = len(texts)
            texts += new + b"\0"
    tree: dict = {}
    for key, new in rules.items():
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[-1] = places[new]
    units: dict[int, int] = {0: 0}

    def place(node: dict, at: int) -> None:
        labels = [max(k, 0) for k in node]
        base = 1
        while any(at ^ base ^ b in units for b in labels):
            base += 1
        inner = at ^ base
        units[at] = units[at] | base << 10 | (0x100 if -1 in node else 0)
        for k in sorted(node):
            if k < 0:
                units[inner] = node[k] | 0x80000000
            else:
                units[inner ^ k] = k
        for k, child in sorted(node.items(), key=lambda x: x[0]):
            if k >= 0:
                place(child, inner ^ k)

    place(tree, 0)
    size = -(-(max(units) + 256) // 256) * 256
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + texts


class PieceCodec:
    def __init__(self, model: str | bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        proto = pb.ModelProto.FromString(model)
        kinds = pb.ModelProto.SentencePiece
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces or white space as suffix aren't supported")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.library = SentencePieceProcessor(model_proto=model)
        plain = pb.ModelProto.FromString(model)
        own = plain.normalizer_spec
        own.name, own.precompiled_charsmap = "identity", b""
        own.add_dummy_prefix = own.remove_extra_whitespaces = own.escape_whitespaces = False
        self.segmenter = SentencePieceProcessor(model_proto=plain.SerializeToString())
        #: Bytes of normalised text that a piece stands for; -1 where that depends on the text.
        self.sizes = np.array([1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.decimal = [str(i) for i in range(len(proto.pieces))]

    # ------------------------------------------------------------ normalisation
    def normalise(self, text: bytes) -> tuple[bytes, Callable[[np.ndarray], np.ndarray]]:
        """The normalised text and its alignment, which gives for places in it (its bytes and its
        end) the places in ``text`` that they stem from (never falling). Empty texts stay empty."""
        if not text:
            return b"", np.zeros(1, np.int64).__getitem__
        space = SPACE if self.escape else b" "
        if self.map is None and not self.squeeze:
            head = space if self.dummy else b""
            ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20) + 1  # of the spaces, the only bytes that grow
            grown = ends + len(head) + (len(space) - 1) * np.arange(1, len(ends) + 1)

            def origin(places: np.ndarray) -> np.ndarray:
                passed = np.searchsorted(grown, places, "right")
                before = np.append(0, ends)[passed]  # a place inside a grown space stems from the space
                last = np.append(len(head), grown)[passed]
                upper = np.append(ends - 1, len(text))[passed]
                return np.maximum(np.minimum(before + places - last, upper), 0)

            return head + (text.replace(b" ", space) if self.escape else text), origin
        out, origin, at, end = bytearray(), [], 0, len(text)
        steps = []
        while at < end:
            known = self.map.longest(text, at) if self.map else None
            size, new = known or (min(_char(text[at]), end - at), text[at:at + min(_char(text[at]), end - at)])
            steps.append((at, size, new))
            at += size
        if self.squeeze:
            while steps and not steps[0][2].strip(b" "):
                steps.pop(0)
        if not steps:
            return b"", np.zeros(1, np.int64).__getitem__
        if self.dummy:
            out += space
            origin += [steps[0][0]] * len(space)
        after_space = self.squeeze
        for at, _size, new in steps:
            if after_space:
                new = new.lstrip(b" ")
            if not new:
                continue
            wide = new.replace(b" ", space)
            out += wide
            origin += [at] * len(wide)
            after_space = self.squeeze and new.endswith(b" ")
        last = steps[-1][0] + steps[-1][1]
        if self.squeeze:
            while out.endswith(space):
                last = origin[len(out) - len(space)]
                del out[len(out) - len(space):]
                del origin[len(out):]
        return bytes(out), np.array([*origin, last], np.int64).__getitem__

    # ------------------------------------------------------------ pieces
    def encode(self, texts: list[bytes]) -> list[tuple[list[int], np.ndarray]]:
        """For each text its ids and the places in the text where the pieces start, and its end:
        piece k is text[bounds[k]:bounds[k + 1]]."""
        normal = [self.normalise(t) for t in texts]
        found = self.segmenter.encode([n.decode(errors="replace") for n, _ in normal], num_threads=1)
        out = []
        for (norm, origin), ids in zip(normal, found, strict=True):
            size = self.sizes[ids] if ids else np.zeros(0, np.int64)
            if (size < 0).any():
                pieces = self.segmenter.encode(norm.decode(errors="replace"), out_type="immutable_proto").pieces
                size = np.array([len(p.surface.encode()) for p in pieces], np.int64)
            out.append((ids, origin(np.concatenate([[0], np.cumsum(size)]))))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _char(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


@lru_cache(maxsize=2)
def _codec(path: str) -> PieceCodec:
    return PieceCodec(path)


# ---------------------------------------------------------------- on tables
_SHAPES = {
    "pieces": pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string())]),
    "compact": pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("first", pa.int64()), ("sizes", pa.list_(pa.int32())), ("decoded", pa.string())]),
    "ids": pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]),
    "digests": pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("covered", pa.int64())]),
}
_DDL = {
    "pieces": "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string",
    "compact": "doc_id long, n_tokens long, ids array<int>, first long, sizes array<int>, decoded string",
    "ids": "doc_id long, n_tokens long, ids array<int>",
    "digests": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered long",
}


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, model: str, output: str = "pieces", id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document, by ``output``:

    * pieces: (doc_id, ids, starts, ends, decoded), where starts[k] to ends[k] are the UTF-8 bytes of
      the text that piece k stands for;
    * compact: (doc_id, n_tokens, ids, first, sizes, decoded), the same with less to store: the first
      piece starts at byte ``first``, each other where the one before it ends, and sizes has their bytes;
    * ids: (doc_id, n_tokens, ids);
    * digests: (doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256,
      covered: bytes of the text inside spans).

    A character that the model spells in bytes has a span for each byte. Null and empty texts have
    no ids and decode to the empty text. Repeated rows each have their own row; other columns are
    ignored; nothing is shuffled and each task holds ``slice_bytes`` of texts (or one longer text).
    An empty table gives no rows.
    """
    shape = _SHAPES[output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in slices(batches, "text", slice_bytes):
            found = codec.encode([t or b"" for t in batch.column("text").to_pylist()])
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": [len(ids) for ids, _ in found]}
            if output != "digests":
                columns["ids"] = [np.array(ids, np.int32) for ids, _ in found]
            if output == "pieces":
                columns |= {"starts": [b[:-1] for _, b in found], "ends": [b[1:] for _, b in found]}
            if output == "compact":
                columns |= {"first": [int(b[0]) for _, b in found], "sizes": [np.diff(b).astype(np.int32) for _, b in found]}
            if output != "ids":
                decoded = [codec.decode(ids) if ids else "" for ids, _ in found]
                columns |= {"decoded": decoded} if output != "digests" else {
                    "ids_sha256": [_sha256(",".join([codec.decimal[i] for i in ids])) for ids, _ in found],
                    "decoded_sha256": [_sha256(t) for t in decoded], "covered": [int(b[-1] - b[0]) for _, b in found]}
            yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in shape], schema=shape)
        release()

    rows = narrow(docs, doc_id=id_col, text=text_col)
    rows = rows.select(rows["doc_id"].cast("long"), rows["text"].cast("binary").alias("text"))
    return rows.mapInArrow(run, _DDL[output])
