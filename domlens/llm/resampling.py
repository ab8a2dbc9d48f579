"""Importance resampling towards a target distribution; ranks by a distributed radix sort."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_batch, narrow, slices, utf8, written
from .words import LOWER

BUCKETS = 10_000
PERCENT = 25
MIN_WORDS = 20
SEED = 7
DIGIT_BITS = 11          # of one counting-sort pass: 2,048 digits
CHUNK_ROWS = 1 << 17     # rows of one part of a pass: what a task ranks at once
LONG_WORD = 64           # bytes; longer words are hashed one by one

#: Word bytes are 0-9, a-z and all of code points beyond ASCII (after lower-casing A-Z).
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ---------------------------------------------------------------- checksums of many words at once
@cache
def _one_byte() -> np.ndarray:
    """What each value of the lowest byte adds when a zero byte follows (the reflected CRC-32 polynomial)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


@cache
def _shifts() -> np.ndarray:
    """[length, byte, value]: checksum of a run followed by ``length`` zero bytes, byte by byte of the checksum."""
    table = _one_byte()
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    out = [now]
    for _ in range(LONG_WORD):
        now = table[now & np.uint32(255)] ^ (now >> np.uint32(8))
        out.append(now)
    return np.stack(out)


def _run_checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each run: byte k of all runs that have one, k = 0, 1, ... up to LONG_WORD."""
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero(sizes <= LONG_WORD)
    short = short[np.argsort(sizes[short], kind="stable")]
    size, at, table = sizes[short], starts[short], _one_byte()
    now = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[-1]) if len(size) else 0):
        first = np.searchsorted(size, k, "right")  # runs from here on have a byte k
        part = now[first:]
        now[first:] = table[(part ^ data[at[first:] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[short] = now ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = zlib.crc32(data[starts[i]:starts[i] + sizes[i]].tobytes())
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Checksums of all features of a batch of texts (single words, then pairs joined by a space), the
    text each belongs to, and the words of each text."""
    texts = len(offsets) - 1
    data = LOWER[data]
    first = INSIDE[data]
    inside = first.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts[cuts > 0] - 1] |= inside[cuts[cuts > 0] - 1]
    sizes = np.flatnonzero(last) + 1 - starts
    of = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(of, minlength=texts)
    single = _run_checksums(data, starts, sizes)
    left = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
    a, b, n = single[left], single[left + 1], sizes[left + 1]
    table = _one_byte()
    a = zlib.crc32(b" ") ^ table[a & np.uint32(255)] ^ (a >> np.uint32(8))  # of the left word and a space
    short, shifts = np.minimum(n, LONG_WORD), _shifts()
    pair = b.copy()
    for k in range(4):
        pair ^= shifts[short, k, (a >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(n > LONG_WORD):
        w = left[i] + 1
        pair[i] = zlib.crc32(data[starts[w]:starts[w] + sizes[w]].tobytes(), int(a[i]))
    return np.concatenate([single, pair]), np.concatenate([of, of[left]]), words


# ---------------------------------------------------------------- features and weights
def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; each task sends a row for each bucket at most."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(features(*utf8(batch.column("text")))[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield as_batch(schema, used.astype(np.int32), total[used])

    found = narrow(texts, text=text_col).filter("text is not null").mapInArrow(count, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, doc_text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 * ln of target share over corpus share), each count
    raised by one."""
    s = bucket_counts(docs, doc_text, buckets).select("bucket", F.col("n").alias("s"))
    t = bucket_counts(target, target_text, buckets).select("bucket", F.col("n").alias("t"))
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    all_ = W.partitionBy()  # over ``buckets`` rows
    both = both.withColumns({"all_s": F.sum("s").over(all_), "all_t": F.sum("t").over(all_)})
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    share = ((t + 1.0) * (all_s + float(buckets))) / ((s + 1.0) * (all_t + float(buckets)))
    return both.select("bucket", F.floor(F.log(share) * 1000.0).cast("long").alias("gain"))


def _weigh(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sums, of, words = features(*utf8(batch.column("text")))
            n = np.bincount(of, minlength=batch.num_rows).astype(np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of, gains[sums % np.uint32(len(gains))])
            yield as_batch(schema, batch.column("doc_id").cast(pa.int64()), words.astype(np.int64), n, np.where(n > 0, total // np.maximum(n, 1), 0))

    return weigh


# ---------------------------------------------------------------- distributed radix sort
def _digits(value: Column, name: str) -> list[tuple[str, Column]]:
    """The digits of a long from the lowest to the highest, in the order of signed numbers."""
    plain = F.coalesce(value, F.lit(0).cast("long")).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    mask = (1 << DIGIT_BITS) - 1
    return [(f"_{name}{k}", F.shiftrightunsigned(plain, k).bitwiseAND(F.lit(mask)).cast("int")) for k in range(0, 64, DIGIT_BITS)]


def radix_ranks(rows: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Add ``row``, the place from 0 of each row in the order of ``keys``: (column, "asc" or "desc")
    pairs of longs, the first one counting most; nulls come last.

    The composite key is cut into digits of DIGIT_BITS, digits that all rows share are left out, and
    the others are passed from the lowest to the highest. A pass is a stable counting sort: rows lie
    in parts of CHUNK_ROWS places; (part, digit) counts give, by prefix sums over all smaller digits
    and over the same digit in earlier parts, the offset of each (part, digit), and a row's
    destination is that offset and its rank inside (part, digit). No task holds more than a part,
    whatever the keys; the prefix sums are over the parts of one digit, and over the digits.

    Rows that agree in all keys keep the order in which they were first written. Columns that begin
    with an underscore are not allowed.
    """
    columns = rows.columns
    digits: list[tuple[str, Column]] = []
    for name, order in reversed(keys):
        value = F.col(name).cast("long")
        digits += _digits(F.bitwise_not(value) if order == "desc" else value, name)
        digits.append((f"_{name}_null", F.col(name).isNull().cast("int")))
    placed = written(rows.withColumns({"_part": F.spark_partition_id().cast("long"), "_at": F.monotonically_increasing_id()}), "radix")
    ends = placed.agg(*[F.max(c).alias(f"{n}_most") for n, c in digits], *[F.min(c).alias(f"{n}_least") for n, c in digits]).first()  # one row
    for name, digit in digits:
        if ends[f"{name}_most"] == ends[f"{name}_least"]:
            continue
        now = placed.withColumn("_digit", digit)
        counts = written(now.groupBy("_digit", "_part").agg(F.count(F.lit(1)).alias("_n")), "radix_counts")
        all_ = counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))
        base = all_.select(F.col("_digit").alias("_d"), (F.sum("_n").over(W.orderBy("_digit")) - F.col("_n")).alias("_base"))  # a row for each digit
        earlier = F.sum("_n").over(W.partitionBy("_digit").orderBy("_part")) - F.col("_n")
        offset = counts.withColumn("_earlier", earlier).join(base, F.col("_digit") == F.col("_d")).select(
            F.col("_digit").alias("_d"), F.col("_part").alias("_p"), (F.col("_earlier") + F.col("_base")).alias("_offset"))
        ranked = now.withColumn("_rank", F.row_number().over(W.partitionBy("_part", "_digit").orderBy("_at")) - 1)
        moved = ranked.join(offset, (F.col("_part") == F.col("_p")) & (F.col("_digit") == F.col("_d"))).withColumn("_to", F.col("_offset") + F.col("_rank"))
        placed = written(moved.select(*columns, F.floor(F.col("_to") / CHUNK_ROWS).alias("_part"), F.col("_to").alias("_at")), "radix")
    if all(ends[f"{n}_most"] == ends[f"{n}_least"] for n, _ in digits):  # all rows agree: their first order, numbered
        before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = before.select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each part
        rank = F.row_number().over(W.partitionBy("_part").orderBy("_at")) - 1
        return placed.withColumn("_rank", rank).join(before, F.col("_part") == F.col("_p")).select(*columns, (F.col("_rank") + F.col("_before")).alias("row"))
    return placed.select(*columns, F.col("_at").alias("row"))


# ---------------------------------------------------------------- the operator
def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document, drawn towards ``target``.

    Features are the words and pairs of neighbouring words, hashed into ``buckets``. A bucket's gain
    is 1,000 times the log of its share in the target texts over its share in the corpus; a
    document's weight is the mean of its gains, and its score the weight and a Gumbel number made
    from its id and the seed, so that the highest scores are a draw without replacement by exp(weight).
    The highest floor(percent * N / 100) scores of the N documents with ``min_words`` words or more
    have a rank from 1, ties to the smaller id; ranks come from ``radix_ranks``.

    The driver sees the gains (``buckets`` numbers) and N. Null and empty texts have no features and
    weight 0; a null id draws its number from the empty text and comes last among ties; rows that
    repeat an id are drawn each on its own, and among rows that agree in score and id, any order
    holds. Empty tables give no rows (an empty target: every t is 0). Other columns are ignored.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    gains = np.zeros(buckets, np.int64)
    for r in written(bucket_gains(rows, narrow(target, text=target_text), buckets), "gains").collect():  # ``buckets`` rows
        gains[r["bucket"]] = r["gain"]
    weighed = rows.mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel), "scores")
    able = F.col("n_words") >= min_words
    wanted = scored.filter(able).count() * percent // 100
    ranked = radix_ranks(scored.filter(able), [("score", "desc"), ("doc_id", "asc")])
    rank = F.when(F.col("row") < wanted, F.col("row") + 1).cast("long")
    return ranked.withColumn("rank", rank).drop("row").unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
