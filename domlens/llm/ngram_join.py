"""N-gram Jaccard self-join by rare-first prefix filtering, and the classes of linked documents.

Two sets with Jaccard similarity t or more share an n-gram among the first
``size - ceil(t * size) + 1`` of each, in any order that is the same for all sets. N-grams are
ordered rare first, by classes of their measured frequency and then by hash, so that passages which
many documents share come last. Documents meet on n-grams of their prefixes; a pair is passed by
the length filter, the positional filter (what the places of the shared n-gram leave possible) and
the suffix filter (a lower bound on the Hamming distance: each section of the hashes that holds an
odd number of one set's n-grams and an even number of the other's has one that they don't share),
all inside the join, and is then verified, once, on the whole sets.

Only the classes are asked for, so a pair whose ends are already known to be linked needs no
verification. On n-grams that many documents of different classes meet on, rounds compare every
document with a few leaders only, which is linear in the prefixes and soon links large groups of
near copies. The last round takes all pairs that are left, on all n-grams. No pair is left out, and
none inside a class is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, narrow, release, slices, utf8, written
from .words import shingles, words

FREQUENCY_BITS = 21  # the frequency sketch has 2 ** FREQUENCY_BITS classes, one byte each
SECTION_BITS = 14    # slots of the sketch that reach the driver as one row
SEEN = 3             # repeats inside a task from which an n-gram counts as frequent there
PARTS = ["p0", "p1", "p2", "p3"]  # of the suffix filter: 64 sections each
WIDE = 32            # parts of the second suffix filter, which tells larger sets apart
SLICE = 1 << 20      # bytes of text hashed at once
LEADERS = 3          # of an n-gram in a round
WORK = 32            # documents outside an n-gram's largest class from which on leaders are tried first

_SETS = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("digest", pa.int64()), ("digest2", pa.int64()), ("prefix", pa.list_(pa.int64()))] + [(c, pa.int64()) for c in PARTS] + [("wide", pa.list_(pa.int64()))])
_GRAMS = pa.schema([("doc_id", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """Distinct n-grams of each text of a batch, as sorted 64-bit hashes."""
    hashes, first = words(*utf8(batch.column("text")))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(shingles(hashes[a:b], n))


def frequency_classes(texts: DataFrame, n: int) -> np.ndarray:
    """For each slot of the sketch, the rounded log2 of the frequency of the frequent n-grams that
    fall into it: 2 ** FREQUENCY_BITS bytes whatever the input. A task passes on the counts of
    n-grams that it sees SEEN times or more in different sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0

        def slots() -> pa.RecordBatch:
            grams = np.concatenate(held)
            held.clear()
            grams.sort()  # in place: no second copy
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            times = np.diff(np.append(first, len(grams)))
            first, times = first[times >= SEEN], times[times >= SEEN]
            slot = (grams[first] >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int32)  # ascending
            new = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else first
            most = np.maximum.reduceat(times, new) if len(new) else times
            return pa.RecordBatch.from_arrays([pa.array(slot[new]), pa.array(most)], names=["slot", "times"])

        for batch in slices(batches, "text", SLICE):
            for grams in _sets(batch, n):
                key = hash(grams.tobytes())
                if key not in seen:
                    seen.add(key)
                    held.append(grams)
                    size += len(grams)
            if size > 3_000_000:
                yield slots()
                size = 0
                seen.clear()
        if held:
            yield slots()
        seen.clear()
        release()

    rows = texts.mapInArrow(count, "slot int, times long").groupBy("slot").agg(F.sum("times").alias("times"))

    def section(group: pa.Table) -> pa.Table:
        out = np.zeros(1 << SECTION_BITS, np.uint8)
        out[group["slot"].to_numpy() & (len(out) - 1)] = np.minimum(np.log2(group["times"].to_numpy().astype(float)).round(), 30).astype(np.uint8) + 1
        return pa.table({"section": pa.array([group["slot"][0].as_py() >> SECTION_BITS], pa.int32()), "kinds": pa.array([out.tobytes()], pa.binary())})

    found = rows.groupBy(F.shiftright("slot", SECTION_BITS)).applyInArrow(section, "section int, kinds binary")
    out = np.zeros((1 << (FREQUENCY_BITS - SECTION_BITS), 1 << SECTION_BITS), np.uint8)
    for r in found.collect():  # 2 ** FREQUENCY_BITS bytes at most
        out[r["section"]] = np.frombuffer(r["kinds"], np.uint8)
    return out.ravel()


def ordered(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """N-grams as 63-bit numbers whose order is rare first: class, then hash."""
    kind = classes[(grams >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((kind << np.uint64(58)) | ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(6))).astype(np.int64)


def document_sets(texts: DataFrame, n: int, threshold: Fraction, classes) -> DataFrame:
    """(doc_id, t1, t2, n: set size, digest, digest2 of the set, prefix, p0 to p3): one row per document. A
    bit of p0 to p3 is set if a section of the hashes holds an odd number of the set's n-grams, and
    so is one of ``wide``, which has more and narrower sections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.frombuffer(classes.value, np.uint8)
        for batch in slices(batches, "text", SLICE):
            size, one, two, prefix, odd, wide = [], [], [], [], [], []
            for grams in _sets(batch, n):
                order = ordered(grams, kinds)
                count = len(order)
                size.append(count)
                digest = _digests(grams)
                one.append(digest[0])
                two.append(digest[1])
                prefix.append(order[:count - _ceil(threshold * count) + 1] if count else order)
                odd.append(_parity(grams, len(PARTS)))
                wide.append(_parity(grams, WIDE))
            odd = np.array(odd, np.int64).reshape(-1, len(PARTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2")), *(pa.array(c, pa.int64()) for c in (size, one, two)), pa.array(prefix, _SETS.field("prefix").type), *(pa.array(odd[:, k]) for k in range(len(PARTS))), pa.array(wide, _SETS.field("wide").type)], schema=_SETS)
        release()

    return texts.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, digest long, digest2 long, prefix array<long>, p0 long, p1 long, p2 long, p3 long, wide array<long>")


def _digests(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    weight = np.arange(1, 2 * len(grams) + 1, 2, dtype=np.uint64)
    return int((grams * weight).sum().astype(np.int64)), int(((grams >> np.uint64(7)) * (weight * weight + grams)).sum().astype(np.int64))


def _parity(grams: np.ndarray, parts: int) -> np.ndarray:
    sections = np.bincount((grams & np.uint64(64 * parts - 1)).astype(np.int64), minlength=64 * parts)
    return np.packbits(sections & 1).view(np.int64)


def _ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


def whole_sets(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams: 64-bit hashes) of the documents to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g.astype(np.int64) for g in _sets(batch, n)], _GRAMS.field("grams").type)], schema=_GRAMS)
        release()

    return texts.mapInArrow(run, "doc_id long, grams array<long>")


def similar(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Of pairs (a, b), those whose whole sets reach the threshold: both / (all - both) >= p / q."""
    p, q = threshold.numerator, threshold.denominator
    x = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.select("a", "b").join(x, "a").join(y, "b").filter((p + q) * both >= p * (F.size("x") + F.size("y"))).select("a", "b")


def components(links: DataFrame, name: str = "classes") -> DataFrame:
    """(doc_id, component) of every document in ``links`` (a, b): the smallest document that links
    lead to. Large and small stars by turns: every document points to the smallest one that it or
    its neighbours know, until each class is one star; the rounds grow as the logarithm of the links."""
    links = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # large star: larger neighbours point to the smallest one that their neighbour knows
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = written(large.distinct(), name)
        # small star: smaller neighbours, and the document itself, point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.u", "l.v").filter("u <> v")
        links = written(small.distinct(), name)
        # done when every class is one star: no document points to two, or to one that points on
        ends = links.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if not ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 or out = 1 and into > 0").head(1):
            break
    return links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "doc_id")


def set_classes(docs: DataFrame, n: int, threshold: str, id_col: str, text_col: str, null_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """(sets, same, label, often). ``sets``: a row for each document (row, doc_id, t1, t2: hashes of the text, n, digest,
    digest2). ``same``: each distinct set that isn't empty (digest, digest2, n, rep: its smallest id, sid: the row
    of its first document, which stands for it). ``label``: (doc_id: a sid, component: the smallest sid that links lead to) of all
    linked sets, or None. ``often``: the ids (often) of several rows.

    Sets are known by their digests and rows throughout, never by ids, so that ids that repeat with
    different texts, and null ids (if ``null_ids``), take part like others.
    """
    spark, limit = docs.sparkSession, Fraction(threshold)
    p, q = limit.numerator, limit.denominator
    texts = narrow(docs, doc_id=id_col, text=text_col)
    texts = texts.select(F.col("doc_id").cast("long"), "text", *[h.alias(f"t{k}") for k, h in enumerate(text_hashes(F.col("text")), 1)])
    classes = spark.sparkContext.broadcast(frequency_classes(texts.select("doc_id", "text"), n).tobytes())
    sets = written(document_sets(texts, n, limit, classes).withColumn("row", F.monotonically_increasing_id()), "sets")

    # documents with one set are one class, which its first document stands for
    one = ["digest", "digest2", "n"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "row")).alias("f")
    same = sets.filter("n > 0" if null_ids else "n > 0 and doc_id is not null").groupBy(*one).agg(first)
    same = written(same.select(*one, F.col("f.doc_id").alias("rep"), "f.t1", "f.t2", F.col("f.row").alias("sid")), "reps")
    # ids of several rows
    often = written(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("often")), "often")
    reps = sets.join(same.select(F.col("sid").alias("row")), "row", "left_semi").withColumn("doc_id", F.col("row"))
    posts = reps.select("doc_id", F.posexplode("prefix").alias("at", "gram"))
    shared = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("gram")
    posts = written(posts.join(shared, "gram").join(reps.select("doc_id", "n", *PARTS), "doc_id"), "posts")
    free_shuffles(spark)

    tried = label = grams = None

    def sets_of(ends: DataFrame) -> DataFrame:
        """(doc_id, grams) of the sids in ``ends``, from the texts of the documents that stand for them."""
        wanted = same.join(ends.withColumnRenamed("doc_id", "sid"), "sid", "left_semi")
        here = wanted["rep"].eqNullSafe(often["often"])
        single = written(wanted.join(often, here, "left_anti").select("sid", "rep"), "wanted")
        found = texts.join(single, texts["doc_id"].eqNullSafe(single["rep"])).select(F.col("sid").alias("doc_id"), "text")
        # ids of several rows: by the text, and rows that repeat an id and its text give it once
        several = written(wanted.join(often, here, "left_semi").select("sid", "rep", F.col("t1").alias("w1"), F.col("t2").alias("w2")), "wanted_often")
        on = texts["doc_id"].eqNullSafe(several["rep"]) & (texts["t1"] == several["w1"]) & (texts["t2"] == several["w2"])
        again = texts.join(several, on).groupBy(F.col("sid").alias("doc_id")).agg(F.min("text").alias("text"))
        return whole_sets(found.unionByName(again), n)

    def link(pairs: DataFrame) -> bool:
        """Verify new pairs, each once, and bring the classes up to date; whether there are new links."""
        nonlocal tried, label, grams
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.head(1):
            return False
        tried = pairs if tried is None else tried.union(pairs)
        wide = reps.select("doc_id", "n", "wide").join(written(_ends(pairs), "ends"), "doc_id", "left_semi")
        pairs = written(_second_filter(pairs, wide, p, q), "pairs")
        ends = _ends(pairs)
        if grams is not None:
            ends = ends.join(grams.select("doc_id"), "doc_id", "left_anti")
        fresh = written(sets_of(written(ends, "ends")), "grams")
        grams = fresh if grams is None else grams.union(fresh)
        new = written(similar(pairs, grams, limit).distinct(), "links")
        if not new.head(1):
            return False
        label = components(new if label is None else label.toDF("a", "b").union(new))
        free_shuffles(spark)
        return True

    def labelled(rows: DataFrame) -> DataFrame:
        if label is None:
            return rows.withColumn("component", F.col("doc_id"))
        return rows.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    # documents of n-grams with many pairs are linked through leaders as long as that halves the pairs
    crowd, turn, before = posts, 0, math.inf
    while True:
        top = _largest(labelled(crowd)).filter(F.col("m") - F.col("t.c") > WORK)
        left = top.agg(F.sum((F.col("m") - F.col("t.c")) * F.col("m"))).first()[0]
        if not left or left > before / 2:
            break
        crowd = written(crowd.join(top.select("gram"), "gram"), "crowd")
        if not link(_with_leaders(labelled(crowd), turn, p, q).distinct()):
            break
        turn, before = turn + 1, left
    mine = labelled(posts)
    link(_remaining(mine, _largest(mine).filter("t.c < m"), p, q).distinct())
    return sets.select("row", "doc_id", "t1", "t2", *one), same.drop("t1", "t2"), label, often


def ngram_classes(docs: DataFrame, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id), where documents are linked if the
    Jaccard similarity of their sets of n-grams of words is ``threshold`` (a decimal) or more, and
    component_id is the smallest id that links lead to.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text after lower-casing A-Z; a text of fewer than n
    words has one n-gram, the whole sequence; null and empty texts have none and are linked with
    nothing. Rows that repeat an id keep a row each; an id with several texts is linked
    with whatever any of them is like. Rows with a null id are linked with nothing and have a null
    component. Other columns are ignored; an empty table gives no rows.
    """
    sets, same, label, often = set_classes(docs, n, threshold, id_col, text_col, null_ids=False)
    one = ["digest", "digest2", "n"]
    # an id with several sets links these
    own = sets.filter("doc_id is not null and n > 0").join(often.withColumnRenamed("often", "doc_id"), "doc_id", "left_semi").select("doc_id", *one).distinct().join(same, one)
    several = own.groupBy("doc_id").agg(F.min("sid").alias("b"), F.max("sid").alias("most")).filter("b < most").select("doc_id", "b")
    links = written(own.join(several, "doc_id").filter("sid > b").select(F.col("sid").alias("a"), "b").distinct(), "own_links")
    if links.head(1):
        label = components(links if label is None else label.toDF("a", "b").union(links))
    if label is not None:
        same = same.join(label.withColumnRenamed("doc_id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        smallest = same.groupBy("component").agg(F.min("rep").alias("least"))
        same = same.join(smallest, "component").select(*one, F.col("least").alias("rep"))
    out = sets.join(same.select(*one, "rep"), one, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id"))


def near_copies(docs: DataFrame, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2) of the texts that aren't the first of their class, by id, null last, and then by the hashes
    t1 and t2 of the text (``text_hashes``). Classes are of texts, whatever their ids: a text that only shares its id
    with another isn't linked with it. Rows that repeat an id and its text are alike."""
    sets, same, label, _ = set_classes(docs, n, threshold, id_col, text_col, null_ids=True)
    one = ["digest", "digest2", "n"]
    classes = same.select(*one, F.col("sid").alias("class"))
    if label is not None:
        classes = same.join(label.withColumnRenamed("doc_id", "sid"), "sid", "left").select(*one, F.coalesce("component", "sid").alias("class"))
    rows = written(sets.join(classes, one).select("class", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2").alias("k")), "class_rows")
    first = rows.groupBy("class").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last").select("class", "first")
    return rows.join(first, "class").filter("k > first").select("k.doc_id", "k.t1", "k.t2").distinct()


def text_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits of a text in two longs."""
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def _possible(p: int, q: int) -> Column:
    """Length, positional and suffix filter of candidates x and y."""
    nx, ny = F.col("x.n"), F.col("y.n")
    least = F.ceil((nx + ny) * p / (p + q) - 1e-9)
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in PARTS), F.lit(0))
    return (nx * q >= ny * p) & (ny * q >= nx * p) & (F.least(nx - F.col("x.at"), ny - F.col("y.at")) >= least) & (nx + ny - 2 * least >= apart)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _second_filter(pairs: DataFrame, wide: DataFrame, p: int, q: int) -> DataFrame:
    """Suffix filter of pairs (a, b) with narrower sections (doc_id, n, wide)."""
    x = wide.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x"))
    y = wide.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y"))
    both = F.col("na") + F.col("nb")
    apart = F.aggregate(F.zip_with("x", "y", lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda s, t: s + t)
    return pairs.join(x, "a").join(y, "b").filter(both - 2 * F.ceil(both * p / (p + q) - 1e-9) >= apart).select("a", "b").distinct()


def _pair() -> list[Column]:
    return [F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")]


def _largest(rows: DataFrame) -> DataFrame:
    """For each n-gram its documents (m) and its largest class (t: c documents, component)."""
    each = rows.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy("gram").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("t"))


def _with_leaders(mixed: DataFrame, turn: int, p: int, q: int) -> DataFrame:
    """Candidates of every document with LEADERS documents of each n-gram, others each turn. The first of them has
    the n-gram nearest the start of its prefix: it has the fewest n-grams of its own, and the
    positional filter leaves it the most partners."""
    one = ["doc_id", "n", "at", "component", *PARTS]
    lead = mixed.groupBy("gram").agg(F.array_distinct(F.array(*[F.min(F.struct(*([F.col("at").alias("first")] if k == 0 else []), F.xxhash64("component", F.lit(LEADERS * turn + k)).alias("h"), *one)).dropFields("first", "h") for k in range(LEADERS)])).alias("l"))
    lead = lead.select("gram", F.explode("l").alias("l")).select("gram", "l.*")
    on = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & _possible(p, q)
    return mixed.alias("x").join(lead.alias("y"), on).select(*_pair())


def _remaining(mixed: DataFrame, top: DataFrame, p: int, q: int) -> DataFrame:
    """All candidates that are left: documents outside an n-gram's largest class, with those of all
    other classes, each pair from one side."""
    both = mixed.join(top.select("gram", F.col("t.component").alias("top")), "gram")
    on = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.top")) | (F.col("x.doc_id") < F.col("y.doc_id"))) & _possible(p, q)
    return both.filter("component <> top").alias("x").join(both.alias("y"), on).select(*_pair())
