"""Operators 11 to 13 against plain Python, with odd rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from domlens.llm import line_dedup, merkle, resampling
from tests.llm.conftest import SF


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


# ---------------------------------------------------------------- 11
def plain_lines(rows, min_docs=2, min_chars=10):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    first = {k: min((d for d in docs if d is not None), default=None) for k, docs in held.items() if len(docs) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in first or first[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_are_brute_force(spark, docs, no_docs, corpus):
    shared = "This line is SHARED by many\n"
    rows = [(i, shared + f"own line number {i}\n\t this line is shared by many \x0b\nshort\n") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared), (None, "only without an id\nonly without an id"), (103, "only without an id"), (5, "another text of five\n" + shared), (5, "another text of five\n" + shared),
             (200, "É" * 10 + "\nÀ ligne \n" + "x" * 9 + "\r\n" + "x" * 10), (201, "É" * 10 + "\n" + "é" * 10 + "\n" + "X" * 10), (202, "line again and again\n" * 500), (203, "Line Again And Again"), (204, "z" * 200_000), (205, "z" * 200_000)]
    odd = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, key1 string, place int").repartition(4)
    for df in (odd, docs, corpus[0]):
        want = plain_lines([(r["doc_id"], r["text"]) for r in df.collect()])
        got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_repeated_lines(df).collect()), key=str)
        assert got == want
    want = plain_lines(rows, 3, 4)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_repeated_lines(odd, 3, 4).collect()), key=str) == want
    assert line_dedup.drop_repeated_lines(no_docs).collect() == []


# ---------------------------------------------------------------- 12
def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(fields):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k:k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for row in levels[:-1]:
        other = i ^ 1
        out.append(None if other >= len(row) else (other < i, row[other]))
        i //= 2
    return out


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text), tampered where 7 divides the id's checksum."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = climb([plain_leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for t, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, t)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            digest = plain_leaf((r[0], r[1], r[2], r[3] + 1, r[4])) if changed else plain_leaf(r)
            for s in steps:
                digest = h(digest if s is None else s[1] + digest if s[0] else digest + s[1])
            out.append((r[0], plain_leaf(r), trees[g][-1][0], top[-1][0], h("".join(s[1] for s in steps if s)), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(df, levels):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in merkle.manifest(df, tampered=tampered, levels=levels).collect()), key=str)


@pytest.mark.parametrize("block", [2, 3, 10])
def test_manifest_is_brute_force(spark, docs, no_docs, block):
    """Low blocks make several stages of them."""
    random.seed(block)
    rows = [(i, f"s{i % 4}", ["en", "de", None, "zz", "É"][i % 5 if i < 200 else 0], None if i % 9 == 0 else i, f"text {i} é") for i in range(331)]
    rows += [(9_000, None, "alone", 1, None), (None, None, None, None, None), (7, "again", "en", 3, ""), (7, "again", "en", 3, "")]
    random.shuffle(rows)
    for given in (rows, [r for r in rows if r[2] == "alone"], [r for r in rows if r[2] == "en"][:17]):
        df = spark.createDataFrame([(*r, "x", 1) for r in given], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int").repartition(3)
        assert manifest_rows(df, block) == plain_manifest(given)
    if block == 10:
        assert manifest_rows(docs, block) == plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()])
        assert merkle.manifest(no_docs).collect() == []


@pytest.mark.parametrize("levels", range(1, 9))
def test_layout(levels):
    """Every slot once; the upper half first, and each subtree below in one stretch."""
    depth = np.concatenate([np.full(1 << d, d) for d in range(levels)])
    index = np.concatenate([np.arange(1 << d) for d in range(levels)])
    at = merkle.places(levels, depth, index)
    assert sorted(at.tolist()) == list(range((1 << levels) - 1)) and at[0] == 0
    upper = levels // 2
    if upper:
        assert sorted(at[depth < upper].tolist()) == list(range((1 << upper) - 1))
        size = (1 << (levels - upper)) - 1
        for tree in range(1 << upper):
            mine = (depth >= upper) & (index >> np.maximum(depth - upper, 0) == tree)
            assert sorted(at[mine].tolist()) == list(range((1 << upper) - 1 + tree * size, (1 << upper) - 1 + (tree + 1) * size))


# ---------------------------------------------------------------- 13
def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_draw(rows, target, percent=25, least=20, buckets=10_000):
    s, t = Counter(), Counter()
    for count, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            count.update(zlib.crc32(f.encode()) % buckets for f in plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets)))) for b in range(buckets)]
    scored = []
    for doc, text in rows:
        words, found = plain_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        draw = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((draw + 0.5) / 4294967296))), len(words) >= least])
    able = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in scored], key=str)


def drawn(df, target, **more):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resample(df, target, **more).collect()), key=str)


def test_draw_is_brute_force(spark, docs, no_docs, corpus, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK_ROWS", 16)
    monkeypatch.setattr(resampling, "DIGIT_BITS", 5)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    odd = [(i, " ".join(random.Random(i).choices(["Wort", "é", "x1", "中文", "a" * 70, "b" * 200, "--", "it's"], k=15 + i % 20))) for i in range(120)]
    odd += [(-5, odd[0][1]), (1 << 40, odd[1][1]), (-(1 << 62), odd[2][1]), (None, odd[3][1]), (None, None), (900, None), (901, ""), (902, "q" * 100_000 + " end"), (903, "word " * 30_000)]
    for rows in (odd, [(r[0], r[1]) for r in corpus[1]]):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, bucket string").repartition(3)
        for percent in (25, 100) if rows is odd else (25,):
            assert drawn(df, target, percent=percent) == plain_draw(rows, texts, percent)
    same = resampling.resample(docs, target, percent=100, min_words=1).collect()  # repeated rows: any order among equals
    assert sorted(r["rank"] for r in same if r["rank"]) == list(range(1, 1 + sum(r["n_words"] > 0 for r in same)))
    assert [r["score"] for r in sorted((r for r in same if r["rank"]), key=lambda r: r["rank"])] == sorted((r["score"] for r in same if r["rank"]), reverse=True)
    assert resampling.resample(no_docs, target).collect() == []
    assert drawn(spark.createDataFrame(odd[:30], "doc_id long, text string"), target.limit(0)) == plain_draw(odd[:30], [])


def test_radix_ranks_order_everything(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK_ROWS", 8)
    rows = [(random.Random(i).choice([-3, 0, 7, 7, 1 << 50, -(1 << 63), (1 << 63) - 1, None]), random.Random(-i).randint(-20, 20) if i % 7 else None, i) for i in range(200)]
    got = resampling.radix_ranks(spark.createDataFrame(rows, "a long, b long, i long").repartition(5), [("a", "desc"), ("b", "asc")]).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(200)) and sorted(r["i"] for r in got) == list(range(200))
    assert [(r["a"], r["b"]) for r in got] == sorted(((a, b) for a, b, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0))
    equal = resampling.radix_ranks(spark.createDataFrame([(1, 2)] * 30, "a long, b long").repartition(4), [("a", "asc")]).collect()
    assert sorted(r["row"] for r in equal) == list(range(30))


def test_checksums():
    texts = ["", "a", "Hello WORLD", "é ß 中文", "x" * 64 + " " + "y" * 65, "y" * 300 + " z", "1,2;3", "a b"]
    data = [t.encode() for t in texts]
    sums, of, words = resampling.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for k, t in enumerate(texts):
        w, f = plain_features(t)
        assert sorted(sums[of == k].tolist()) == sorted(zlib.crc32(x.encode()) for x in f) and words[k] == len(w)
