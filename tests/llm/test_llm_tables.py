"""Operators 4 to 10 and the pipeline against brute force, with odd rows and empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from domlens.llm import cuckoo_dedup, mixing, mtree, ngram_join, pieces, sharding, toxicity, warc
from domlens.llm.common import scratch, written
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


# ---------------------------------------------------------------- 4
def best(vectors, k, every):
    out = []
    for key, q in vectors.items():
        if key % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, x)), other) for other, x in vectors.items() if other != key))[:k]
            out += [(key, n, other, -score) for n, (score, other) in enumerate(found, 1)]
    return sorted(out)


def test_nearest_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "CELL", 60)
    monkeypatch.setattr(mtree, "TREE", 100)
    monkeypatch.setattr(mtree, "PAGE", 4)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * (1 + i % 3)).tolist()) for i in range(500)] + [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.5]) for i in range(300)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2010, [float("nan")] * 6), (2020, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2030, [0.5, -0.5]), (2040, []), rows[3], rows[500]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, tree string, score int")
    vectors = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert sorted(map(tuple, mtree.nearest(df, 10, 10).collect())) == best(vectors, 10, 10)
    assert sorted(map(tuple, mtree.nearest(df.filter("vec_id in (10, 20, 1000)"), 10, 10).collect())) == best({i: vectors[i] for i in (10, 20, 1000)}, 10, 10)
    assert mtree.nearest(df.limit(0), 10, 10).collect() == []


def test_long_vectors_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(200, [70_000.0, 1.0, -3.0, 0.25]), (201, [200_000.0, -5.0, 0.5, 1.0]), (300, [1e9, 1.0, 2.0, 3.0]), (301, [1e9, 1.0, 2.0, 3.5]), (302, [-1e9, 0.0, 1e12, 0.0]), (310, [3e15, 1.0, 1.0, 1.0]), (320, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    clip = [(q, n, x, max(-(1 << 63), min((1 << 63) - 1, s))) for q, n, x, s in best(vectors, 10, 10)]
    assert sorted(map(tuple, mtree.nearest(df, 10, 10).collect())) == clip
    only = {i: v for i, v in vectors.items() if i in (200, 300, 301)}
    assert [r["vec_id"] for r in mtree.nearest(df.filter("vec_id in (200, 300, 301)"), 10, 100).orderBy("query_id", "rank").collect()] == [x for _, _, x, _ in best(only, 10, 100)]


def test_bounds_save_distances():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 8)) * 3000
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 8)) * 50 for c in centers]))
    metric = mtree.Metric(8, int((x * x).sum(1).max()))
    tree = mtree.Tree(metric)
    tree.build(np.arange(len(x)), x)
    for q in (0, 555, 1999):
        ids, scores, computed = tree.search(x[q], q, 5, None)
        order = np.lexsort((np.arange(len(x)), -(x @ x[q])))
        assert ids.tolist() == [i for i in order.tolist() if i != q][:5]
        assert computed < len(x) / 2


# ---------------------------------------------------------------- 5
def test_byte_shards(docs, no_docs, corpus):
    for df in (docs, corpus[0]):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        got = sorted(sharding.byte_shards(df).collect(), key=lambda r: (r["shard"], r["slot"]))
        assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"]) for r in got))) == sorted(map(str, ((i, len(t) + 1, zlib.crc32(t)) for i, t in rows)))
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert order == sorted(order)
        total, before = sum(r["size"] for r in got), 0
        for r in got:  # a document lies where its middle lies
            assert r["shard"] == min(15, (2 * before + r["size"]) * 16 // (2 * total))
            before += r["size"]
        for shard in {r["shard"] for r in got}:
            assert [r["slot"] for r in got if r["shard"] == shard] == list(range(sum(r["shard"] == shard for r in got)))
    assert sharding.byte_shards(no_docs).collect() == []


# ---------------------------------------------------------------- 6
def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark, docs, no_docs, corpus):
    skewed = spark.createDataFrame([(i, "w " * (1 + i % 50), "big" if i % 3 else f"s{i % 7}") for i in range(3000)], "doc_id long, text string, source string")
    for df, near in ((corpus[0], 0.1), (skewed, 0.02), (docs, None)):
        rows = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in df.collect()]
        sizes = Counter()
        for _, n, s in rows:
            sizes[s] += n
        target = fill(sizes)
        got = mixing.mix_sources(df).collect()
        assert sorted(map(str, ((r["doc_id"], r["size"], r["source"]) for r in got))) == sorted(map(str, rows))
        taken = Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
            assert r["taken"] == r["copies"] * r["size"] and r["copies"] in ((0, 1, 2, 3) if r["size"] else (0,))
            whole = math.floor(r["target"] / r["source_size"]) if r["source_size"] else 0
            assert not r["size"] or whole <= r["copies"] <= whole + 1
            taken[r["source"]] += r["taken"]
        if near:
            assert all(abs(taken[s] - t) <= near * t for s, t in target.items())
        again = mixing.mix_sources(df.repartition(7)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(no_docs).collect() == []


def test_inclusion_follows_size(spark):
    """Sources that are alike stand for many draws: each document is taken about as often as its inclusion says."""
    own = [1] * 240 + [2] * 240 + [4] * 240 + [8] * 120  # no document over 1/256 of its source
    rows = [(1000 * s + i, "w " * n, f"s{s:03d}") for s in range(80) for i, n in enumerate(own)]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2)).collect()
    for whole in (0, 1):
        part = [r for r in found if r["whole"] == whole]
        rest = part[0]["target"] - whole * part[0]["source_size"]
        expected = dict(zip(own, mixing._inclusion(np.array(own), rest).tolist(), strict=True))
        assert sum(n * expected[n] for n in own) == pytest.approx(rest)
        for n in (1, 2, 4, 8):
            these = [r["copies"] - whole for r in part if r["size"] == n]
            assert np.mean(these) == pytest.approx(expected[n], abs=0.025)
    assert mixing._inclusion(np.array([5, 100, 5, 5]), 108).tolist() == pytest.approx([8 / 15, 1.0, 8 / 15, 8 / 15])


# ---------------------------------------------------------------- 7
def brute_classes(rows, n, threshold):
    sets = {}
    for key, text in rows:
        words = WORD.findall(lower(text))
        sets[key] = {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    keys, top = sorted(sets), {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    at = {}
    for k in keys:
        for g in sets[k]:
            at.setdefault(g, []).append(k)
    for pair, both in Counter((a, b) for own in at.values() for i, a in enumerate(own) for b in own[i + 1:]).items():
        a, b = pair
        if Fraction(both, len(sets[a]) + len(sets[b]) - both) >= Fraction(threshold):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize(("n", "threshold"), [(4, "0.85"), (5, "0.8"), (1, "0.5")])
def test_ngram_classes(corpus, n, threshold):
    want = brute_classes([(i, t) for i, t, _ in corpus[1]], n, threshold)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(corpus[0], n, threshold).collect()}
    assert got == want


def test_chains_and_hot_groups(spark):
    """A large group of near copies, chains of links, and a passage that all documents share."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        words[i % 60] = f"x{i}"
        rows.append((i * 10, " ".join(words)))
    rows += [(5000 + i, " ".join(f"c{k}" for k in range(i, i + 40))) for i in range(25)]  # each is like the next only
    rows += [(6000 + i, " ".join([f"u{i}_{k}" for k in range(10)] + [f"p{k}" for k in range(30)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(df, 4, "0.85").collect()}
    assert got == brute_classes(rows, 4, "0.85")
    assert len({c for i, (_, c) in got.items() if 5000 <= i < 6000}) == 1


def test_ngram_classes_of_odd_rows(docs, no_docs):
    got = ngram_join.ngram_classes(docs, 4, "0.85").collect()
    assert len(got) == docs.count()
    known = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert [known[k]["component_id"] for k in (1, 2, 3, 4, 5, 6, 16, 17)] == [1, 1, 1, 4, 5, 6, 16, 16]
    assert known[4]["n_shingles"] == known[5]["n_shingles"] == known[6]["n_shingles"] == 0
    assert known[12]["n_shingles"] == 1 and known[13]["n_shingles"] == 1
    assert known[8]["component_id"] == known[11]["component_id"] == 8
    assert ngram_join.ngram_classes(no_docs, 4, "0.85").collect() == []


# ---------------------------------------------------------------- 8
def test_archives(spark, monkeypatch):
    trap = warc.record(777, "http://trap/", b"inner", warc.sha1_base32(b"inner")).decode()
    rows = [(i, f"http://h/{i}", f"<p>{i % 40}</p>" if i % 3 else trap * (i % 5) + str(i)) for i in range(200)]
    rows += [(300, None, None), (301, "http://a\r\nb", ""), (302, "u", "x" * 100_000 + trap), (None, "n", "<p>1</p>"), (None, "n", "only"), (None, "n", "only"), rows[1], (1, "again", "other")]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, kind string, range int").repartition(3)
    path = scratch(spark, "warc-test")
    warc.write_archives(df, f"{path}/data").write.parquet(f"{path}/files")
    files = spark.read.parquet(f"{path}/files")
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        known = [k for k in groups[p] if k is not None]
        top = max(known) if known else None
        revisit = top is not None and i != top
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, True))
    for size in (700, 5000, 1 << 20):  # ranges that begin inside payloads
        got = warc.read_archives(files, size).select("page_id", "payload_bytes", "digest", "kind", "refers_to", "sound").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = warc.archive_roundtrip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound").collect()
    assert sorted(map(str, map(tuple, whole))) == sorted(map(str, want))
    assert all(r["record_type"] == "response" for r in warc.archive_roundtrip(df.filter("page_id < 200"), least=10 ** 6).collect())
    assert warc.archive_roundtrip(df.limit(0)).collect() == []


def test_archives_with_long_urls(spark):
    urls = {k: f"http://h/{k}" + "x" * (300_000 if k % 4 == 0 else 65_536 if k % 4 == 1 else 0) for k in range(24)}
    rows = [(k, u, f"<p>{k}</p>" + "WARC/1.1\r\na: no end" * (k % 3)) for k, u in urls.items()]
    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{path}/data").write.parquet(f"{path}/files")
    files = spark.read.parquet(f"{path}/files")
    for size in (50_000, 1 << 20):
        got = warc.read_archives(files, size).collect()
        assert sorted((r["page_id"], r["uri"], r["payload_bytes"], r["sound"]) for r in got) == sorted((k, u, len(h), True) for k, u, h in rows)


def test_archives_that_break_off(spark):
    path = scratch(spark, "warc-test")
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 50) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    [(file, size)] = warc.write_archives(pages, f"{path}/data").collect()
    name = file.removeprefix("file://")
    with open(name, "rb") as f:
        data = f.read()
    with open(name, "wb") as f:
        f.write(data.replace(b"<urn:page:10>\r\n", b"<urn:page:10>\r\nno colon\r\n"))
        size = f.tell()
    for length in (300, 1 << 20):
        with pytest.raises(RuntimeError, match="chain"):
            warc.read_archives(spark.createDataFrame([(file, size)], "file string, bytes long"), length).collect()


# ---------------------------------------------------------------- 9
@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.booleans()), max_size=2000))
def test_cuckoo_index(changes):
    index, live = cuckoo_dedup.CuckooIndex(2), {}
    for number, gone in changes:
        key = hashlib.sha256(str(number).encode()).digest()
        if gone:
            assert index.delete(key) == (live.pop(key, None) is not None)
        elif key not in live:
            index.insert((key, number))
            live[key] = number
        assert (index.get(key) or (None, None))[1] == live.get(key)
    assert dict(index) == live and len(index) == len(live)


def test_cuckoo_index_grows_and_verifies():
    index = cuckoo_dedup.CuckooIndex(1)
    keys = [k.to_bytes(30, "big") + b"\x01\x00" for k in range(200)]  # one fingerprint for all
    for k in keys[:8]:
        index.insert((k, 0))
    assert index.find(keys[9]) < 0  # a hit of the fingerprint that the stored key denies
    for k in range(3000):
        index.insert((hashlib.sha256(b"%d" % k).digest(), k))
    assert index.resizes and len(index) == 3008 and all(index.get(hashlib.sha256(b"%d" % k).digest())[1] == k for k in range(3000))


def test_exact_duplicates(docs, no_docs, corpus):
    for df in (docs, corpus[0]):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        groups = {}
        for i, t in rows:
            groups.setdefault(lower(t), []).append(i)
        want = []
        for i, t in rows:
            own = groups[lower(t)]
            top = max((k for k in own if k is not None), default=None)
            want.append((i, top, len(own), i == top, hashlib.sha256(lower(t).encode()).hexdigest()))
        assert sorted(map(str, map(tuple, cuckoo_dedup.exact_duplicates(df).collect()))) == sorted(map(str, want))
    assert cuckoo_dedup.exact_duplicates(no_docs).collect() == []


def test_index_maintenance(docs):
    rows = cuckoo_dedup.text_digests(docs)
    changes = cuckoo_dedup.insertions(rows, 3)
    gone = rows.filter("doc_id = 1").select("digest").distinct()
    before, after = (cuckoo_dedup.maintain(c) for c in (changes, changes.unionByName(cuckoo_dedup.removals(gone, 3))))
    assert before.count() == rows.select("digest").distinct().count() == after.count() + 1


# ---------------------------------------------------------------- 10
def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity_learns_from_documents(spark, docs, no_docs):
    sf = "/root/testdata/sf0.01"
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(texts, labels)
    got = toxicity.score_documents(texts, model).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["score"], r["toxic"]) for r in got if r["held_out"]]
    assert auc(held) > 0.8
    assert sum(s >= 0.7 for s, y in held if not y) <= 0.03 * len(held)
    odd = toxicity.score_documents(docs, model).collect()
    assert len(odd) == docs.count()
    assert all(r["score"] == 0 and r["worst_start"] == -1 for r in odd if r["doc_id"] in (4, 5, 6))
    assert not any(r["held_out"] for r in odd if r["doc_id"] is None)
    bad = next(r for r in odd if r["doc_id"] == 14)
    assert bad["worst_start"] == 0 and bad["worst_score"] > 0.1
    assert toxicity.score_documents(no_docs, model).collect() == []


def test_toxicity_without_labels(spark, docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    for texts in (docs, no_docs):
        model = toxicity.fit(texts, labels)
        assert all(r["predicted"] == 0 for r in toxicity.score_documents(texts, model).collect())
    one = spark.createDataFrame([(k, 1) for k in range(1, 18)] * 2, "doc_id long, toxic int")
    assert toxicity.score_documents(docs, toxicity.fit(docs, one)).count() == docs.count()


def test_held_out_labels_do_not_matter(spark):
    sf = SF
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = (toxicity.fit(texts, x) for x in (labels, other))
    assert (a.hashes == b.hashes).all() and (a.weights == b.weights).all()


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, corpus):
    docs = corpus[0]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "pieces"]
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in corpus[1]} - toxic
    exact = corpus_pipeline.drop_copies(spark, docs, SF)
    groups = {}
    for i, t, _ in corpus[1]:
        groups.setdefault(lower(t), []).append(i)
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(max(g) for g in groups.values())
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    classes = brute_classes([(i, t) for i, t, _ in corpus[1]], 5, "0.8")
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({c for _, c in classes.values()})
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix(spark, docs, SF).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect() if r["copies"]})
    for stage in (kept, exact, near, corpus_pipeline.mix(spark, docs, SF)):
        assert stage.columns == docs.columns


def test_toxic_rows_with_null_and_repeated_ids(spark, corpus):
    docs = corpus[0]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, model).collect()}
    bad, good = (next((i, t) for i, t, _ in corpus[1] if scores[i] == p) for p in (1, 0))
    odd = [(None, bad[1]), (None, good[1]), (None, None), (bad[0], good[1]), (good[0], bad[1]), (bad[0], None)]
    more = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, more, SF).collect())
    assert got == Counter([(i, t) for i, t, _ in corpus[1] if not scores[i]] + [o for o in odd if o[1] != bad[1]])


def test_pipeline_with_odd_rows(spark, docs, no_docs):
    for df in (docs, no_docs):
        rows = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == df.columns
            assert rows.exceptAll(df).count() == 0 or stage is corpus_pipeline.mix
        out = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert out.count() == rows.count()
    copies = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert len({lower(r["text"]) for r in copies}) == len(copies)


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and all(len(r["ids"]) == r["n_tokens"] > 0 for r in out.collect())


def test_pipeline_keeps_spans_and_decoded_text(spark, monkeypatch):
    """The last stage encodes and decodes: its table has spans and decoded texts beside the ids."""
    kept = []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    docs = spark.createDataFrame([(1, "Two words"), (2, None), (None, "")], "doc_id long, text string")
    out = corpus_pipeline.encode(spark, docs, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and len(kept) == 1
    rows = {r["doc_id"]: r for r in kept[0].collect()}
    spans = {r["doc_id"]: r for r in pieces.encode_documents(docs, corpus_pipeline.tokenizer("piece_bpe_32k.model")).collect()}
    assert rows[1]["decoded"] == "Two words" and rows[1]["first"] == 0 and rows[2]["ids"] == rows[None]["ids"] == []
    for k, r in rows.items():
        ends = [r["first"] + sum(r["sizes"][:i + 1]) for i in range(len(r["ids"]))]
        assert spans[k]["ids"] == r["ids"] and spans[k]["ends"] == ends and spans[k]["starts"] == [e - n for e, n in zip(ends, r["sizes"], strict=True)]
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {k: len(r["ids"]) for k, r in rows.items()}


def test_ids_with_several_texts(spark):
    """Links hang on texts: an id with several texts is linked by each of them, and drops only the near copies."""
    long = " ".join(f"w{i}" for i in range(80))
    near_ = " ".join(f"w{i}" for i in range(79))
    short = " ".join(f"s{i}" for i in range(12))
    rows = [(1, short), (1, long), (2, near_), (3, short + " x"), (4, "alone here"), (None, near_ + " y"), (None, long + " z"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.ngram_classes(df, 5, "0.8").collect()}
    assert got[(1, 76)] == got[(2, 75)] == got[(1, 8)] == got[(3, 9)] == 1 and got[(4, 1)] == 4 and got[(None, 76)] is None and got[(4, 0)] == 4
    docs_ = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs_, SF).collect()), key=str)
    assert kept == sorted([(1, short), (1, long), (4, "alone here"), (4, None)], key=str)
    many = spark.createDataFrame([(7, f"text number {i} of one id " + " ".join(f"v{i}x{j}" for j in range(10))) for i in range(1000)] + [(8, "text number 5 of one id " + " ".join(f"v5x{j}" for j in range(10)))], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.ngram_classes(many, 5, "0.8").collect()} == {7}
    assert ngram_join.near_copies(many, 5, "0.8").count() == 1


def test_noisy_or_is_brute_force(spark, docs, corpus):
    """Scores from sentences split and looked up in plain Python."""
    model = toxicity.fit(corpus[0], spark.read.parquet(f"{SF}/labels.parquet"), "toxic")
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))

    def score(text):
        low = (text or "").encode().translate(bytes(toxicity.LOWER.tolist()))
        clean = 1.0
        for sentence in re.split(rb"[.!?\n]", low):
            words = re.findall(rb"[0-9a-z'\x80-\xff]+", sentence)
            if words:
                seen = set()
                for w in words:
                    for piece in [w, *(w[:k] for k in toxicity.PREFIXES if len(w) > k)]:
                        data = np.frombuffer(piece, np.uint8)
                        if piece is w:
                            seen.add(int(toxicity.hash_runs(data, np.ones(len(data), bool), np.zeros(1, np.int64))[2][0]))
                    for k in toxicity.PREFIXES:
                        if len(w) > k:
                            data = np.frombuffer(w, np.uint8)
                            seen.add(int(toxicity.hash_prefixes(data, np.zeros(1, np.int64), np.array([len(w)]), k)[1][0]))
                z = model.bias + sum(weight.get(h, 0.0) for h in seen)
                clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    for df in (docs, corpus[0]):
        texts = sorted((r["text"] or "" for r in df.collect()))
        found = sorted((r["score"] for r in toxicity.score_documents(df, model).collect()))
        assert found == pytest.approx(sorted(map(score, texts)), abs=1e-9)


def test_an_id_counts_once_in_the_fit(spark, corpus):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    once_ = toxicity.fit(corpus[0], labels, "toxic")
    many = toxicity.fit(corpus[0].unionByName(corpus[0]).unionByName(corpus[0].limit(50)), labels, "toxic")
    assert (once_.hashes == many.hashes).all() and np.allclose(once_.weights, many.weights) and once_.bias == pytest.approx(many.bias)
