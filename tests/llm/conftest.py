from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row int, _salt int, component string, digest string"

WORDS = "the of and in to a is that for with on as by at from it or be are this which an not but have".split()


def near(k: int, change: int | None = None) -> str:
    words = [WORDS[(i * i + 3 * i) % len(WORDS)] + str(i) for i in range(60)]
    if change is not None:
        words[change] = f"changed{k}"
    return " ".join(words)


def rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    texts = {
        1: "Hello World", 2: "hello world", 3: "HELLO   world", 4: None, 5: "", 6: " \t\n", 7: "é ß 中文 😀 ▁   x", 8: near(8), 9: near(9, 0), 10: near(10, 59), 11: near(11),
        12: "WORD " * 30_000, 13: "a" * 50_000, 14: "you stupid idiot. Fine day!", 15: "<|endoftext|> it's 'tis <s> </s> <|startoftext|> 123 …", 16: "one two three", 17: "One Two Three", 18: "x",
    }
    out = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, k, -k, 7, "c", "d") for k, t in texts.items()]
    out += [out[0], out[0], out[7]]                     # repeated rows
    out += [(None, "Hello world", None, None, None, None, None, None, None, None), (None, None, "en", "s1", 0, 0, 0, 0, "", "")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest table of documents, as Spark's and as Python rows."""
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(4).cache()
    return df, [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
