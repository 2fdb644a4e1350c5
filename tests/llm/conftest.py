import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Odd texts: null, empty, blanks, ties, near copies, added tokens, long stretches without a blank, odd characters.
BASE = "the quick brown fox jumps over the lazy dog and runs to the old mill by the river where it sleeps until dawn " * 1


def texts():
    words = [f"w{i}" for i in range(120)]
    near = " ".join(words)
    return [
        None, "", "   \n\t\x0b ", "one", "one", "ONE", "a b c d", "A B C D", near, near, near.upper(), near.replace("w60", "x60"),
        " ".join(words[:110]), " ".join(words[10:]), near + " w120 w121", "x <|endoftext|> y  <|endoftext|>z", " " * 300 + "q" + "\n" * 50,
        "ab" * 6000, "é" * 5000 + " 中文" * 400, "\u00a0 \u2003 x\u3000 y", "\x00\x7f\x85 nul", "don't we'll 12 345  six", "same line\n" * 40,
        "k k k k k k k k k " * 10, 'password = "abcdef12" token=token=abcdef token=ab api_key: ZZZZZZ', "AKIA" + "Z" * 16 + " AKIAAKIA" + "0f" * 20,
        "ſecret=abcdefgh SECRET:'aaaaaaaa'" + "ab" * 14, BASE + "SHOUT! " * 3, BASE * 5]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with repeated rows, a null key and columns that other operators use as names."""
    rows = [(i, t, "en", f"s{i % 3}", "x") for i, t in enumerate(texts())]
    rows += [rows[8], (None, "one", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string").repartition(3)


@pytest.fixture(scope="session")
def odd_rows(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.collect()]


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def same(df, want, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(map(tuple, want), key=key)
