"""Small tables with awkward rows, and plain versions of what the operators must give."""

import re

from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SHAPE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use for columns of their own
        *[T.StructField(n, T.StringType()) for n in ("clean", "copies", "unit", "size", "cls", "part", "rid", "norm", "component", "score", "kept")],
    ]
)
BASE = " ".join(f"word{i % 97} plain{i % 13} text{i}" for i in range(40))
LINE = "the quick brown fox jumps over the lazy dog near the old river bank today"


def documents(spark):
    texts = [
        (1, BASE, "a"),
        (2, BASE, "a"),  # a copy
        (3, BASE + " and one more end", "b"),  # a near copy
        (4, None, "b"),
        (5, "", None),
        (6, " \t\n ", "c"),
        (7, "three short words", "c"),
        (8, "THREE short\twords", "a"),
        (9, "lone", "a"),
        (10, f"first head of a text\n{LINE}\ntail one", "a"),
        (11, f"second head of a text\n{LINE.replace('lazy', 'lazi')}\ntail two", "b"),
        (12, " ".join(f"long{i * 7919 % 4001}" for i in range(20_000)), "a"),
        (13, "x" * 50_000, "b"),
        (14, "grüße 你好 \U0001f600 naïve <|endoftext|> cc by all rights reserved", "c"),
        (14, "grüße 你好 \U0001f600 naïve <|endoftext|> cc by all rights reserved", "c"),  # a repeated row
        (None, "no identifier here", "a"),
    ]
    rows = [(i, t, "xx", s, None if t is None else len(t), *["?"] * 11) for i, t, s in texts]
    return spark.createDataFrame(rows, SHAPE)


def none(spark):
    return spark.createDataFrame([], SHAPE)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = WORDS.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
