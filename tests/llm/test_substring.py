"""Substring dedup against a brute-force version."""

import collections
import random
import re

import pytest

from lexframe.llm.substring import dedup_text, level_lengths, remove_repeats


def plain(texts, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        hit = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                hit.update(range(i, i + length))
        out.append((len(w), len(hit), " ".join(x for i, x in enumerate(w) if i not in hit)))
    return out


def got(df, length):
    return [(r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, length=length).orderBy("n").collect()]


def table(spark, texts):
    return spark.createDataFrame([(i, None if i % 5 == 4 else i // 2, t) for i, t in enumerate(texts)], "n int, doc_id long, text string")


def test_lengths():
    assert level_lengths(35) == [18, 35] and level_lengths(70) == [18, 35, 70] and level_lengths(5) == [5] and level_lengths(32) == [16, 32]


def test_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = plain([r.text for r in rows], 35)
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=35).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in found] == want and sum(x[1] for x in want) > 0


@pytest.mark.parametrize("length", [1, 4, 17, 35, 70])
def test_random_texts(spark, length):
    rng = random.Random(length)
    shared = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = [None, "", " \n ", "a " * 300, "a " * 40, "b a " * 30, shared[0], shared[0], shared[0]]
    for _ in range(40):
        texts.append("\t".join(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choices("xyzé", k=5)) for _ in range(rng.randint(1, 12))))
    assert got(table(spark, texts), length) == plain(texts, length)


def test_extra_columns_and_empty(spark):
    texts = ["p q r s", "p q r s t"]
    wide = table(spark, texts).selectExpr("*", "'x' as kept", "7 as n_words", "8 as blocks2", "9L as n_chars")
    out = dedup_text(wide, length=4)
    assert out.columns == wide.columns and {(r.text, r.kept, r.n_chars) for r in out.collect()} == {("", "x", 0), ("t", "x", 1)}
    assert remove_repeats(table(spark, texts).limit(0)).count() == 0
