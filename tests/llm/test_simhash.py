"""SimHash near-duplicates against a brute-force version."""

import random
import re

import numpy as np
import xxhash

from lexframe.llm.golay import codeword_keys
from lexframe.llm.simhash import drop_near_duplicates, linked_fingerprints, near_duplicates, segment_keys

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(values):
    """fingerprint -> least fingerprint (as listed) it reaches."""
    label = {v: v for v in values}
    todo = True
    while todo:
        todo = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 4 and label[a] > label[b]:
                    label[a], todo = label[b], True
    return label


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = plain_labels(sorted({f for _, f in prints}))
    least = {}
    for i, f in prints:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return sorted(((i, f"{f:016x}", least.get(label[f])) for i, f in prints), key=str)


def got(df):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=str)


def test_golay_words_within_two_bits_share_a_key():
    rng = random.Random(5)
    for _ in range(3000):
        a = b = rng.getrandbits(23)
        for i in rng.sample(range(23), rng.randint(0, 2)):
            b ^= 1 << i
        keys, counts = codeword_keys(np.array([a, b]))
        assert set(counts) <= {1, 6} and set(keys[0]) & set(keys[1])


def test_fingerprints_within_four_bits_share_a_key():
    rng = random.Random(6)
    for _ in range(2000):
        a = b = rng.getrandbits(64)
        for i in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << i
        rows, keys = segment_keys(np.array([a, b], dtype=np.uint64).view(np.int64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_links_of_chosen_fingerprints(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        a = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            values.add(a)
            for i in rng.sample(range(64), rng.randint(1, 6)):
                a ^= 1 << i
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {}
    for v, w in plain_labels(sorted(values)).items():
        want.setdefault(w, set()).add(v)
    found = {}
    for r in linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect():
        found.setdefault(r.label, set()).add(r.fp & (1 << 64) - 1)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(near_duplicates(docs)) == plain_components([tuple(r) for r in docs.collect()])


def test_nulls_empty_ties_repeats(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "a b c d e f g"), (7, "A b C d e f g"), (7, "A b C d e f g"), (None, "zz"), (2, "one two three"), (4, "x " * 60000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(near_duplicates(df)) == plain_components(rows)
    wide = df.selectExpr("doc_id", "text", "1 as fp", "2 as component_id", "3 as key", "4 as _n")
    kept = drop_near_duplicates(wide.drop("_n")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 2, 3, 4, 7] and set(kept[0].asDict()) == {"doc_id", "text", "fp", "component_id", "key"}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).columns == ["doc_id", "fp", "component_id"] and near_duplicates(df).count() == 0
    assert drop_near_duplicates(df).count() == 0
