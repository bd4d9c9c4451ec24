"""The queries that SQL can express, and the pipeline against its stages' plain meaning."""

import collections
import hashlib
import re
import sys
from pathlib import Path

import public_tokenizers
import pytest

from compare import of_duckdb, of_spark
from lexframe.llm import queries
from lexframe.llm._common import written

sys.path.insert(0, str(Path(__file__).parent))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    assert of_spark(queries.queries()[name](spark, sf_dir)) == of_duckdb(queries.oracle_sql()[name], sf_dir)


def plain_cut(docs, length=35):
    """Texts without the words of repeated windows, by plain loops."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs.items()}
    counts = collections.Counter(tuple(w[p : p + length]) for w in words.values() for p in range(len(w) - length + 1))
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - length + 1) if counts[tuple(w[p : p + length])] > 1 for q in range(p, p + length)}
        out[i] = " ".join(x for q, x in enumerate(w) if q not in gone) if gone else docs[i]
    return out


def test_pipeline_stage_by_stage(spark, sf_dir):
    """What each stage keeps of what the stage before kept, against plain versions."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from lexframe.llm.quality import score_quality
    from test_nearcopies import plain_components
    from test_operators import plain_hits

    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    first = read("documents")
    inputs, docs = [], first
    for name, stage in p.STAGES:
        inputs.append({r.doc_id: r.text for r in docs.collect()})
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        if name != p.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.filter("n_chars <> length(text)").count() == 0
    everything, good, once, cut, clean = inputs
    scores = {r.doc_id: r.score for r in score_quality(first, read("labels")).collect()}
    assert good == {i: t for i, t in everything.items() if scores[i] >= 0.7} and len(good) > 0.7 * len(everything)
    assert once == {i: good[i] for i in {c for _, c in plain_components(list(good.items()))}} and len(once) < len(good)
    assert cut == plain_cut(once) and cut != once
    hits = plain_hits(list(cut.items()), [(r.item_id, r.text) for r in read("benchmark").collect()], 10)
    assert clean == {i: t for i, t in cut.items() if not hits[i][1]} and len(clean) < len(cut)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(clean)
    for i, text in clean.items():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert bytes(got[i].ids) == b"".join(x.to_bytes(4, "little") for x in ids) and got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf_dir):
    import corpus_pipeline as p

    body = " ".join(f"w{i}" for i in range(80))
    rows = [(1, body, "en", "s", len(body)), (1, body, "en", "s", len(body)), (2, None, "en", "s", None), (3, "", "en", "s", 0), (None, body, None, None, None), (4, "x" * 70_000, "en", "s", 70_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (odd, odd.limit(0)):
        for name, stage in p.STAGES:
            got = stage(spark, table, sf_dir)
            assert got.count() <= table.count()
            if name != p.STAGES[-1][0]:
                assert got.columns == table.columns
    assert sorted(str(r.doc_id) for r in p.near_dedup(spark, odd, sf_dir).collect()) == ["1", "2", "4"]
    assert {(r.doc_id, r.text) for r in p.substring_dedup(spark, odd, sf_dir).collect()} == {(1, ""), (2, None), (3, ""), (None, ""), (4, "x" * 70_000)}
