"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexframe.llm._common import bounded_batches, tidy
from lexframe.llm.bpe import byte_batches, codec_of


@lru_cache(maxsize=2)
def _library(kind: str, spec: bytes):
    """texts -> numbers of tokens, by the library for the file; made once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec.decode())
    made.no_padding()
    made.no_truncation()
    return lambda texts: [len(x) for x in made.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_level(spec: bytes) -> bool:
    """Whether this library's own batch encoder covers a tokenizers file: byte-level BPE, nothing else around it."""
    import json

    data = json.loads(spec)
    model, before = data["model"], data.get("pre_tokenizer") or {}
    return (
        model.get("type") == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not data.get("normalizer")
        and not data.get("post_processor")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token"))
        and not any(t.get(k) for t in data.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    )


def token_count(spark: SparkSession, tokenizer_path: str, text: str | Column = "text", *, piece_chars: int = 16_384, batch_bytes: int = 1 << 20) -> Column:
    """A column with the number of tokens of a text column.

    tokenizer_path: a .json file (tokenizers) or a .model file (sentencepiece). It is read on
    the driver and sent to the tasks once; a vocabulary has a fixed size. Byte-level BPE files go through
    the batch encoder of lexframe.llm.bpe, others through their library. Batches hold about
    batch_bytes bytes (UTF-8) whatever the number of rows; longer texts are cut at safe boundaries into pieces of
    about piece_chars characters. (Texts for .model files and for .json files with other pre-tokenizers stay whole:
    their pieces depend on what is before them.) Special strings inside a text are handled as is the library's default; no begin,
    end or padding tokens are added, nothing is truncated. Null and empty texts have 0 tokens. Only
    integers leave the Python workers.
    """
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    kind = "model" if tokenizer_path.endswith(".model") else "bytes" if _byte_level(spec) else "json"
    sent = spark.sparkContext.broadcast(spec.decode() if kind == "bytes" else spec)

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if kind == "bytes":
            codec = codec_of(sent.value)

            def lengths(texts: list[str]) -> list[int]:
                return [len(x) // 4 for x in codec.batch(texts)]
        else:
            lengths = _library(kind, sent.value)
        for column in batches:
            total = np.zeros(len(column), dtype=np.int64)
            rows = ((i, x) for i, v in enumerate(column) if (x := v.as_py()))
            for batch in byte_batches(rows, piece_chars if kind == "bytes" else 1 << 62, batch_bytes):
                np.add.at(total, [i for i, _ in batch], lengths([p for _, p in batch]))
            yield pa.array(total)
        tidy()

    return count(F.col(text) if isinstance(text, str) else text)


def count_tokens(df: DataFrame, tokenizer_path: str, *, text: str = "text", limit: int = 512) -> DataFrame:
    """df with n_bytes (UTF-8, long), n_tokens (long) and over_limit (n_tokens > limit).

    Any other columns stay; columns of these three names are replaced. Repeated rows are counted
    each; an empty table gives an empty result. One pass over the rows, no shuffle.
    """
    bounded_batches(df.sparkSession)
    return (
        df.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
        .withColumn("n_tokens", token_count(df.sparkSession, tokenizer_path, text))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )
