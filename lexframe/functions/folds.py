"""Folds of names and texts to comparison keys (X1) and tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@arrow_udf(T.StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        yield pa.array([None if (x := v.as_py()) is None else unicodedata.normalize("NFKC", x) for v in column], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition; needed only where a text has characters past ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def fold_key(text: Column, *, ascii_only: bool = False) -> Column:
    """Lower case, letters a-z and digits only: 'FW Act' and 'fwact' are one key. Null stays null.

    ascii_only leaves out the NFKC step, which needs a Python worker.
    """
    return F.regexp_replace(F.lower(text if ascii_only else nfkc(text)), "[^a-z0-9]", "")


def fold_words(text: Column) -> Column:
    """Lower case, every run of other characters one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case; quotes, zero-width characters and emphasis marks dropped, dashes '-', white space one space."""
    out = F.regexp_replace(text, "[​‌‍⁠﻿*_`\"'‘’“”]", "")
    out = F.regexp_replace(out, "[‐-―−]", "-")
    return F.lower(F.trim(F.regexp_replace(out, "[\\s   ]+", " ")))


#: Words that don't tell titles apart.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")


def stem_tokens(text: Column) -> Column:
    """The folded words of a text without stop words, plural and participle endings cut off."""
    words = F.filter(F.split(fold_words(text), " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.transform(words, lambda w: F.when(F.length(w) > 5, F.regexp_replace(w, "(ings|ing|ies|ed|es|s)$", "")).otherwise(w))
