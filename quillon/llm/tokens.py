"""A corpus as token ids of a public byte-level BPE vocabulary, and back."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import bounded

#: Fixed value: how the vocabulary's authors split a text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place where the pattern always starts a new piece, whatever stands before it: a blank or line break after a mark.
SAFE = regex.compile(r"(?<=\S)(?=[ \n])")


def default_rank_file() -> str:
    """The rank file of ``byte_bpe_50k`` on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(rank_file: str | None = None):
    """The tokenizer of a local rank file; read once a worker."""
    import tiktoken

    with open(rank_file or default_rank_file(), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int) -> list[str]:
    """The text cut at safe places into parts of about ``size`` characters; a part without one stays whole."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def encode_text(enc, text: str, size: int) -> list[int]:
    """Ids of a text; the same as for the text in one piece."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in enc.encode_ordinary(part)]


def encode(df: DataFrame, id_col: str, text_col: str, *, rank_file: str | None = None, piece: int = 1 << 16) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens.

    Null and empty texts give an empty list; every row of ``df`` gives a row, repeated
    ones too. Strings that look like special tokens are ordinary text. Texts
    of more than ``piece`` characters are encoded in parts that change no id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for batch in bounded(batches, "_text"):
            ids = [encode_text(enc, t, piece) if t else [] for t in batch.column("_text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["_id", "ids"])

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def count_tokens(df: DataFrame, text_col: str, out: str = "n_tokens", *, rank_file: str | None = None, piece: int = 1 << 16) -> DataFrame:
    """``df`` with the number of token ids of each text as long; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(rank_file)
        for texts in parts:
            yield pd.Series([len(encode_text(enc, t, piece)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out, counted(F.col(f"`{text_col}`").cast("string")))


def decode(df: DataFrame, id_col: str, ids_col: str, *, rank_file: str | None = None) -> DataFrame:
    """(id, text): the texts of lists of ids, decoded as raw bytes; bytes that are no UTF-8 become U+FFFD. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for batch in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], ["_id", "text"])

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("_ids"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
