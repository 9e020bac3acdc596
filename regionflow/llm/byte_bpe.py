"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A long text is cut at safe boundaries before encoding: between a character that
isn't white space and a following blank or line end, every match of the
splitting pattern ends, so the parts' ids joined are the whole text's ids.
Ids travel as little-endian unsigned 32-bit integers in one binary column (the
form that training loaders map into memory); decoding gives raw bytes.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded each; an empty table gives an empty table; input
columns are kept and clashing ones replaced.  A text without any safe boundary
is encoded in one piece.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, table, texts_of

#: Texts of more code points than this are cut at safe boundaries.
PART_CHARS = 1 << 16

_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


def safe_parts(text: str, most: int = PART_CHARS) -> list[str]:
    """text in order, each part at least ``most`` code points long but the last, cut at safe boundaries only."""
    parts, start = [], 0
    while len(text) - start > most and (m := _CUT.search(text, start + most)):
        parts.append(text[start : m.start()])
        start = m.start()
    parts.append(text[start:])
    return parts


def encoding(rank_file: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_bpe(df: DataFrame, rank_file: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with token_ids (binary, little-endian uint32) and n_tokens."""
    added = T.StructType().add("token_ids", "binary").add("n_tokens", "long")

    def make():
        import numpy as np

        bpe = encoding(rank_file)

        def f(batch):
            ids = [np.array([i for p in safe_parts(t) for i in bpe.encode_ordinary(p)] if t else [], "<u4") for t in texts_of(batch, text_col)]
            return {"token_ids": [x.tobytes() for x in ids], "n_tokens": [len(x) for x in ids]}

        return f

    return arrow_map(df, added, make, text_col, () if keep_text else (text_col,))


def decode_bpe(df: DataFrame, rank_file: str, ids_col: str = "token_ids") -> DataFrame:
    """df with decoded, the raw bytes of its ids; a null stands for no ids."""
    added = T.StructType().add("decoded", "binary")

    def make():
        import numpy as np

        bpe = encoding(rank_file)
        return lambda batch: {"decoded": [bpe.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in texts_of(batch, ids_col)]}

    return arrow_map(df, added, make, ids_col)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode_bpe(encode_bpe(docs, ranks, keep_text=False), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
