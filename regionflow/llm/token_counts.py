"""Token counts: batch encoding in Arrow functions that return lengths only.

``count_tokens`` counts the tokens of every whole text with the tokenizer's own
library.  Texts come in batches balanced by bytes.  A text for sentencepiece is
split at safe boundaries, single blanks between two other characters: no piece
of such a vocabulary crosses one (checked when the model is read), and the
blank itself becomes the marker that starts the next piece.  Equal parts have
equal counts, so a task encodes each distinct part of a batch once.

Defined results: a null or empty text has 0 bytes, 0 tokens and isn't over the
limit; repeated rows are counted each; an empty table gives an empty table;
input columns are kept and clashing ones replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, table, texts_of

#: Distinct parts that a task remembers between batches.
KNOWN_PARTS = 200_000
#: Parts longer than this (code points) are encoded each time, not remembered.
LONG_PART = 80

_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


class PieceCounter:
    """Counts with sentencepiece, by parts where that is safe."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}
        size = self.model.get_piece_size()
        inner = any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(size))
        enc = self.model.encode
        probes = ["x y", "is it\n so", "a é 1", "Q. R"]
        self.split = not inner and all(enc(p) == sum((enc(x) for x in p.split(" ")), []) for p in probes)

    def parts(self, text: str) -> list[str]:
        if not self.split:
            return [text]
        if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
            return _SAFE.split(text)
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > KNOWN_PARTS:
            known.clear()
        split = [self.parts(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(known)) if split else []
        found = dict(zip(new, map(len, self.model.encode(new, num_threads=1)))) if new else {}
        known.update((p, n) for p, n in found.items() if len(p) <= LONG_PART)
        out = []
        for parts in split:
            out.append(sum([known[p] if p in known else found[p] for p in parts]))
        return out


class JsonCounter:
    """Counts with tokenizers; whole texts, as its normalizers may look anywhere."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


def counter(path: str):
    return JsonCounter(path) if path.endswith(".json") else PieceCounter(path)


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096, keep_text: bool = True) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    added = T.StructType().add("n_bytes", "long").add("n_tokens", "long")

    def make():
        model = counter(model_path)

        def f(batch):
            texts = [t or "" for t in texts_of(batch, text_col)]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": model.counts(texts)}

        return f

    drop = ("over_limit",) if keep_text else ("over_limit", text_col)
    return arrow_map(df, added, make, text_col, drop).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False).select("doc_id", "n_bytes", "n_tokens", "over_limit")
