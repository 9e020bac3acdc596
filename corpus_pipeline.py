"""From raw documents to token ids: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's rows to the shared folder and reads them again, so a
lost executor never undoes more than the stage at work.

1. quality_rules: documents that the rules or the isolation forest reject go.
2. ngram_jaccard_join: one document of each near-duplicate class stays, that of
   the smallest id.
3. decontamination: documents contaminated with benchmark items go.
4. secret_scans: every secret found is replaced by a mark, and n_chars follows.
5. byte_bpe: texts become token ids; ``round_trip`` says that they decode to
   the very same bytes.

Defined results: other columns of documents go through all stages, also where
their names are those of an operator's columns (the last stage's own replace
them); a null text has no words, so the quality rules reject it, and in the other
stages it stays null and has no tokens; rows of one id and one text are one
document; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.llm import byte_bpe, decontaminate, near_dup, quality_rules, secret_scan
from regionflow.llm.common import discard, stored, table


def bare(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the other columns as one, so that none meets a name of an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def as_documents(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows of ``bare``."""
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = quality_rules.fit_forest(docs, table(spark, sf_dir, "labels"))
    return as_documents(quality_rules.judge(bare(docs), forest).where("kept"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_documents(near_dup.one_of_each(bare(docs)), docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(bare(docs), table(spark, sf_dir, "benchmark"))
    return as_documents(found.where("NOT contaminated"), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = as_documents(secret_scan.redact(bare(docs), secret_scan.ledger_of(spark)), docs)
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return masked.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns]) if "n_chars" in docs.columns else masked


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.decode_bpe(byte_bpe.encode_bpe(bare(docs), ranks), ranks)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = ("n_tokens", "token_ids", "round_trip")
    rest = [F.col("doc_id") if c == "doc_id" else F.col(f"_rest.`{c}`") for c in docs.columns if c != "text" and c.lower() not in own]
    return done.select(*rest, "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("secret_scans", mask_secrets),
    ("byte_bpe", to_tokens),
]

#: SQL can express neither the forest nor the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
