"""A training corpus from raw documents: five stages, each written and read again before the next.

toxicity: documents scored 0.5 or more go.
near_duplicates: of documents whose five-word shingles are about 0.8 alike or more, the one with the least doc_id stays.
repeats: byte strings of 100 or more that start earlier in the corpus go from the texts.
secrets: each found secret gives way to a mark.
packing: the texts' token ids in sequences of 2048, a row per piece.

A null text is empty. All stages but the last return the columns they are given; n_chars, if there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.llm import packing, secrets, simhash, suffix, toxicity
from motley.llm.common import stored, table, tokenizer_path


REST = "__rest"
#: Words that a worker keeps in the last stage, after others have used its memory.
WORDS = 250_000


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name of theirs meets one of an operator's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias(REST)] if rest else []))


def _wide(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(REST)[c].alias(c) for c in docs.columns])


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _wide(toxicity.scored(_narrow(docs), model).where("predicted = 0"), docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = suffix.numbered(_narrow(docs))
    return _wide(rows.join(simhash.kept_documents(rows, key="sid"), "sid", "left_semi"), docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix.without_repeats(_narrow(docs), whole=True)
    left = F.col("kept").cast("string")
    return _counted(_wide(cut.withColumn("text", F.when(F.col("n_removed") > 0, left).otherwise(F.col("text"))), docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(_wide(secrets.redacted(_narrow(docs)), docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), words=WORDS)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("repeats", remove_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No SQL: learnt scores, fingerprints and token ids are beyond it. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
