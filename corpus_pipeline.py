"""Corpus pipeline over `documents`: five stages, each stored before the next one reads it.

1. toxicity: documents scored 0.5 or more go;
2. near duplicates: of each component of near copies (five-word shingles, similarity 0.8) the least doc_id stays;
3. substring dedup: words of 13-word windows that an earlier document has too are removed from the texts, which are
   changed only where something is removed; n_chars follows; a text left without words stays as an empty one;
4. benchmark decontamination: contaminated documents go;
5. packing: the rows are the pieces of all documents left, with their places in sequences of 1024 tokens.

All stages but the last return the columns of `documents`. Every stage works on all rows its predecessor kept; null texts
and null doc_ids have each operator's defined result (a null doc_id is never a duplicate and is kept). Columns of the documents
keep their values also where an operator's result has their name. The stages are not
expressible in SQL (fitted classifier, tokenizer), so ORACLE_SQL is None and tests compare them with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.decontam import contaminated, find_contamination
from lathe.llm.neardup import near_duplicates
from lathe.llm.packing import pack_documents
from lathe.llm.queries import fold, table
from lathe.llm.store import release, written
from lathe.llm.substring import remove_repeats
from lathe.llm.toxicity import fit, score

ORACLE_SQL = None


def apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """(`docs` under names of no operator's result but for doc_id and text, expressions that give its columns back)."""
    names = [c if c in ("doc_id", "text") else f"of_document_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = apart(docs)
    model = fit(rows, table(spark, sf_dir, "labels"), learn=fold("doc_id") != 0)
    return score(rows, model).where("predicted = 0").select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each component stays; rows that share a doc_id are one document, of which equal texts stay once."""
    found = near_duplicates(docs.select("doc_id", "text"), keep=["doc_id"])
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.take(1):
        return left
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = apart(docs)
    changed = F.col("n_removed") > 0
    found = remove_repeats(rows).withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        kind = docs.schema["n_chars"].dataType
        back[at] = F.when(changed, F.length("text").cast(kind)).otherwise(F.col(f"of_document_{at}")).alias("n_chars")
    return found.select(back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = apart(docs)
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"))
    return found.where(~contaminated()).select(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
