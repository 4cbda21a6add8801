"""A training corpus from the documents table, in stages that each write Parquet for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import decontaminate, jaccard, mixing, tokenbin, toxicity
from vacantia.llm.shared import Scratch, own_names


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic. Null and empty texts and repeated rows are judged like others, each row alone; equal texts score alike."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id; of several texts with that id the one with the smallest hash, once (of rows that agree in both, the one with the smallest hash of all columns).

    Texts that share an id are told apart: each is judged in its own group. A document without an id goes if a group of its text's near duplicates has one with an id;
    of those that have none, the one with the smallest hash stays. Null and empty texts, and texts without words, link with nothing and stay, each once for an id.
    """
    none, id_, hash_, row = own_names(docs, "text_none", "text_id", "text_hash", "text_row")
    keyed = docs.withColumns({none: F.col("doc_id").isNull(), id_: F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), hash_: F.xxhash64("text")})
    key = F.struct(F.col(none).alias("none"), F.col(id_).alias("id"), F.col(hash_).alias("hash"))
    found = jaccard.near_duplicate_components(keyed.select(key.alias("doc_id"), "text"), most_blocks=1, largest_block=5000)
    kept = found.where("doc_id = component_id").selectExpr(f"doc_id.none as {none}", f"doc_id.id as {id_}", f"doc_id.hash as {hash_}").distinct()
    one = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    # Joined and grouped by the same plain columns, so that the texts are shuffled once.
    return keyed.join(kept, [none, id_, hash_]).groupBy(none, id_, hash_).agg(one.alias(row)).select(f"{row}.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows of 13 words. Each row is judged alone; without words it stays."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: some documents left out, some taken twice. A null source is one of its own; equal rows are decided one by one; texts without words are left out or kept by the same chance."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table of the mix, written and read back: doc_id, start, n_tokens, ids_crc32. Null texts are empty, null ids come first, equal ids go by their texts."""
    import public_tokenizers

    return tokenbin.token_table_report(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", without_toxic), ("ngram_jaccard", one_of_each_group), ("decontamination", decontaminated), ("source_mix", mixed), ("token_ids", token_ids)]
#: Nearest neighbours, components, the cube method and tokenizers have no SQL form: tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"{k}_{name}")
    return docs
