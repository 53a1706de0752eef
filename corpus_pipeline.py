"""A document pipeline: five stages, each one operator over all rows that its predecessor kept.

Every stage but the last returns the columns of its input, whatever further columns that has.
Null texts count as empty in all stages. Stages are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm import jaccard, langid, packing, pii, suffix_dedup
from panelforge.llm.common import concluded, documents, map_values, quoted, step_done, written

#: Texts whose best language has less than this share of the evidence are rejected.
MIN_LANGUAGE_SCORE = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """docs with another text, and n_chars, where there is one, counted again."""
    out = docs.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*map(quoted, columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of no clear language; learns from every row with a language.

    Written here, so that whole texts go to the workers and back in small Arrow batches.
    """
    model = langid.fitted(docs)
    # predicted() appends its two columns, so they are told apart by place from any of that name
    names = [f"c{i}" for i in range(len(docs.columns))]
    clear = (F.col("found") != langid.UNKNOWN) & (F.col("share") >= MIN_LANGUAGE_SCORE)

    def kept() -> DataFrame:
        judged = langid.predicted(docs, model, docs.columns).toDF(*names, "found", "share")
        return judged.where(clear).select(*names).toDF(*docs.columns)

    return concluded(kept, "clear")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near duplicates; of rows that repeat an id, the one with the least hash of its text stays.

    Rows with a null id are in no class and stay.
    """
    ids = concluded(lambda: jaccard.classes(docs, NEAR_WORDS, NEAR_PERCENT).select("doc_id", "component_id"), "near")
    stay = ids.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi")
    if ids.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rank = max(kept.columns, key=len) + "_"
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *[F.col(quoted(c)).cast("string") for c in sorted(kept.columns)])
        kept = kept.withColumn(rank, F.row_number().over(first)).where(F.col(quoted(rank)) == 1).drop(rank)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that stand in documents of smaller ids; characters cut in two go as well. Null ids stay whole."""

    def changed() -> DataFrame:
        rows = suffix_dedup.deduplicated(docs.select("doc_id", "text").where("doc_id IS NOT NULL"))
        return rows.where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept")

    cleaned = concluded(changed, "cleaned").dropDuplicates(["_id", "_hash"])

    def decode(parts: list) -> list[list]:
        return [[p.decode("utf-8", "ignore") for p in parts]]

    texts = map_values(cleaned, ["_id", "_hash"], "kept", "_text string", decode)
    joined = docs.join(texts, (docs["doc_id"] == texts["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == texts["_hash"]), "left")
    return _with_text(joined, F.coalesce("_text", docs["text"]), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind. Texts without any, null and empty ones stay as they are; so do all rows."""
    found = pii.detect(docs, "text", "_pii_spans")
    return _with_text(found, pii.redacted("text", "_pii_spans"), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all texts; pieces with their ids, sequence and place.

    Null texts are empty and have an end token only; rows that repeat an id are packed one by one.
    """
    path = public_tokenizers.path(packing.VOCABULARY)
    parts = written(packing.pieces(docs, path, packing.END, packing.CAPACITY), "pieces")
    return packing.packed(parts, packing.CAPACITY)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("sequences", sequences),
]
#: Language models, rolling hashes and tokenizers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one's is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = concluded(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if before is not None:
            step_done(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
