"""Corpus pipeline: documents through the cleaning stages and into packed
sequences, each stage's result written and read again as the next one's
documents.  A stage works on all rows its predecessor kept, and each row
follows its own verdict, whether its id is null, shared or its own: language
and benchmark judge a row by its text, lines works on rows, and near_dup gives
the rows that an id does not tell apart keys of their own.  An empty table
stays one; all columns are kept, whatever their names; ``n_chars`` follows the
text where there is such a column."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.catalog import digest_pieces
from sitewise.llm.decontam import decontaminate, words
from sitewise.llm.langid import identify
from sitewise.llm.line_dedup import dedup_lines
from sitewise.llm.near_dup import near_duplicates
from sitewise.llm.packing import pack
from sitewise.llm.scratch import broadcast_if_small, drop, materialise, short_batches, tables

# Language ID by a trained network, SimHash and MinHash groups and packing by
# a tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None

MIN_SCORE = 0.5  # of the predicted language


_left: list[DataFrame] = []  # tables that the last stage's result still reads


def frees(stage):
    """A stage whose tables are dropped when the next one starts, as its
    result is written by then.  What it writes itself goes to Python in short
    batches."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(*[t for t in _left if t.sparkSession.sparkContext is spark.sparkContext])
        _left.clear()
        with tables() as made, short_batches(spark):
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out
    return run


def _key(text: Column) -> Column:
    """Digest of a text, 16 bytes; of no bytes for null."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def _without(docs: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """Rows whose text is not among those of ``verdicts`` (out_key)."""
    out = broadcast_if_small(materialise(verdicts.select("out_key").distinct(), f"{name}-out"))
    return docs.join(out, _key(docs["text"]) == out["out_key"], "left_anti").select(*_all(docs))


def _all(docs: DataFrame) -> list[Column]:
    return [docs[f"`{c}`"] for c in docs.columns]


@frees
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without a clear one, go; a missing
    label is filled with the prediction.  Null and empty texts, and those
    without a letter, have no language."""
    rows = docs.select("doc_id", "text", "lang", _key(F.col("text")).alias("out_key"))
    found = materialise(identify(rows, carry=["out_key"]).select("rest.out_key", "lang_pred", "score"), "lang")
    kept = _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < MIN_SCORE)), "lang")
    label = found.groupBy("out_key").agg(F.max_by("lang_pred", "score").alias("out_lang"))
    unlabelled = kept.where(kept["lang"].isNull())
    named = unlabelled.join(label, _key(unlabelled["text"]) == label["out_key"], "left")
    lang = label["out_lang"].cast(docs.schema["lang"].dataType).alias("lang")
    named = named.select(*[lang if c == "lang" else unlabelled[f"`{c}`"] for c in docs.columns])
    return kept.where(kept["lang"].isNotNull()).unionByName(named)


@frees
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no word is left."""
    out = dedup_lines(docs, carry=[c for c in docs.columns if c != "text"])
    out = out.where((F.col("n_removed") == 0) | (F.size(words(F.col("text"))) > 0))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.length("text"))
        new["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"rest.{c}")).alias(c) for c in docs.columns])


@frees
def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest id.
    Rows with a null id, or with one that other rows have, come after all
    ids and are told apart by their text; of those equal in id and text one
    stays, whichever.  Texts without a word are in no group and stay."""
    shared = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1 or doc_id is null")
                         .select(F.col("doc_id").alias("shared_id")), "near-shared")
    same_id = docs["doc_id"].eqNullSafe(shared["shared_id"])
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    fresh = (docs.join(broadcast_if_small(shared), same_id, "left_semi")
             .select(F.col("doc_id").alias("shared_id"), _key(F.col("text")).alias("shared_text")).distinct())
    fresh = materialise(fresh.withColumn("fresh", F.monotonically_increasing_id() + last + 1), "near-fresh")
    few = broadcast_if_small(fresh)
    same_row = docs["doc_id"].eqNullSafe(few["shared_id"]) & (_key(docs["text"]) == few["shared_text"])
    rows = docs.join(few, same_row, "left").select(
        F.struct(*_all(docs)).alias("row"), docs["text"].alias("text"), few["fresh"].alias("fresh"),
        F.coalesce(few["fresh"], docs["doc_id"]).alias("key"))
    gone = materialise(near_duplicates(rows, id_col="key").where(~F.col("kept")).select(
        F.col("doc_id").alias("gone")).distinct(), "near-out")
    left = rows.join(broadcast_if_small(gone), F.col("key") == F.col("gone"), "left_anti")
    alone = F.col("fresh").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = left.where(~alone).groupBy("fresh").agg(F.first("row").alias("row"))
    return left.where(alone).select("row").unionByName(one.select("row")).select("row.*")


@frees
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null texts and those without a word stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(_key(F.col("text")).alias("out_key"), "text")
    found = decontaminate(rows, items, id_col="out_key").where("contaminated")
    return _without(docs, found.select(F.col("doc_id").alias("out_key")), "bench")


@frees
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return digest_pieces(pack(docs))


STAGES = [("language", language), ("lines", lines), ("near_dup", near_dup), ("benchmark", benchmark), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
