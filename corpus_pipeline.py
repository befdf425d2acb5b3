"""From raw documents to packed training sequences: five stages, each applied to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import _store, decontamination, language_id, minhash_dedup, packing, pii

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Model-based stages and tokens cannot be had in SQL.
ORACLE_SQL = None

#: Bands that propose a pair at the threshold itself with a probability of 1 - (1 - 0.8**7)**48 = 0.99999.
NEAR = minhash_dedup.Params(percent=80, bands=48, rows=7)


def _carried(docs: DataFrame) -> DataFrame:
    """docs under numbered names but for the text, so that no name of theirs meets a name an operator adds."""
    return docs.select(*[F.col(c).alias("text" if c == "text" else f"c{k}") for k, c in enumerate(docs.columns)])


def _named(carried: DataFrame, docs: DataFrame, **values: Column) -> DataFrame:
    """Back to the columns of docs, with other values for some."""
    own = {c: F.col("text" if c == "text" else f"c{k}") for k, c in enumerate(docs.columns)}
    return carried.select(*[values.get(c, v).alias(c) for c, v in own.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language of the corpus, go; the rest stays as it is.

    Languages are learnt from all documents outside the held-out fold that have
    a language and a text.  Null and empty texts go; very long ones are counted
    in segments; repeated rows are judged alike; of an empty table, or one
    without languages, nothing stays."""
    model = language_id.fit(docs.where(~language_id.held_out()).select("lang", "text"))
    return _named(language_id.identify(_carried(docs), model).where("NOT rejected"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates stays; so do rows without an id.

    Of rows that repeat an id and its text one stays.  An id on rows with
    several texts counts as a document for each text, of which the smallest by
    id and a hash of the text stays.  Null and empty texts stay; a text of any
    length is compared whole; an empty table gives none; the columns are those of docs."""
    known = docs.where("doc_id IS NOT NULL")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    many = _store.save(known.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(text_hash) < F.max(text_hash)).alias("several")).where("n > 1").select("doc_id", "several"), "repeated")
    if not many.take(1):
        dropped = minhash_dedup.minhash_components(docs.select("doc_id", "text"), NEAR).where("doc_id IS NOT NULL AND NOT kept").select("doc_id")
        return docs.join(_store.small(_store.save(dropped, "dropped")), "doc_id", "left_anti").select(*docs.columns)
    carried = _carried(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    key = f"c{docs.columns.index('doc_id')}"
    carried = carried.withColumn("row", F.when(F.col(key).isNotNull(), F.xxhash64(key, F.col("text").cast("string"))))
    found = minhash_dedup.minhash_components(carried.select(F.col("row").alias("doc_id"), "text"), NEAR).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("row"), "component_id").distinct()
    first = F.min(F.struct(F.col(key).alias("id"), F.col("row"))).alias("first")
    stay = found.join(carried.where("row IS NOT NULL").select(key, "row").distinct(), "row").groupBy("component_id").agg(first).select("first.row")
    left = carried.where("row IS NOT NULL").join(_store.save(stay, "stay"), "row", "left_semi")
    many = _store.small(many.select(F.col("doc_id").alias(key)))
    once = left.join(many, key, "left_anti").unionByName(left.join(many, key, "left_semi").dropDuplicates(["row"]))
    return _named(once.unionByName(carried.where("row IS NULL")), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; the rest stays as it is.

    Null and empty texts hold none and stay, very long ones are searched whole;
    repeated rows are judged alike; an empty benchmark removes nothing."""
    return _named(decontamination.remove_contaminated(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are replaced by their sanitised form, and n_chars follows.

    Null texts stay null; rows are kept one for one, repeated ones alike."""
    return _named(pii.sanitise(_carried(docs)), docs, text=F.col("clean"), n_chars=F.length("clean").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece, with its place.

    Null and empty texts are pieces of the end id alone; longer documents than
    a sequence are cut; repeated rows are packed each; an empty table gives none."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", sanitise),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    _store.shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = _store.save(docs, f"stage-{name}")
    return docs
