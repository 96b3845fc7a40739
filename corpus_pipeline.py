"""From raw documents to packed training sequences: five stages, each one operator of splinebrook.llm.

Each stage takes all documents that its predecessor kept and returns a table with the columns of documents, the last one
the pieces of packed sequences. Between stages the table is written as Parquet and read again.

Rows may have null or repeated ids, null, empty and very long texts, and repeat each other; a stage judges each by its text.
Null and empty texts have no letter, so they go with the language stage. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splinebrook.llm import lang_id, packing, simhash, substring_dedup, toxicity
from splinebrook.llm.common import checkpoint, delete, maybe_in, read_table, scratch_path
from splinebrook.llm.queries import remainder

#: A document stays if its language has this share of it at least; an even mix of three languages has more.
LEAST_SHARE = 0.3


#: What an operator that takes beside(docs) has to carry.
CARRIED = ("text", "row")


def beside(docs: DataFrame) -> DataFrame:
    """doc_id and text with the row's other columns beside them. The text is not among these, so that it travels once."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(True).alias("none")])).alias("row"))


def column(name: str) -> F.Column:
    """A column of the documents, of what was carried."""
    return F.col(name) if name in ("doc_id", "text") else F.col("row")[name].alias(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no clear language; fills in languages that are missing."""
    model = lang_id.train(docs, remainder(F.col("doc_id"), 5) != 0)
    found = lang_id.identify(beside(docs), model, carry=CARRIED)
    kept = found.filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else column(c) for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), lambda i: remainder(i, 3) != 1)
    return toxicity.score(beside(docs), model, carry=CARRIED).filter("predicted = 0").select(*map(column, docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest id. Repeated rows count as copies.

    A row is judged by its own text: others that share its id, or have none either, are copies only if their texts are.
    """
    verdicts = checkpoint(simhash.copies(docs).withColumn("__both", F.xxhash64("doc_id", "key")))
    # the few that may have to go meet their verdicts in a join; the others stay where they are
    keyed = docs.withColumn("__key", simhash.text_key()).withColumn("__both", F.xxhash64("doc_id", "__key"))
    flagged = maybe_in(keyed, "__both", verdicts.select("__both"), hit="__hit")
    sure = flagged.filter("NOT __hit").select(*docs.columns)
    asked = flagged.filter("__hit").alias("d").join(verdicts.alias("v"), F.expr("d.doc_id <=> v.doc_id AND d.__key = v.key"), "left")
    kept = asked.filter("v.n IS NULL OR v.stays").select("d.doc_id", "d.__key", F.struct(*[F.col(f"d.{c}") for c in docs.columns]).alias("row"))
    return sure.unionByName(kept.groupBy("doc_id", "__key").agg(F.min("row").alias("row")).select("row.*"))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that occur more than once; n_chars follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = substring_dedup.remove_repeats(docs.select("doc_id", "text", F.struct(*rest).alias("row")) if rest else docs, carry=("row",) if rest else ())
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[values.get(c, F.col("row")[c] if rest else None).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", clean),
    ("near-dedup", distinct),
    ("substring-dedup", unrepeated),
    ("packing", packed),
]

#: No SQL: the stages rest on a trained classifier and on XXH64 fingerprints; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; what the stages before it wrote is deleted once it has been read."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
