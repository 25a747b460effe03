"""Helpers shared by the operators of this folder: tables, names, word rules."""
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetsieve.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def one_space(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    folder = os.environ.get("TOKENIZER_FOLDER")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def one_row_each(docs: DataFrame, chosen: DataFrame, doc_id="doc_id", text="text", also: str | None = None) -> DataFrame:
    """The rows of a table that are chosen by id and xxhash64 of the text (doc_id, text_hash, distinct),
    with the column `also` of the choice. Rows that are equal in both are one document: one of them stands for all."""
    own, name, many = fresh(docs, "text_hash", "chosen_id", "many")
    rows = docs.withColumn(own, F.xxhash64(text))
    chosen = chosen.select(F.col("doc_id").alias(name), F.col("text_hash").alias(own), *([also] if also else []))
    repeats = cut(docs.select(F.col(doc_id).alias(name), F.xxhash64(text).alias(own)).groupBy(name, own).agg(F.count("*").alias(many)).filter(F.col(many) > 1))
    same = lambda a, b: a[own].eqNullSafe(b[own]) & a[doc_id].eqNullSafe(b[name])
    found = rows.join(chosen, same(rows, chosen)).select(rows["*"], *([chosen[also]] if also else []))
    if not repeats.isEmpty():
        again = repeats.select(own, name)
        once = found.join(again, same(found, again), "left_anti")
        found = once.unionByName(found.join(again, same(found, again), "left_semi").dropDuplicates([doc_id, own]))
    return found.select(*docs.columns, *([also] if also else []))
