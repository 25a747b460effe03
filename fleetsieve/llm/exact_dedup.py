"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole.

Texts are compared after every run of ASCII white space became one space. The first pass keeps only
length and prefix hash; lengths that occur once and then prefixes that occur once are settled. Only
rows of the groups that are left have their whole text hashed (SHA-256) and grouped again. Groups are
counted by aggregation with map-side sums, so a group of any size is one row.
"""
from pyspark.sql import Column, DataFrame, functions as F

from fleetsieve.llm.common import fresh, one_space
from fleetsieve.session import cut

PREFIX = 256


def _marks(text: Column, prefix: int) -> list[Column]:
    same = one_space(text)
    return [F.length(same).alias("length"), F.xxhash64(F.substring(same, 1, prefix)).alias("head")]


def shared_heads(docs: DataFrame, text="text", prefix=PREFIX) -> DataFrame:
    """(length, head) of the groups that are left after length and prefix hash."""
    marks = cut(docs.select(*_marks(F.col(text), prefix)).groupBy("length", "head").agg(F.count("*").alias("n")))
    lengths = marks.groupBy("length").agg(F.sum("n").alias("all")).filter("all > 1").select("length")
    return marks.join(lengths, "length").filter("n > 1").select("length", "head")


def group_members(docs: DataFrame, doc_id="doc_id", text="text", prefix=PREFIX) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text as it is), text_sha256 of the rows in groups that are left."""
    heads = shared_heads(docs, text, prefix)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *_marks(F.col(text), prefix))
    return rows.join(heads, ["length", "head"], "left_semi").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.sha2(one_space(F.col("text")), 256).alias("text_sha256"))


def duplicate_groups(docs: DataFrame, doc_id="doc_id", text="text", prefix=PREFIX) -> DataFrame:
    """Groups of two or more equal texts: text_sha256, keep_id (smallest id that isn't null), group_size."""
    full = group_members(docs, doc_id, text, prefix)
    return full.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")


def exact_dedup(docs: DataFrame, doc_id="doc_id", text="text", prefix=PREFIX) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    Null counts as empty. Of rows that are equal in id and text one is kept. A group whose ids are all
    null keeps one row as well, under a null keep_id.
    """
    groups = duplicate_groups(docs, doc_id, text, prefix)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(one_space(F.col(text)), 256).alias("text_sha256"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()).join(groups, "text_sha256", "left").withColumn(
        "keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))))
    chosen = rows.filter("group_size > 1 and doc_id <=> keep_id").groupBy("text_sha256").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("chosen"))
    return rows.join(chosen, "row", "left").select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.coalesce("chosen", F.lit(False))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, doc_id="doc_id", text="text", prefix=PREFIX) -> DataFrame:
    """The table without the copies: of equal texts the row with the smallest id stays (null ids last).

    Who goes is settled on ids and hashes; whole rows are moved once, to be held against the list of
    those that go. Of rows equal in id and text one stays."""
    name, own = fresh(docs, "gone_id", "text_hash")
    members = cut(group_members(docs, doc_id, text, prefix).groupBy("text_sha256", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("kept")
    stays = members.groupBy("text_sha256").agg(first)
    kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    judged = cut(members.join(stays, "text_sha256").select(F.col("doc_id").alias(name), F.col("text_hash").alias(own), "n", kept.alias("stays"))
                 .filter("not stays or n > 1"))
    rows = docs.withColumn(own, F.xxhash64(text))

    def held(rows, keys, how):
        keys = keys.select(name, own)
        return rows.join(keys, (rows[own] == keys[own]) & rows[doc_id].eqNullSafe(keys[name]), how)

    once = held(rows, judged, "left_anti")
    again = judged.filter("stays")
    if not again.isEmpty():
        once = once.unionByName(held(rows, again, "left_semi").dropDuplicates([doc_id, own]))
    return once.select(*docs.columns)
