"""Matrices delivered feature by feature, one file per sample, or probe by probe.

In tall form a transpose is only a renaming, so none of these ever builds a wide frame."""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsieve.functions.text import to_number
from fleetsieve.session import written


def text_lines(spark, path: str) -> DataFrame:
    """file, line_pos, line of text files. Lines are numbered inside their split and the
    split start orders the splits, so large files are read in parallel."""
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row")).alias("line_pos"), F.col("value").alias("line")))


def feature_major(lines: DataFrame, sep: str = "\t", comment: str | None = None,
                  drop=("description",)) -> DataFrame:
    """file, feature, sample, value of matrices stored features x samples.

    The first line that is no comment names the samples; the first field of every other
    line is the feature. Text that is no number becomes missing."""
    if comment is not None:
        lines = lines.where(~F.col("line").startswith(comment))
    lines = lines.where(F.col("line") != "")
    heads = written(lines.groupBy("file").agg(F.min("line_pos").alias("line_pos")), "heads")  # a row per file: the lines stay where they are
    quoted = lambda c: F.regexp_replace(c, '^"|"$', "")
    sep_re = sep if sep != "|" else r"\|"
    fields = F.posexplode(F.split("part", sep_re)).alias("at", "text")
    place = (F.col("start") + F.col("at")).alias("i")
    head = (line_pieces(lines.join(heads, ["file", "line_pos"], "left_semi"), sep).select("file", "start", fields)
            .select("file", place, F.col("text").alias("name"))
            .where((F.col("i") > 0) & ~F.col("name").isin(*drop))
            .select("file", "i", quoted(F.col("name")).alias("sample")))
    body = (line_pieces(lines.join(heads, ["file", "line_pos"], "left_anti"), sep)
            .select("file", quoted(F.col("first")).alias("feature"), "start", fields)
            .select("file", "feature", place, "text").where(F.col("i") > 0))
    return body.join(head, ["file", "i"]).select(
        "file", "feature", "sample", to_number(F.col("text")).alias("value"))


PIECE = 1 << 15  # fields of a line that stay together


def line_pieces(lines: DataFrame, sep: str, size: int = PIECE) -> DataFrame:
    """file, first, start, part of the lines of files: the first field of a line, and its fields from ``start`` on, ``size``
    of them at most, still joined. A line may have a field for each of millions of samples: it is never an array of them."""
    def run(batches):
        for pdf in batches:
            for file, line in zip(pdf["file"], pdf["line"]):
                at = line.find(sep)
                first = line if at < 0 else line[:at]
                data = np.frombuffer(line.encode(), np.uint8)
                marks = np.flatnonzero(data == ord(sep))
                ends = [*marks[size - 1::size].tolist(), len(data)]
                raw, begin = data.tobytes(), 0
                for n, end in enumerate(ends):
                    yield pd.DataFrame({"file": [file], "first": [first], "start": [n * size], "part": [raw[begin:end].decode()]})
                    begin = end + 1

    return lines.select("file", "line").mapInPandas(run, "file string, first string, start int, part string")


def stack_sample_files(lines: DataFrame, labels: DataFrame, feature_col: str, value_col: str,
                       sep: str = "\t", comment: str = "#") -> DataFrame:
    """file, feature, value, label from one table per sample: two columns of each file,
    numbers only, the last row of a repeated feature; unlabelled files are dropped."""
    lines = lines.where(~F.col("line").startswith(comment) & (F.col("line") != ""))
    heads = lines.groupBy("file").agg(F.min_by(F.split("line", sep), "line_pos").alias("names"),
                                      F.min("line_pos").alias("first"))
    heads = heads.select("file", "first", F.array_position("names", feature_col).cast("int").alias("f"),
                         F.array_position("names", value_col).cast("int").alias("v"))
    parsed = (lines.join(heads, "file").where(F.col("line_pos") > F.col("first"))
              .withColumn("fields", F.split("line", sep)).select(
                  "file", "line_pos",
                  F.nullif(F.try_element_at("fields", F.col("f")), F.lit("")).alias("feature"),
                  to_number(F.try_element_at("fields", F.col("v"))).alias("value"))
              .where(F.col("feature").isNotNull() & F.col("value").isNotNull()))
    last = parsed.groupBy("file", "feature").agg(F.max_by("value", "line_pos").alias("value"))
    good = labels.where(F.col("label").isNotNull() & (F.col("label") != "")).select("file", "label")
    return last.join(good, "file")


def union_width(stacked: DataFrame) -> DataFrame:
    """Columns per study when its files are stacked: the union of their features."""
    return stacked.select("study", "feature").distinct().groupBy("study").agg(F.count("*").alias("n_features"))


def align_to_first(probes: DataFrame) -> DataFrame:
    """study, sample, probe, value: every sample on the probe list of the study's first
    sample; its missing probes are NULL, extra ones dropped. ``probes`` has study, sample,
    sample_pos, probe, value."""
    first = probes.groupBy("study").agg(F.min("sample_pos").alias("sample_pos"))
    listed = probes.join(first, ["study", "sample_pos"], "left_semi").select("study", "probe")
    samples = probes.select("study", "sample").distinct()
    grid = samples.join(listed, "study")
    return grid.join(probes.select("study", "sample", "probe", "value"), ["study", "sample", "probe"], "left")


def align(samples: DataFrame, labels: DataFrame, min_shared: int) -> DataFrame:
    """Samples with a label (inner join by id); datasets with fewer than ``min_shared`` of
    them are dropped. Both sides have dataset_id and sample."""
    labelled = labels.where(F.col("label").isNotNull())
    joined = samples.join(labelled, ["dataset_id", "sample"])
    enough = (joined.groupBy("dataset_id").agg(F.count("*").alias("n"))
              .where(F.col("n") >= min_shared).select("dataset_id"))
    return joined.join(enough, "dataset_id", "left_semi")


def attach_attributes(samples: DataFrame, case_of: DataFrame, attrs: DataFrame, numbers, texts, keep=()) -> DataFrame:
    """Samples with per-case attributes appended as further columns. ``samples`` has file,
    num, txt and the columns ``keep``; ``case_of`` maps file to case; ``attrs`` is one row per case."""
    cols = [F.col(c).cast("double") for c in numbers]
    joined = samples.join(case_of, "file", "left").join(attrs, "case", "left")
    return joined.select(
        "file", "case", *keep,
        (F.concat("num", F.array(*cols)) if cols else F.col("num")).alias("num"),
        (F.concat("txt", F.array(*[F.col(c).cast("string") for c in texts])) if texts else F.col("txt")).alias("txt"))


def dedupe_keep_first(meta: DataFrame, key: str = "sample", pos: str = "pos") -> DataFrame:
    rest = [c for c in meta.columns if c != key]
    return meta.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("r")).select(key, "r.*")


def transformed(num: Column, kind: Column) -> Column:
    """The value transform of a source applied to a whole numeric array."""
    return (F.when(kind == "log1p", F.transform(num, lambda x: F.log1p(x)))
            .when(kind == "clip_log1p", F.transform(num, lambda x: F.log1p(F.greatest(x, F.lit(0.0)))))
            .otherwise(num))


def source_transform(source: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in table.items():
        out = F.when(source == name, kind).otherwise(out)
    return out
