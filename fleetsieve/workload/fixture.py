"""A fleet of datasets made from whole driver tables, for Spark and as SQL text."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsieve.fleet import Fleet, clean, feature_rows

LI = ["AF", "AO", "NF", "NO", "RF", "RO"]
EV = ["click", "error", "purchase", "signup", "view"]
NAMES = {
    "li": (["l_quantity", "l_discount", "l_tax", "l_linenumber", "one"], []),
    "lc": (["l_quantity", "l_discount", "l_tax", "l_linenumber"], []),
    "ev": (["hour", "weekday", "k", "user"], []),
    "or": (["price_k", "day", "cust_k", "price_gaps"], ["mixed", "digits"]),
    "emb": ([f"e{i}" for i in range(64)], []),
}


def dataset_list():
    rows = [(f"li-{x}", "lineitem", "regression") for x in LI]
    rows += [(f"lc-{x}", "linecls", "classification") for x in "FO"]
    rows += [(f"ev-{x}", "events", "regression") for x in EV]
    rows += [(f"or-{x}", "orders", "supervised_classification") for x in "12345"]
    rows += [(f"emb-{x}", "emb", "classification") for x in ["all", "rev", "low"]]
    rows += [(f"emb-ovr-{x}", "emb", "classification") for x in range(10)]
    return [(d, s, i, "dataset " + d, t, "general", "table://" + s) for i, (d, s, t) in enumerate(rows)]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def array(*columns):
    return F.array(*[clean(c) for c in columns])


def _samples(df, dataset_id, row_id, num, txt=None, y_str=None, y_num=None, batch=None):
    none = F.lit(None)
    return df.select(
        dataset_id.alias("dataset_id"), row_id.cast("bigint").alias("row_id"), num.alias("num"),
        (txt if txt is not None else F.array().cast("array<string>")).alias("txt"),
        (y_str if y_str is not None else none).cast("string").alias("y_str"),
        (y_num if y_num is not None else none).cast("double").alias("y_num"),
        (batch if batch is not None else none).cast("string").alias("batch"))


def fleet_parts(spark: SparkSession, sf: str):
    c = F.col
    li = read(spark, sf, "lineitem")
    row = c("l_orderkey") * 10 + c("l_linenumber")
    base = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    ev = read(spark, sf, "events")
    micros = F.unix_micros(c("ts").cast("timestamp"))
    hours = F.floor(micros / F.lit(3_600_000_000))
    od = read(spark, sf, "orders")
    day = F.floor(F.unix_micros(c("o_orderdate").cast("timestamp")) / F.lit(86_400_000_000)) - 9000
    price = c("o_totalprice") / 1000.0
    emb = read(spark, sf, "embeddings")
    vec = F.transform("embedding", lambda x: x.cast("double"))
    label = c("label").cast("string")
    ovr = emb.withColumn("k", F.explode(F.array(*map(F.lit, range(10)))))
    return {
        "li": _samples(li, F.concat(F.lit("li-"), c("l_returnflag"), c("l_linestatus")), row,
                       array(*map(c, base), F.lit(1)), y_num=c("l_extendedprice") / 1000.0),
        "lc": _samples(li, F.concat(F.lit("lc-"), c("l_linestatus")), row, array(*map(c, base)),
                       y_str=c("l_returnflag")),
        "ev": _samples(ev, F.concat(F.lit("ev-"), c("event_type")), c("event_id"),
                       array(F.pmod(hours, F.lit(24)), F.pmod(F.floor(hours / 24), F.lit(7)),
                             F.get_json_object("props", "$.k"), c("user_id") / 10.0),
                       y_num=c("value"), batch=F.pmod(c("user_id"), F.lit(4))),
        "or": _samples(od, F.concat(F.lit("or-"), F.substring("o_orderpriority", 1, 1)), c("o_orderkey"),
                       array(price, day / 1000.0, c("o_custkey") / 1000.0,
                             F.when(F.pmod(c("o_orderkey"), F.lit(7)) != 0, price)),
                       txt=F.array(F.when(F.pmod(c("o_orderkey"), F.lit(50)) == 0, c("o_orderstatus"))
                                   .otherwise(c("o_custkey").cast("string")),
                                   c("o_orderkey").cast("string")),
                       y_str=c("o_orderstatus")),
        "emb": (_samples(emb, F.lit("emb-all"), c("vec_id"), vec, y_str=label)
                .unionByName(_samples(emb, F.lit("emb-rev"), c("vec_id"), F.reverse(vec), y_str=label))
                .unionByName(_samples(emb.where("label < 5"), F.lit("emb-low"), c("vec_id"), vec, y_str=label))
                .unionByName(_samples(ovr, F.concat(F.lit("emb-ovr-"), c("k").cast("string")), c("vec_id"), vec,
                                      y_str=F.when(c("k") == c("label"), "case").otherwise("rest")))),
    }


def fleet(spark: SparkSession, sf: str, *kinds: str) -> Fleet:
    """The whole fleet, or only the datasets made from the named tables."""
    parts = fleet_parts(spark, sf)
    kinds = kinds or tuple(parts)
    samples = None
    for kind in kinds:
        samples = parts[kind] if samples is None else samples.unionByName(parts[kind])
    chosen = [d for d in dataset_list() if d[0].split("-")[0] in kinds]
    datasets = spark.createDataFrame(chosen, "dataset_id string, source string, pos int, name string, "
                                             "task_type string, domain string, url string")
    features = feature_rows(spark, {d[0]: NAMES[d[0].split("-")[0]] for d in chosen})
    return Fleet(datasets, features, samples)


# ------------------------------------------------------------------ SQL twin
def _values(rows):
    quote = lambda v: "'%s'" % v if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def _feature_values(kinds):
    rows = []
    for d in dataset_list():
        kind = d[0].split("-")[0]
        if kind in kinds:
            numbers, texts = NAMES[kind]
            rows += [(d[0], i, n) for i, n in enumerate(numbers + texts)]
    return rows


PART_SQL = {
    "li": """SELECT 'li-' || l_returnflag || l_linestatus AS dataset_id,
  l_orderkey * 10 + l_linenumber AS row_id,
  [l_quantity, l_discount, l_tax, l_linenumber::DOUBLE, 1.0::DOUBLE] AS num, []::VARCHAR[] AS txt,
  NULL::VARCHAR AS y_str, l_extendedprice / 1000.0::DOUBLE AS y_num, NULL::VARCHAR AS batch FROM lineitem""",
    "lc": """SELECT 'lc-' || l_linestatus, l_orderkey * 10 + l_linenumber,
  [l_quantity, l_discount, l_tax, l_linenumber::DOUBLE], []::VARCHAR[], l_returnflag, NULL::DOUBLE, NULL::VARCHAR
  FROM lineitem""",
    "ev": """SELECT 'ev-' || event_type, event_id,
  [((epoch_us(ts) // 3600000000) % 24)::DOUBLE, ((epoch_us(ts) // 86400000000) % 7)::DOUBLE,
   regexp_extract(props, '"k": (\\d+)', 1)::DOUBLE, user_id / 10.0::DOUBLE], []::VARCHAR[], NULL::VARCHAR, value,
  (user_id % 4)::VARCHAR FROM events""",
    "or": """SELECT 'or-' || substr(o_orderpriority, 1, 1), o_orderkey,
  [o_totalprice / 1000.0::DOUBLE, (epoch_us(o_orderdate) // 86400000000 - 9000) / 1000.0::DOUBLE,
   o_custkey / 1000.0::DOUBLE, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000.0::DOUBLE END],
  [CASE WHEN o_orderkey % 50 = 0 THEN o_orderstatus ELSE o_custkey::VARCHAR END, o_orderkey::VARCHAR],
  o_orderstatus, NULL::DOUBLE, NULL::VARCHAR FROM orders""",
    "emb": """SELECT 'emb-all', vec_id, embedding::DOUBLE[], []::VARCHAR[], label::VARCHAR, NULL::DOUBLE, NULL::VARCHAR
  FROM embeddings
UNION ALL SELECT 'emb-rev', vec_id, list_reverse(embedding)::DOUBLE[], []::VARCHAR[], label::VARCHAR, NULL, NULL
  FROM embeddings
UNION ALL SELECT 'emb-low', vec_id, embedding::DOUBLE[], []::VARCHAR[], label::VARCHAR, NULL, NULL
  FROM embeddings WHERE label < 5
UNION ALL SELECT 'emb-ovr-' || k, vec_id, embedding::DOUBLE[], []::VARCHAR[],
  CASE WHEN k = label THEN 'case' ELSE 'rest' END, NULL, NULL
  FROM (SELECT *, unnest(range(10)) AS k FROM embeddings)""",
}


def fleet_sql(*kinds: str) -> dict:
    """CTEs ``datasets``, ``features``, ``samples``, ``cells`` equal to :func:`fleet`."""
    kinds = kinds or tuple(PART_SQL)
    first = "SELECT * FROM (%s) t(dataset_id, row_id, num, txt, y_str, y_num, batch)"
    chosen = [d for d in dataset_list() if d[0].split("-")[0] in kinds]
    return {
        "datasets": f"SELECT * FROM (VALUES {_values(chosen)}) "
                    "t(dataset_id, source, pos, name, task_type, domain, url)",
        "features": f"SELECT * FROM (VALUES {_values(_feature_values(kinds))}) t(dataset_id, feat_id, feat)",
        "samples": "\nUNION ALL ".join(first % PART_SQL[k] for k in kinds),
        "cells": """SELECT dataset_id, row_id, y_str, y_num, TRUE AS is_num, unnest(num) AS num,
  unnest(range(len(num))) AS feat_id, NULL::VARCHAR AS str FROM samples
UNION ALL SELECT dataset_id, row_id, y_str, y_num, FALSE, NULL::DOUBLE,
  unnest(range(len(num), len(num) + len(txt))), unnest(txt) FROM samples WHERE len(txt) > 0""",
    }
