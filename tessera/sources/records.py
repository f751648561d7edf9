"""Record files: delimited, versioned YAML, JSON of several shapes; and record sinks.

A record is (id, idx, cluster_id, data): idx is dense in file order, data a map of strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..operators.pairs import group_pairs
from .shared import stash

RECORD = ArrayType(StructType([StructField("id", StringType()), StructField("cluster_id", StringType()), StructField("data", MapType(StringType(), StringType()))]))
#: Fields of a record object that aren't attributes.
RESERVED = {"id", "idx", "cluster_id", "original_cluster_id", "data", "records"}


def dense_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """df with dense numbers from 0 in the order of its partitions and rows.

    Only a count for each partition is gathered; no row leaves its partition.
    """
    # Written first: counts and rows come from the same partitions, whatever adaptive plans or retries do.
    marked = stash(df.withColumn("_at", F.monotonically_increasing_id()), "index")
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    # A row for each partition: bounded by the number of input splits.
    return marked.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")


def file_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """df with dense numbers from 0 in the order of file names, and of rows in a file; df has the rows' _file and _block.

    A reader deals files to partitions by size, so the order of partitions says nothing. Only a count for each block is gathered.
    """
    marked = stash(df.withColumn("_at", F.monotonically_increasing_id()), "index")
    sizes = marked.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    # A row for each block: bounded by the number of input splits.
    return marked.join(F.broadcast(starts), ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_file", "_block", "_at", "_start")


def place() -> tuple[Column, Column]:
    """Where a row was read, for file_index."""
    return F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")


def read_delimited(spark: SparkSession, path: str, attributes: list[str], cluster: str | None = None, sep: str = "\t") -> DataFrame:
    """Records of a delimited file with a header; only listed attributes are kept, rows too short are dropped."""
    if not attributes:
        raise ValueError("attributes must be named")
    rows = spark.read.csv(path, sep=sep, header=True, mode="DROPMALFORMED", quote='"', escape='"', enforceSchema=False)
    kept = [a for a in attributes if a in rows.columns]
    pairs = [x for a in kept for x in (F.lit(a), F.coalesce(F.col(f"`{a}`"), F.lit("")))]
    owner = F.coalesce(F.col(f"`{cluster}`"), F.lit("")) if cluster else F.lit("")
    return file_index(rows.select(*place(), F.expr("uuid()").alias("id"), owner.alias("cluster_id"), F.create_map(*pairs).alias("data")))


def read_any(spark: SparkSession, path: str, attributes: list[str] | None = None, cluster: str | None = None) -> DataFrame:
    """Records of a file, by its extension."""
    kind = path.rpartition(".")[2].lower()
    if kind in ("tsv", "csv"):
        return read_delimited(spark, path, attributes or [], cluster, "\t" if kind == "tsv" else ",")
    if kind in ("yml", "yaml"):
        return read_yaml(spark, path)
    if kind == "json":
        return read_json(spark, path)
    raise ValueError(f"no reader for .{kind}")


def upgraded(doc: dict) -> dict:
    """A record document of any known version, as version 3.1."""
    version = str(doc.get("version", "2.2"))
    if version not in ("2.2", "3.0", "3.1"):
        raise ValueError(f"unknown version {version}")
    if version == "2.2":
        books = doc.get("books") or {}
        attributes = sorted({k for rows in books.values() for r in rows for k in r if k not in ("id", "group")})
        doc = {
            "version": "3.0", "type": doc.get("type", "NORMAL"), "inf_attr": {a: "NORMAL" for a in attributes},
            "records": {c: [{"id": r.get("id"), "cluster_id": r.get("group", c), "data": {k: v for k, v in r.items() if k not in ("id", "group")}} for r in rows] for c, rows in books.items()},
        }
    if doc["version"] == "3.0":
        doc = doc | {"version": "3.1", "type": "TARGET" if doc.get("type") == "NORMAL" else doc.get("type"), "inf_attr": {k: "TEXT" if v == "NORMAL" else v for k, v in (doc.get("inf_attr") or {}).items()}}
    return doc


def flattened(doc: object) -> Iterator[dict]:
    """Records of a document of any of the known shapes: group lists, record lists, or maps by cluster."""
    if isinstance(doc, dict) and isinstance(doc.get("group"), list):
        for g, group in enumerate(doc["group"]):
            for i, r in enumerate(group.get("records") or []):
                yield _record(r, str(r.get("cluster_id", g)), f"record_{g}_{i}")
        return
    records = doc.get("records", doc) if isinstance(doc, dict) else doc
    if isinstance(records, list):
        for i, r in enumerate(records):
            yield _record(r, str(r.get("cluster_id", "")), f"record_0_{i}")
    elif isinstance(records, dict):
        for g, (c, rows) in enumerate(records.items()):
            for i, r in enumerate(rows if isinstance(rows, list) else [rows]):
                if isinstance(r, dict):
                    yield _record(r, str(r.get("cluster_id", c)), f"record_{g}_{i}")


def _record(r: dict, cluster: str, name: str) -> dict:
    data = dict(r.get("data") or {}) | {k: v for k, v in r.items() if k not in RESERVED}
    return {"id": str(r.get("id") or name), "cluster_id": cluster, "data": {str(k): "" if v is None else str(v) for k, v in data.items()}}


@F.pandas_udf(RECORD)
def parse_yaml(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [r for doc in yaml.safe_load_all(t) for r in flattened(upgraded(doc or {}))])


def json_documents(text: str) -> Iterator[object]:
    """The documents of a JSON file: one, or several one after the other (as in files of a document a line)."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        else:
            doc, at = decoder.raw_decode(text, at)
            yield doc


@F.pandas_udf(RECORD)
def parse_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [r for doc in json_documents(t) for r in flattened(doc)])


def _documents(spark: SparkSession, path: str, parser) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(*place(), F.posexplode(parser("value")).alias("pos", "r"))
    return file_index(rows.select("_file", "_block", "r.id", "r.cluster_id", "r.data"))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, parse_yaml)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, parse_json)


def by_cluster(records: DataFrame) -> DataFrame:
    """cluster_id, records: for export; a cluster is one output row by its format."""
    return records.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("idx", "id", "data")), lambda x, y: (x["idx"] - y["idx"]).cast("int")).alias("records"))


def result_groups(records: DataFrame) -> DataFrame:
    """label, size, records, perfect_match (the label's records are one truth cluster, and all of it) from label, id, cluster_id."""
    truth = records.groupBy("cluster_id").agg(F.count("*").alias("truth_size"))
    return (
        records.join(truth, "cluster_id").groupBy("label")
        .agg(F.count("*").alias("size"), F.min("cluster_id").alias("lo"), F.max("cluster_id").alias("hi"), F.max("truth_size").alias("t"), F.array_sort(F.collect_list("id")).alias("ids"))
        .select("label", "size", "ids", ((F.col("lo") == F.col("hi")) & (F.col("t") == F.col("size"))).alias("perfect_match"))
    )


def first_groups(records: DataFrame) -> DataFrame:
    """label, size, ids, perfect_match (all records have the truth cluster of the first) from label, id, cluster_id."""
    return records.groupBy("label").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("ids"), (F.min("cluster_id") == F.max("cluster_id")).alias("perfect_match"))


def summary(records: DataFrame) -> DataFrame:
    """part, key, n: the number of records and clusters, and of clusters of each size."""
    per = records.groupBy("cluster_id").agg(F.count("*").alias("n"))
    row = lambda part, key, n: (F.lit(part).alias("part"), key.alias("key"), n.cast("long").alias("n"))
    sizes = per.groupBy("n").agg(F.count("*").alias("k")).select(*row("size", F.col("n").cast("string"), F.col("k")))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("r"), F.count("*").alias("c"))
    return sizes.unionByName(total.select(*row("records", F.lit(""), F.col("r")))).unionByName(total.select(*row("clusters", F.lit(""), F.col("c"))))


def cluster_info(records: DataFrame) -> DataFrame:
    """label, size, majority (truth cluster; smallest of equals), purity from label, cluster_id."""
    per = records.groupBy("label", "cluster_id").count()
    return per.groupBy("label").agg(F.sum("count").alias("size"), F.min_by("cluster_id", F.struct(-F.col("count"), "cluster_id")).alias("majority"), F.max("count").alias("top")).select("label", "size", "majority", (F.col("top") / F.col("size")).alias("purity"))


def matched_pairs(records: DataFrame, fields: list[str]) -> DataFrame:
    """All pairs within a predicted label with both sides' fields and whether they are of one truth cluster."""
    met = group_pairs(records.select("label", "id", "cluster_id", *fields), "label", "id")
    side = lambda n, r: (F.col(f"{r}.{c}").alias(f"{c}{n}") for c in ("id", *fields))
    return met.select("label", *side(1, "x"), *side(2, "y"), (F.col("x.cluster_id") == F.col("y.cluster_id")).alias("correct"))


def profile(records: DataFrame) -> DataFrame:
    """Number of clusters and records, and the smallest, largest and mean cluster."""
    per = records.groupBy("cluster_id").count()
    return per.agg(F.count("*").alias("clusters"), F.sum("count").alias("records"), F.min("count").alias("least"), F.max("count").alias("most"), F.round(F.avg("count"), 6).alias("mean"))


def sample_clusters(records: DataFrame, sizes: dict[int, int], seed: str = "42") -> DataFrame:
    """For each size k (larger ones first), `sizes[k]` clusters of k records or more, k records of each, all by hash order; no cluster twice."""
    per = records.groupBy("cluster_id").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "cluster_id")))
    chosen = None
    for k in sorted(sizes, reverse=True):
        free = per.where(F.col("n") >= k)
        if chosen is not None:
            free = free.join(chosen.select("cluster_id"), "cluster_id", "left_anti")
        part = free.orderBy("h", "cluster_id").limit(sizes[k]).select("cluster_id", F.lit(k).alias("k"))
        chosen = part if chosen is None else chosen.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id")), "id"))
    return records.join(chosen, "cluster_id").withColumn("_r", rank).where("_r <= k").drop("_r", "k")


def benchmark_slices(records: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """records with slice: whole clusters, in hash order, dealt round to n slices by a hash of the cluster, so that none is split."""
    h = F.xxhash64(F.lit(seed), "cluster_id")
    return records.withColumn("slice", F.pmod(h, F.lit(n)).cast("int"))


def synthetic(spark: SparkSession, books: list[dict[str, str]], variations: int) -> DataFrame:
    """Labelled records: each book with spelling variations (cluster of its number) and a decoy of its own."""
    rows = []
    for b, book in enumerate(books):
        for v in range(variations):
            rows.append((f"{b}-{v}", str(b), {k: (x if v == 0 else x.upper() if v % 2 else f"{x} ") for k, x in book.items()}))
        rows.append((f"{b}-decoy", f"{b}-decoy", {k: f"{x} (続)" if "title" in k else x for k, x in book.items()}))
    return spark.createDataFrame(rows, "id string, cluster_id string, data map<string, string>")


def field(name: str) -> Column:
    return F.col("data")[name]
