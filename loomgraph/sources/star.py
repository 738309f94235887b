"""The graph that the star schema holds: regions declare nations, nations customers and suppliers, customers call orders, orders
read parts, and parts inject suppliers, with one evidence item for each line item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name, language."""
    kinds = [("region", "r_regionkey", "r_name", "Package", "Python"), ("nation", "n_nationkey", "n_name", "Module", "Python"), ("customer", "c_custkey", "c_name", "Class", "Java"), ("supplier", "s_suppkey", "s_name", "Interface", "Java"), ("part", "p_partkey", "p_name", "PolicyLeaf", "Policy")]
    parts = [table(spark, sf_dir, t).select(node_id(t, k).alias("id"), F.lit(kind).alias("type"), F.col(n).alias("name"), F.lit(lang).alias("language")) for t, k, n, kind, lang in kinds]
    orders = table(spark, sf_dir, "orders").select(node_id("order", "o_orderkey").alias("id"), F.lit("Method").alias("type"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("name"), F.lit("Java").alias("language"))
    return reduce(DataFrame.unionByName, [*parts, orders])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, type; as found, so with repetitions."""
    edge = lambda t, a, ka, b, kb, kind: table(spark, sf_dir, t).select(node_id(a, ka).alias("source"), node_id(b, kb).alias("target"), F.lit(kind).alias("type"))
    return reduce(DataFrame.unionByName, [
        edge("nation", "region", "n_regionkey", "nation", "n_nationkey", "DECLARES"), edge("customer", "nation", "c_nationkey", "customer", "c_custkey", "DECLARES"),
        edge("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "DECLARES"), edge("orders", "customer", "o_custkey", "order", "o_orderkey", "CALLS"),
        edge("lineitem", "order", "l_orderkey", "part", "l_partkey", "READS_POLICY_LEAF"), edge("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "INJECTS"),
    ])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each line item: source (part), target (supplier), type and canonical JSON (keys in alphabetical order)."""
    item = F.struct(
        F.when(F.col("l_linestatus") == "O", "resolved_static").otherwise("direct_syntax").alias("basis"), F.col("l_linenumber").alias("line_start"),
        F.concat(F.lit("lineitem."), F.lower("l_returnflag")).alias("rule_id"), F.when(F.col("l_returnflag") == "R", "runtime_unknown").otherwise("not_applicable").alias("runtime_status"),
    )
    return table(spark, sf_dir, "lineitem").select(node_id("part", "l_partkey").alias("source"), node_id("supplier", "l_suppkey").alias("target"), F.lit("INJECTS").alias("type"), item.alias("item"), F.to_json(item).alias("canon"))


def full_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of parts, customers, suppliers and orders with path, qualified name and metadata; some paths can't leave the engine."""
    meta = "struct<return_type:string,semantic_groups:array<string>,ordinal:int>"
    none = F.lit(None).cast("string")

    def some(name, kind, prefix, key, label, language, path, qualified, returns, groups, ordinal):
        m = F.struct(returns.alias("return_type"), groups.alias("semantic_groups"), ordinal.cast("int").alias("ordinal")).cast(meta)
        return table(spark, sf_dir, name).select(node_id(prefix, key).alias("id"), F.lit(kind).alias("type"), label.alias("name"), F.lit(language).alias("language"), path.alias("path"), qualified.alias("qualified_name"), m.alias("metadata"))

    no_groups = F.lit(None).cast("array<string>")
    order_path = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/var/"), "o_orderkey")).when(F.col("o_orderstatus") == "O", F.concat(F.lit("orders/../"), "o_orderkey")).otherwise(F.concat(F.lit("orders/"), "o_orderkey"))
    return reduce(DataFrame.unionByName, [
        some("part", "PolicyLeaf", "part", "p_partkey", F.col("p_name"), "Policy", F.concat(F.lit("policy/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".yaml")), F.concat_ws(".", "p_brand", "p_name"), F.col("p_type"), F.array("p_brand"), F.col("p_size")),
        some("customer", "Class", "customer", "c_custkey", F.col("c_name"), "Java", F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/"), "c_custkey", F.lit(".java")), F.concat_ws(".", "c_mktsegment", "c_name"), none, no_groups, F.col("c_nationkey")),
        some("supplier", "Interface", "supplier", "s_suppkey", F.col("s_name"), "Java", none, F.concat(F.lit("supply."), "s_name"), none, no_groups, F.col("s_nationkey")),
        some("orders", "Method", "order", "o_orderkey", F.concat(F.lit("order "), "o_orderkey"), "Java", order_path, F.concat(F.lit("order#"), "o_orderkey", F.lit("()")), F.col("o_orderpriority"), no_groups, F.lit(None)),
    ])


def edges_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each line item (order reads part), with one or two items of evidence as they come in: some rules, paths and lines are not allowed, and some orders have none."""
    late = F.col("l_linestatus") == "O"
    item = lambda k: F.struct(
        F.when(F.col("l_returnflag") == "R", F.lit("Bad Rule")).otherwise(F.concat(F.lit("lineitem."), F.lower("l_linestatus"), F.lit(str(k)))).alias("rule_id"),
        F.when(late, "resolved_static").otherwise("direct_syntax").alias("basis"), F.when(F.col("l_returnflag") == "A", "runtime_unknown").otherwise("not_applicable").alias("runtime_status"),
        F.when(late, F.concat(F.lit("/var/"), "l_partkey")).otherwise(F.concat(F.lit("src\\"), "l_partkey", F.lit(".java"))).alias("path"),
        (F.col("l_linenumber") - k).alias("line_start"), (F.col("l_linenumber") - 1).alias("line_end"), F.array(F.lit("zeta.limit"), F.lit("alpha.limit"), F.lit("zeta.limit"), F.lit("Not allowed")).alias("limitations"),
    )
    items = F.when(F.col("l_quantity") < 5, F.slice(F.array(item(1)), 1, 0)).when(F.col("l_quantity") < 25, F.array(item(1))).otherwise(F.array(item(1), item(2)))
    return table(spark, sf_dir, "lineitem").select(node_id("order", "l_orderkey").alias("source"), node_id("part", "l_partkey").alias("target"), F.lit("READS_POLICY_LEAF").alias("type"), items.alias("evidence"), "l_orderkey", "l_linenumber", "l_partkey")
