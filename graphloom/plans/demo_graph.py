"""The driver's tables as a graph: the same rules in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import as_edges, as_nodes
from ..functions.tables import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: table, kind, key, label, metadata
_TABLES = (
    ("region", "region", "r_regionkey", "r_name", {}),
    ("nation", "nation", "n_nationkey", "n_name", {}),
    ("customer", "customer", "c_custkey", "c_name", {"segment": "c_mktsegment"}),
    ("supplier", "supplier", "s_suppkey", "s_name", {}),
    ("part", "part", "p_partkey", "p_name", {"brand": "p_brand", "type": "p_type"}),
    ("orders", "order", "o_orderkey", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority"}),
)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer, supplier, part, order, brand."""
    out = []
    for name, kind, key, label, meta in _TABLES:
        pairs = [F.lit("producer"), F.lit("tpch")]
        for k, v in meta.items():
            pairs += [F.lit(k), F.col(v)]
        key_text = F.col(key).cast("string")
        out.append(table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{kind}:"), key_text).alias("id"), F.col(label).cast("string").alias("label"), F.lit(kind).alias("kind"),
            F.lit("schema").alias("file_type"), F.concat(F.lit(f"tpch/{name}/"), key_text).alias("source"), F.create_map(*pairs).alias("metadata"),
        ))
    brand = table(spark, sf_dir, "part").select("p_brand").distinct()
    out.append(brand.select(
        F.concat(F.lit("brand:"), "p_brand").alias("id"), F.col("p_brand").alias("label"), F.lit("brand").alias("kind"), F.lit("schema").alias("file_type"),
        F.concat(F.lit("tpch/brand/"), "p_brand").alias("source"), F.create_map(F.lit("producer"), F.lit("tpch")).alias("metadata"),
    ))
    both = out[0]
    for df in out[1:]:
        both = both.unionByName(df)
    return as_nodes(both)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as EXTRACTED edges; lineitems grouped by (order, part) and (order, supplier), INFERRED if any was returned."""
    t = lambda n: table(spark, sf_dir, n)
    meta = F.create_map(F.lit("producer"), F.lit("tpch")).alias("metadata")

    def key(df: DataFrame, kind: str, a: str, to: str, b: str, relation: str) -> DataFrame:
        ends = (F.concat(F.lit(f"{kind}:"), F.col(a).cast("string")).alias("source"), F.concat(F.lit(f"{to}:"), F.col(b).cast("string")).alias("target"))
        return df.select(*ends, F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(0.0).alias("weight"), meta)

    def grouped(to: str, b: str, relation: str, weight) -> DataFrame:
        returned = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
        # Nearly every row is a group of its own.
        g = dealt(t("lineitem").select("l_orderkey", b, "l_returnflag", "l_quantity"), "l_orderkey", b).groupBy("l_orderkey", b).agg(returned.alias("r"), weight.alias("weight"))
        ends = (F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit(f"{to}:"), F.col(b).cast("string")).alias("target"))
        return g.select(*ends, F.lit(relation).alias("relation"), F.when(F.col("r") == 1, "INFERRED").otherwise("EXTRACTED").alias("confidence"), "weight", meta)

    parts = [
        key(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "in_region"),
        key(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "in_nation"),
        key(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation"),
        key(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "placed_by"),
        key(t("part"), "part", "p_partkey", "brand", "p_brand", "of_brand"),
        grouped("part", "l_partkey", "contains", F.sum("l_quantity")),
        grouped("supplier", "l_suppkey", "supplied_by", F.lit(0.0)),
    ]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return as_edges(out)


_NODE = "select '{k}:' || {key} as id, cast({label} as varchar) as label, '{k}' as kind, 'schema' as file_type, 'tpch/{t}/' || {key} as source, {seg} as segment, {brand} as brand from {t}"
NODES_SQL = " union all ".join(
    _NODE.format(t=t, k=k, key=key, label=label, seg=m.get("segment", "null"), brand=m.get("brand", "null")) for t, k, key, label, m in _TABLES
) + " union all select distinct 'brand:' || p_brand, p_brand, 'brand', 'schema', 'tpch/brand/' || p_brand, null, null from part"
_KEY = "select '{k}:' || {a} as source, '{to}:' || {b} as target, '{r}' as relation, 'EXTRACTED' as confidence, 0.0::double as weight from {t}"
_GROUP = "select 'order:' || l_orderkey, '{to}:' || {b}, '{r}', case when max(case when l_returnflag = 'R' then 1 else 0 end) = 1 then 'INFERRED' else 'EXTRACTED' end, {w} from lineitem group by l_orderkey, {b}"
EDGES_SQL = " union all ".join([
    *(_KEY.format(t=t, k=k, a=a, to=to, b=b, r=r) for t, k, a, to, b, r in (
        ("nation", "nation", "n_nationkey", "region", "n_regionkey", "in_region"), ("customer", "customer", "c_custkey", "nation", "c_nationkey", "in_nation"),
        ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation"), ("orders", "order", "o_orderkey", "customer", "o_custkey", "placed_by"),
        ("part", "part", "p_partkey", "brand", "p_brand", "of_brand"),
    )),
    _GROUP.format(to="part", b="l_partkey", r="contains", w="sum(l_quantity)"), _GROUP.format(to="supplier", b="l_suppkey", r="supplied_by", w="0.0::double"),
])
GRAPH_SQL = f"nodes as ({NODES_SQL}), edges as ({EDGES_SQL})"
