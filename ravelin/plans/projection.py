"""A property graph projected from the order tables, as DataFrames and as the same in SQL.

Suppliers, customers, parts and orders are symbols; line items give calls,
conformances, references and extensions; orders give containment; brands
bought in bulk from a nation's suppliers are that nation's imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name suffixes of suppliers, by key modulo 5.
SUFFIXES = ("ViewModel", "Coordinator", "Router", "Presenter", "View")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols, with the columns of schema.NODES."""
    places = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    places = F.broadcast(places.select("n_nationkey", F.concat_ws("/", F.lit("Sources"), "r_name", "n_name").alias("folder")))  # one row a nation
    text = lambda c: F.col(c).cast("string")

    def symbol(rows: DataFrame, prefix: str, key, name, kind, file, line, access, attributes, signature) -> DataFrame:
        return rows.select(
            F.concat(F.lit(prefix), key).alias("id"), name.alias("name"), F.concat(F.lit("App."), name).alias("qualified_name"),
            kind.alias("kind"), F.lit(None).cast("string").alias("sub_kind"), file.alias("file"), line.cast("int").alias("line"),
            F.lit(1).alias("col"), (line + 10).cast("int").alias("end_line"), F.lit(1).alias("end_col"), signature.alias("signature"),
            attributes.alias("attributes"), access.alias("access_level"), F.lit(None).cast("string").alias("container_usr"),
            F.lit(None).cast("string").alias("doc_comment"), F.lit(10).alias("lines"), F.lit(1).alias("complexity"),
            F.lit(None).cast("int").alias("parameter_count"),
        )

    none, internal = F.array().cast("array<string>"), F.lit("Internal")
    only = lambda test, value: F.when(test, F.array(F.lit(value))).otherwise(none)
    supplier = _read(spark, sf_dir, "supplier")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s_name = F.concat(F.lit("Supplier"), text("s_suppkey"), suffix)
    isolation = F.when(F.col("s_acctbal") > 5000, F.array(F.lit("@MainActor"))).when(F.col("s_acctbal") < 0, F.array(F.lit("nonisolated"))).otherwise(none)
    suppliers = symbol(
        supplier.join(places, F.expr("s_nationkey = n_nationkey")), "supp::", text("s_suppkey"), s_name, F.lit("class"),
        F.concat(F.col("folder"), F.lit("/Suppliers.swift")), F.col("s_suppkey"), internal, isolation, F.concat(F.lit("class "), s_name),
    )
    customers = symbol(
        _read(spark, sf_dir, "customer").join(places, F.expr("c_nationkey = n_nationkey")), "cust::", text("c_custkey"), F.col("c_name"), F.lit("struct"),
        F.concat(F.col("folder"), F.lit("/Customers.swift")), F.col("c_custkey"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Public").otherwise(internal), none, F.concat(F.lit("struct "), F.col("c_name")),
    )
    kind = F.when(F.col("p_size") > 40, "protocol").when(F.col("p_size") > 20, "struct").otherwise("property")
    parts = symbol(
        _read(spark, sf_dir, "part"), "part::", text("p_partkey"), F.col("p_name"), kind, F.concat(F.lit("Sources/Parts/"), F.col("p_brand"), F.lit("/Parts.swift")),
        F.col("p_partkey"), internal, only(F.col("p_size") % 3 == 0, "@Published"), F.col("p_type"),
    )
    place = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("App/Tests/"), F.col("o_orderpriority"), F.lit("Tests.swift")))
    o_name = F.concat(F.lit("order"), text("o_orderkey"))
    orders = symbol(
        _read(spark, sf_dir, "orders"), "ord::", text("o_orderkey"), o_name, F.lit("method"),
        place.otherwise(F.concat(F.lit("Sources/Orders/"), F.col("o_orderpriority"), F.lit(".swift"))), F.col("o_orderkey"), internal, none,
        F.concat(F.lit("func "), o_name),
    )
    bulk = _read(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_suppkey", "l_partkey")
    bulk = bulk.join(supplier.select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
    bulk = bulk.join(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")).select("s_nationkey", "p_brand").distinct()
    imports = symbol(
        bulk.join(places, F.expr("s_nationkey = n_nationkey")), "imp::", F.concat(text("s_nationkey"), F.lit("::"), F.col("p_brand")), F.col("p_brand"), F.lit("import"),
        F.concat(F.col("folder"), F.lit("/Suppliers.swift")), F.lit(1), internal, none, F.concat(F.lit("import "), F.col("p_brand")),
    )
    return suppliers.unionByName(customers).unionByName(parts).unionByName(orders).unionByName(imports)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations, with the columns of schema.EDGES."""
    items = _read(spark, sf_dir, "lineitem")
    orders = _read(spark, sf_dir, "orders")
    ident = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    order, part, supplier = ident("ord::", "l_orderkey"), ident("part::", "l_partkey"), ident("supp::", "l_suppkey")

    def relation(rows: DataFrame, source, target, kind: str, line=None, distinct: bool = False) -> DataFrame:
        own = rows.select(
            source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("file"),
            (F.lit(None) if line is None else F.col(line)).cast("int").alias("line"), F.lit(None).cast("int").alias("col"), F.lit(False).alias("is_implicit"),
        )
        return own.distinct() if distinct else own

    all_of = [
        relation(items, order, part, "calls", "l_linenumber"),
        relation(items.where("l_linestatus = 'O'"), order, supplier, "calls", "l_linenumber"),
        relation(items.where("l_returnflag = 'R'"), supplier, part, "conformsTo", distinct=True),
        relation(items.where("l_quantity >= 50 AND l_discount >= 0.10 AND l_returnflag = 'A'"), part, supplier, "references", distinct=True),
        relation(items.where("l_quantity >= 49 AND l_tax >= 0.08 AND l_returnflag = 'N'"), part, supplier, "extendsType", distinct=True),
        relation(orders.where("o_orderstatus = 'O'"), ident("cust::", "o_custkey"), ident("ord::", "o_orderkey"), "contains"),
    ]
    out = all_of[0]
    for more in all_of[1:]:
        out = out.unionByName(more)
    return out


#: The same graph as SQL: put in front of a SELECT over nodes and edges.
SQL = """
WITH places AS (
    SELECT n_nationkey, 'Sources/' || r_name || '/' || n_name AS folder FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
    SELECT 'supp::' || s_suppkey AS id, 'Supplier' || s_suppkey || ['ViewModel', 'Coordinator', 'Router', 'Presenter', 'View'][s_suppkey % 5 + 1] AS name,
           'class' AS kind, folder || '/Suppliers.swift' AS file, CAST(s_suppkey AS INTEGER) AS line, 'Internal' AS access_level,
           CASE WHEN s_acctbal > 5000 THEN ['@MainActor'] WHEN s_acctbal < 0 THEN ['nonisolated'] ELSE CAST([] AS VARCHAR[]) END AS attributes,
           'class Supplier' || s_suppkey || ['ViewModel', 'Coordinator', 'Router', 'Presenter', 'View'][s_suppkey % 5 + 1] AS signature
    FROM supplier JOIN places ON s_nationkey = n_nationkey
    UNION ALL
    SELECT 'cust::' || c_custkey, c_name, 'struct', folder || '/Customers.swift', CAST(c_custkey AS INTEGER),
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'Public' ELSE 'Internal' END, CAST([] AS VARCHAR[]), 'struct ' || c_name
    FROM customer JOIN places ON c_nationkey = n_nationkey
    UNION ALL
    SELECT 'part::' || p_partkey, p_name, CASE WHEN p_size > 40 THEN 'protocol' WHEN p_size > 20 THEN 'struct' ELSE 'property' END,
           'Sources/Parts/' || p_brand || '/Parts.swift', CAST(p_partkey AS INTEGER), 'Internal',
           CASE WHEN p_size % 3 = 0 THEN ['@Published'] ELSE CAST([] AS VARCHAR[]) END, p_type
    FROM part
    UNION ALL
    SELECT 'ord::' || o_orderkey, 'order' || o_orderkey, 'method',
           CASE WHEN o_orderstatus = 'P' THEN 'App/Tests/' || o_orderpriority || 'Tests.swift' ELSE 'Sources/Orders/' || o_orderpriority || '.swift' END,
           CAST(o_orderkey AS INTEGER), 'Internal', CAST([] AS VARCHAR[]), 'func order' || o_orderkey
    FROM orders
    UNION ALL
    SELECT 'imp::' || s_nationkey || '::' || p_brand, p_brand, 'import', folder || '/Suppliers.swift', 1, 'Internal', CAST([] AS VARCHAR[]), 'import ' || p_brand
    FROM (SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45)
    JOIN places ON s_nationkey = n_nationkey),
edges AS (
    SELECT 'ord::' || l_orderkey AS source, 'part::' || l_partkey AS target, 'calls' AS kind, CAST(l_linenumber AS INTEGER) AS line FROM lineitem
    UNION ALL SELECT 'ord::' || l_orderkey, 'supp::' || l_suppkey, 'calls', l_linenumber FROM lineitem WHERE l_linestatus = 'O'
    UNION ALL SELECT DISTINCT 'supp::' || l_suppkey, 'part::' || l_partkey, 'conformsTo', CAST(NULL AS INTEGER) FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT DISTINCT 'part::' || l_partkey, 'supp::' || l_suppkey, 'references', CAST(NULL AS INTEGER) FROM lineitem
              WHERE l_quantity >= 50 AND l_discount >= 0.10 AND l_returnflag = 'A'
    UNION ALL SELECT DISTINCT 'part::' || l_partkey, 'supp::' || l_suppkey, 'extendsType', CAST(NULL AS INTEGER) FROM lineitem
              WHERE l_quantity >= 49 AND l_tax >= 0.08 AND l_returnflag = 'N'
    UNION ALL SELECT 'cust::' || o_custkey, 'ord::' || o_orderkey, 'contains', CAST(NULL AS INTEGER) FROM orders WHERE o_orderstatus = 'O')
"""
