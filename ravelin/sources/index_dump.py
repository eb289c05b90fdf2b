"""An exported compiler index as nodes and edges: occurrences of symbols, with their roles and relations as bit fields.

Input rows: usr, name, kind INT, properties BIGINT, roles BIGINT, file, line,
col and relations ARRAY<STRUCT<usr, kind INT, roles BIGINT>>. Relations are
exploded once and each becomes an edge for every role it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of symbols in the index, and what they are in the graph; any other is a function.
KINDS = {
    1: "module", 5: "enum", 6: "struct", 7: "class", 8: "protocol", 9: "extension", 11: "typeAlias", 12: "function", 13: "property", 14: "property",
    15: "enumCase", 16: "function", 17: "function", 18: "function", 19: "property", 20: "property", 21: "property", 22: "function", 23: "function",
}
PROTOCOL = 8
# Bits of roles and properties.
DEFINITION, IMPLICIT = 1 << 1, 1 << 8
CHILD_OF, BASE_OF, OVERRIDE_OF, CALLED_BY, EXTENDED_BY = 1 << 9, 1 << 10, 1 << 11, 1 << 13, 1 << 14
ACCESS = {"Public": (1 << 19) | (1 << 18), "Package": 1 << 19, "Internal": (1 << 18) | (1 << 17), "FilePrivate": 1 << 18, "Private": 1 << 17}


def units(of: DataFrame) -> DataFrame:
    """Units (name, main_file, is_system, records) that matter: none of the system's, Swift only."""
    return of.where(~F.col("is_system") & F.col("main_file").endswith(".swift"))


def records(of: DataFrame) -> DataFrame:
    """name and record of every record that the units depend on, each once."""
    return units(of).select("name", F.explode("records").alias("record")).distinct()


def symbol_kind(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, kind.cast("int")), F.lit("function"))


def access_level(properties: Column, parity: bool = False) -> Column:
    """The level whose bits a symbol has. parity: as soon as it has one of them, which makes most symbols public."""
    field = properties.bitwiseAND(F.lit(sum({1 << 17, 1 << 18, 1 << 19})))
    tests = [F.when(properties.bitwiseAND(F.lit(bits)) != 0 if parity else field == bits, F.lit(level)) for level, bits in ACCESS.items()]
    return F.coalesce(*tests, F.lit("Internal"))


def definitions(occurrences: DataFrame) -> DataFrame:
    """id, name, kind, access_level, file, line and col of every symbol defined."""
    own = occurrences.where(F.col("roles").bitwiseAND(F.lit(DEFINITION)) != 0)
    return own.select(F.col("usr").alias("id"), "name", symbol_kind(F.col("kind")).alias("kind"), access_level(F.col("properties")).alias("access_level"), "file", "line", "col")


def relations(occurrences: DataFrame) -> DataFrame:
    """source, target, kind, file, line and col of an edge for each role of each relation."""
    each = occurrences.select("usr", "file", "line", "col", F.explode("relations").alias("r")).where("r.usr <> ''")
    has = lambda bit: F.col("r.roles").bitwiseAND(F.lit(bit)) != 0
    out = lambda kind: F.struct(F.col("usr").alias("source"), F.col("r.usr").alias("target"), kind.alias("kind"))
    back = lambda kind: F.struct(F.col("r.usr").alias("source"), F.col("usr").alias("target"), kind.alias("kind"))
    base = F.when(F.col("r.kind") == PROTOCOL, F.lit("conformsTo")).otherwise(F.lit("inheritsFrom"))
    edges = F.array_compact(F.array(
        F.when(has(CALLED_BY), back(F.lit("calls"))), F.when(has(BASE_OF), out(base)), F.when(has(OVERRIDE_OF), out(F.lit("overrides"))),
        F.when(has(CHILD_OF), out(F.lit("contains"))), F.when(has(EXTENDED_BY), back(F.lit("extendsType"))),
    ))
    return each.select(F.explode(edges).alias("e"), "file", "line", "col").select("e.*", "file", "line", "col")
