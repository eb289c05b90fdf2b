"""Tables of the property graph, and the fixed values of its string columns."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


FILES = _struct(("path", _S, False), ("language", _S, False), ("hash", _S, False), ("last_indexed", T.TimestampType(), False), ("symbol_count", _I, False))

NODES = _struct(
    ("id", _S, False), ("name", _S, False), ("qualified_name", _S, False), ("kind", _S, False), ("sub_kind", _S, True),
    ("file", _S, False), ("line", _I, False), ("col", _I, False), ("end_line", _I, True), ("end_col", _I, True),
    ("signature", _S, True), ("attributes", T.ArrayType(_S), True), ("access_level", _S, False), ("container_usr", _S, True),
    ("doc_comment", _S, True), ("lines", _I, True), ("complexity", _I, True), ("parameter_count", _I, True),
)

EDGES = _struct(
    ("source", _S, False), ("target", _S, False), ("kind", _S, False), ("file", _S, True), ("line", _I, True), ("col", _I, True), ("is_implicit", _B, False)
)

ISSUES = _struct(
    ("id", _S, False), ("category", _S, False), ("severity", _S, False), ("rule", _S, False), ("message", _S, False),
    ("file", _S, False), ("line", _I, False), ("symbol", _S, True), ("fix", _S, True),
)

# The strings stored in kind, sub_kind, access_level, edge kind, severity and category columns.
SYMBOL_KINDS = (
    "class", "struct", "enum", "protocol", "method", "property", "function", "typeAlias",
    "extension", "enumCase", "macro", "associatedType", "module", "import", "file",
)
SUB_KINDS = ("Getter", "Setter", "Subscript", "Initializer", "Deinitializer")
ACCESS_LEVELS = ("Open", "Public", "Package", "Internal", "FilePrivate", "Private")
EDGE_KINDS = (
    "calls", "conformsTo", "inheritsFrom", "extendsType", "overrides", "implementsRequirement", "references",
    "mutates", "imports", "dependsOn", "contains", "returns", "parameterOf", "propertyType",
)
SEVERITIES = ("low", "medium", "high", "critical")
CATEGORIES = (
    "concurrency", "memory", "swift-performance", "swiftui-performance", "swiftui-architecture", "security",
    "energy", "networking", "codable", "storage", "accessibility", "testing", "modernization",
)
