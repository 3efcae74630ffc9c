"""Schemas and enumerations of the code graph."""

from __future__ import annotations

from pyspark.sql import types as T

_s = T.StringType()


def _fields(*names: str, kind: T.DataType = _s) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


ENDPOINT = T.StructType(_fields("type", "path", "produces", "consumes"))
PARAM = T.StructType(_fields("type", "value"))
CALL = T.StructType([T.StructField("name", _s), T.StructField("params", T.ArrayType(PARAM))])
METHOD = T.StructType([
    *_fields("name", "full_name", "body", "ast_hash"), T.StructField("method_calls", T.ArrayType(CALL)),
    *_fields("used_types", "field_access", "inheritance_info", kind=T.ArrayType(_s)), T.StructField("endpoint", T.ArrayType(ENDPOINT)),
    *_fields("type", "project_id", "branch", "handles_annotation"), T.StructField("annotations", T.ArrayType(_s)),
])
CHUNK = T.StructType([
    *_fields("package", "class_name", "full_class_name", "file_path", "content", "ast_hash"), T.StructField("implements", T.ArrayType(_s)),
    T.StructField("methods", T.ArrayType(METHOD)), *_fields("parent_class", "project_id", "branch"), T.StructField("used_types", T.ArrayType(_s)),
    T.StructField("is_nested", T.BooleanType()), T.StructField("type", _s), T.StructField("is_annotation", T.BooleanType()), T.StructField("handles_annotation", _s),
    T.StructField("annotations", T.ArrayType(_s)),
])
NODE_COLUMNS = ["label", "name", "class_name", "method_name", "file_path", "content", "ast_hash", "project_id", "branch", "version", "status", "base_branch", "base_version", "pull_request_id", "endpoint"]
#: Ids are 64-bit integers everywhere: those of tables as they are, those of imports and copies by hash.
NODE = T.StructType([T.StructField("node_id", T.LongType()), *_fields(*NODE_COLUMNS)])
REL = T.StructType([*_fields("src", "dst", kind=T.LongType()), T.StructField("type", _s)])

# fixed values: chunk types and node labels
CONFIGURATION, ENDPOINT_TYPE, REGULAR = "configuration", "rest_endpoint", "regular"
CLASS_NODE, METHOD_NODE, ENDPOINT_NODE, CONFIGURATION_NODE = "ClassNode", "MethodNode", "EndpointNode", "ConfigurationNode"
