"""Schemas of the stored relations, and ``conform``, which brings older data up to them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

_DDL = {
    "files": "id bigint, path string, language string, size bigint, hash string",
    "symbols": "id bigint, file_id bigint, name string, kind string, line_start int, line_end int, signature string, doc_comment string, is_exported boolean, is_default boolean, parent_symbol_id bigint, tags array<string>, return_type string",
    "imports": "id bigint, file_id bigint, source_path string, imported_names array<string>, original_names map<string,string>, is_default boolean, is_namespace boolean",
    "calls": "caller_symbol_id bigint, callee_symbol_id bigint, line int, confidence double",
    "type_refs": "id bigint, symbol_id bigint, referenced_symbol_id bigint",
    "co_changes": "file_path_a string, file_path_b string, change_count bigint, total_commits bigint, confidence double",
    "patterns": "category string, name string, value string, instance_count bigint, total_count bigint, confidence double, examples array<string>",
    "call_sites": "id bigint, file_id bigint, caller_name string, callee_name string, receiver_name string, line int",
    "implements": "class_symbol_id bigint, interface_name string",
    "type_hints": "id bigint, file_id bigint, scope string, variable_name string, type_name string, source string",
    "meta": "key string, value string",
    "tokens": "id bigint, field string, pos int, token string",
    "symbol_grams": "gram string, id bigint",
    "path_grams": "gram string, id bigint",
}


@lru_cache
def _parsed(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


class _Tables(Mapping):
    """name -> StructType. Types are parsed at first use: that takes a session, and importing this module doesn't."""

    def __getitem__(self, name: str) -> StructType:
        return _parsed(_DDL[name])

    def __iter__(self):
        return iter(_DDL)

    def __len__(self) -> int:
        return len(_DDL)


TABLES = _Tables()

#: One row of extraction: a file and what was found in it.
PARSED_DDL = (
    "path string, language string, size bigint, hash string, "
    "symbols array<struct<name: string, kind: string, line_start: int, line_end: int, signature: string, doc_comment: string, is_exported: boolean, is_default: boolean, parent_name: string, tags: array<string>, return_type: string, implements: array<string>>>, "
    "imports array<struct<source_path: string, imported_names: array<string>, original_names: map<string,string>, is_default: boolean, is_namespace: boolean>>, "
    "call_sites array<struct<caller_name: string, callee_name: string, receiver_name: string, line: int>>, "
    "type_hints array<struct<scope: string, variable_name: string, type_name: string, source: string>>, error string"
)



def parsed_schema() -> StructType:
    return _parsed(PARSED_DDL)


#: Defaults of columns that older data may lack.
_DEFAULTS = {"confidence": 1.0}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns of a table, in order; missing ones are null, or their default."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in TABLES[table]))
