"""Types of VARIANT values."""

from __future__ import annotations

import re

from pyspark.sql import types as T


def plain_type(variant_type: str) -> T.DataType:
    """The Spark type of a schema that ``schema_of_variant_agg`` found.

    Numbers with a fraction anywhere are doubles, fields without any value text, and so are fields whose records disagree:
    they keep the text of each value.
    """
    parts = re.split(r"(`(?:[^`]|``)*`)", variant_type)
    swaps = ((r"OBJECT(?=<)", "STRUCT"), (r"DECIMAL\(\d+,\s*\d+\)|FLOAT(?!\s*:)", "DOUBLE"), (r"\b(VOID|VARIANT)\b(?!\s*:)", "STRING"))
    for at in range(0, len(parts), 2):
        for pattern, new in swaps:
            parts[at] = re.sub(pattern, new, parts[at])
    return T._parse_datatype_string("".join(parts))


def is_json(variant_type: str) -> bool:
    """Whether a schema that ``schema_of_variant_agg`` found only has kinds that JSON text keeps: no dates, instants, binaries
    or single-precision numbers, and no mixed fields, which may hide one."""
    parts = re.split(r"`(?:[^`]|``)*`", variant_type)
    return not any(re.search(r"\b(VARIANT|FLOAT|DATE|TIME\w*|INTERVAL|BINARY|UUID)\b(?!\s*:)", part) for part in parts)


def ddl(kind: T.DataType) -> str:
    """As ``simpleString``, with quoted field names."""
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{ddl(f.dataType)}" for f in kind.fields) + ">"
    return f"array<{ddl(kind.elementType)}>" if isinstance(kind, T.ArrayType) else kind.simpleString()
