"""Schemas from catalog files: blocks of BEGIN, relation, file, (name type)*, END, separated by white space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The type words of catalogs and of CREATE TABLE.
TYPES = {"Int": T.IntegerType(), "Double": T.DoubleType(), "String": T.StringType(), "INTEGER": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}
WORDS = {T.IntegerType(): "Int", T.LongType(): "Int", T.ShortType(): "Int", T.ByteType(): "Int", T.DoubleType(): "Double", T.FloatType(): "Double"}


@dataclass(frozen=True)
class Entry:
    schema: T.StructType
    file: str


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    for name, word in columns:
        if word not in TYPES:
            raise ValueError(f"{name}: unknown type {word}; there are {', '.join(TYPES)}")
    return T.StructType([T.StructField(name, TYPES[word], False) for name, word in columns])


def parse_catalog(text: str) -> dict[str, Entry]:
    found: dict[str, Entry] = {}
    words = iter(text.split())
    for word in words:
        if word != "BEGIN":
            raise ValueError(f"expected BEGIN, found {word}")
        block = []
        for inner in words:
            if inner == "END":
                break
            block.append(inner)
        else:
            raise ValueError("a block has no END")
        if len(block) < 4 or len(block) % 2:
            raise ValueError(f"a block needs a relation, a file and pairs of name and type: {' '.join(block)}")
        found[block[0]] = Entry(schema_of(list(zip(block[2::2], block[3::2], strict=True))), block[1])
    return found


def catalog_text(entries: dict[str, Entry]) -> str:
    rows = []
    for name, e in entries.items():
        rows += ["BEGIN", name, e.file, *(f"{f.name} {WORDS.get(f.dataType, 'String')}" for f in e.schema.fields), "END", ""]
    return "\n".join(rows)
