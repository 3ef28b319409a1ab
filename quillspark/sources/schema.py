"""Declared fields, and the rows that break the declaration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {
    "string": {"string"},
    "text": {"string"},
    "numeric": {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"},
    "vector": {"array<float>", "array<double>"},
    "stored": None,
}


class SchemaError(ValueError):
    """Documents that a schema doesn't allow."""


@dataclass(frozen=True)
class Field:
    """A field's kind (string, text, numeric, vector or stored) and whether each document must have it."""

    name: str
    kind: str = "text"
    required: bool = False
    indexed: bool = True

    def __post_init__(self) -> None:
        if not self.name or any(ord(c) < 32 or ord(c) == 127 for c in self.name):
            raise ValueError(f"not a field name: {self.name!r}")
        if self.kind not in _KINDS:
            raise ValueError(f"unknown kind {self.kind}")


@dataclass(frozen=True)
class Schema:
    """Fields; strict: no others."""

    fields: tuple[Field, ...]
    strict: bool = False

    def problems(self, docs: DataFrame) -> list[str]:
        """What the columns break: names and types."""
        have, out = dict(docs.dtypes), []
        for f in self.fields:
            allowed, kind = _KINDS[f.kind], have.get(f.name)
            if kind is None:
                out += [f"{f.name} is missing"] if f.required else []
            elif allowed is not None:
                item = kind[6:-1] if kind.startswith("array<") and f.kind != "vector" else kind
                if item.split("(")[0] not in allowed:
                    out.append(f"{f.name} is {kind}, not {f.kind}")
        if self.strict:
            known = {f.name for f in self.fields} | {"doc_id"}
            out += [f"{c} isn't declared" for c in docs.columns if c not in known]
        return out

    def violations(self, docs: DataFrame) -> DataFrame:
        """(doc_id, missing): the rows that lack required fields, and which."""
        missing: list[Column] = [F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in self.fields if f.required and f.name in docs.columns]
        names = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
        return docs.select("doc_id", names.alias("missing")).where(F.size("missing") > 0)

    def validate(self, docs: DataFrame) -> DataFrame:
        """docs, if columns and rows are as declared; else a SchemaError."""
        if found := self.problems(docs):
            raise SchemaError("; ".join(found))
        if bad := self.violations(docs).take(1):
            raise SchemaError(f"document {bad[0].doc_id} lacks {', '.join(bad[0].missing)}")
        return docs
