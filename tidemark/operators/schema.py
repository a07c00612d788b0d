"""Field dictionaries: versions, validation, and compact or full JSON records."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The field types and what holds them in Spark, unsigned ones a step wider.
FIELD_TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(),
}


@dataclass(frozen=True)
class Field:
    index: int
    name: str
    type: str


class SchemaRegistry:
    """Append-only versions of one store's fields."""

    def __init__(self, versions: list[list[Field]] | None = None):
        self.versions = versions or []

    def add(self, fields: list[Field]) -> int:
        """A further version, from 1; it must keep every earlier field and may not use an index or name again."""
        if not fields:
            raise ValueError("a schema needs a field")
        names, indexes = [f.name for f in fields], [f.index for f in fields]
        if "" in names or len(set(names)) < len(names) or min(indexes) <= 0 or len(set(indexes)) < len(indexes):
            raise ValueError("field names and indexes must be given, positive and unique")
        if unknown := [f.type for f in fields if f.type not in FIELD_TYPES]:
            raise ValueError(f"unknown types: {unknown}")
        if self.versions and (lost := set(self.versions[-1]) - set(fields)):
            raise ValueError(f"earlier fields changed or missing: {sorted(f.name for f in lost)}")
        self.versions.append(sorted(fields, key=lambda f: f.index))
        return len(self.versions)

    def fields(self, version: int = 0) -> list[Field]:
        """Of a version; 0 is the current one."""
        if not self.versions or version > len(self.versions):
            raise KeyError(f"no schema version {version}")
        return self.versions[version - 1 if version else -1]

    def struct(self, version: int = 0) -> T.StructType:
        return T.StructType([T.StructField(f.name, FIELD_TYPES[f.type]) for f in self.fields(version)])

    def numeric(self, version: int = 0) -> dict[str, bool]:
        return {f.name: f.type not in ("bool", "string") for f in self.fields(version)}

    def dumps(self) -> str:
        return json.dumps([[asdict(f) for f in v] for v in self.versions])

    @classmethod
    def loads(cls, text: str) -> SchemaRegistry:
        return cls([[Field(**f) for f in v] for v in json.loads(text)])

    def _parsed(self, payload: Column, use: Callable[[Column], Column]) -> Column:
        """What `use` makes of the record as a map from keys to VARIANT, which is parsed once; null for what is no object."""
        return F.element_at(F.transform(F.array(F.from_json(payload, "map<string,variant>")), use), 1)

    def _renamed(self, record: Column, names: dict[str, str]) -> Column:
        """The object with the keys of `names` renamed, in that order; others are left out, values stay as they are.

        The work is by the fields that a record has, not by those that the schema has.
        """
        places = [x for i, (old, new) in enumerate(names.items()) for x in (F.lit(old), F.struct(F.lit(i).alias("at"), F.lit(json.dumps(new, ensure_ascii=False) + ":").alias("name")))]
        place = lambda e: F.element_at(F.create_map(*places), e["key"])
        known = F.filter(F.transform(F.map_entries(record), lambda e: F.struct(place(e)["at"].alias("at"), F.concat(place(e)["name"], F.coalesce(F.to_json(e["value"]), F.lit("null"))).alias("text"))), lambda x: x["at"].isNotNull())
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(known), lambda x: x["text"]), ","), F.lit("}"))

    def compact(self, payload: Column, version: int = 0) -> Column:
        """Names to indexes, ascending; null where validate() is false. Compact input stays as it is."""
        names = {f.name: str(f.index) for f in self.fields(version)}
        return self._parsed(payload, lambda r: F.when(self._within(r, [*names]), self._renamed(r, names)).when(self._within(r, [*names.values()]), payload))

    def expand(self, payload: Column, version: int = 0) -> Column:
        """Indexes to names; unknown indexes are skipped, and keys that are no numbers give null."""
        names = {str(f.index): f.name for f in self.fields(version)}
        return self._parsed(payload, lambda r: F.when(F.forall(F.map_keys(r), lambda k: k.rlike(r"^\d+$")), self._renamed(r, names)))

    def _within(self, record: Column, known: list[str]) -> Column:
        return F.coalesce(F.size(F.array_except(F.map_keys(record), F.array(*map(F.lit, known)))) == 0, F.lit(False))

    def is_full(self, payload: Column, version: int = 0) -> Column:
        return F.coalesce(self._parsed(payload, lambda r: self._within(r, [f.name for f in self.fields(version)])), F.lit(False))

    def is_compact(self, payload: Column, version: int = 0) -> Column:
        return F.coalesce(self._parsed(payload, lambda r: self._within(r, [str(f.index) for f in self.fields(version)])), F.lit(False))

    def validate(self, payload: Column, version: int = 0) -> Column:
        """Whether all keys are known names, or all are known indexes; fields may be absent."""
        return self.is_full(payload, version) | self.is_compact(payload, version)
