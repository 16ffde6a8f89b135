"""What queries range over: entities (a row per object) and their references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entity:
    """Objects of one type. key: columns that identify an object (none: anonymous objects); refs: property to the name
    of the entity whose key it holds; multi: properties are arrays of typed values (statement layout)."""

    name: str
    df: DataFrame
    key: tuple[str, ...] = ()
    refs: dict[str, str] = field(default_factory=dict)
    multi: bool = False

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if not (self.multi and c in self.key)]

    def key_of(self, at) -> Column:
        """The native key; at: a property's column."""
        return at(self.key[0]) if len(self.key) == 1 else F.struct(*[at(k).alias(f"k{i}") for i, k in enumerate(self.key)])

    def id_of(self, at) -> Column:
        return F.concat_ws("/", *([] if self.multi else [F.lit(self.name)]), *[at(k).cast("string") for k in self.key])


class Catalog:
    def __init__(self, *entities: Entity):
        self.entities = {e.name: e for e in entities}

    def add(self, entity: Entity) -> Catalog:
        self.entities[entity.name] = entity
        return self

    def having(self, props: set[str]) -> list[Entity]:
        return [e for e in self.entities.values() if e.multi or props <= set(e.props)]

    @staticmethod
    def parquet(spark: SparkSession, folder: str, tables: dict[str, tuple[tuple[str, ...], dict[str, str]]]) -> Catalog:
        """tables: name to (key, refs). A file is opened when the catalog is made, and scanned only by queries."""
        return Catalog(*[Entity(n, spark.read.parquet(f"{folder}/{n}.parquet"), key, refs) for n, (key, refs) in tables.items()])
