"""Named collections: DataFrames with the columns that give their source order and identity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of the sample tables, where it is not the first column alone.
KEYS = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "conversations": ["conv_id", "turn"]}


@dataclass(frozen=True)
class Relation:
    """From a row to rows of a collection: (own column, comparison, their column) triples, `own <= theirs`, `==` first. consumer `first`:
    at most one row, which is read as a record."""

    to: str
    on: tuple[tuple[str, str, str], ...]
    consumer: str | None = None


@dataclass
class Catalog:
    """Collections by name; key columns order a collection's rows and tell them apart."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)
    #: Host functions, called with Columns.
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    #: The day that named dates count from, ISO; None: the day of the query.
    today: str | None = None
    #: (collection, name): rows that a row of the collection leads to.
    relations: dict[tuple[str, str], Relation] = field(default_factory=dict)
    #: Functions of the row: name -> (collection, arguments as trees) -> tree.
    macros: dict[str, Callable[[str | None, list], tuple]] = field(default_factory=dict)

    #: Patterns go to the engine unchecked.
    native_regex: bool = False

    def add(self, name: str, df: DataFrame, key: list[str] | None = None, json: dict[str, str] | None = None) -> Catalog:
        """Adds a collection; json gives the DDL schema of columns that hold JSON texts (malformed ones are absent)."""
        for c, ddl in (json or {}).items():
            df = df.withColumn(c, F.from_json(c, ddl))
        self.tables[name] = df
        self.keys[name] = key or df.columns[:1]
        return self

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        """Parquet tables of a folder, one per name."""
        out = cls()
        for n in names:
            out.add(n, spark.read.parquet(f"{folder}/{n}.parquet"), KEYS.get(n))
        return out
