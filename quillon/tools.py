"""Named tools over a store, and a command line: `python -m quillon.tools query FOLDER "docs { _path }"`.

A tool is a function of (catalog, arguments) that gives a DataFrame. FOLDER holds one Parquet table per collection."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import history, search, walk
from .plans.lower import execute
from .plans.parser import QueryError
from .sources import corpus
from .sources.catalog import Catalog
from .sources.store import ORDER, catalog


def _docs_read(c: Catalog, path: str) -> DataFrame:
    rows = c.tables["blocks"].where(F.col("_path") == path).select("_path", F.col("_ordinal").alias("ordinal"), F.col("_raw").alias("raw"))
    return corpus.rendered(rows, "_path")


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "query": lambda c, text: execute(c, text, ordered=True),
    "graph": lambda c, start, degrees=1, direction="both": walk.neighbourhood(c.tables["links"].select(F.col("_src").alias("src"), F.col("_dst_node").alias("dst"), F.col("_predicate").alias("predicate")), [start], int(degrees), direction)[0],
    "blocks_search": lambda c, text, limit=50: search.bm25(c.tables["blocks"], "_id", "_text", text, int(limit)),
    "blocks_resolve": lambda c, text, limit=10: search.resolve(search.bm25(c.tables["blocks"], "_id", "_text", text, int(limit)), c.tables["blocks"]),
    "docs_list": lambda c: c.tables["docs"].orderBy(*ORDER["docs"]),
    "docs_tree": lambda c: corpus.tree(c.tables["docs"], "_path"),
    "docs_read": _docs_read,
    "docs_outline": lambda c, path: c.tables["blocks"].where((F.col("_path") == path) & (F.col("_type") == "heading")).orderBy("_ordinal").select("_ordinal", "level", "_text"),
    "blocks_read": lambda c, id: c.tables["blocks"].where(F.col("_id") == id),
    "links_stale": lambda c: corpus.stale_links(c.tables["links"].select(F.col("_dst_node").alias("dst"), F.col("_dst_kind").alias("dst_kind"), F.col("_src").alias("src")), "src"),
    "docs_history": lambda c, doc: history.numbered(c.tables["revisions"].where(F.col("_doc_id") == doc), "_doc_id", "_seq"),
    "changes_since": lambda c, cursor, limit=100: history.changes_since(c.tables["revisions"], "_seq", int(cursor), int(limit)),
}


def call(c: Catalog, name: str, **arguments) -> DataFrame:
    """The result of a tool; an unknown name or argument is an error."""
    if name not in TOOLS:
        raise QueryError(f"no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](c, **arguments)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillon")
    p.add_argument("tool", choices=sorted(TOOLS))
    p.add_argument("folder")
    p.add_argument("arguments", nargs="*", help="in the tool's order")
    p.add_argument("--limit", type=int, default=100, help="rows that are printed")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    held = {n: spark.read.parquet(f"{a.folder}/{n}.parquet") for n in ORDER if os.path.exists(f"{a.folder}/{n}.parquet")}
    for row in TOOLS[a.tool](catalog(held), *a.arguments).limit(a.limit).toJSON().collect():
        print(json.dumps(json.loads(row), ensure_ascii=False))


if __name__ == "__main__":
    main()
