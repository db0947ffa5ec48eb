"""Query trees to DataFrame plans.

Every collection that a query reads gets columns under names of its own, so outer and inner rows can stand in one plan.
Conjuncts of a block's `where` that read no outer row filter the inner collection before any join; equalities with the
outer row become null-safe join keys; the rest is a join condition. Tests in `where` are semi and anti joins. A block
that is a value (count, lookup, list) is aggregated by its keys first and joined once, left; when it has conditions
other than equalities, the distinct outer values they read take the place of the keys.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions import temporal
from ..operators.walk import MAX_DEPTH, walk
from ..sources.catalog import Catalog
from .parser import Body, QueryError, parse

#: What a walk says of each row.
WALKED = ("$depth", "$stop", "$leaf", "$frontier", "$ordinal")
#: Comparisons with their sides changed.
MIRROR = {"==": "==", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
FUNCTIONS = ("date", "dur", "entries", "size", "has", "list", "range")
REDUCTIONS = ("count", "sum", "avg", "min", "max", "collect", "first", "last", "any", "all")


class Frame:
    """Rows in the making: a DataFrame, the columns that names read, the columns of the source order."""

    def __init__(self, df: DataFrame, fields: dict[str, str], order: list[str], parent: Frame | None = None):
        self.df, self.fields, self.order, self.parent = df, fields, order, parent
        self.aliases: dict[str, tuple] = {}
        self.open: set[str] = set()
        self.coll: str | None = None

    def at(self, depth: int) -> Frame | None:
        frame = self
        for _ in range(depth):
            frame = frame.parent if frame else None
        return frame

    def type(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType


def conjuncts(e: tuple | None) -> list[tuple]:
    if e is None:
        return []
    if e[0] == "op" and e[1] == "and":
        return conjuncts(e[2]) + conjuncts(e[3])
    return [e]


#: The collection of names by which refs() finds documents.
NAMES = "$names"


class Lowering:
    def __init__(self, catalog: Catalog, ordered: bool = False):
        self.catalog, self.ids, self.ordered = catalog, count(), ordered
        self.guarded = 0  # inside an operand that may not be reached: errors wait for a row that reaches it

    def fresh(self) -> str:
        return f"_{next(self.ids)}"

    # -- sources and bodies

    def scan(self, name: str, parent: Frame | None) -> Frame:
        if name not in self.catalog.tables:
            raise QueryError(f"unknown collection {name!r}")
        df, tag = self.catalog.tables[name], self.fresh()
        fields = {c: f"{tag}_{i}" if "." in c else f"{tag}_{c}" for i, c in enumerate(df.columns)}
        frame = Frame(df.toDF(*fields.values()), fields, [fields[c] for c in self.catalog.keys[name]], parent)
        frame.coll = name
        return frame

    def root(self, e: tuple, frame: Frame | None) -> str | None:
        """The collection that a receiver names: a name which no row on the way has, or one read from the root object."""
        if e[0] == "get" and e[1][0] == "name" and e[1][2] == "$it" and (frame is None or frame.at(e[1][1]) is None):
            return e[2]
        if e[0] != "name" or e[2] in ("$rows", "$it"):
            return None
        at = frame.at(e[1]) if frame else None
        if at is not None and (e[2] in at.fields or e[2] in at.aliases or e[2] in (getattr(at, "elements", None) or ())):
            return None
        return e[2]

    def related(self, frame: Frame, e: tuple) -> tuple:
        """A block whose receiver is a relation of the row, as a block over the relation's collection."""
        receiver, consumer, body = (e[1], e[2], e[3]) if e[0] == "block" else (e, "collect", Body())
        if receiver[0] == "call" and receiver[1] == "refs" and NAMES in self.catalog.tables:
            if len(receiver[2]) != 1 or receiver[2][0][0] not in ("name", "lit"):
                raise QueryError("refs() takes a name or a text")
            x = receiver[2][0]
            if x[0] == "name" and isinstance(self.typed(frame, x)[1], T.ArrayType):
                raise QueryError("refs() takes one text: flatten the list first")
            test = ("op", "==", ("name", 0, "_name"), ("name", x[1] + 1, x[2]) if x[0] == "name" else x)
            return ("block", ("name", 1, NAMES), consumer, replace(body, where=test if body.where is None else ("op", "and", test, body.where)))
        if receiver[0] != "name" or (at := frame.at(receiver[1])) is None or (rel := self.catalog.relations.get((at.coll, receiver[2]))) is None:
            return e
        test = reduce(lambda a, b: ("op", "and", a, b), [("op", MIRROR[op], ("name", 0, theirs), ("name", receiver[1] + 1, own)) for own, op, theirs in rel.on])
        body = replace(body, where=test if body.where is None else ("op", "and", test, body.where))
        return ("block", ("name", receiver[1], rel.to), rel.consumer if rel.consumer and consumer == "collect" else consumer, body)

    def run(self, e: tuple) -> DataFrame:
        if e[0] == "method" or e[0] != "block":
            raise QueryError("a query is a collection with a body")
        _, receiver, consumer, body = e
        if receiver == ("name", 0, "$it"):  # the root object: one row, whose names are the collections
            frame = Frame(next(iter(self.catalog.tables.values())).sparkSession.range(1).toDF(one := self.fresh()), {}, [one], None)
        elif receiver[0] == "call" and receiver[1] == "refs" and receiver[2] and receiver[2][0][0] == "lit":
            frame = self.scan(NAMES, None)
            self.filter(frame, ("op", "==", ("name", 0, "_name"), receiver[2][0]))
            del frame.fields["_name"]
        else:
            frame = self.union(receiver[1]) if receiver[0] == "tuple" else self.scan(self.root(receiver, None) or "", None)
        if consumer in ("exists", "none", "count"):
            frame = self.shaped(frame, body)[0]
            n = frame.df.agg(F.count(F.lit(1)).alias("value"))
            return n if consumer == "count" else n.select((F.col("value") > 0 if consumer == "exists" else F.col("value") == 0).alias("value"))
        frame, items = self.shaped(frame, body)
        if self.ordered and not (body.order or body.limit is not None or body.offset):
            frame.df = frame.df.orderBy(*self.sort(frame, Body()))
        out = [F.col(c).alias(n or "value") for n, c in items]
        if consumer == "first":
            frame.df = frame.df.limit(1)
        if consumer == "single":  # two rows tell whether there is more than one
            rows = frame.df.limit(2).agg(F.collect_list(F.struct(*out)).alias("r"))
            kind = rows.schema["r"].dataType.simpleString()
            rows = rows.select(F.explode(F.when(F.size("r") > 1, F.raise_error(F.lit("`single` found more than one row")).cast(kind)).otherwise(F.col("r"))).alias("r"))
            return rows.select("r.*")
        return frame.df.select(*out)

    def union(self, parts: list[tuple]) -> Frame:
        """A tuple source: collections one after another, columns by name."""
        frames = []
        for i, p in enumerate(parts):
            df = self.run(p if p[0] == "block" else ("block", p, "collect", Body()))
            frames.append(df.withColumn("__part", F.lit(i)))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        tag = self.fresh()
        fields = {c: f"{tag}_{c}" for c in df.columns}
        out = Frame(df.toDF(*fields.values()), fields, [*fields.values()], None)
        del out.fields["__part"]
        return out

    def shaped(self, frame: Frame, body: Body) -> tuple[Frame, list[tuple[str | None, str]]]:
        """Applies a body's clauses in order; the frame, and output names with their columns."""
        frame.aliases = {n: x for n, lift, x in body.select or [] if n and not lift}
        key = next((x for n, _, x in body.select or [] if n == "$key"), None)
        if body.select is not None:
            body.select = [i for i in body.select if i[0] != "$key"]
        if body.group:
            self.staged(body)
        after = [e for e in conjuncts(body.where) if body.follow and any(d == 0 and n in WALKED for d, n in self.reads(e))]
        self.where(frame, [e for e in conjuncts(body.where) if e not in after])
        if body.follow:
            self.follow(frame, body, key)
        elif body.frontier is not None:
            raise QueryError("`frontier` needs a `follow`")
        for e in after:
            self.filter(frame, e)
        if body.source is not None:
            self.reproject(frame, body.source)
        for name, e in body.flatten:
            self.flatten(frame, name, e)
        if body.group:
            items = self.grouped(frame, body)
        else:
            items = self.project(frame, body.select)
        if body.having is not None:
            for e in conjuncts(body.having):
                self.filter(frame, e)
        order = self.sort(frame, body)
        if body.distinct and items and (body.select is not None or not frame.coll) and not (body.order or body.limit is not None or body.offset or self.ordered):
            frame.df = frame.df.select(*(c for _, c in items)).distinct()
        elif body.distinct and (items or frame.coll):
            # Rows that are not projected are told apart by their identity.
            keys = [c for _, c in items] if body.select is not None or not frame.coll else [frame.fields[c] for c in self.catalog.keys[frame.coll]]
            w = Window.partitionBy(*keys).orderBy(*order)
            first = self.fresh()
            frame.df = frame.df.withColumn(first, F.row_number().over(w)).where(F.col(first) == 1).drop(first)
        if body.order or body.limit is not None or body.offset:
            frame.df = frame.df.orderBy(*order)
        if body.offset:
            frame.df = frame.df.offset(body.offset)
        if body.limit is not None:
            frame.df = frame.df.limit(body.limit)
        return frame, items

    def staged(self, body: Body) -> None:
        """Clauses before `group by` see rows, so they can't read an item that was written for the group's rows."""
        late = {n for n, _, e in body.select or [] if n and ("$rows" in repr(e))}
        before = {"where": [body.where], "from": [body.source], "frontier": [body.frontier], "flatten": [e for _, e in body.flatten], "group by": [e for n, e in body.group if e != ("name", 0, n)]}
        for clause, trees in before.items():
            for depth, name in set().union(*(self.reads(e) for e in trees if e is not None)) if trees else set():
                if depth == 0 and name in late:
                    raise QueryError(f"`{name}` reads `$rows`, which `{clause}` has not grouped yet; `having` can read it")

    def where(self, frame: Frame, tests: list[tuple]) -> None:
        """Conjuncts from left to right; one that is false ends them, and errors of later ones wait for a row."""
        for i, e in enumerate(tests):
            if e == ("lit", False):
                frame.df = frame.df.where(F.lit(False))
                return
            self.guarded += bool(i)
            try:
                self.filter(frame, e)
            finally:
                self.guarded -= bool(i)

    def sort(self, frame: Frame, body: Body) -> list[Column]:
        """Sort columns: absent last in both directions, then the source order."""
        out = []
        for e, desc in body.order:
            c = self.named(frame, self.value(frame, e))
            out.append(F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last())
        return out + [F.col(c).asc_nulls_last() for c in frame.order]

    def named(self, frame: Frame, c: Column) -> str:
        name = self.fresh()
        frame.df = frame.df.withColumn(name, c)
        return name

    def project(self, frame: Frame, select: list | None) -> list[tuple[str | None, str]]:
        if select is None:
            return [(n, c) for n, c in frame.fields.items() if not n.startswith("$")]
        out = []
        for name, lift, e in select:
            if lift:
                raise QueryError("a lift is only valid in a collect in where position")
            frame.open.add(name or "")
            out.append((name, self.named(frame, self.value(frame, e))))
            frame.open.discard(name or "")
        return out

    def key(self, frame: Frame, e: tuple | None) -> Column:
        """A row's identity: the expression given, else the collection's key."""
        if e is not None:
            return self.value(frame, e)
        cols = [frame.fields[c] for c in self.catalog.keys[frame.coll]]
        return F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)

    def follow(self, frame: Frame, body: Body, key: tuple | None) -> None:
        """Replaces the seeds by the rows of their walk. The destinations become one table of edges between keys."""
        coll = frame.coll
        if coll is None:
            raise QueryError("`follow` needs the rows of a collection")
        mark = F.lit(False) if body.frontier is None else self.test(frame, body.frontier)
        seeds = frame.df.select(self.key(frame, key).alias("key"), mark.alias("frontier"))
        edges, depths = None, []
        for rank, dest in enumerate(body.follow):
            if dest[0] != "block" or self.root(dest[1], None) != coll or dest[2] not in ("collect", "first", "single"):
                raise QueryError("`follow` takes blocks over the walk's own collection: `follow ^rows { where ... }`")
            b, base = dest[3], self.scan(coll, frame.parent)
            src = self.named(base, self.key(base, key))
            inner, keys, cond = self.correlated(coll, b.where, base)
            inner, keys = self.keyed(base, inner, keys, cond)
            limit = 1 if dest[2] != "collect" else b.limit
            if limit is not None:
                n = self.fresh()
                inner.df = inner.df.withColumn(n, F.row_number().over(Window.partitionBy(*(k for k, _ in keys)).orderBy(*self.sort(inner, b))))
                inner.df = inner.df.where((F.col(n) > (b.offset or 0)) & (F.col(n) <= (b.offset or 0) + limit))
            dst, front = self.named(inner, self.key(inner, key)), self.named(inner, F.lit(False) if b.frontier is None else self.test(inner, b.frontier))
            depths.append(b.depth or MAX_DEPTH)
            step = base.df.join(inner.df.select(*dict.fromkeys([*(k for k, _ in keys), dst, front])), self.condition(keys, []), "inner")
            step = step.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(front).alias("frontier"), F.lit(depths[-1]).alias("depth"), F.lit(rank).alias("rank"))
            edges = step if edges is None else edges.unionByName(step)
        reads = set().union(*(self.reads(x) for _, _, x in body.select or []), *(self.reads(x) for x, _ in body.order), self.reads(body.where), *(self.reads(x) for _, x in body.group))
        rows = walk(seeds, edges, max(depths), body.follow_distinct, (0, "$ordinal") in reads, min(depths))
        tag = self.fresh()
        rows = rows.withColumnsRenamed({c: f"{tag}_{c}" for c in rows.columns})
        fresh = self.scan(coll, frame.parent)
        own = self.named(fresh, self.key(fresh, key))
        frame.df = rows.join(fresh.df, F.col(f"{tag}_key").eqNullSafe(F.col(own))).withColumn(f"{tag}_leaf", F.col(f"{tag}_stop") == "leaf").withColumn(f"{tag}_frontier", F.col(f"{tag}_stop").isin("frontier", "depth"))
        frame.fields = fresh.fields | {n: c for n in WALKED if (c := f"{tag}_{n[1:]}") in frame.df.columns} | {"$key": f"{tag}_key"}
        frame.order = [f"{tag}_path"]

    def reproject(self, frame: Frame, e: tuple) -> None:
        """`from e`: each row gives way to the rows of e."""
        self.flatten(frame, "$it", e)
        c = frame.fields["$it"]
        t = frame.df.schema[c].dataType
        names = t.fieldNames() if isinstance(t, T.StructType) else []
        if not names:
            frame.df = frame.df.where(F.col(c).isNotNull())
        frame.fields = {n: self.named(frame, F.col(c)[n]) for n in names} | {"$it": c}
        frame.coll = None

    def flatten(self, frame: Frame, name: str, e: tuple) -> None:
        e = self.related(frame, e)
        if e[0] == "block" and (coll := self.root(e[1], frame)):
            inner, keys, cond = self.correlated(coll, e[3].where, frame)
            if e[3].limit is not None or e[3].offset:  # per outer row
                inner, keys = self.keyed(frame, inner, keys, cond)
                cond = []
                rank = self.fresh()
                w = Window.partitionBy(*(k for k, _ in keys)).orderBy(*self.sort(inner, e[3]))
                inner.df = inner.df.withColumn(rank, F.row_number().over(w)).where((F.col(rank) > (e[3].offset or 0)) & (F.col(rank) <= (e[3].offset or 0) + (2**31 if e[3].limit is None else e[3].limit)))
            value = self.fresh()
            inner.aliases = {n: x for n, _, x in e[3].select or [] if n}
            if e[3].select is not None and e[3].values:
                c = self.value(inner, e[3].select[0][2])
                inner.df = inner.df.withColumn(value, c)
            else:
                items = self.project(inner, e[3].select)
                inner.df = inner.df.withColumn(value, F.struct(*(F.col(c).alias(n) for n, c in items)))
            tie = [c for c in inner.order if c in inner.df.columns]
            frame.df = frame.df.join(inner.df.select(*{k for k, _ in keys}, *(c for c in dict.fromkeys([*tie, *self.read(cond, inner)]) if c not in {k for k, _ in keys}), value), self.condition(keys, [x for x, _ in cond]), "inner")
            frame.fields[name] = value
            frame.order = frame.order + tie
            return
        c = self.value(frame, e)
        t = frame.type(c)
        pos, val = self.fresh(), self.fresh()
        one = c if isinstance(t, T.ArrayType) else F.array(c)
        # An empty list has no row, an absent value one row.
        frame.df = frame.df.select("*", F.posexplode(F.when(c.isNull(), F.array(F.lit(None))).otherwise(one)).alias(pos, val))
        frame.fields[name] = val
        frame.order = [*frame.order, pos]

    # -- grouping

    def grouped(self, frame: Frame, body: Body, by: tuple[str, ...] = ()) -> list[tuple[str | None, str]]:
        """Groups by the body's keys, and by columns of a nested block's outer row."""
        keys = []
        for name, e in body.group:
            frame.open.add(name)
            keys.append((name, self.named(frame, self.value(frame, e))))
            frame.open.discard(name)
        select = body.select or [*((n, 0, ("name", 0, n)) for n, _ in keys), ("count", 0, ("call", "count", [("name", 0, "$rows")]))]
        aggs: list[Column] = []
        known = dict(keys)

        def put(c: Column) -> tuple:
            name = self.fresh()
            aggs.append(c.alias(name))
            return ("col", name)

        aliases = {n: e for n, _, e in select if n and n not in known}

        def walk(e, active: frozenset = frozenset()):
            if not isinstance(e, tuple):
                return [walk(x, active) for x in e] if isinstance(e, list) else e
            if e[0] == "call" and e[1] in REDUCTIONS and not self.late(e[1], e[2][0]):
                return put(self.reduction(frame, e[1], e[2][0]))
            if e == ("name", 0, "$rows") or e[0] == "block" and e[1] == ("name", 0, "$rows") and (e[2] not in ("count", "exists", "none") or not plain(e[3])):
                rows = put(self.listed(frame, self.value(frame, ("name", 0, "$it"))))
                return rows if e[0] == "name" else ("block", rows, e[2], e[3])
            if e[0] == "block" and e[1] == ("name", 0, "$rows"):
                n = F.count_if(self.test(frame, e[3].where)) if e[3].where is not None else F.count(F.lit(1))
                return put({"count": n, "exists": n > 0, "none": n == 0}[e[2]])
            if e[0] == "name" and e[1] == 0:
                if e[2] in known:
                    return ("col", known[e[2]])
                if e[2] in aliases and e[2] not in active:
                    return walk(aliases[e[2]], active | {e[2]})
                return put(self.listed(frame, self.value(frame, e)))
            return (e[0], *(walk(x, active) for x in e[1:]))

        plain = lambda b: not (b.distinct or b.order or b.offset or b.limit is not None or b.group or b.flatten or b.source)
        trees = [(n, walk(e, frozenset([n]) if n else frozenset())) for n, _, e in select]
        having = walk(body.having) if body.having is not None else None
        order = [(walk(e), d) for e, d in body.order]
        # Groups keep the order of their first rows where that shows: in bounds and values, and to part ties.
        told = {("col", c) for _, c in keys} <= {e for e, _ in order}
        shown = bool(by) or body.limit is not None or bool(body.offset) or bool(order) or self.ordered
        ties = [] if told or not shown else [self.fresh()]
        for name in ties:
            aggs.append((F.min(frame.order[0]) if len(frame.order) == 1 else F.min(F.struct(*frame.order))).alias(name))
        grouped = frame.df.groupBy(*by, *(c for _, c in keys))
        frame.df = grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias(self.fresh()))
        frame.fields, frame.aliases, frame.order, frame.coll = dict(keys), {}, ties, None
        body.having, body.order = having, order
        return [(n, self.named(frame, self.value(frame, e))) for n, e in trees]

    def late(self, name: str, arg: tuple) -> bool:
        """Whether a reduction takes the group's rows in a form that only their list can give."""
        if arg[0] != "block" or arg[1] != ("name", 0, "$rows"):
            return False
        b = arg[3]
        return arg[2] != "collect" or bool(b.order or b.limit is not None or b.offset or b.group or b.flatten or b.source) or b.distinct and (name != "count" or not b.select)

    def listed(self, frame: Frame, c: Column, where: Column | None = None, present: bool = False) -> Column:
        """Values in source order."""
        row = F.struct(*frame.order, c.alias("v"))
        if present:
            where = c.isNotNull() if where is None else where & c.isNotNull()
        rows = F.collect_list(row if where is None else F.when(where, row))
        return F.transform(F.array_sort(rows), lambda x: x["v"])

    def reduction(self, frame: Frame, name: str, arg: tuple) -> Column:
        where, distinct = None, False
        if arg == ("name", 0, "$rows"):
            if name != "count":
                raise QueryError(f"{name}($rows) needs a value")
            return F.count(F.lit(1))
        if arg[0] == "block" and arg[1] == ("name", 0, "$rows"):
            body = arg[3]
            where = self.test(frame, body.where) if body.where is not None else None
            distinct = body.distinct
            if not body.select:
                return F.count(F.lit(1)) if where is None else F.count_if(where)
            c = self.value(frame, body.select[0][2])
        else:
            c = self.value(frame, arg)
        t = frame.type(c)
        only = c if where is None else F.when(where, c)
        order = F.struct(*frame.order)
        present = c.isNotNull() if where is None else where & c.isNotNull()
        if name == "count":
            return F.count_distinct(only) if distinct else F.count(only)
        if name in ("sum", "avg") and S.kind(t) not in ("number", "absent"):
            raise QueryError(f"{name} needs numbers")
        if distinct:
            raise QueryError("`distinct` is only supported in count")
        return {
            "sum": lambda: F.coalesce(F.sum(only.cast("double")), F.lit(0.0)), "avg": lambda: F.avg(only), "min": lambda: F.min(only), "max": lambda: F.max(only),
            "first": lambda: F.min_by(c, F.when(present, order)), "last": lambda: F.max_by(c, F.when(present, order)), "collect": lambda: self.listed(frame, c, where, True),
            "any": lambda: F.coalesce(F.bool_or(S.truthy(only, t) if where is None else F.when(where, S.truthy(c, t))), F.lit(False)),
            "all": lambda: F.coalesce(F.bool_and(S.truthy(only, t) if where is None else F.when(where, S.truthy(c, t))), F.lit(True)),
        }[name]()

    # -- correlated blocks

    def outer(self, e, depth: int = 0) -> set[tuple[int, str]]:
        """Names that a tree reads outside its own row: (scopes out, name)."""
        if isinstance(e, Body):
            parts = [x for _, _, x in e.select or []] + [e.where, e.having] + [x for _, x in e.flatten] + [x for _, x in e.group] + [x for x, _ in e.order]
            return set().union(*(self.outer(x, depth + 1) for x in parts if x is not None)) if parts else set()
        if isinstance(e, list):
            return set().union(*(self.outer(x, depth) for x in e)) if e else set()
        if not isinstance(e, tuple):
            return set()
        if e[0] == "name":
            return {(e[1] - depth, e[2])} if e[1] > depth else set()
        if e[0] == "block" and e[1][0] == "name":
            at = e[1]
            own = self.outer(at, depth) if at[2] not in self.catalog.tables else set()
            return own | self.outer(e[3], depth)
        return set().union(*(self.outer(x, depth) for x in e[1:])) if len(e) > 1 else set()

    def correlated(self, coll: str, where: tuple | None, frame: Frame) -> tuple[Frame, list[tuple[str, Column]], list[tuple[Column, list[str]]]]:
        """The inner collection with its own filters applied, (inner column, outer value) keys, and other conditions
        with the outer columns that they read."""
        inner = self.scan(coll, frame)
        keys, cond, late = [], [], []
        for e in conjuncts(where):
            out = self.outer(e)
            if out and self.blocks(e):
                late.append((e, self.columns(frame, out)))
                continue
            if not out:
                self.filter(inner, e)
                continue
            if e[0] == "op" and e[1] == "==":
                for a, b in ((e[2], e[3]), (e[3], e[2])):
                    if not self.outer(a) and self.outer(b) == self.reads(b):
                        keys.append((self.named(inner, self.value(inner, a)), self.value(inner, b)))
                        break
                else:
                    cond.append((self.test(inner, e), self.columns(frame, out)))
                continue
            cond.append((self.test(inner, e), self.columns(frame, out)))
        if late:  # blocks that read the outer row too: its distinct values come to the inner rows first
            inner, keys = self.keyed(frame, inner, keys, [*cond, (F.lit(True), []), *((F.lit(True), c) for _, c in late)], late)
            cond = []
        return inner, keys, cond

    def blocks(self, e) -> bool:
        """Whether a tree holds a block."""
        return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "block" or any(self.blocks(x) for x in e))

    def reads(self, e) -> set[tuple[int, str]]:
        """All names that a tree reads, own row's too."""
        if isinstance(e, list):
            return set().union(*(self.reads(x) for x in e)) if e else set()
        if not isinstance(e, tuple):
            return set()
        if e[0] == "name":
            return {(e[1], e[2])}
        return set().union(*(self.reads(x) for x in e[1:])) if len(e) > 1 else set()

    def columns(self, frame: Frame, out: set[tuple[int, str]]) -> list[str]:
        return [f.fields[n] for d, n in sorted(out) if (f := frame.at(d - 1)) and n in f.fields]

    def read(self, cond: list, inner: Frame) -> list[str]:
        """Inner columns that join conditions may read."""
        return list(inner.fields.values()) if cond else []

    def condition(self, keys: list[tuple[str, Column]], cond: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(v) for k, v in keys] + cond, F.lit(True))

    def keyed(self, frame: Frame, inner: Frame, keys: list, cond: list, late: list | None = None) -> tuple[Frame, list[tuple[str, Column]]]:
        """Inner rows with columns that are equal to outer values exactly where the block's conditions hold."""
        if not cond:
            return inner, keys
        held = {c: self.fresh() for _, names in cond for c in names}
        outer_keys = [(self.fresh(), v) for _, v in keys]
        values = frame.df.select(*held, *(v.alias(n) for n, v in outer_keys)).distinct()
        on = self.condition([(k, F.col(n)) for (k, _), (n, _) in zip(keys, outer_keys)], [c for c, _ in cond])
        inner.df = inner.df.join(values, on, "inner")
        for e, _ in late or []:
            self.filter(inner, e)
        inner.df = inner.df.withColumnsRenamed(held)
        return inner, [(held[c], F.col(c)) for c in held] + outer_keys

    def filter(self, frame: Frame, e: tuple) -> None:
        negated = e[0] == "not" and e[1][0] in ("block", "call")
        block = e[1] if negated else e
        if block[0] == "call" and block[1] in self.catalog.macros:
            block = self.catalog.macros[block[1]](frame.coll, block[2])
            e = ("not", block) if negated else block
        if block[0] == "op" and block[1] == "and" and not negated:
            self.where(frame, conjuncts(block))
            return
        if block[0] == "block":
            block = self.related(frame, block)
        if block[0] == "block" and not block[3].offset and block[3].limit != 0 and block[2] in ("exists", "none", "collect") and (coll := self.root(block[1], frame)) and not block[3].group and not block[3].flatten:
            lifts = [(n, x) for n, lift, x in block[3].select or [] if lift]
            if lifts and not negated:
                value = self.block(frame, ("block", block[1], "collect", Body(select=[(n, 0, x) for n, x in lifts], where=block[3].where, order=block[3].order)))
                rows = self.named(frame, value)
                for n, _ in lifts:
                    frame.fields[n] = self.named(frame, F.col(rows)[n])
                    frame.aliases.pop(n, None)
                frame.df = frame.df.where(F.size(rows) > 0)
                return
            inner, keys, cond = self.correlated(coll, block[3].where, frame)
            anti = (block[2] == "none") != negated
            if not keys and not cond:  # one row answers for all
                inner.df = inner.df.limit(1)
            frame.df = frame.df.join(inner.df, self.condition(keys, [c for c, _ in cond]), "left_anti" if anti else "left_semi")
            return
        keep = self.test(frame, ("not", block) if negated else block)
        frame.df = frame.df.where(keep)

    def ranged(self, frame: Frame, coll: str, consumer: str, body: Body) -> Column | None:
        """A block whose only condition beside equalities bounds an inner value by an outer one: the nearest such row
        (`first`, ordered by that value), or how many there are (count, exists, none). Outer values and inner rows are
        laid side by side in one window per key, so each is read once; None where the block has another form."""
        if body.group or body.flatten or body.follow or body.source or body.distinct or body.offset or body.limit is not None or consumer not in ("first", "count", "exists", "none"):
            return None
        tests = conjuncts(body.where)
        bounds = [e for e in tests if self.outer(e) and e[0] == "op" and e[1] in ("<", "<=", ">", ">=") and not self.blocks(e)]
        if len(bounds) != 1 or any(self.outer(e) and (e[0] != "op" or e[1] != "==" or self.blocks(e)) for e in tests if e is not bounds[0]):
            return None
        _, op, a, b = bounds[0]
        if self.outer(a) and not self.outer(b):
            a, b, op = b, a, MIRROR[op]
        if self.outer(a) or self.outer(b) != self.reads(b):
            return None
        down = op[0] == "<"  # inner values below the outer one
        if consumer == "first" and (not body.order or body.order[0] != (a, down)):
            return None
        rest = [e for e in tests if e is not bounds[0]]
        inner, keys, cond = self.correlated(coll, reduce(lambda x, y: ("op", "and", x, y), rest) if rest else None, frame)
        if cond:
            return None
        (x, tx), (y, ty) = self.typed(inner, a), self.typed(inner, b)
        if S.kind(tx) != S.kind(ty) or S.kind(tx) not in ("number", "string"):
            return None
        at, side, by = self.fresh(), self.fresh(), [k for k, _ in keys]
        inner_first = len(op) == 2  # equal values count
        outer_value = self.named(frame, y)
        probes = frame.df.select(*(v.alias(k) for k, v in keys), F.col(outer_value).alias(at)).where(F.col(at).isNotNull()).distinct().withColumn(side, F.lit(1 if inner_first else 0))
        rows = inner.df.withColumn(at, x).where(F.col(at).isNotNull()).withColumn(side, F.lit(0 if inner_first else 1))
        found, out = self.fresh(), self.fresh()
        names = [*by, at, side]
        if consumer == "first":
            inner.df = rows
            order = [(self.named(inner, self.value(inner, e)), desc) for e, desc in body.order[1:]] + [(c, False) for c in inner.order]
            items = self.project(inner, body.select)
            value = F.col(items[0][1]) if body.values else F.struct(*(F.col(c).alias(n) for n, c in items))
            rows = inner.df.select(*names, *dict.fromkeys(c for c, _ in order), F.struct(value.alias("v")).alias(found))
            # The row that is wanted is the last one before the outer value in the reverse order.
            back = [F.col(c).asc_nulls_first() if desc else F.col(c).desc_nulls_first() for c, desc in order]
        else:
            rows, back = rows.select(*names, F.lit(1).alias(found)), []
        both = rows.unionByName(probes, allowMissingColumns=True)
        w = Window.partitionBy(*by).orderBy(F.col(at).asc() if down else F.col(at).desc(), side, *back).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.last(found, ignorenulls=True).over(w)["v"] if consumer == "first" else F.count(found).over(w)
        answer, key, match = both.withColumn(out, last).where(F.col(side) == (1 if inner_first else 0)), self.fresh(), {k: self.fresh() for k in by}
        answer = answer.select(*(F.col(k).alias(n) for k, n in match.items()), F.col(at).alias(key), out)
        on = self.condition([(match[k], v) for k, v in keys], [F.col(key) == F.col(outer_value)])
        frame.df = frame.df.join(answer, on, "left").drop(*match.values(), key)
        c = F.col(out)
        return c if consumer == "first" else {"count": F.coalesce(c, F.lit(0)), "exists": F.coalesce(c, F.lit(0)) > 0, "none": F.coalesce(c, F.lit(0)) == 0}[consumer]

    def block(self, frame: Frame, e: tuple) -> Column:
        """A block over a collection as a value of each outer row."""
        e = self.related(frame, e)
        _, receiver, consumer, body = e
        coll = self.root(receiver, frame)
        if coll is None or coll not in self.catalog.tables and receiver[0] == "name" and (at := frame.at(receiver[1])) is not None and at.parent is None and at.coll:
            return self.array_block(frame, e)
        if (c := self.ranged(frame, coll, consumer, body)) is not None:
            return c
        inner, keys, cond = self.correlated(coll, body.where, frame)
        inner, keys = self.keyed(frame, inner, keys, cond)
        by = [k for k, _ in keys]
        out = self.fresh()
        items = None
        if body.group:
            inner.aliases = {n: x for n, lift, x in body.select or [] if n and not lift}
            items = self.grouped(inner, body, tuple(by))
            for h in conjuncts(body.having):
                self.filter(inner, h)
        if consumer in ("count", "exists", "none"):
            if body.distinct and body.select:  # an absent value is one of them
                n = F.count_distinct(F.struct(*(self.value(inner, x) for _, _, x in body.select)))
            else:
                n = F.count(F.lit(1))
            if body.offset:
                n = F.greatest(n - body.offset, F.lit(0))
            if body.limit is not None:
                n = F.least(n, F.lit(body.limit))
            inner.df = inner.df.groupBy(*by).agg(n.alias(out))
        else:
            order = self.sort(inner, body)
            items = items or self.project(inner, body.select)
            value = F.col(items[0][1]) if body.values else F.struct(*(F.col(c).alias(n) for n, c in items))
            rank, v = self.fresh(), self.fresh()
            if not by and consumer == "first" and not body.offset:  # the first row of all needs no window
                inner.df = inner.df.orderBy(*order).limit(1)
            w = Window.partitionBy(*by).orderBy(*order)
            inner.df = inner.df.withColumn(v, value)
            if body.distinct and body.select:
                once = self.fresh()
                inner.df = inner.df.withColumn(once, F.row_number().over(Window.partitionBy(*by, v).orderBy(*order))).where(F.col(once) == 1).drop(once)
            inner.df = inner.df.withColumn(rank, F.row_number().over(w))
            if consumer in ("first", "single", "single!"):
                if consumer != "first":
                    every = F.count(F.lit(1)).over(Window.partitionBy(*by))
                    inner.df = inner.df.withColumn(v, F.when(every > 1, F.raise_error(F.lit("more than one row")).cast(inner.type(F.col(v)))).otherwise(F.col(v)))
                inner.df = inner.df.where(F.col(rank) == 1 + (body.offset or 0)).select(*by, F.col(v).alias(out))
            else:
                lo = body.offset or 0
                if body.limit is not None or lo:
                    inner.df = inner.df.where((F.col(rank) > lo) & (F.col(rank) <= lo + (body.limit if body.limit is not None else 2**31 - 1 - lo)))
                rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(v).alias("v"))))
                inner.df = inner.df.groupBy(*by).agg(F.transform(rows, lambda x: x["v"]).alias(out))
        frame.df = frame.df.join(inner.df.select(*by, out), self.condition(keys, []), "left") if by else frame.df.join(inner.df.select(out), how="left")
        frame.df = frame.df.drop(*by)
        c = F.col(out)
        if consumer == "count":
            return F.coalesce(c, F.lit(0))
        if consumer in ("exists", "none"):
            some = F.coalesce(c, F.lit(0)) > 0
            return some if consumer == "exists" else ~some
        if consumer == "collect":
            return F.coalesce(c, F.array().cast(frame.type(c)))
        if consumer == "single!":
            return F.when(c.isNull(), F.raise_error(F.lit("required value is absent")).cast(frame.type(c))).otherwise(c)
        return c

    def array_block(self, frame: Frame, e: tuple) -> Column:
        """A block over a list of the row, by higher-order functions."""
        _, receiver, consumer, body = e
        arr = self.value(frame, receiver)
        t = frame.type(arr)
        single = isinstance(t, T.StructType)  # one object is one row
        if single:
            arr, t = F.when(arr.isNull(), F.array().cast(T.ArrayType(t))).otherwise(F.array(arr)), T.ArrayType(t)
        if not isinstance(t, T.ArrayType):
            raise QueryError("a block needs a list or a collection")
        if body.follow or body.source is not None:
            raise QueryError("follow and from are not supported in a block over a list")
        if consumer in ("count", "exists", "none", "collect") and not single:
            arr = F.coalesce(arr, F.array().cast(t))
        names = t.elementType.fieldNames() if isinstance(t.elementType, T.StructType) else []
        fields = {n: (lambda x, n=n: x[n], t.elementType[n].dataType) for n in names}
        fields["$it"] = (lambda x: x, t.elementType)

        def scope(x: Column) -> Frame:
            f = Frame(frame.df, {}, [], frame)
            f.elements = {n: (get(x), kind) for n, (get, kind) in fields.items()}
            return f

        if body.where is not None:
            arr = F.filter(arr, lambda x: self.test(scope(x), body.where))
        for name, e in body.flatten:  # each element once for each of its inner values
            had = dict(fields)

            def spread(x: Column, e=e) -> Column:
                c, kind = self.typed(scope(x), e)
                return c if isinstance(kind, T.ArrayType) else F.array(c)

            kind = self.typed(scope(F.lit(None)), e)[1]
            arr = F.flatten(F.transform(arr, lambda x: F.transform(spread(x), lambda y: F.struct(x.alias("row"), y.alias("value")))))
            fields = {n: (lambda x, get=get: get(x["row"]), k) for n, (get, k) in had.items()}
            fields[name] = (lambda x: x["value"], kind.elementType if isinstance(kind, T.ArrayType) else kind)
        if body.group:
            kinds = {n: self.typed(scope(F.lit(None)), e)[1] for n, e in body.group}
            rows_of, had = arr, dict(fields)
            key = lambda x: F.struct(*(self.value(scope(x), e).alias(n) for n, e in body.group))
            whole = lambda x: F.struct(*(get(x).alias(n) for n, (get, _) in had.items() if not n.startswith("$")))
            keyed = F.transform(rows_of, lambda x: F.struct(key(x).alias("k"), x.alias("x")))
            arr = F.transform(F.array_distinct(F.transform(keyed, lambda y: y["k"])), lambda k: F.struct(k.alias("k"), F.transform(F.filter(keyed, lambda y: y["k"].eqNullSafe(k)), lambda y: y["x"]).alias("rows")))
            row = T.StructType([T.StructField(n, kd) for n, (_, kd) in had.items() if not n.startswith("$")])
            fields = {n: (lambda g, get=get: F.transform(g["rows"], get), T.ArrayType(kd)) for n, (get, kd) in had.items() if not n.startswith("$")}
            fields["$rows"] = (lambda g: F.transform(g["rows"], whole), T.ArrayType(row)) if names or body.flatten else (lambda g: g["rows"], t)
            fields |= {n: (lambda g, n=n: g["k"][n], kd) for n, kd in kinds.items()}
            fields["$it"] = (lambda g: g["k"], T.StructType([T.StructField(n, kd) for n, kd in kinds.items()]))
            if body.select is None:
                body.select = [*((n, 0, ("name", 0, n)) for n, _ in body.group), ("count", 0, ("call", "count", [("name", 0, "$rows")]))]
            inline = {n: e for n, _, e in body.select if n and n not in kinds}
            named = lambda e: tuple(named(x) for x in e) if isinstance(e, tuple) and e[:2] != ("name", 0) else [named(x) for x in e] if isinstance(e, list) else inline.get(e[2], e) if isinstance(e, tuple) else e
            if body.having is not None:
                having = named(body.having)
                arr = F.filter(arr, lambda g: self.test(scope(g), having))
            body.order = [(named(e), d) for e, d in body.order]
        if body.order:

            def before(x: Column, y: Column) -> Column:
                test = F.lit(0)
                for spec, desc in reversed(body.order):
                    p, q = self.value(scope(x), spec), self.value(scope(y), spec)
                    less, more = (F.lit(1), F.lit(-1)) if desc else (F.lit(-1), F.lit(1))
                    test = F.when(p.isNull() & q.isNull(), test).when(p.isNull(), 1).when(q.isNull(), -1).when(p < q, less).when(p > q, more).otherwise(test)
                return test

            arr = F.array_sort(arr, before)
        bounded = body.offset or body.limit is not None
        cut = lambda a: F.slice(a, 1 + (body.offset or 0), body.limit if body.limit is not None else 2**31 - 1) if bounded else a
        if body.select is not None and (body.distinct or consumer not in ("count", "exists", "none")):
            arr = arr if body.distinct else cut(arr)
            make = lambda x: self.value(scope(x), body.select[0][2]) if body.values else F.struct(*(self.value(scope(x), i).alias(n) for n, _, i in body.select))
            arr = F.transform(arr, make)
            arr = cut(F.array_distinct(arr)) if body.distinct else arr
        else:
            arr = cut(F.array_distinct(arr) if body.distinct else arr)
        if consumer in ("count", "exists", "none"):
            n = F.coalesce(F.size(arr), F.lit(0))
            return {"count": n, "exists": n > 0, "none": n == 0}[consumer]
        if consumer == "first" or single:
            return F.get(arr, F.lit(0))
        if consumer in ("single", "single!"):
            kind = self.element_type(frame)(arr)
            one = F.when(F.size(arr) > 1, F.raise_error(F.lit("`single` found more than one row")).cast(kind)).otherwise(F.get(arr, F.lit(0)))
            return one if consumer == "single" else F.when(one.isNull(), F.raise_error(F.lit("required value is absent")).cast(kind)).otherwise(one)
        return arr

    def element_type(self, frame: Frame):
        """A function that gives the type of a list's elements in a frame."""
        beside = {f.name: f.dataType for g in self.outers(frame) for f in g.df.schema}

        def of(arr: Column) -> T.DataType:
            df = frame.df.select("*", *(F.lit(None).cast(t).alias(n) for n, t in beside.items() if n not in frame.df.columns))
            return df.select(arr.alias("x")).schema[0].dataType.elementType

        return of

    # -- expressions

    def test(self, frame: Frame, e: tuple) -> Column:
        """A predicate: the truth of a value."""
        if e[0] == "op" and e[1] in ("and", "or"):
            if e[2] == ("lit", e[1] == "or"):  # decided
                return F.lit(e[1] == "or")
            a = self.test(frame, e[2])
            self.guarded += 1
            try:
                b = self.test(frame, e[3])
            finally:
                self.guarded -= 1
            if self.raises(e[3]):  # reached only by rows that the left side doesn't decide
                return F.when(a, b).otherwise(False) if e[1] == "and" else F.when(a, True).otherwise(b)
            return a & b if e[1] == "and" else a | b
        if e[0] == "not":
            return ~self.test(frame, e[1])
        c, t = self.typed(frame, e)
        return S.truthy(c, t)

    def raises(self, e) -> bool:
        """Whether a tree holds something that may fail."""
        if not isinstance(e, (tuple, list)):
            return False
        if e and (e[0] == "required" or e[0] == "block" and e[2] in ("single", "single!") or e[0] == "call" and e[1] not in REDUCTIONS and not self.known(e[1])):
            return True
        return any(self.raises(x) for x in e)

    def known(self, name: str) -> bool:
        return name in FUNCTIONS or name in self.catalog.functions or name in self.catalog.macros

    def failed(self, message: str) -> Column:
        """An error of a call: at once, or where a row reaches it."""
        if self.guarded:
            return F.raise_error(F.lit(message)).cast("boolean")
        raise QueryError(message)

    def value(self, frame: Frame, e: tuple) -> Column:
        return self.typed(frame, e)[0]

    def typed(self, frame: Frame, e: tuple) -> tuple[Column, T.DataType]:
        c = self.expr(frame, e)
        if isinstance(c, tuple):
            return c
        if getattr(frame, "elements", None) is not None:
            return c, self.guess(e)
        # The expression may read outer columns: their frames' columns stand beside.
        names = frame.df.columns
        beside = {f.name: f.dataType for g in self.outers(frame) for f in g.df.schema if f.name not in names}
        cols = [F.lit(None).cast(t).alias(n) for n, t in beside.items()]
        return c, frame.df.select("*", *cols).select(c.alias("x")).schema[0].dataType

    def outers(self, frame: Frame) -> list[Frame]:
        return [] if frame.parent is None else [frame.parent, *self.outers(frame.parent)]

    def guess(self, e: tuple) -> T.DataType:
        """Type of an expression over list elements, which no DataFrame can be asked for."""
        if e[0] == "lit":
            return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), type(None): T.NullType()}.get(type(e[1]), T.StringType())
        if e[0] == "call" and e[1] in ("size", "count", "sum", "avg") or e[0] == "method" and e[2] in ("size", "year", "month", "day", "weekday", "hour", "minute", "second"):
            return T.DoubleType()
        if e[0] == "op" and e[1] in "+-*/%" or e[0] == "neg":
            return T.DoubleType()
        return T.BooleanType() if e[0] in ("op", "not") else T.StringType()

    def name(self, frame: Frame, depth: int, name: str):
        at = frame.at(depth)
        if at is None:
            return F.lit(None), T.NullType()
        if getattr(at, "elements", None) is not None:
            if name == "$rows" and "$rows" not in at.elements:  # a row is a group of one
                c, t = at.elements["$it"]
                return F.array(c), T.ArrayType(t)
            return at.elements.get(name, (F.lit(None), T.NullType()))
        if name in ("$it", "$rows") and name not in at.fields:
            c = F.struct(*(F.col(x).alias(n) for n, x in at.fields.items() if not n.startswith("$")))
            t = T.StructType([T.StructField(n, at.df.schema[x].dataType) for n, x in at.fields.items() if not n.startswith("$")])
            return (c, t) if name == "$it" else (F.array(c), T.ArrayType(t))
        if name == "$key" and name not in at.fields and at.coll:
            c = self.key(at, None)
            return c, at.type(c)
        if name in at.aliases and name in at.open and name not in at.fields and at.aliases[name] != ("name", 0, name):
            raise QueryError(f"`{name}` is defined by itself")
        if name in at.aliases and name not in at.open:
            at.open.add(name)
            out = self.typed(at, at.aliases[name])
            at.open.discard(name)
            return out
        if name in at.fields:
            return F.col(at.fields[name]), at.df.schema[at.fields[name]].dataType
        return F.lit(None), T.NullType()

    def expr(self, frame: Frame, e: tuple):
        op = e[0]
        if op == "host":
            return e[1](frame)
        if op == "col":
            return F.col(e[1]), frame.df.schema[e[1]].dataType
        if op == "lit":
            return F.lit(e[1])
        if op == "name":
            if (linked := self.related(frame, e)) is not e:
                return self.block(frame, linked)
            return self.name(frame, e[1], e[2])
        if op == "get":
            if e[1][0] == "name" and (linked := self.related(frame, e[1])) is not e[1]:
                at = frame.at(e[1][1])
                rel = self.catalog.relations[at.coll, e[1][2]]
                if rel.consumer == "first" and rel.on[0][2] == e[2]:  # the row holds it itself
                    return self.name(frame, e[1][1], rel.on[0][0])
                return self.expr(frame, ("get", linked, e[2]))
            if e[1][0] == "name" and (at := frame.at(e[1][1])) is not None and e[1][2] not in at.fields and f"{e[1][2]}.{e[2]}" in at.fields:
                return self.name(frame, e[1][1], f"{e[1][2]}.{e[2]}")  # a column with a dotted name
            c, t = self.typed(frame, e[1])
            if isinstance(t, T.StructType):
                return c[e[2]] if e[2] in t.fieldNames() else F.lit(None)
            return c[e[2]] if isinstance(t, T.MapType) else F.lit(None)
        if op == "at":
            return F.get(self.value(frame, e[1]), self.value(frame, e[2]).cast("int"))
        if op == "neg":
            return -self.value(frame, e[1]).cast("double")
        if op == "not":
            return ~self.test(frame, e[1])
        if op == "required":
            c, t = self.typed(frame, e[1])
            return F.when(c.isNull(), F.raise_error(F.lit("required value is absent")).cast(t)).otherwise(c)
        if op == "present":
            c, t = self.typed(frame, e[1])
            kept = F.filter(c, lambda x: x.isNotNull())
            return F.when(F.size(kept) > 0, kept) if isinstance(t, T.ArrayType) else c
        if op == "template":
            return F.concat(*(S.text(*self.typed(frame, p)) for p in e[1]))
        if op == "tuple":
            return F.array(*(self.value(frame, x) for x in e[1]))
        if op == "block":
            return self.block(frame, e)
        if op == "call" and (linked := self.related(frame, e)) is not e:
            return self.block(frame, linked)
        if op == "call":
            return self.call(frame, e[1], e[2])
        if op == "method":
            c, t = self.typed(frame, e[1])
            if e[2] == "matches":
                self.pattern(e[3][0])
                return F.coalesce(F.rlike(c.cast("string"), self.value(frame, e[3][0])), F.lit(False))
            if e[2] == "format":
                return S.date_format(c, e[3][0][1])
            if e[2] in ("plus", "minus"):
                return temporal.moved(c, t, e[3][0][1] if e[3][0][0] == "lit" else self.value(frame, e[3][0]), 1 if e[2] == "plus" else -1)
            if e[2] == "until":
                return temporal.until(c, self.value(frame, e[3][0]))
            if e[2] in ("dur_text", "dur_iso"):
                return getattr(temporal, e[2])(c)
            if e[2] in self.catalog.functions:
                return self.catalog.functions[e[2]](c, *(self.value(frame, x) for x in e[3]))
            if e[2] not in S.METHODS:
                return self.failed(f"unknown method {e[2]!r}")
            return S.METHODS[e[2]](c, t, *(self.value(frame, x) for x in e[3]))
        if op == "op":
            return self.operator(frame, *e[1:])
        raise QueryError(f"can't read {op}")

    def operator(self, frame: Frame, op: str, a: tuple, b: tuple):
        if op in ("and", "or"):  # as values they yield an operand
            (x, t), y = self.typed(frame, a), self.value(frame, b)
            return F.when(S.truthy(x, t), y if op == "and" else x).otherwise(x if op == "and" else y)
        x, tx = self.typed(frame, a)
        if op == "in" and b[0] == "range":
            lo, hi = self.typed(frame, b[1]), self.typed(frame, b[2]) if b[2] is not None else None
            test = S.compare(">=", x, tx, *lo)
            return test if hi is None else test & S.compare("<" if b[3] else "<=", x, tx, *hi)
        if op == "in" and b[0] == "call" and b[1] == "range" and len(b[2]) == 1:
            if b[2][0][0] == "range":
                return self.operator(frame, op, a, b[2][0])
            y, ty = self.typed(frame, b[2][0])
            return S.in_text_range(x, tx, y) if S.kind(ty) == "string" else F.lit(False)
        if op == "in" and b[0] == "tuple":
            return reduce(lambda p, q: p | q, (S.equal(x, tx, *self.typed(frame, i)) for i in b[1]), F.lit(False))
        y, ty = self.typed(frame, b)
        if op in ("==", "is"):
            return S.equal(x, tx, y, ty)
        if op in ("!=", "isnt"):
            return ~S.equal(x, tx, y, ty)
        if op in ("<", "<=", ">", ">="):
            return S.compare(op, x, tx, y, ty)
        if op in ("~", "~*", "!~", "!~*"):
            self.pattern(b)
            hit = F.coalesce(F.rlike(x.cast("string"), F.concat(F.lit("(?i)"), y) if op.endswith("*") else y), F.lit(False))
            return ~hit if op[0] == "!" else hit
        if op == "in":
            return S.contains(y, ty, x)
        if op == "+" and "string" in (S.kind(tx), S.kind(ty)):
            return F.concat(S.text(x, tx), S.text(y, ty))
        return S.arithmetic(op, x, y)

    def pattern(self, e: tuple) -> None:
        """Refuses what the portable dialect lacks, unless the catalog asks for the engine's own."""
        if self.catalog.native_regex or e[0] != "lit" or not isinstance(e[1], str):
            return
        text = re.sub(r"\\[\\^$.|?*+()\[\]{}/-]", "", e[1])  # escaped signs stand for themselves
        text, classes = re.sub(r"\[\^?[^\]]*\]", "C", text), re.findall(r"\[\^?([^\]]*)\]", text)
        if found := re.search(r"\(\?(?:[=!#>iPmsx-]|<[=!])|\\[1-9kpPxcAzZGKQEU0]|[*+?}]\+", text):
            raise QueryError(f"{found[0]!r} is not supported in regular expressions")
        if any("[" in c or "&&" in c or "~~" in c or r"\b" in c for c in classes):
            raise QueryError("nested classes and class operations are not supported in regular expressions")

    def call(self, frame: Frame, name: str, args: list[tuple]):
        if name in REDUCTIONS and len(args) == 1:
            c, t = self.typed(frame, args[0])
            if not isinstance(t, T.ArrayType):
                c, t = F.when(c.isNull(), F.array().cast(T.ArrayType(t))).otherwise(F.array(c)), T.ArrayType(t)
            else:
                c = F.coalesce(c, F.array().cast(t))
            if name in ("sum", "avg") and S.kind(t.elementType) not in ("number", "absent"):
                raise QueryError(f"can't {name} values that are no numbers")
            kept = F.filter(c, lambda x: x.isNotNull())
            total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.cast("double"))
            return {"count": lambda: F.size(kept), "sum": lambda: total, "avg": lambda: F.try_divide(total, F.size(kept)), "min": lambda: F.array_min(c), "max": lambda: F.array_max(c), "collect": lambda: kept, "first": lambda: F.get(kept, F.lit(0)), "last": lambda: F.get(kept, F.size(kept) - 1), "any": lambda: F.exists(c, lambda x: S.truthy(x, t.elementType)), "all": lambda: F.forall(c, lambda x: S.truthy(x, t.elementType))}[name]()
        if name in self.catalog.functions:
            return self.catalog.functions[name](*(self.value(frame, x) for x in args))
        if name in self.catalog.macros:
            return self.typed(frame, self.catalog.macros[name](frame.coll, args))
        if name not in FUNCTIONS or not args:
            return self.failed(f"unknown function {name!r}")
        if name in ("date", "dur") and args[0][0] == "lit" and isinstance(args[0][1], str):
            return F.lit(temporal.named_date(args[0][1], self.catalog.today) if name == "date" else temporal.seconds(args[0][1]))
        c, t = self.typed(frame, args[0])
        if name == "dur":
            return c.cast("double") if S.kind(t) == "number" else temporal.seconds_of(c)
        if name == "entries":
            if isinstance(t, T.MapType):
                return F.map_entries(c)
            if isinstance(t, T.ArrayType):
                return F.transform(c, lambda x, i: F.struct(i.alias("key"), x.alias("value")))
            if isinstance(t, T.StructType):
                same = len({f.dataType.simpleString() for f in t}) == 1
                return F.when(c.isNotNull(), F.array(*(F.struct(F.lit(f.name).alias("key"), (c[f.name] if same else S.text(c[f.name], f.dataType)).alias("value")) for f in t)))
            return F.array().cast("array<struct<key:string,value:string>>")
        if name == "size":
            return S.size(c, t)
        if name == "has":
            return c.isNotNull()
        if name == "list":
            return c if isinstance(t, T.ArrayType) else F.when(c.isNull(), F.array().cast(T.ArrayType(t))).otherwise(F.array(c))
        if name == "date":
            return F.date_format(F.try_to_timestamp(c.cast("string")), "yyyy-MM-dd")
        raise QueryError(f"unknown function {name!r}")


def execute(catalog: Catalog, query: str | tuple, bindings: dict | None = None, ordered: bool = False) -> DataFrame:
    """The rows of a query, text or tree, over a catalog; ordered: in the collection's order where the query states none. Bindings that are DataFrames or lists of records are
    collections; records get the order of their list."""
    held = {}
    for n, v in (bindings or {}).items():
        if isinstance(v, DataFrame):
            held[f"${{{n}}}"] = (v, v.columns[:1])
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            spark = next(iter(catalog.tables.values())).sparkSession
            held[f"${{{n}}}"] = (spark.createDataFrame([{**r, "$ord": i} for i, r in enumerate(v)]), ["$ord"])
    if held:
        catalog = replace(catalog, tables={**catalog.tables, **{n: d for n, (d, _) in held.items()}}, keys={**catalog.keys, **{n: k for n, (_, k) in held.items()}})
    return Lowering(catalog, ordered).run(parse(query, bindings) if isinstance(query, str) else query)
