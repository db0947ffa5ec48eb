"""Versions of documents: reading at a point, block and line differences, the change feed, retention and its sweep.

A revision table has one row per version: doc, seq (rising), ts and what the version holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_at(revisions: DataFrame, doc: str, seq: str, at: int | None = None) -> DataFrame:
    """Each document's last version at or before `at` (None: now); documents that begin later are left out."""
    rows = revisions if at is None else revisions.where(F.col(seq) <= at)
    others = [c for c in revisions.columns if c != doc]
    last = rows.groupBy(doc).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_r"))
    return last.select(doc, *(F.col("_r")[c].alias(c) for c in others)).select(*revisions.columns)


def numbered(revisions: DataFrame, doc: str, seq: str) -> DataFrame:
    """Adds each version's number in its document and the seq of the one before."""
    w = Window.partitionBy(doc).orderBy(seq)
    return revisions.withColumn("version", F.row_number().over(w)).withColumn("previous", F.lag(seq).over(w))


def diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, change, before, after): removed, added and changed rows of two snapshots, one full join on the key."""
    a = old.select(*key, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = new.select(*key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, key, "full").select(*key, change.alias("change"), "before", "after").where(F.col("change").isNotNull())


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Shortest edit script of two lists as (" ", i, j), ("-", i, _), ("+", _, j) steps; removals come first.

    The greedy furthest-reaching search over diagonals. Of two ways that reach equally far the removal is taken, which
    makes the script canonical; a common head is kept as it is, which every such script does, a common tail is not cut.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    x, y = a[head:], b[head:]
    n, m = len(x), len(y)
    reach, trace = {1: 0}, []
    found = None
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= n and i - k >= m:
                found = d
                break
        if found is not None:
            break
    steps, i, j = [], n, m
    for d in range(found or 0, 0, -1):
        v, k = trace[d], i - j
        down = k == -d or k != d and v[k - 1] < v[k + 1]
        pi = v[k + 1] if down else v[k - 1]
        pj = pi - (k + 1 if down else k - 1)
        while i > pi + (not down) and j > pj + down:
            i, j = i - 1, j - 1
            steps.append((" ", head + i, head + j))
        if down:
            j -= 1
            steps.append(("+", head + i, head + j))
        else:
            i -= 1
            steps.append(("-", head + i, head + j))
    while i and j:
        i, j = i - 1, j - 1
        steps.append((" ", head + i, head + j))
    return [(" ", k, k) for k in range(head)] + steps[::-1]


def unified(before: str, after: str, context: int = 3) -> str:
    """Unified difference of two texts by lines; empty when they are equal."""
    a, b = before.splitlines(), after.splitlines()
    steps = edit_script(a, b)
    near = [k for k, s in enumerate(steps) if s[0] != " "]
    out, at = [], 0
    while at < len(near):
        first = last = near[at]
        while at < len(near) and near[at] - last <= 2 * context:
            last, at = near[at], at + 1
        part = steps[max(first - context, 0) : last + context + 1]
        na, nb = sum(s[0] != "+" for s in part), sum(s[0] != "-" for s in part)
        span = lambda start, n: f"{start + (n > 0)}" + ("" if n == 1 else f",{n}")
        out.append(f"@@ -{span(part[0][1], na)} +{span(part[0][2], nb)} @@")
        out += [c + (b[j] if c == "+" else a[i]) for c, i, j in part]
    return "\n".join(out)


def unified_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, diff) of two texts a row; null texts are empty. Rows are independent: no shuffle."""
    rows = pairs.select(key, F.coalesce(before, F.lit("")).alias("_b"), F.coalesce(after, F.lit("")).alias("_a"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({key: p[key], "diff": [unified(x, y) for x, y in zip(p["_b"], p["_a"])]})

    schema = rows.select(key).withColumn("diff", F.lit("")).schema
    return rows.mapInPandas(run, schema)


def changes_since(feed: DataFrame, seq: str, cursor: int, limit: int, origin: tuple[str, str] | None = None) -> DataFrame:
    """A page of the feed after a cursor, with `truncated` when more follows; origin is (column, value)."""
    rows = feed.where(F.col(seq) > cursor)
    if origin is not None:
        rows = rows.where(F.col(origin[0]) == origin[1])
    page = rows.orderBy(seq).limit(limit + 1)
    w = Window.orderBy(seq)  # limit + 1 rows
    more = F.max("_n").over(Window.partitionBy()) > limit
    return page.withColumn("_n", F.row_number().over(w)).withColumn("truncated", more).where(F.col("_n") <= limit).drop("_n")


@dataclass(frozen=True)
class Policy:
    """Retention: days kept whole, newest versions kept, and rungs (after_days, grain) that keep one of each period."""

    keep_days: int = 30
    per_doc_max: int = 50
    ladder: tuple[tuple[int, str], ...] = ((30, "day"), (90, "week"), (365, "month"))
    keep_origins: tuple[str, ...] = field(default=())


def retention(revisions: DataFrame, doc: str, seq: str, ts: str, now: str, policy: Policy = Policy(), origin: str | None = None, reason: str | None = None, before: str | None = None) -> DataFrame:
    """Adds `kept` to live revisions: the head, the young, the newest, the named, the gap below the ladder, and the
    newest of each period of a rung. One shuffle by document; versions of one document meet in a sort, not in memory.
    """
    at = F.col(ts).cast("timestamp")
    age = F.floor((F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(at)) / 86_400_000)
    rung, bucket = F.lit(-1), F.lit(None).cast("timestamp")
    for i, (after, grain) in enumerate(sorted(policy.ladder)):
        rung = F.when(age >= after, i).otherwise(rung)
        bucket = F.when(age >= after, F.date_trunc(grain, at)).otherwise(bucket)
    newest = Window.partitionBy(doc).orderBy(F.col(seq).desc())
    rows = revisions.withColumn("_age", age).withColumn("_rung", rung).withColumn("_bucket", bucket).withColumn("_n", F.row_number().over(newest))
    period = Window.partitionBy(doc, "_rung", "_bucket").orderBy(F.col(seq).desc())
    rows = rows.withColumn("_p", F.row_number().over(period))
    kept = (F.col("_n") == 1) | (F.col("_age") < policy.keep_days) | (F.col("_n") <= policy.per_doc_max) | (F.col("_rung") < 0) | (F.col("_p") == 1)
    if origin is not None and reason is not None and policy.keep_origins:
        kept |= F.coalesce(F.col(origin).isin(*policy.keep_origins) & (F.col(reason) != ""), F.lit(False))
    if before is not None:
        kept |= F.col(ts) >= F.lit(before).cast("timestamp")
    return rows.withColumn("kept", kept).drop("_age", "_rung", "_bucket", "_n", "_p")


def unreachable(objects: DataFrame, key: str, references: DataFrame, column: str) -> DataFrame:
    """Objects that no reference names: the sweep's candidates."""
    return objects.join(references.select(F.col(column).alias(key)).distinct(), key, "left_anti")


def dispositions(revisions: DataFrame, doc: str, block: str, seq: str, text: str) -> DataFrame:
    """(doc, block, seq, kind) of every version of every block: inserted, same or edited, against the version before."""
    before = F.lag(text).over(Window.partitionBy(doc, block).orderBy(seq))
    first = F.row_number().over(Window.partitionBy(doc, block).orderBy(seq)) == 1
    kind = F.when(first, "inserted").when(before.eqNullSafe(F.col(text)), "same").otherwise("edited")
    return revisions.select(doc, block, seq, kind.alias("kind"))


def pruned(feed: DataFrame, seq: str, ts: str, now: str, keep_days: int, epoch: str) -> tuple[DataFrame, DataFrame]:
    """What stays of a feed, and one row (epoch, floor) that its readers check: a cursor below floor has expired. The
    newest row always stays."""
    last = feed.agg(F.max(seq).alias("_last"))
    old = F.col(ts) < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(keep_days))
    kept = feed.join(F.broadcast(last)).where(~old | (F.col(seq) == F.col("_last"))).drop("_last")  # last is one row
    return kept, kept.agg(F.lit(epoch).alias("epoch"), F.min(seq).alias("floor"))


def released(claims: DataFrame, key: str, minted: str, now: str, keep_days: int, live: list[DataFrame]) -> DataFrame:
    """Claims on ids that are older than keep_days and that no live row names."""
    out = claims.where(F.col(minted) < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(keep_days)))
    for rows in live:
        out = out.join(rows.select(F.col(rows.columns[0]).alias(key)).distinct(), key, "left_anti")
    return out


def squashed(revisions: DataFrame, doc: str, seq: str, kept: str) -> DataFrame:
    """Kept versions, each with the versions (`squashed`) that were dropped since the kept one before it."""
    w = Window.partitionBy(doc).orderBy(seq)
    run = F.coalesce(F.sum(F.when(F.col(kept), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = revisions.withColumn("_run", run)
    n = rows.groupBy(doc, "_run").agg(F.count_if(~F.col(kept)).alias("squashed"))
    return rows.where(F.col(kept)).join(n, [doc, "_run"]).drop("_run")
