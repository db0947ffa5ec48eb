"""Full-text filters, BM25 ranking, vector ranking, rank fusion and token-shingle similarity.

A ranked search reads the collection once, keeps its counts, a few numbers a row, and takes statistics (one row) and scores
from them; it builds no index and shuffles no texts. `postings` builds the inverted index for those who search it often.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stem, stems, tokens, words
from .ranking import top_k

#: Fixed values of the ranking formulas.
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
#: Fixed boosts: title, heading, path, and by layer.
TITLE, HEADING, PATH, LAYERS = 1.25, 1.15, 1.10, {"canon": 1.30, "working": 1.15, "draft": 0.85}


@dataclass(frozen=True)
class Term:
    """One conjunct of a search: words in a row, the last one a prefix or not."""

    words: tuple[str, ...]
    prefix: bool = False


def parse_search(query: str) -> list[Term]:
    """A search box's text: quoted phrases, words, `word*` prefixes; what holds no letter or digit is dropped."""
    out = []
    for m in re.finditer(r'"([^"]*)"?|([^\s"]+)', query):
        phrase = m[1] is not None
        token = m[1] if phrase else m[2]
        prefix = not phrase and token.endswith("*")
        if any(unicodedata.category(ch)[0] in "LN" for ch in token) and words(token):
            out.append(Term(words(token), prefix))
    return out


def _head(of: str) -> str:
    """What every word with a stem begins with: its first letter, and all but its last two."""
    return of[: max(1, len(of) - 2)]


def _cut(toks: Column, heads: set[str]) -> Column:
    """The stems of the tokens that may have one of some stems, in their places; other tokens are empty. A stem keeps all of
    its word but a suffix, and ends in at most two letters that the word hasn't there, so most tokens are never cut."""
    may = lambda t: reduce(Column.__or__, (F.startswith(t, F.lit(h)) for h in sorted(heads)))
    return stems(F.transform(toks, lambda t: F.when(may(t), t).otherwise("")))


def hits(toks: Column, term: Term) -> Column:
    """How often a term stands in a list of tokens; words meet by their stems, a prefix meets the stems that begin with its own."""
    wanted = [stem(w) for w in term.words]
    last = len(wanted) - 1
    toks = toks if last else F.filter(toks, lambda t: F.startswith(t, F.lit(_head(wanted[0]))))
    toks = _cut(toks, {_head(w) for w in wanted})
    meets = lambda t, k: F.startswith(t, F.lit(wanted[k])) if term.prefix and k == last else t == F.lit(wanted[k])
    if last == 0:
        return F.size(F.filter(toks, lambda t: meets(t, 0)))
    # One pass with the number of words met so far would lose overlaps, so each place is tested against the stems in it.
    none = F.array().cast("array<int>")
    at = lambda ts, i: reduce(Column.__and__, (F.coalesce(meets(F.get(ts, i + k), k), F.lit(False)) for k in range(last + 1)))
    counted = F.transform(F.array(toks), lambda ts: F.size(F.filter(F.when(F.size(ts) > last, F.sequence(F.lit(0), F.size(ts) - 1 - last)).otherwise(none), lambda i: at(ts, i))))
    return counted[0]


def text_filter(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds every term; none for an empty search."""
    terms = parse_search(query)
    if not terms:
        return df.where(F.lit(False))
    keep = F.lit(True)
    for t in terms:
        keep &= hits(tokens(F.col(text)), t) > 0
    return df.where(keep)


def bm25(df: DataFrame, key: str, text: str, query: str, limit: int = 50) -> DataFrame:
    """(key, score, rank) of the best rows that hold every term; ties by key. Null keys take part like others."""
    terms = parse_search(query)
    if not terms:
        return df.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    counted = df.select(F.col(key), tokens(F.col(text)).alias("toks"))
    # A few numbers a row, kept so that statistics and scores don't cut the texts twice.
    counted = counted.select(key, F.size("toks").alias("len"), *(hits(F.col("toks"), t).alias(f"tf{i}") for i, t in enumerate(terms))).persist()
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    matching = counted.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, found = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - found + 0.5) / (found + 0.5)), F.lit(1e-6))
        score += idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg")))
    out = matching.join(F.broadcast(stats)).select(key, score.alias("score"))  # stats is one row
    return top_k(out, [F.col("score").desc(), F.col(key).asc()], limit, "rank")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index: (stem, key, tf) as term, key, tf. Counts are combined before the shuffle; a frequent term has many keys."""
    return df.select(key, F.explode(stems(tokens(F.col(text)))).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles; 0 where one is all zero, absent where one is absent."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def vector_search(df: DataFrame, key: str, vector: str, query: list[float], limit: int = 50) -> DataFrame:
    """(key, cosine, rank) of the nearest rows to a query vector; all rows are compared; ties by key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = df.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), q).alias("cosine"))
    return top_k(scored, [F.col("cosine").desc(), F.col(key).asc()], limit, "rank")


def pooled(df: DataFrame, doc: str, vector: str, weight: str) -> DataFrame:
    """One vector a document: the weighted mean of its parts' vectors at unit length; sums are combined map-side."""
    dims = df.select(doc, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("i", "x"))
    means = dims.groupBy(doc, "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    vec = means.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vec.select(doc, F.transform("v", lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x / length)).alias("vector"))


def fuse(text_ranks: DataFrame, vector_ranks: DataFrame, key: str, limit: int = 50, boosts: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of two (key, rank) lists: (key, text_rank, vector_rank, rrf, score); ties by key."""
    a = text_ranks.select(key, F.col("rank").alias("text_rank"))
    b = vector_ranks.select(key, F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    out = a.join(b, key, "full").withColumn("rrf", part("text_rank") + part("vector_rank"))
    out = out.withColumn("score", F.col("rrf") * (F.lit(1.0) if boosts is None else boosts))
    return out.orderBy(F.col("score").desc(), F.col(key).asc()).limit(limit)


def boost(terms: list[str], title: Column, headings: Column, path: Column, layer: Column) -> Column:
    """The product of the boosts that apply to a hit; headings is a list."""
    has = lambda c: F.coalesce(F.lower(c).rlike("|".join(re.escape(t.lower()) for t in terms) or "(?!)"), F.lit(False))
    out = F.when(has(title), TITLE).otherwise(1.0) * F.when(F.exists(headings, has), HEADING).otherwise(1.0) * F.when(has(path), PATH).otherwise(1.0)
    by_layer = F.lit(1.0)
    for name, x in LAYERS.items():
        by_layer = F.when(layer == name, x).otherwise(by_layer)
    return out * by_layer


# -- similarity

#: White space that parts tokens.
_SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def shingles(text: Column) -> Column:
    """The set of three-token shingles; one or two tokens are one shingle, no token none."""
    toks = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda t: t != "")

    def of(ts: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(ts) - 3), lambda i: F.concat_ws(" ", F.get(ts, i), F.get(ts, i + 1), F.get(ts, i + 2)))
        few = F.when(F.size(ts) > 0, F.array(F.array_join(ts, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(ts) > 2, many).otherwise(few)

    # The one-element list binds the tokens; named inside of many, a text would be split anew for each of its shingles.
    return F.array_distinct(F.transform(F.array(toks), of)[0])


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two sets; 1 when both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


#: Bits of the sketch of how frequent shingles are (a byte for each value), and keys that copies of one text join in at once.
SKETCH_BITS, COPIES = 18, (256, 32)


def _sketch(hashes: DataFrame) -> bytes:
    """Classes of frequency, a sixteenth of a power of two each, of the hashes (h) that share their lowest bits."""
    counts = hashes.groupBy(F.expr(f"h & {(1 << SKETCH_BITS) - 1}").cast("int").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    out = bytearray(1 << SKETCH_BITS)
    for i, n in counts.toLocalIterator():
        out[i] = min(255, round(16 * math.log2(n)))
    return bytes(out)


def similar_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(key_a, key_b, similarity) of all pairs at or above a Dice threshold.

    Rows with one set are a class, and classes are compared. Two sets that similar share one of the first
    |S| - ceil(|S| * t / (2 - t)) + 1 of their shingles in any common order, so only these prefixes meet in a join. The
    order is from rare to frequent by a sketch of bounded size; where it errs, more prefixes meet, but none is missed.
    What can't reach the threshold from the place where two prefixes meet is dropped, the rest is compared once. At the
    end a class's keys, which lie in its row, pair block by block. Texts without tokens pair with nothing.
    """
    least = threshold / (2 - threshold)
    none = lambda df, key: F.lit(None).cast(df.schema[key].dataType)
    hashes = F.array_sort(F.transform(shingles(F.col(text)), lambda s: F.xxhash64(s))).alias("s")
    rows = a.select(F.col(key_a).alias("ka"), none(b, key_b).alias("kb"), hashes).unionByName(b.select(none(a, key_a).alias("ka"), F.col(key_b).alias("kb"), hashes))
    classes = rows.groupBy(F.md5(F.array_join(F.col("s").cast("array<string>"), " ")).alias("c")).agg(F.first("s").alias("s"), F.collect_list("ka").alias("ka"), F.collect_list("kb").alias("kb")).where(F.size("s") > 0).persist()
    sketch = F.lit(bytearray(_sketch(classes.select(F.explode("s").alias("h")))))
    place = lambda h: F.substring(sketch, h.bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)).cast("int") + 1, F.lit(1))
    order = F.array_sort(F.transform("s", lambda h: F.struct(place(h).alias("f"), h.alias("h"))))
    keep = F.size("s") - F.ceil(F.size("s") * least - 1e-9).cast("int") + 1
    prefix = classes.select("c", F.size("s").alias("n"), (F.size("ka") > 0).alias("a"), (F.size("kb") > 0).alias("b"), F.posexplode(F.slice(order, F.lit(1), keep)).alias("p", "x")).select("c", "n", "a", "b", "p", "x.h")
    x, y = (prefix.select("h", *(F.col(k).alias(k + side) for k in ("c", "n", "a", "b", "p"))) for side in ("1", "2"))
    shared = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    may = (F.col("c1") < F.col("c2")) & ((F.col("a1") & F.col("b2")) | (F.col("a2") & F.col("b1"))) & (shared >= (F.col("n1") + F.col("n2")) * (threshold / 2) - 1e-9)
    near = x.join(y, "h").where(may).select("c1", "c2").distinct()
    sets = lambda side: classes.select(F.col("c").alias("c" + side), F.col("s").alias("s" + side))
    near = near.join(sets("1"), "c1").join(sets("2"), "c2").select("c1", "c2", dice(F.col("s1"), F.col("s2")).alias("similarity")).where(F.col("similarity") >= threshold)
    both = near.select(F.explode(F.array(F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c1").alias("c2")))).alias("p"), "similarity").select("p.c1", "p.c2", "similarity")
    # Each class pair is cut into blocks of keys of either side, so copies of one text pair in many tasks.
    blocks = lambda keys, n: F.ceil(F.size(keys) / n).cast("int")
    sized = lambda side, k: classes.where(F.size(k) > 0).select(F.col("c").alias("c" + side), blocks(k, COPIES[int(side) - 1]).alias("m" + side))
    alike = classes.where((F.size("ka") > 0) & (F.size("kb") > 0)).select(F.col("c").alias("c1"), F.col("c").alias("c2"), F.lit(1.0).alias("similarity"), blocks("ka", COPIES[0]).alias("m1"), blocks("kb", COPIES[1]).alias("m2"))
    cells = both.join(sized("1", "ka"), "c1").join(sized("2", "kb"), "c2").unionByName(alike)
    cells = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m1") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m2") - 1)))

    def keys(k: str, side: str, at: str, name: str) -> DataFrame:
        each = classes.select(F.col("c").alias("c" + side), F.posexplode(k).alias("p", name))
        return each.select("c" + side, F.floor(F.col("p") / COPIES[int(side) - 1]).cast("int").alias(at), name)

    out = cells.join(keys("ka", "1", "i", "_ka"), ["c1", "i"]).join(keys("kb", "2", "j", "_kb"), ["c2", "j"])
    return out.select(F.col("_ka").alias(key_a), F.col("_kb").alias(key_b), "similarity")


def idf(n: int, found: int) -> float:
    """Inverse document frequency as the ranking uses it."""
    return max(math.log((n - found + 0.5) / (found + 0.5)), 1e-6)


# -- what is embedded, and resolving a search to places

#: Tokens from which a leaf block is embedded on its own; estimated model tokens of a word.
LEAF_TOKENS, PER_WORD = 24, 1.3


def spaced(text: Column) -> Column:
    """The pieces of a text between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def embed_tasks(blocks: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(_id, ctx, input, ctx_hash, content_hash, weight) of live leaf blocks of LEAF_TOKENS tokens and more. The context
    is title, path, the chain of headings from the shallowest, and the type."""
    parents = blocks.where(F.col("_parent_id").isNotNull()).select(F.col("_parent_id").alias("_id")).distinct()
    n = F.size(spaced(F.col("_text")))
    leaf = blocks.join(parents, "_id", "left_anti").where(n >= LEAF_TOKENS).withColumn("weight", F.ceil(n * PER_WORD))
    heads = sections.where(F.col("first_ordinal").isNotNull()).select(F.col("_doc_id").alias("_d"), "first_ordinal", "last_ordinal", F.col("level").alias("_level"), "_name")
    chain = leaf.join(heads, (F.col("_doc_id") == F.col("_d")) & F.col("_ordinal").between(F.col("first_ordinal"), F.col("last_ordinal"))).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_level", "_name"))).alias("h"))
    chain = chain.select("_id", F.array_join(F.transform("h", lambda x: x["_name"]), " \u203a ").alias("headings"))
    rows = leaf.join(chain, "_id", "left").join(docs.select(F.col("_id").alias("_doc_id"), "_title"), "_doc_id")
    ctx = F.concat_ws(" \u00b7 ", "_title", "_path", F.coalesce("headings", F.lit("")), "_type")
    rows = rows.withColumn("ctx", ctx)
    return rows.select("_id", "ctx", F.concat("ctx", F.lit("\n"), "_text").alias("input"), F.sha2("ctx", 256).alias("ctx_hash"), F.col("_hash").alias("content_hash"), "weight")


def due(tasks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Tasks whose content and context have no vector of a model yet: cache (content_hash, ctx_hash, model)."""
    return tasks.join(cache.where(F.col("model") == model).select("content_hash", "ctx_hash").distinct(), ["content_hash", "ctx_hash"], "left_anti")


def hashed_vectors(df: DataFrame, key: str, text: str, dims: int = 32) -> DataFrame:
    """A provider without a model: tokens hashed to signed dimensions, summed, at unit length; for tests and cold starts."""
    digest = lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long")
    lowered = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    h = F.transform(lowered, digest)
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(h, F.lit(0.0), lambda s, x: s + F.when(x % dims == d, F.when(F.floor(x / dims) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return df.select(key, F.transform(vector, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x / length)).alias("vector"))


def resolve(ranked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(_id, rank, locator, preview) of ranked blocks: path#type[ordinal], and the first 12 words."""
    words_ = spaced(F.col("_text"))
    preview = F.concat(F.array_join(F.slice(words_, 1, 12), " "), F.when(F.size(words_) > 12, "\u2026").otherwise(""))
    locator = F.concat("_path", F.lit("#"), "_type", F.lit("["), "_ordinal", F.lit("]"))
    return ranked.join(blocks, "_id").select("_id", "rank", locator.alias("locator"), preview.alias("preview"))
