"""Filing and news text: tokens, change scores, themes, sentiment, citations, clean-up and event clusters."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9%]+"), F.lit(0))


_TOKEN = re.compile("[a-z0-9%]+")


@lru_cache(maxsize=1 << 18)
def _bucket(token: str, dim: int) -> int:
    """The first eight bytes of the token's MD5 decide."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big") % dim


def _vector(text: str | None, dim: int) -> Counter:
    return Counter(_bucket(t, dim) for t in _TOKEN.findall((text or "").lower()))


def hashing_vector(docs: DataFrame, dim: int = 256) -> DataFrame:
    """doc_id, bucket, n: token counts of each row by hash bucket. Nothing crosses rows, so nothing is shuffled."""

    def run(batches):
        for rows in batches:
            out = [(i, b, n) for i, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()) for b, n in sorted(_vector(text, dim).items())]
            ids, buckets, counts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(buckets, pa.int32()), pa.array(counts, pa.int64())], ["doc_id", "bucket", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bucket int, n long")


def change_score(pairs: DataFrame, dim: int = 256) -> DataFrame:
    """1 - cosine of two texts' hashing vectors (columns doc_id, before, after), row by row.

    Two blank texts score 0, one blank text 1; a text that isn't blank but has no token has no direction, and scores 1.
    """

    def score(before: str | None, after: str | None) -> float:
        blank = [not (x or "").strip() for x in (before, after)]
        if any(blank):
            return 0.0 if all(blank) else 1.0
        a, b = _vector(before, dim), _vector(after, dim)
        norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        return min(1.0, max(0.0, 1.0 - (sum(n * b[k] for k, n in a.items()) / norm if norm else 0.0)))

    def run(batches):
        for rows in batches:
            values = [score(x, y) for x, y in zip(rows.column("before").to_pylist(), rows.column("after").to_pylist())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    return pairs.select(F.col("doc_id").cast("long").alias("doc_id"), "before", "after").mapInArrow(run, "doc_id long, score double")


def top_tokens(docs: DataFrame, k: int = 20) -> DataFrame:
    t = docs.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "token").limit(k)


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of ``least`` characters or more, in lower case with single spaces."""
    cut = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " "))), lambda s: F.length(s) >= least)


def sentence_diff(pairs: DataFrame) -> DataFrame:
    """Sentences that came and went between two texts."""
    x = pairs.select("doc_id", sentences(F.col("before")).alias("b"), sentences(F.col("after")).alias("a"))
    return x.select("doc_id", F.array_except("a", "b").alias("added"), F.array_except("b", "a").alias("removed"))


def keyword_themes(docs: DataFrame, themes: dict[str, list[str]]) -> DataFrame:
    """How many of each theme's keywords a text holds as whole words; themes with none are left out."""
    out = None
    for theme, words in themes.items():
        hits = sum((F.col("t").rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])").cast("int") for w in words), F.lit(0))
        one = F.struct(F.lit(theme).alias("theme"), hits.alias("hits"))
        out = [one] if out is None else [*out, one]
    x = docs.select("doc_id", F.lower("text").alias("t")).select("doc_id", F.explode(F.array(*out)).alias("x")).select("doc_id", "x.theme", "x.hits").where("hits > 0")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "theme")))


def sentiment(docs: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """(positive - negative) / (positive + negative) of distinct lexicon words, with a label beyond one half."""
    own = F.array_distinct(tokens(F.col("text")))
    x = docs.select("doc_id", F.size(F.array_intersect(own, F.array(*map(F.lit, positive)))).alias("p"), F.size(F.array_intersect(own, F.array(*map(F.lit, negative)))).alias("q"))
    score = F.coalesce((F.col("p") - F.col("q")) / F.nullif(F.col("p") + F.col("q"), F.lit(0)), F.lit(0.0))
    return x.select("doc_id", score.alias("score"), F.when(score > 0.5, "positive").when(score < -0.5, "negative").otherwise("neutral").alias("label"))


def url_key(url: Column) -> Column:
    """A URL without query, fragment, trailing slash and case."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"[?#].*$", ""), r"/+$", "")


def first_by_url(pages: DataFrame) -> DataFrame:
    """The first page of each URL."""
    return pages.groupBy(url_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def clean_html(pages: DataFrame) -> DataFrame:
    """Text of pages: scripts and styles go, block tags become line ends, entities are resolved, white space is squeezed."""
    x = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|tr|h[1-6]|table|ul|ol|section|article)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    unescape = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else html.unescape(t)), "string")
    x = unescape(x)
    return pages.select("page_id", F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^\S\n]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "").alias("text"))


def citations(docs: DataFrame) -> DataFrame:
    """Chunks in round brackets that hold a figure or a key: value, with a kind."""
    c = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\(([^()]{2,})\)"), F.lit(1))).alias("pos", "raw"))
    kind = F.when(F.col("raw").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(F.col("raw").rlike(r"^\+?[\d ()-]{7,}$"), "number").when(F.col("raw").rlike(r"\d%"), "percent").when(F.col("raw").rlike(r"\w+\s*[:=]\s*\S"), "key").when(F.col("raw").rlike(r"\d"), "figure")
    return c.withColumn("kind", kind).where("kind is not null")


def money(value: Column) -> Column:
    """``$137,237M`` and the like as a number; per cents as shares; null where neither."""
    raw = F.regexp_replace(F.upper(F.trim(value)), r"[$,\s]", "")
    body = F.regexp_extract(raw, r"^\(?(-?\d+(?:\.\d+)?)", 1)
    scale = F.when(raw.rlike(r"%\)?$"), 0.01).when(raw.rlike(r"T\)?$"), 1e12).when(raw.rlike(r"B\)?$"), 1e9).when(raw.rlike(r"M\)?$"), 1e6).when(raw.rlike(r"K\)?$"), 1e3).otherwise(1.0)
    return F.when(raw.rlike(r"^\(?-?\d+(\.\d+)?[KMBT%]?\)?$"), body.try_cast("double") * scale * F.when(raw.startswith("("), -1.0).otherwise(1.0))


def values_match(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= tolerance


def clusters(items: DataFrame, days: int = 3, least: float = 0.5) -> DataFrame:
    """Greedy clusters of titles by symbol, in order of time: Jaccard of tokens with the growing cluster, few days apart.

    Equal titles of a symbol and day are one row of the pass and share its cluster. No cluster spans a gap of more than
    ``days``, so the pass, which depends on order, takes one gapless stretch of a symbol at a time, as a sorted stream
    that holds only the clusters still open. Items without a word or a date stand alone.
    """
    told = F.col("date").isNotNull() & F.coalesce(F.col("title").rlike(r"(?U)\S"), F.lit(False))
    alone = items.where(~told).select("item_id", F.col("item_id").alias("cluster"))
    own = items.where(told).select("item_id", "symbol", F.col("date").cast("date").alias("date"), "title")
    titles = own.groupBy("symbol", "date", "title").agg(F.min("item_id").alias("first"))
    w = Window.partitionBy("symbol").orderBy("date")  # a row a day
    dates = titles.select("symbol", "date").distinct().withColumn("gap", (F.date_diff("date", F.lag("date").over(w)) > days).cast("int"))
    runs = dates.select(F.col("symbol").alias("s"), F.col("date").alias("d"), F.coalesce(F.sum("gap").over(w), F.lit(0)).alias("run"))
    rows = titles.join(runs, F.col("symbol").eqNullSafe(F.col("s")) & (F.col("date") == F.col("d"))).drop("s", "d")

    def run(batches):
        now, open_, holders = None, {}, {}  # by age: [words, last date, first item]; by word: ages of the clusters with it
        for rows in batches:
            out = []
            for r in rows.itertuples():
                at = (None if pd.isna(r.symbol) else r.symbol, r.run)
                if now is None or now[0] != at:
                    open_, holders, born = {}, {}, 0
                elif now[1] != r.date:
                    open_ = {k: c for k, c in open_.items() if (r.date - c[1]).days <= days}
                    holders = {}
                    for k, c in open_.items():
                        for word in c[0]:
                            holders.setdefault(word, set()).add(k)
                now = (at, r.date)
                words = set(r.title.lower().split())
                # a cluster that is near has ``least`` of the words, so one at least of all but so many
                rare = sorted(words, key=lambda x: len(holders.get(x, ())))[: len(words) - max(1, math.ceil(least * len(words) - 1e-9)) + 1]
                for k in sorted(set().union(*(holders.get(x, ()) for x in rare))):
                    c = open_[k]
                    if words and len(words & c[0]) / len(words | c[0]) >= least:
                        break
                else:
                    k, c = born, [set(), r.date, r.first]
                    open_[k], born = c, born + 1
                for word in words - c[0]:
                    holders.setdefault(word, set()).add(k)
                c[0] |= words
                c[1] = r.date
                out.append((r.symbol, r.date, r.title, c[2]))
            yield pd.DataFrame(out, columns=["s", "d", "t", "cluster"])

    order = ["symbol", "run", "date", "first"]
    found = rows.select(*order, "title").repartition("symbol", "run").sortWithinPartitions(*order, "title").mapInPandas(run, "s string, d date, t string, cluster long")
    same = F.col("symbol").eqNullSafe(F.col("s")) & (F.col("date") == F.col("d")) & (F.col("title") == F.col("t"))
    return own.join(found, same).select("item_id", "cluster").unionByName(alone)
