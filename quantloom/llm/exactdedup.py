"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

Texts are compared without the ASCII white space of the contract. The index has one entry for each 64-bit hash of a text:
how many rows have it, and which row stays. The directory starts with one slot and doubles until no bucket holds more
than ``capacity`` entries: a bucket of local depth d owns the hashes with one d-bit prefix. Where the directory is as deep
as it may get, a bucket that is still too full has overflow pages, told apart by further bits. Buckets lie in the shared
folder in ranges of (bucket, page, h), so one owner task has each entry; a row finds its bucket and page by the
directory and its entry there, and nowhere else.

The rows under one hash are compared byte by byte. Only texts whose hash more than one row has are moved for that: a bit
map of fixed size, built from the index, tells the others apart where they are read. A hash under which texts differ gets
a chain with an entry for each text. Joins name their strategy, so the plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACES, join_heavy, may_hold, stored

#: The directory has at most 2 ** MOST_DEPTH slots; it is small enough to send to every task.
MOST_DEPTH = 16
#: Entries of a bucket.
CAPACITY = 1 << 16
_ADDRESS = ["bucket", "page", "h"]


def normalised(column: str):
    """The text without ASCII white space; null counts as empty. (Six replacements took two thirds of translate's time.)"""
    out = F.coalesce(F.col(column), F.lit(""))
    for x in SPACES:
        out = F.replace(out, F.lit(x), F.lit(""))
    return out


def texts(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, points (of the original text), t (the normalised text) and h (its hash; fewer bits are for tests)."""
    out = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised("text").alias("t"))
    h = F.xxhash64("t")
    return out.withColumn("h", h if hash_bits == 64 else h.bitwiseAND(F.lit((1 << hash_bits) - 1)))


def entries(rows: DataFrame, keys: tuple[str, ...] = ("h",)) -> DataFrame:
    """One index entry for each key: n rows and the row that stays. Pre-aggregated before its shuffle.

    The row that stays has the most code points, then the smallest doc_id; a row without one comes last.
    """
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("less"), "doc_id"))  # ~x falls as x grows, and never overflows
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), best.alias("best")).select(*keys, "n", F.col("best.doc_id").alias("keep_id"))


def directory(index: DataFrame, capacity: int) -> DataFrame:
    """slot (prefix of MOST_DEPTH bits), depth, bucket and pages: the directory after its doublings.

    Entries are counted by slot in Spark; at most 2 ** MOST_DEPTH counts reach the driver, which doubles the directory
    while a bucket holds more than ``capacity`` entries: that bucket is split by one more bit of the hash. A bucket of the
    greatest depth has as many overflow pages as its entries need.
    """
    counts = dict(index.groupBy(_slot().alias("slot")).agg(F.count("*").alias("n")).collect())
    rows = []
    split = [(0, 0, sorted(counts))]  # depth, first slot and occupied slots of buckets not yet settled
    while split:
        d, first, slots = split.pop()
        held = sum(counts[x] for x in slots)
        if d == MOST_DEPTH or held <= capacity:
            rows += [(x, d, first, max(1, -(-held // capacity))) for x in slots]
            continue
        half = first + (1 << MOST_DEPTH - d - 1)
        split += [(d + 1, first, [x for x in slots if x < half]), (d + 1, half, [x for x in slots if x >= half])]
    return index.sparkSession.createDataFrame(rows, "slot long, depth int, bucket long, pages int")


def _slot():
    return F.shiftrightunsigned("h", 64 - MOST_DEPTH)


def addressed(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` with the bucket and page that own their h; a hash whose slot the directory lacks is in no bucket."""
    slots = slots.select(F.col("slot").alias("__slot"), "bucket", "pages")  # at most 2 ** MOST_DEPTH rows
    out = rows.withColumn("__slot", _slot()).join(F.broadcast(slots), "__slot", "left")
    return out.withColumn("page", F.pmod("h", "pages").cast("int")).drop("__slot", "pages")


def build_index(rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index as a table in the shared folder (bucket, page, h, n, keep_id, in ranges of the first three), and its directory."""
    found = stored(entries(rows), "exact-entries")
    slots = stored(directory(found, capacity), "exact-directory")
    out = addressed(found, slots).repartitionByRange(*_ADDRESS).sortWithinPartitions(*_ADDRESS)
    return stored(out.select(*_ADDRESS, "n", "keep_id"), "exact-index"), slots


def lookup(rows: DataFrame, index: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` with n and keep_id of their entry in the bucket and page that the directory names."""
    return join_heavy(addressed(rows, slots), index, _ADDRESS, "n").drop("bucket", "page")


def collisions(docs: DataFrame, index: DataFrame, hash_bits: int = 64) -> DataFrame:
    """The hashes whose rows are not byte for byte the same: under them the least and the greatest text differ.

    Only rows whose hash another row may have are compared; copies are reduced to two texts where they are read.
    """
    shared = may_hold(texts(docs, hash_bits).select("h", "t"), "h", index.where("n > 1"))
    return shared.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a != b").select("h")


def groups(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Of equal texts, the row with the most code points stays, then the smallest doc_id. Null and empty texts, and those
    of white space only, are equal to each other. Rows that repeat a doc_id and text share its answer; a null doc_id
    stays only where its group's row that stays has none. An empty table gives an empty result. Other columns aren't read.
    """
    rows = stored(texts(docs, hash_bits).select("doc_id", "points", "h", F.unhex(F.sha2("t", 256)).alias("sha")), "exact-rows")
    index, slots = build_index(rows, capacity)
    found = lookup(rows, index, slots).select("doc_id", "keep_id", "n", "sha", "h")
    clash = stored(collisions(docs, index, hash_bits), "exact-collisions")
    if not clash.isEmpty():
        chained = may_hold(texts(docs, hash_bits), "h", clash).join(clash.hint("merge"), "h")
        chained = chained.select("doc_id", "points", "h", "t", F.unhex(F.sha2("t", 256)).alias("sha"))
        chains = entries(chained, ("h", "t"))
        own = join_heavy(chained, chains, ["h", "t"], "n").select("doc_id", "keep_id", "n", "sha", "h")
        found = found.join(clash.hint("merge"), "h", "left_anti").unionByName(own)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    sha = F.lower(F.hex("sha"))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), sha.alias("text_sha256"))


def keep_first(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, and rows that repeat it.

    A row is known by its doc_id (which may be null) and text, so of rows that share a doc_id each has its own answer.
    """
    gone = groups(docs, capacity).where("not kept").select(F.col("doc_id").alias("__doc"), F.unhex("text_sha256").alias("__sha")).distinct()
    marked = docs.withColumn("__own", F.unhex(F.sha2(normalised("text"), 256)))
    same = marked["doc_id"].eqNullSafe(gone["__doc"]) & (marked["__own"] == gone["__sha"])
    return marked.join(gone.hint("merge"), same, "left_anti").drop("__own")
