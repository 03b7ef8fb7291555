"""Benchmark decontamination by winnowing: every shared span of ten words is found through one kept fingerprint.

A window's fingerprint is the least hash among its five-word grams, so equal windows of documents and of benchmark
items have equal fingerprints.  Fingerprints are joined first, and a hit is extended to its window, compared word by
word.  All of it is column functions and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.common import materialize, picked, release

#: Fixed value of the contract: words are what stands between runs of these.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows, and bytes of their text, that are sent to all tasks at once: further ones are looked for in a scan of their own.
PART_WINDOWS, PART_BYTES = 200_000, 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text in which only A-Z are lower-cased; null of null.  ASCII texts take the faster way.

    Splitting is linear; extracting all matches would copy the text for each of them.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN), "")


def hashed_words(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """df, which has a column text, with its words in its place, their number, and hashes of the grams that windows of these lengths need.

    Nothing after this step needs a lambda, so the rest stays in generated code.
    """
    rows = df.withColumn("words", words_of(F.coalesce("text", F.lit("")))).drop("text").withColumn("n_words", F.size("words"))
    rows = rows.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w)))

    def grams(k: int) -> Column:
        return F.transform("_hashes", lambda h, i: F.xxhash64(h, *(F.get("_hashes", i + j) for j in range(1, k))))

    for k in sorted({min(gram, n) for n in lengths}):
        rows = rows.withColumn(f"_grams{k}", grams(k))
    return rows.drop("_hashes")


def fingerprint(at: Column, length: int, gram: int) -> Column:
    """The least hash of a gram in the window of this length at this place; a window shorter than a gram is one."""
    k = min(gram, length)
    hashes = [F.get(f"_grams{k}", at + j) for j in range(length - k + 1)]
    return F.least(*hashes) if len(hashes) > 1 else hashes[0]


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(item_id, words, m, content): each item's windows; an item with fewer words is one window."""
    items = hashed_words(benchmark, list(range(1, window + 1)), gram).where("n_words > 0").withColumn("length", F.least("n_words", F.lit(window)))
    placed = items.select("*", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("length"))).alias("at"))
    m = F.coalesce(*(F.when(F.col("length") == n, fingerprint(F.col("at"), n, gram)) for n in range(1, window + 1)))
    return placed.select("item_id", "length", m.alias("m"), F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("content"))


def places(docs: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(row, doc_id, n_words, words, at, length, m): each document's windows of each length, and one row at least."""
    rows = docs.select("*", F.posexplode_outer("words").alias("at", "_word"))
    m = {n: F.when(F.col("at") + n <= F.col("n_words"), fingerprint(F.col("at"), n, gram)) for n in lengths}
    own = ["row", "doc_id", "n_words", "words", "at"]
    if len(lengths) == 1:
        return rows.select(*own, F.lit(lengths[0]).alias("length"), m[lengths[0]].alias("m"))
    return rows.select(*own, F.inline(F.array(*(F.struct(F.lit(n).alias("length"), v.alias("m")) for n, v in m.items()))))


def found_windows(docs: DataFrame, windows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(row, doc_id, n_words, at, length, window_id) of the windows that documents hold, and of each document's first place."""
    marks = windows.select("m").distinct().withColumn("_mark", F.lit(True))
    met = places(docs, lengths, gram).join(F.broadcast(marks), "m", "left")
    content = F.when(F.col("_mark"), F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " "))
    texts = windows.select("content", "window_id")
    seen = met.withColumn("content", content).join(F.broadcast(texts), "content", "left")
    first = F.coalesce(F.col("at"), F.lit(0)).eqNullSafe(F.lit(0)) & (F.col("length") == lengths[0])
    return seen.where(F.col("window_id").isNotNull() | first).select("row", "doc_id", "n_words", "at", "length", "window_id")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5,
    part_windows: int = PART_WINDOWS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of an item's window of ``window`` words; an item with fewer words is one window.
    Null and empty texts have no words, so such documents aren't hit and such items hit nothing.  Every row of docs
    counts for itself, ids that repeat or are null too.  Items of one id count once; an item without id hits words but
    is neither counted nor listed.  Empty tables give no rows, or documents that are clean.  A text's words are one
    array in its row, so a task holds the words of its longest text.
    """
    if not 0 < gram <= window:
        raise ValueError("gram has to be between 1 and window")
    listed = materialize(item_windows(picked(benchmark, item_id=item_col, text=item_text_col).withColumn("item_id", F.col("item_id").cast("string")), window, gram).distinct(), "item-windows")
    windows = materialize(listed.select("length", "m", "content").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    stats = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    lengths = stats["lengths"] or [window]
    parts = max(1, math.ceil(stats["n"] / part_windows), math.ceil(stats["bytes"] / part_bytes))
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = hashed_words(rows, lengths, gram).withColumn("row", F.monotonically_increasing_id())
    found = None
    for part in range(parts):
        # the row's number is that of the scan, the same in every part
        own = found_windows(hashed, windows.where(F.pmod("m", F.lit(parts)) == part) if parts > 1 else windows, lengths, gram)
        found = own if found is None else found.unionByName(own.where("window_id is not null"))
    found = materialize(found, "found-windows")
    # words that no earlier window of the document covers
    end = F.col("at") + F.col("length")
    before = F.max(F.when(F.col("window_id").isNotNull(), end)).over(Window.partitionBy("row").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("window_id").isNotNull(), F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(before, F.lit(0)))))
    counted = found.withColumn("_fresh", fresh).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.coalesce(F.sum("_fresh"), F.lit(0)).alias("n_hit"))
    hits = found.where("window_id is not null").select("row", "window_id").distinct()
    owners = materialize(listed.where("item_id is not null").join(windows, "content").select("window_id", "item_id"), "window-items")
    owners = F.broadcast(owners) if owners.count() <= 5 * part_windows else owners
    items = hits.join(owners, "window_id").select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("_items"))
    none = F.array().cast("array<string>")
    out = counted.join(items, "row", "left").withColumn("_items", F.coalesce("_items", none))
    release(listed)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
