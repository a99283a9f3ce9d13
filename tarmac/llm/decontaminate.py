"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

A window is ``size`` consecutive words of an item (a shorter item is one window). A document
contains a window only if it holds every shingle of the window, so the rarest one is the
necessary prefix: shingles are counted over the whole corpus, each window is filed under its
rarest shingle, and windows whose rarest shingle never occurs are dropped. Document positions
join on that one shingle; the position fixes where the window would start, which must lie
within the document (positional and length bounds); the window's words are then compared with
the document's words in place.

The corpus is only scanned: the benchmark's shingles are a side that is broadcast after its
rows are counted, else the join shuffles. A benchmark passage in a third of the documents makes
one row for each window and document that holds it. All of it is DataFrame functions.

Null or empty text: no words, no hits. Items without words are no windows; an item with a null
id hits words but is not listed. Rows that repeat a doc_id are judged each by its own text.
Extra columns are ignored; an empty table or benchmark gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import ascii_lower, broadcast_if_small, stored

WINDOW = 13
SHINGLE = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COUNT_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before lower-casing
MAX_BROADCAST = 250_000  # windows of at most 13 words, or shingles


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(words: str, size: int) -> Column:
    """Hash of the shingle that begins at each word of an array column."""
    return F.when(F.size(words) >= size, F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)]))).otherwise(
            F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id, win (its words), w``: every window of every item with words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    return (items.select("item_id", "words", F.explode(starts).alias("s"))
            .select("item_id", F.slice("words", F.col("s"), F.lit(size)).alias("win")).distinct()
            .withColumn("w", F.size("win")))


def _positions(documents: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, words, pos, shingle`` of every shingle of the corpus. The outer form keeps
    the planner from filtering on the arrays' sizes first, which would compute them twice."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text_hash", "words", shingles("words", size).alias("grams"))
    return rows.select("doc_id", "text_hash", "words", F.posexplode_outer("grams").alias("pos", "shingle"))


def necessary_prefix(documents: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``size, shingle, offset, win, w, item_id``: each window under its rarest shingle, which is of
    ``shingle`` words, or of all the window's if it has fewer."""
    sizes = [r.size for r in windows.select(F.least("w", F.lit(shingle)).alias("size")).distinct().collect()]
    parts = []
    for size in sizes:  # at most ``shingle`` sizes
        own = windows.where(F.least("w", F.lit(shingle)) == size).select("*", shingles("win", size).alias("grams"))
        listed = stored(own.select("item_id", "win", "w", F.posexplode("grams").alias("offset", "shingle")), "item-shingles")
        wanted = broadcast_if_small(stored(listed.select("shingle").distinct(), "shingles"), MAX_BROADCAST)
        counts = (_positions(documents, size).select("shingle").join(wanted, "shingle")
                  .groupBy("shingle").agg(F.count(F.lit(1)).alias("n")))
        whole = listed.join(counts, "shingle", "left").groupBy("item_id", "win", "w").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"))
        parts.append(whole.where("rarest.n > 0").select(F.lit(size).alias("size"), "rarest.shingle", "rarest.offset",
                                                       "win", "w", "item_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out, "prefixes")


def occurrences(documents: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, w, item_id`` of every occurrence of a window in a document."""
    parts = []
    for (size,) in prefixes.select("size").distinct().collect():
        side = prefixes.where(F.col("size") == size).drop("size")
        start = F.col("pos") - F.col("offset")
        rows = _positions(documents, size)
        if side.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:  # compared where the document is
            found = rows.join(F.broadcast(side), "shingle").where((start >= 0) & (start + F.col("w") <= F.size("words")))
            found = found.withColumn("start", start)
        else:  # numbers go to the windows, and words only to the places left
            places = rows.select("doc_id", "text_hash", F.size("words").alias("n_words"), "pos", "shingle")
            places = places.join(side, "shingle").where((start >= 0) & (start + F.col("w") <= F.col("n_words")))
            places = stored(places.select("doc_id", "text_hash", start.alias("start"), "w", "win", "item_id").distinct(), "places")
            texts = documents.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), words_of(F.col("text")).alias("words"))
            found = places.join(texts, places["doc_id"].eqNullSafe(texts["_d"]) & (places["text_hash"] == texts["_t"]))
        parts.append(found.where(F.slice("words", F.greatest("start", F.lit(0)) + 1, F.col("w")) == F.col("win"))
                     .select("doc_id", "text_hash", "start", "w", "item_id"))
    if not parts:
        return documents.sparkSession.createDataFrame(
            [], "doc_id bigint, text_hash bigint, start int, w int, item_id string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: words, words inside any occurrence, items that occur, and the verdict."""
    documents = documents.select("doc_id", "text")
    windows = stored(item_windows(benchmark, size), "windows")
    if windows.isEmpty():
        found = occurrences(documents, windows.select(F.lit(0).alias("size")).limit(0))
    else:
        found = occurrences(documents, necessary_prefix(documents, windows))
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "w", "item_id").rowsBetween(
        Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("w")
    fresh = end - F.greatest("start", F.coalesce(F.max(end).over(before), F.col("start")))
    hits = (found.select("*", F.greatest(fresh, F.lit(0)).alias("fresh"))
            .groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
            .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")))
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(
        F.array_remove(F.split(F.coalesce("text", F.lit("")), COUNT_SEPARATORS), "")).cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.join(hits, rows["doc_id"].eqNullSafe(hits["d"]) & (rows["text_hash"] == hits["t"]), "left")
            .select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                    ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), items.alias("items")))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` that are not contaminated; all columns."""
    bad = contamination(documents, benchmark, size).where("contaminated").select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_d"])
                          & (F.xxhash64(documents["text"]) == bad["_t"]), "left_anti")
