"""Quality rules: per-text rules, then the frequency of lines across a host's documents.

Base rules look at one text: too few words, or too many words inside repeated 5-word windows.
The cross-document rule hashes every normalised line (trimmed, A-Z lower-cased, runs of blanks
as one), counts the distinct documents of each host that hold it, and takes a line out of a
document when more than ``min_docs`` of its host's documents hold it (and, if a ``share`` is given, more
than that share of them). One copy stays: in the host's smallest doc_id that holds the line. A document is
depleted, and rejected, when lines were taken out of it and the words left are fewer than
``min_words`` or than ``keep_share`` of its words.

Lines are hashed once per document. Each (host, document, line) is dealt by all three and counted
once, so a line that a third of the rows share is spread over the tasks, and its (host, line) count
is combined before the next shuffle. The lines
over the limit go back to the documents through a join on (host, hash) that holds no text.

Null text: no words, base_failed. Null source: a host of its own. Rows that repeat a doc_id are
judged as rows, but count as one document of their host (so do rows without a doc_id). Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import broadcast_if_small, stored, without

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"

SHARE = 0.0
MIN_DOCS = 5
KEEP_SHARE = 0.3

STATS = ("doc_id bigint, host string, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
         "n_dup_lines bigint, n_repeat_words bigint, hashes array<bigint>, weights array<bigint>")


def line_hash(line: bytes) -> int:
    """Hash of a normalised line, as a signed 64-bit number."""
    h = xxhash.xxh3_64_intdigest(b" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words covered by windows of ``size`` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # equal windows get equal numbers: pair up neighbours by rank, size - 1 times, so it is exact
    rank = ids
    for step in range(1, size):
        pair = rank[:len(words) - step] * (len(number) + 1) + ids[step:]
        rank = np.unique(pair, return_inverse=True)[1]
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[size:size + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: bytes) -> tuple:
    words = text.split()
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    weight: dict[int, int] = {}
    for line in lines:
        h = line_hash(line)
        weight[h] = weight.get(h, 0) + len(line.split())
    blanks = len(text) - len(text.translate(None, BLANKS))
    return (len(words), len(text.decode()) - blanks, len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), list(weight), list(weight.values()))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "hashes", "weights"]
    for batch in batches:
        rows = list(zip(*[text_stats(x or b"") for x in batch.column("text").to_pylist()])) or [()] * len(names)
        yield pa.record_batch([batch.column(c) for c in ("doc_id", "host", "text_hash")]
                              + [pa.array(x, k) for x, k in zip(rows, kinds)],
                              names=["doc_id", "host", "text_hash", *names])


def document_stats(documents: DataFrame, host_col: str = "source") -> DataFrame:
    """Base figures of every text, with its lines' hashes and words, written once."""
    rows = documents.select("doc_id", F.col(host_col).alias("host"), F.xxhash64("text").alias("text_hash"),
                            F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(_stats, STATS), "quality-stats")


def frequent_lines(stats: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """``host, hash, docs, first_doc`` of lines over their host's limit."""
    lines = (stats.select("host", "doc_id", F.explode("hashes").alias("hash")).distinct()
             .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
             .where(F.col("docs") > min_docs))
    if not share:
        return stored(lines.select("host", "hash", "docs", "first_doc"), "frequent-lines")
    hosts = stats.select("host", "doc_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    over = lines.join(hosts, lines["host"].eqNullSafe(hosts["host"])).where(F.col("docs") > share * F.col("host_docs"))
    return stored(over.select(lines["host"], "hash", "docs", "first_doc"), "frequent-lines")


def removed_lines(stats: DataFrame, frequent: DataFrame) -> DataFrame:
    """``doc_id, text_hash, removed, removed_words`` of documents that lose lines."""
    lines = stats.select("doc_id", "host", "text_hash", F.explode(F.arrays_zip("hashes", "weights")).alias("x"))
    lines = lines.select("doc_id", F.col("host").alias("h"), "text_hash",
                         F.col("x.hashes").alias("line"), F.col("x.weights").alias("words"))
    side = broadcast_if_small(frequent, 200_000)
    hit = (lines.join(side, lines["h"].eqNullSafe(side["host"]) & (lines["line"] == side["hash"]))
           .where(~F.col("doc_id").eqNullSafe(F.col("first_doc"))))
    return hit.dropDuplicates(["doc_id", "h", "text_hash", "line"]).groupBy("doc_id", "h", "text_hash").agg(
        F.collect_list("line").alias("removed"), F.sum("words").alias("removed_words"))


def judge(documents: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS,
          keep_share: float = KEEP_SHARE, host_col: str = "source") -> DataFrame:
    """One row per document: its figures, ``base_failed``, ``removed_words``, ``removed`` (hashes of
    the lines taken out) and ``kept``."""
    stats = document_stats(without(documents, ["doc_id", "text", host_col]), host_col)
    gone = removed_lines(stats, frequent_lines(stats, share, min_docs))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("h"), F.col("text_hash").alias("t"), "removed", "removed_words")
    base = stats.drop("hashes", "weights")
    both = base.join(gone, base["doc_id"].eqNullSafe(gone["d"]) & (base["text_hash"] == gone["t"])
                     & base["host"].eqNullSafe(gone["h"]), "left").drop("d", "t", "h")
    n, lost = F.col("n_words"), F.coalesce("removed_words", F.lit(0).cast("bigint"))
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)
    left = n - lost
    depleted = (lost > 0) & ((left < MIN_WORDS) | (left < keep_share * n))
    return both.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
                       lost.alias("removed_words"), "removed")


def clean_documents(documents: DataFrame, **limits) -> DataFrame:
    """The documents kept, without the lines over their host's limit; all columns of ``documents``."""
    gone = next(n for n in map("removed_{}".format, range(len(documents.columns) + 1)) if n not in documents.columns)
    verdict = judge(documents, **limits).where("kept").select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("host").alias("_h"),
        F.col("removed").alias(gone)).dropDuplicates(["_d", "_t", "_h"])
    host = limits.get("host_col", "source")
    both = documents.join(verdict, documents["doc_id"].eqNullSafe(verdict["_d"])
                          & (F.xxhash64(documents["text"]) == verdict["_t"])
                          & documents[host].eqNullSafe(verdict["_h"]))
    schema = documents.schema
    text_at = documents.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if x is None or not gone else _without_lines(x, set(gone))
                     for x, gone in zip(batch.column(text_at).to_pylist(), batch.column(len(schema)).to_pylist())]
            columns = batch.columns[:len(schema)]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=schema.names)

    return both.select(*[documents[c] for c in documents.columns], gone).mapInArrow(cut, schema)


def _without_lines(text: str, gone: set[int]) -> str:
    lines = text.encode().split(b"\n")
    return b"\n".join(x for x in lines if not x or x.isspace() or line_hash(x) not in gone).decode()
