"""Token counts: pieces are counted once per distinct pre-token and joined to the documents.

1. One pass counts pre-tokens by partition; a grouped sum makes the corpus's distinct pre-tokens
   with their frequencies, and the tokenizer sees each of them once. The table (hash, pieces,
   frequency) is written to the shared folder.
2. A second pass takes every document's pre-token frequencies. The ``HEAD`` most frequent
   pre-tokens, a fixed number, travel to the tasks, so the keys that would be hot in a join are
   summed in place; all other (document, pre-token, frequency) rows join the table by hash.
3. Pieces times frequency are summed by document. No ids are made.

A pre-token is a stretch of text at whose ends the tokenizer splits too: stretches between ASCII
white space, and inside these, where all characters are ASCII or Latin-1 letters and there is no
special token, the tokenizer's own pattern (contractions, letters, one digit, other signs).
Whatever is left whole is split by the tokenizer when it counts it, so counts are exact.

Null text is empty: 0 bytes, 0 tokens. Rows that repeat a doc_id are counted each by its own
text. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored

TOKENIZER = "word_bpe_49k.json"
HEAD = 1 << 17
LIMIT = 2048
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pre_tokens(chunk: bytes) -> list[bytes]:
    """Pre-tokens of a stretch without ASCII white space."""
    if b"<|" in chunk:
        return [chunk]
    text = chunk.decode()
    if not _PLAIN.fullmatch(text):
        return [chunk]
    return [x.encode() for x in _SPLIT.findall(text.lower())]


def key_of(pre_token: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(pre_token)
    return h - (1 << 64) if h >> 63 else h


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens with their frequency in this partition; what is held is sent on when it is large."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        found: Counter = Counter()
        for chunk, n in held.items():
            for p in pre_tokens(chunk):
                found[p] += n
        held.clear()
        return pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                               names=["piece", "freq"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                held.update(text.split())
            if len(held) > 300_000:
                yield out()
    if held:
        yield out()


def piece_table(documents: DataFrame, path: str) -> DataFrame:
    """``key, piece, n, freq`` of every distinct pre-token of the corpus; the tokenizer counts each once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            found = encode([p.decode() for p in pieces], add_special_tokens=False)
            yield pa.record_batch([pa.array([key_of(p) for p in pieces], pa.int64()), batch.column("piece"),
                                   pa.array([len(x) for x in found], pa.int32()), batch.column("freq")],
                                  names=["key", "piece", "n", "freq"])

    distinct = (documents.select(F.col("text").cast("binary").alias("text"))
                .mapInArrow(_frequencies, "piece binary, freq bigint")
                .groupBy("piece").agg(F.sum("freq").alias("freq")))
    return stored(distinct.mapInArrow(count, "key bigint, piece binary, n int, freq bigint"), "pieces")


def most_frequent(pieces: DataFrame, head: int) -> dict[bytes, int]:
    """Pieces of the pre-tokens at or over a frequency that at most ``head`` pre-tokens reach."""
    step = F.floor(F.log2(F.col("freq")) * 8)
    levels = pieces.groupBy(step.alias("level")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("level")).collect()
    taken, cut = 0, None
    for level, c in levels:  # a few hundred at most
        if taken + c > head:
            break
        taken, cut = taken + c, level
    if cut is None:
        return {}
    return {bytes(r.piece): r.n for r in pieces.where(step >= cut).select("piece", "n").collect()}


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    pieces = piece_table(documents, path or tokenizer_path())
    known = spark.sparkContext.broadcast(most_frequent(pieces, head))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (pieces of its frequent pre-tokens) and for each other pre-token of it."""
        table = known.value

        class Parts(dict):
            def __missing__(self, chunk: bytes) -> tuple:
                if len(self) > 300_000:
                    self.clear()
                parts = pre_tokens(chunk)
                self[chunk] = v = (sum(table.get(p, 0) for p in parts), [key_of(p) for p in parts if p not in table])
                return v

        parts = Parts()
        for batch in batches:
            ids, hashes, keys, freqs, sizes = [], [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")))
            for doc_id, text_hash, text in rows:
                text, total, rare = text or b"", 0, Counter()
                for chunk, f in Counter(text.split()).items():
                    n, others = parts[chunk]
                    total += n * f
                    for k in others:
                        rare[k] += f
                ids += [doc_id] * (len(rare) + 1)
                hashes += [text_hash] * (len(rare) + 1)
                keys += [text_hash, *rare]
                freqs += [total, *rare.values()]
                sizes += [len(text)] + [None] * len(rare)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, hashes, keys, freqs, sizes)],
                                  names=["doc_id", "text_hash", "key", "freq", "size"])

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    spread_rows = rows.mapInArrow(spread, "doc_id bigint, text_hash bigint, key bigint, freq bigint, size bigint")
    table = pieces.select("key", F.col("n").alias("pieces"))
    own = F.col("size").isNotNull()
    part = F.when(own, F.col("freq")).otherwise(F.col("freq") * F.col("pieces"))
    # a text's own row has its text's hash as key: should that be a pre-token's key as well, it stays one row
    sums = (spread_rows.join(table, "key", "left").groupBy("doc_id", "text_hash")
            .agg(F.sum(part).alias("tokens"), F.max("size").alias("n_bytes"), F.count("size").alias("rows")))
    each = sums.select("doc_id", "n_bytes", F.expr("tokens div rows").alias("n_tokens"),
                       F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("_row"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
