"""Exact dedup by a cuckoo-filter index of live digests, with insertion and deletion.

Texts are equal when identical after each run of ASCII white space became one blank. A text's
digest is the SHA-256 of that form; the digest's first 64 bits are its key.

The index is dealt to shards by the key. A shard has a cuckoo filter (16-bit fingerprints, four a
bucket, two buckets each), the keys that stand in it, and its bucketed content: the normalised
texts of its live digests. An index is a snapshot of written tables; ``insert`` and ``delete``
return the next one, so a task that is run again starts from the same state.

* *Arrivals.* Each task digests its texts and adds up equal ones (compared as bytes, in a bounded
  window), so a text that a third of all rows share comes as a few rows a task.
* *Shard pass.* Arrivals go to their shard, in order of the key, behind the shard's filter. A key
  that the filter has not is new: its fingerprint goes in, and its text becomes content. A key
  that it has is verified: against the content of the same key in hand, and what is not there
  against the content of earlier snapshots (a join on the digest that compares the texts). What is
  in neither was a false positive and is inserted like a new one.
* *Overflow.* An insertion that finds no place doubles the buckets and fills them anew from the
  shard's stored keys. Shards that hold more than ``SHARD_KEYS`` keys on average are dealt to
  twice as many, again from the stored keys.
* *Deletion.* Texts that the filter has and the content confirms are live: one fingerprint of each
  and its key are taken out, and so are its content and its group. The others are passed over.

Null text counts as empty; empty texts are equal. A group's ``keep_id`` is its smallest doc_id, null only if
all are null. Rows that repeat a doc_id with an equal text are counted in ``group_size`` and share
one verdict, as nothing tells them apart. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import broadcast_if_small, stored

SLOTS = 4
KICKS = 500
FIRST_BUCKETS = 64
SHARD_KEYS = 1 << 18
WINDOW_BYTES = 48 << 20  # of texts that a task holds while it adds up equal ones
BATCH_BYTES = 16 << 20
BROADCAST_GROUPS = 200_000

FILTER, NEW, HIT = 0, 1, 2
ARRIVAL = "key bigint, sha binary, first bigint, n bigint, text binary"
PASS = f"kind int, shard int, {ARRIVAL}, buckets int, slots binary, keys binary"


class CuckooFilter:
    """Fingerprints of keys in pairs of buckets. ``keys`` are what a larger filter is filled from."""

    def __init__(self, buckets: int = FIRST_BUCKETS, slots: bytes = b"", keys: bytes = b""):
        self.buckets = buckets
        self.slots = array("H", slots) if slots else array("H", bytes(2 * SLOTS * buckets))
        self.keys = array("q", keys)
        self._turn = 0

    @staticmethod
    def fingerprint(key: int) -> int:
        return (key & 0xFFFF) or 1

    def places(self, key: int) -> tuple[int, int, int]:
        """Fingerprint and the two buckets; each bucket is the other one's partner by the fingerprint."""
        fp, mask = (key & 0xFFFF) or 1, self.buckets - 1
        at = (key >> 16) & mask
        return fp, at, at ^ (fp * 0x5BD1E995 & mask)

    def _slot(self, bucket: int, value: int) -> int:
        for k in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if self.slots[k] == value:
                return k
        return -1

    def __contains__(self, key: int) -> bool:
        fp, a, b = self.places(key)
        return self._slot(a, fp) >= 0 or self._slot(b, fp) >= 0

    def _place(self, key: int) -> bool:
        fp, a, b = self.places(key)
        for bucket in (a, b):
            if (k := self._slot(bucket, 0)) >= 0:
                self.slots[k] = fp
                return True
        at, mask = b, self.buckets - 1
        for _ in range(KICKS):  # the fingerprint takes another's slot, which moves on to its partner bucket
            self._turn = (self._turn + 1) % SLOTS
            k = SLOTS * at + self._turn
            fp, self.slots[k] = self.slots[k], fp
            at ^= fp * 0x5BD1E995 & mask
            if (k := self._slot(at, 0)) >= 0:
                self.slots[k] = fp
                return True
        return False

    def add(self, key: int) -> None:
        self.keys.append(key)
        if not self._place(key):
            self._resize()

    def _resize(self) -> None:
        """Twice the buckets, again and again, until all stored keys have a place."""
        while True:
            self.buckets *= 2
            self.slots = array("H", bytes(2 * SLOTS * self.buckets))
            if all(map(self._place, self.keys)):
                return

    def remove(self, gone: list[int]) -> None:
        """Take out one fingerprint for each of the keys, which must all be in."""
        for key in gone:
            fp, a, b = self.places(key)
            k = max(self._slot(a, fp), self._slot(b, fp))
            if k >= 0:
                self.slots[k] = 0
        left, kept = Counter(gone), array("q")
        for key in self.keys:
            if left[key]:
                left[key] -= 1
            else:
                kept.append(key)
        self.keys = kept


def normalized(text: bytes) -> bytes:
    """Each run of ASCII white space as one blank."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + b" ".join(words) + (b" " if text[-1:].isspace() else b"")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_ARRIVAL_NAMES = ["key", "sha", "first", "n", "text"]
_ARRIVAL_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
_PASS_NAMES = ["kind", "shard", *_ARRIVAL_NAMES, "buckets", "slots", "keys"]
_PASS_KINDS = [pa.int32(), pa.int32(), *_ARRIVAL_KINDS, pa.int32(), pa.binary(), pa.binary()]


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _arrive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalised texts with their digest, equal ones of a window added up."""
    held: dict[bytes, list] = {}

    def out() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, (first, n) in held.items():
            sha = hashlib.sha256(text).digest()
            rows.append((int.from_bytes(sha[:8], "big", signed=True), sha, first, n, text))
            size += len(text)
            if size > BATCH_BYTES:
                yield _batch(rows, _ARRIVAL_NAMES, _ARRIVAL_KINDS)
                rows, size = [], 0
        held.clear()
        yield _batch(rows, _ARRIVAL_NAMES, _ARRIVAL_KINDS)

    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = normalized(text or b"")
            entry = held.get(text)
            if entry is None:
                held[text] = [doc_id, 1]
                size += len(text) + 200
            else:
                entry[0], entry[1] = _smaller(entry[0], doc_id), entry[1] + 1
            if size > WINDOW_BYTES:
                yield from out()
                size = 0
    yield from out()


def arrivals(documents: DataFrame) -> DataFrame:
    """``key, sha, first, n, text`` of the documents' texts."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_arrive, ARRIVAL)


class _Shard:
    """A shard within a pass: its filter and the entries of the key in hand."""

    def __init__(self, shard: int):
        self.shard, self.filter = shard, CuckooFilter()
        self.key: int | None = None
        self.entries: dict[bytes, list] = {}  # sha: [kind, first, n, text]
        self.gone: list[int] = []

    def closed(self) -> Iterator[tuple]:
        """The entries of the key in hand, as rows."""
        for sha, (kind, first, n, text) in self.entries.items():
            yield (kind, self.shard, self.key, sha, first, n, text, None, None, None)
        self.entries = {}

    def row(self) -> tuple:
        if self.gone:
            self.filter.remove(self.gone)
        f = self.filter
        return (FILTER, self.shard, None, None, None, None, None, f.buckets, f.slots.tobytes(), f.keys.tobytes())

    def insert(self, sha: bytes, first: int | None, n: int, text: bytes, earlier: bool) -> None:
        if self.key in self.filter:
            entry = self.entries.get(sha)
            if entry is not None and entry[3] == text:
                entry[1], entry[2] = _smaller(entry[1], first), entry[2] + n
                return
            if earlier:
                self.entries[sha] = [HIT, first, n, text]
                return
        self.filter.add(self.key)
        self.entries[sha] = [NEW, first, n, text]

    def probe(self, sha: bytes, first: int | None, n: int, text: bytes) -> None:
        if self.key in self.filter:
            entry = self.entries.setdefault(sha, [HIT, first, 0, text])
            entry[1], entry[2] = _smaller(entry[1], first), entry[2] + n


def _passes(mode: str, earlier: bool):
    """Rows in order of (shard, kind, key, sha): each shard's filter, then what arrives at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Shard | None = None
        rows, size = [], 0

        def end() -> list[tuple]:
            if now is None:
                return []
            return [*now.closed()] + ([now.row()] if mode != "probe" else [])

        for batch in batches:
            for kind, shard, key, sha, first, n, text, buckets, slots, keys in zip(
                    *(batch.column(c).to_pylist() for c in _PASS_NAMES)):
                if now is None or shard != now.shard:
                    rows += end()
                    now = _Shard(shard)
                if kind == FILTER:
                    now.filter = CuckooFilter(buckets, slots, keys)
                    continue
                if key != now.key:
                    rows += now.closed()
                    now.key = key
                if mode == "insert":
                    now.insert(sha, first, n, text, earlier)
                elif mode == "probe":
                    now.probe(sha, first, n, text)
                else:
                    now.gone.append(key)
                size += len(text or b"")
                if size > BATCH_BYTES:
                    yield _batch(rows, _PASS_NAMES, _PASS_KINDS)
                    rows, size = [], 0
        yield _batch(rows + end(), _PASS_NAMES, _PASS_KINDS)

    return run


@dataclass(frozen=True)
class CuckooIndex:
    """A snapshot. ``filters``: shard, buckets, slots, keys; ``content``: shard, key, sha, text;
    ``entries``: sha, first, n, one or more rows for each live digest."""

    spark: SparkSession
    shards: int
    filters: DataFrame | None = None
    content: DataFrame | None = None
    entries: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession, keys: int = 0, shard_keys: int = SHARD_KEYS) -> CuckooIndex:
        """For about so many keys; a shard a shuffle partition at least."""
        at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls(spark, max(at_least, -(-keys // shard_keys)))

    def _shard_of(self, key: str = "key"):
        return F.pmod(F.shiftrightunsigned(F.col(key), 40), F.lit(self.shards).cast("bigint")).cast("int")

    def _pass(self, arrived: DataFrame, mode: str, earlier: bool = False) -> DataFrame:
        """One pass of the shards, written."""
        none = {"buckets": "int", "slots": "binary", "keys": "binary"}
        rows = arrived.select(F.lit(NEW).alias("kind"), self._shard_of().alias("shard"), *_ARRIVAL_NAMES,
                              *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        if self.filters is not None:
            kinds = dict(zip(_ARRIVAL_NAMES, ("bigint", "binary", "bigint", "bigint", "binary")))
            rows = rows.unionByName(self.filters.select(
                F.lit(FILTER).alias("kind"), "shard", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], *none))
        dealt = rows.repartition("shard").sortWithinPartitions("shard", "kind", "key", "sha")
        return stored(dealt.mapInArrow(_passes(mode, earlier), PASS), f"cuckoo-{mode}")

    def _known(self, hits: DataFrame) -> DataFrame:
        """The hits whose text is content of an earlier snapshot."""
        old = self.content.select(F.col("sha").alias("_sha"), F.col("text").alias("_text"))
        return hits.join(old, (hits["sha"] == old["_sha"]) & (hits["text"] == old["_text"]), "left_semi")

    @staticmethod
    def _filters_of(done: DataFrame) -> DataFrame:
        return done.where(F.col("kind") == FILTER).select("shard", "buckets", "slots", "keys")

    def insert(self, documents: DataFrame) -> CuckooIndex:
        """The snapshot with the documents' texts added."""
        return self._insert(arrivals(documents))

    def _insert(self, arrived: DataFrame) -> CuckooIndex:
        earlier = self.content is not None
        done = self._pass(arrived, "insert", earlier)
        new = done.where(F.col("kind") == NEW)
        index = CuckooIndex(self.spark, self.shards, self._filters_of(done),
                            self._with("content", new.select("shard", "key", "sha", "text")),
                            self._with("entries", new.select("sha", "first", "n")))
        if earlier:
            hits = done.where(F.col("kind") == HIT).select(*_ARRIVAL_NAMES)
            known = stored(self._known(hits).select("sha", "first", "n"), "cuckoo-known")
            others = stored(hits.join(known.select("sha").distinct(), "sha", "left_anti").select(*_ARRIVAL_NAMES), "cuckoo-others")
            index = CuckooIndex(self.spark, self.shards, index.filters, index.content, index._with("entries", known))
            if not others.isEmpty():  # what the filter took for known, and is not
                again = index._pass(others, "insert")
                new = again.where(F.col("kind") == NEW)
                same = index.filters.join(index._filters_of(again).select("shard"), "shard", "left_anti")
                index = CuckooIndex(self.spark, self.shards, stored(same.unionByName(index._filters_of(again)), "cuckoo-filters"),
                                    index._with("content", new.select("shard", "key", "sha", "text")),
                                    index._with("entries", new.select("sha", "first", "n")))
        return index

    def _with(self, name: str, rows: DataFrame) -> DataFrame:
        before = getattr(self, name)
        return rows if before is None else before.unionByName(rows)

    def contains(self, documents: DataFrame) -> DataFrame:
        """``sha`` of the documents' texts that are live: filter first, content second."""
        if self.content is None:
            return self.spark.createDataFrame([], "sha binary")
        hits = self._pass(arrivals(documents), "probe").where(F.col("kind") == HIT)
        return self._known(hits).select("sha").distinct()

    def delete(self, documents: DataFrame) -> CuckooIndex:
        """The snapshot without the documents' texts, whatever the number of their copies."""
        if self.content is None:
            return self
        gone = stored(self.contains(documents), "cuckoo-gone")
        keyed = self.content.join(gone, "sha", "left_semi").select(
            "key", "sha", F.lit(None).cast("bigint").alias("first"), F.lit(1).cast("bigint").alias("n"),
            F.lit(None).cast("binary").alias("text"))
        done = self._pass(keyed, "remove")
        return CuckooIndex(self.spark, self.shards, self._filters_of(done),
                           stored(self.content.join(gone, "sha", "left_anti").select("shard", "key", "sha", "text"), "cuckoo-content"),
                           stored(self.entries.join(gone, "sha", "left_anti").select("sha", "first", "n"), "cuckoo-entries"))

    def resharded(self, shards: int) -> CuckooIndex:
        """The same keys and content in another number of shards; filters are filled from the content's keys."""
        if self.content is None:
            return CuckooIndex(self.spark, shards)
        index = CuckooIndex(self.spark, shards)
        none = F.lit(None).cast("bigint")
        rows = self.content.select("key", "sha", none.alias("first"), F.lit(0).cast("bigint").alias("n"), "text")
        done = index._pass(rows, "insert")
        new = done.where(F.col("kind") == NEW)
        return CuckooIndex(self.spark, shards, self._filters_of(done), new.select("shard", "key", "sha", "text"), self.entries)

    def grown(self, shard_keys: int = SHARD_KEYS) -> CuckooIndex:
        """Twice the shards, again and again, while they hold more keys than ``shard_keys`` on average."""
        keys = 0 if self.filters is None else self.filters.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
        shards = self.shards
        while keys > shards * shard_keys:
            shards *= 2
        return self if shards == self.shards else self.resharded(shards)

    def groups(self) -> DataFrame:
        """``sha, keep_id, group_size`` of every live digest."""
        if self.entries is None:
            return self.spark.createDataFrame([], "sha binary, keep_id bigint, group_size bigint")
        return self.entries.groupBy("sha").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))


def text_sha256():
    """SHA-256 of the normalised ``text``, as a column."""
    blanks = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(blanks.cast("binary"), 256)


def duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, from an index of all of them."""
    documents = documents.select("doc_id", "text")
    index = CuckooIndex.empty(documents.sparkSession, documents.count()).insert(documents)
    several = stored(index.groups().where("group_size > 1"), "cuckoo-groups")
    rows = documents.select("doc_id", text_sha256().alias("text_sha256")).withColumn("_sha", F.unhex("text_sha256"))
    named = rows.join(broadcast_if_small(several, BROADCAST_GROUPS), rows["_sha"] == several["sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return named.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def without_copies(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with all columns; rows without a doc_id do."""
    gone = duplicates(documents).where("NOT kept AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s")).distinct()
    return documents.join(gone, (documents["doc_id"] == gone["_d"]) & (text_sha256() == gone["_s"]), "left_anti")
