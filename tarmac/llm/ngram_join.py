"""N-gram Jaccard join: near-duplicate documents by signature trees.

A document's set is its distinct 5-word shingles; two documents link when their sets' Jaccard
similarity is at least 3/4, and a group is a connected component of links.

1. *Signatures* (two passes over the texts): the first counts shingles in ``BUCKETS`` buckets, of which each
   task reports those far above its mean; the second gives the set's size, 128-bit hash, bitmap (two to four bits
   a shingle) and prefix: its ``n // 4 + 1`` rarest shingles, in the order of (bucket's count, hash). Two sets
   that link share a shingle of both prefixes, whatever the order is, so what the buckets miss costs time and
   never a link. Equal sets collapse to one class (grouped, combined before the shuffle).
2. *Trees.* The classes whose prefixes hold a shingle have one root, the smallest of them; all that have a
   root in common are the leaves of its tree, in one tree for each width of bitmap. Linked sets
   differ in width by one step at most: a class is also a guest, its bitmap folded, in the tree one step narrower, and
   guests do not meet there. A leaf holds the set's bitmap; an inner node the OR of its
   children's bitmaps, the range of their sizes and the largest number of shingles that fell on
   an already set bit. For two nodes, ``popcount(or1 & or2) + min(excess1, excess2)`` bounds the
   overlap of any two documents below them; a pair of nodes goes on only if that could reach 3/7
   of their smallest sizes.
3. *First traversal: the pivot.* Every tree is traversed together with its smallest class alone, so
   a group of near copies, however large, gives one candidate for each leaf. Leaves whose size rules the pivot out stay behind.
4. *Dual traversal.* In trees whose leaves but the pivot still lie in different components, node pairs are
   traversed from the roots; pairs wholly inside one component and pairs under the bound are
   pruned. It ships bitmaps only and names the leaves that have a possible partner; a second traversal
   among these compares leaves by their 32-bit shingle hashes. One pair for
   each leaf and other component is a candidate: more would say nothing new. Large trees are
   cut into blocks of ``BLOCK`` leaves; only the leaves outside the tree's largest component
   probe the others.
5. Candidates are verified exactly on the whole texts' shingle sets; components are found by
   distributed union-find.

Every link between different sets comes through a tree, and none is missed: prefixes and bounds are necessary conditions. Nothing is
capped: all leaves of a tree are traversed as said, whatever their number. The driver gets the counts of at most ``BUCKETS`` buckets.

Null or empty text, or text without words: empty set, linked with nothing, component_id is the
row's own doc_id. Null doc_id: the component of the rows that have the same set, null without any. Repeated rows get equal
results; rows of one doc_id with different texts count as one document that has both sets.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import broadcast_if_small, components, stored

SHINGLE = 5
BUCKETS = 1 << 22  # of the rarity order: one byte each goes to every task
MIN_BITS, MAX_BITS = 1 << 6, 1 << 17  # a bitmap's width; longer texts only get a weaker (still valid) bound
BLOCK = 512
FAN = 8
MEMBERS = 64  # leaves that one verification task compares with an anchor's text

_rng = np.random.default_rng(20240501)
_ODD = _rng.integers(1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURES = "doc_id bigint, n int, s1 bigint, s2 bigint, w int, bitmap binary, prefix array<bigint>"


class WordHash(dict):
    """64-bit hash of a word, remembered for up to half a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, word_hash: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles (A-Z lower-cased, ASCII white space)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        return mix((ids * _ODD[:len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - size + 1
    h = ids[:n] * _ODD[0]
    for i in range(1, size):
        h += ids[i:i + n] * _ODD[i]
    return np.unique(mix(h))


def bitmap_bits(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (2 * max(n, 1) - 1).bit_length()))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of 32-bit shingle hashes, as 64-bit words."""
    on = np.zeros(bits, bool)
    on[tokens & np.uint32(bits - 1)] = True
    return np.packbits(on, bitorder="little").view(np.uint64)


def fold(sig: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap made narrower: what it would be at that many bits."""
    while 64 * len(sig) > bits:
        sig = sig[:len(sig) // 2] | sig[len(sig) // 2:]
    return sig


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets with far more shingles than this task's mean."""
    word_hash, counts = WordHash(), np.zeros(BUCKETS, np.int32)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            at = (shingle_set(text, word_hash) & np.uint64(BUCKETS - 1)).astype(np.int64)
            np.add.at(counts, at, 1)
    mean = int(counts.sum(dtype=np.int64)) / BUCKETS
    often = np.flatnonzero(counts >= max(3.0, mean + 4 * mean ** 0.5))
    yield pa.record_batch([pa.array(often, pa.int64()), pa.array(counts[often].astype(np.int64))], names=["bucket", "n"])


def rarity(rows: DataFrame) -> np.ndarray:
    """A level for each bucket, the number of binary digits of its count: 0 where no task found it frequent."""
    found = rows.select("text").mapInArrow(_bucket_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[found.column("bucket").to_numpy()] = np.frexp(found.column("n").to_numpy().astype(float))[1]
    return levels


def prefix(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, one of which any set that links with it has among its own rarest."""
    order = np.argsort(levels[(shingles & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")
    return shingles[order[:len(shingles) // 4 + 1]]


def _signatures(levels: np.ndarray):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = WordHash()
        for batch in batches:
            n, s1, s2, w, maps, prefixes = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                u = shingle_set(text, word_hash)
                bits = bitmap_bits(len(u))
                n.append(len(u))
                s1.append(int(u.sum().view(np.int64)))
                s2.append(int(np.bitwise_xor.reduce(mix(u)).view(np.int64)) if len(u) else 0)
                w.append(bits.bit_length() - 1)
                maps.append(bitmap(upper(u), bits).tobytes() if len(u) else b"")
                prefixes.append(prefix(u, levels).view(np.int64) if len(u) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                                   pa.array(w, pa.int32()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                                  names=["doc_id", "n", "s1", "s2", "w", "bitmap", "prefix"])
    return signed


def upper(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of shingle hashes; sorted, as the hashes are."""
    return (shingles >> np.uint64(32)).astype(np.uint32)


def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper halves of the shingle hashes, sorted, as bytes."""
    word_hash = WordHash()
    for batch in batches:
        sets = [upper(shingle_set(t, word_hash)) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "tokens"])


def enough(overlap, sizes):
    """Jaccard >= 3/4, as integers: 100 * o >= 75 * (sizes - o)."""
    return 7 * overlap >= 3 * sizes


# ---- trees ----

class Tree:
    """Levels of a signature tree over leaves sorted by component (smallest member first) and size; level 0 is the leaves."""

    def __init__(self, ids: np.ndarray, comps: np.ndarray, tokens: list[np.ndarray], bits: int):
        self.build(ids, comps, np.array([len(t) for t in tokens], np.int64), np.stack([bitmap(t, bits) for t in tokens]))
        self.tokens = [tokens[k] for k in self.order]

    @classmethod
    def of_bitmaps(cls, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sig: np.ndarray) -> Tree:
        tree = cls.__new__(cls)
        tree.build(ids, comps, sizes, sig)
        return tree

    def build(self, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sig: np.ndarray) -> None:
        known, at = np.unique(comps, return_inverse=True)
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, at, sizes)
        self.order = order = np.lexsort((sizes, comps, least[at]))
        self.ids, self.comps, sig, n = ids[order], comps[order], sig[order], sizes[order]
        excess = n - np.bitwise_count(sig).sum(axis=1, dtype=np.int64)
        self.levels = [(sig, n, n, excess, self.comps, self.comps)]
        while len(self.levels[-1][0]) > 1:
            self.grow()

    def grow(self) -> None:
        sig, low, high, excess, c_low, c_high = self.levels[-1]
        at = np.arange(0, len(sig), FAN)
        self.levels.append((np.bitwise_or.reduceat(sig, at, axis=0), np.minimum.reduceat(low, at),
                            np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at),
                            np.minimum.reduceat(c_low, at), np.maximum.reduceat(c_high, at)))


def dual_traversal(a: Tree, b: Tree, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Leaf numbers of ``a`` and ``b`` whose possible overlap may make a link across components.
    ``seen`` gets the number of node pairs met and kept, level by level from the roots."""
    while len(a.levels) < len(b.levels):
        a.grow()
    while len(b.levels) < len(a.levels):
        b.grow()
    i = j = np.zeros(1, np.int64)
    for level in reversed(range(len(a.levels))):
        keep_i, keep_j = [i[:0]], [j[:0]]
        la, lb = a.levels[level], b.levels[level]
        step = max(1, (1 << 22) // la[0].shape[1])
        for k in range(0, len(i), step):
            x, y = i[k:k + step], j[k:k + step]
            same = (la[4][x] == la[5][x]) & (lb[4][y] == lb[5][y]) & (la[4][x] == lb[4][y])
            x, y = x[~same], y[~same]
            possible = np.minimum(np.minimum(la[2][x], lb[2][y]),
                                  np.bitwise_count(la[0][x] & lb[0][y]).sum(axis=1, dtype=np.int64)
                                  + np.minimum(la[3][x], lb[3][y]))
            ok = enough(possible, la[1][x] + lb[1][y])
            keep_i.append(x[ok])
            keep_j.append(y[ok])
        met = len(i)
        i, j = np.concatenate(keep_i), np.concatenate(keep_j)
        if seen is not None:
            seen.append((met, len(i)))
        if level:
            below_a, below_b = len(a.levels[level - 1][0]), len(b.levels[level - 1][0])
            kids = np.arange(FAN)
            ci = np.broadcast_to((i[:, None, None] * FAN + kids[None, :, None]), (len(i), FAN, FAN)).ravel()
            cj = np.broadcast_to((j[:, None, None] * FAN + kids[None, None, :]), (len(j), FAN, FAN)).ravel()
            there = (ci < below_a) & (cj < below_b)
            i, j = ci[there], cj[there]
    return i, j


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted token sets are similar enough."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return enough(int((b[at] == a).sum()), len(a) + len(b))


def links_across(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """A pair of linked leaves for each leaf of ``b`` and component of ``a``'s leaves, if there is one."""
    found, known = [], set()
    for i, j in zip(*(x.tolist() for x in dual_traversal(a, b))):
        key = (int(b.ids[j]), int(a.comps[i]))
        if key not in known and a.comps[i] != b.comps[j] and linked(a.tokens[i], b.tokens[j]):
            known.add(key)
            x, y = int(a.ids[i]), key[0]
            found.append((max(x, y), min(x, y)))
    return found


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, tb, pb): builds the block's two trees and traverses them together."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        sides = [[r for r in rows if r[3] == probe] for probe in (False, True)]
        if not all(sides):
            return []
        tokens = [[np.frombuffer(r[6], np.uint32) for r in s] for s in sides]
        bits = bitmap_bits(max(len(t) for side in tokens for t in side))
        return links_across(*(Tree(np.array([r[4] for r in s]), np.array([r[5] for r in s]), t, bits)
                              for s, t in zip(sides, tokens)))

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows, names = [], ("key", "tb", "pb", "probe", "id", "comp", "tokens")
    for batch in batches:
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if rows and row[:3] != rows[0][:3]:
                found += pairs(rows)
                rows = []
            rows.append(row)
        yield batch_of(found)
    if rows:
        yield batch_of(pairs(rows))


def partners(rows: list[tuple], seen: list | None = None) -> list[tuple]:
    """``key, id, comp, probe`` of the leaves of two blocks that may link with a leaf of the other one.
    A row: key, tb, pb, probe, id, comp, n, w, guest, bitmap."""
    sides = [[r for r in rows if r[3] == probe] for probe in (False, True)]
    if not all(sides):
        return []
    bits = 1 << min(r[7] for r in rows)
    a, b = (Tree.of_bitmaps(np.array([r[4] for r in s]), np.array([r[5] for r in s]), np.array([r[6] for r in s], np.int64),
                            np.stack([fold(np.frombuffer(r[9], np.uint64), bits) for r in s])) for s in sides)
    i, j = dual_traversal(a, b, seen)
    guests = [np.array([r[8] for r in s])[t.order] for s, t in zip(sides, (a, b))]
    meet = ~(guests[0][i] & guests[1][j])
    return [(rows[0][0], int(t.ids[k]), int(t.comps[k]), probe) for t, at, probe in ((a, i, False), (b, j, True))
            for k in np.unique(at[meet]).tolist()]


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, tb, pb): traverses the trees of each two blocks by bitmaps alone."""
    names, types = ("key", "id", "comp", "probe"), (pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=names)

    rows, columns = [], ("key", "tb", "pb", "probe", "id", "comp", "n", "w", "guest", "bitmap")
    for batch in batches:
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if rows and row[:3] != rows[0][:3]:
                found += partners(rows)
                rows = []
            rows.append(row)
        yield batch_of(found)
    if rows:
        yield batch_of(partners(rows))


def _blocks(count: str):
    return F.ceil(F.col(count) / F.lit(BLOCK)).cast("int")


def _dealt(leaves: DataFrame, probes) -> DataFrame:
    """The leaves of each tree (with its ``total``) in blocks, and those that probe (``minor`` of them) in others; each block meets each.
    Rows are sorted by key, tb, pb."""
    tbs, pbs, hashed = _blocks("total"), _blocks("minor"), F.xxhash64("id")
    own = [c for c in leaves.columns if c not in ("key", "total", "minor", "major", "pivot")]
    target = leaves.select("key", F.pmod(hashed, tbs).cast("int").alias("tb"),
                           F.explode(F.sequence(F.lit(0), pbs - 1)).alias("pb"), F.lit(False).alias("probe"), *own)
    probe = leaves.where(probes).select("key", F.explode(F.sequence(F.lit(0), tbs - 1)).alias("tb"),
                                        F.pmod(hashed, pbs).cast("int").alias("pb"), F.lit(True).alias("probe"), *own)
    return target.unionByName(probe).repartition("key", "tb", "pb").sortWithinPartitions("key", "tb", "pb")


def _mixed(leaves: DataFrame) -> DataFrame:
    """The leaves of the trees that hold several components, with the tree's counts and its largest component."""
    parts = leaves.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    trees = (parts.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("total"),
                                      F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("major"))
             .where(F.col("comps") > 1))
    trees = stored(trees.select("key", "total", "major", (F.col("total") - F.col("most")).alias("minor")), "trees")
    return leaves.join(broadcast_if_small(trees), "key")


def tree_candidates(leaves: DataFrame, tokens: DataFrame) -> DataFrame:
    """``a, b``: leaves of one tree, in different components, that link by their token sets.

    ``leaves``: key, id, comp (stored); ``tokens``: id, tokens. A tree's largest component only waits to be probed, so a
    tree with one large group and a few others costs the few times the whole, in blocks.
    """
    return (_dealt(_mixed(leaves).join(tokens, "id"), F.col("comp") != F.col("major"))
            .mapInArrow(_traverse, "a bigint, b bigint").where("a <> b").distinct())


def leaves_of(reps: DataFrame) -> DataFrame:
    """``key, id, s1, n, w, guest, total, pivot`` of every leaf in every tree that may hold a link, stored.
    ``pivot``: id, s1 and n of the tree's smallest class."""
    postings = reps.select(F.col("doc_id").alias("id"), F.explode("prefix").alias("shingle"))
    roots = stored(postings.groupBy("shingle").agg(F.min("id").alias("root"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows"))
                   .where("root < last"), "roots")
    # a shingle of two rows names its leaves itself; the postings are joined with those of more rows only
    two = roots.where("rows = 2").select(F.explode(F.array("root", "last")).alias("id"), "root")
    more = postings.join(broadcast_if_small(roots.where("rows > 2").select("shingle", "root")), "shingle").select("id", "root")
    own = stored(two.unionByName(more).distinct(), "own-trees")
    sets = reps.select(F.col("doc_id").alias("id"), "s1", "n", "w").distinct()
    in_tree = F.explode(F.array(F.struct(F.col("w").alias("w"), F.lit(False).alias("guest")),
                                F.struct((F.col("w") - 1).alias("w"), F.lit(True).alias("guest")))).alias("t")
    leaves = own.join(sets, "id").select("id", "s1", "n", "root", in_tree).where(F.col("t.w") >= MIN_BITS.bit_length() - 1)
    leaves = stored(leaves.select(F.xxhash64("root", "t.w").alias("key"), "id", "s1", "n", "t.w", "t.guest"), "leaves")
    trees = stored(leaves.groupBy("key").agg(F.count(F.lit(1)).alias("total"),
                                             F.min(F.when(~F.col("guest"), F.struct("id", "s1", "n"))).alias("pivot"))
                   .where("total > 1 AND pivot IS NOT NULL"), "trees")
    return stored(leaves.join(broadcast_if_small(trees), "key"), "leaves")


def near_pivots(leaves: DataFrame) -> DataFrame:
    """The leaves that by their sizes may link with their tree's pivot, and the pivot; as components of their own, stored."""
    sized = enough(F.least("n", "pivot.n"), F.col("n") + F.col("pivot.n"))
    sized = stored(leaves.where(sized).drop("total").withColumn("comp", F.col("id")), "sized")
    total = stored(sized.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where("total > 1"), "totals")
    return sized.join(broadcast_if_small(total), "key").withColumn("minor", F.lit(1))


def possible_partners(leaves: DataFrame, bitmaps: DataFrame, probes) -> DataFrame:
    """``key, id, comp, probe``: leaves that a traversal by bitmaps leaves a possible partner in another component.
    ``leaves`` have their tree's ``total`` and ``minor``, ``bitmaps``: id, s1, bitmap."""
    return _dealt(leaves.join(bitmaps, ["id", "s1"]).drop("s1"), probes).mapInArrow(
        _partners, "key bigint, id bigint, comp bigint, probe boolean")


# ---- exact verification ----

def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, part, anchor first): compares each member's set with its anchor's."""
    word_hash, now, anchors = WordHash(), None, []
    for batch in batches:
        a, b = [], []
        for key_b, part, member, doc, text in zip(
                *(batch.column(c).to_pylist() for c in ("b", "part", "member", "id", "text"))):
            u = shingle_set(text, word_hash)
            if now != (key_b, part):
                now, anchors = (key_b, part), []
            if not member:
                anchors.append(u)
                continue
            for v in anchors:
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                if len(u) and len(v) and enough(int((v[at] == u).sum()), len(u) + len(v)):
                    a.append(doc)
                    b.append(key_b)
                    break
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), stored, whose texts (id, text) link. An anchor ``b`` with many members is dealt to
    several tasks, each with the anchor's text once."""
    sizes = stored(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int").alias("parts")), "anchors")
    members = pairs.join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"),
                                            F.lit(True).alias("member"), F.col("a").alias("id"))
    anchors = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                           F.lit(False).alias("member"), F.col("b").alias("id"))
    return (members.unionByName(anchors).join(texts, "id").repartition("b", "part")
            .sortWithinPartitions("b", "part", "member").mapInArrow(_verify, "a bigint, b bigint"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    sig = stored(rows.mapInArrow(_signatures(rarity(rows)), SIGNATURES), "signatures")
    classes = stored(sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2")
                     .agg(F.min("doc_id").alias("rep")), "classes")
    reps = sig.join(broadcast_if_small(classes.withColumnRenamed("rep", "doc_id")), ["doc_id", "n", "s1", "s2"], "left_semi")
    leaves = leaves_of(reps)
    wanted = stored(leaves.select(F.col("id").alias("doc_id"), "s1").distinct(), "wanted")
    bitmaps = stored(reps.join(broadcast_if_small(wanted), ["doc_id", "s1"], "left_semi")
                     .select(F.col("doc_id").alias("id"), "s1", "bitmap").dropDuplicates(["id", "s1"]), "bitmaps")

    def texts_of(ids: DataFrame) -> DataFrame:
        named = rows.select(F.col("doc_id").alias("id"), "text")
        return stored(named.join(broadcast_if_small(stored(ids.distinct(), "wanted")), "id", "left_semi"), "texts")

    is_pivot = "id = pivot.id AND s1 = pivot.s1 AND NOT guest"
    near = near_pivots(leaves)
    first = possible_partners(near, bitmaps, is_pivot).where("NOT probe").select("key", "id")
    pivots = stored(near.select("key", F.col("pivot.id").alias("b")).distinct(), "pivots")
    first = stored(first.join(broadcast_if_small(pivots), "key").where("id <> b")
                   .select(F.col("id").alias("a"), "b").distinct(), "pairs")
    links = stored(verified(first, texts_of(first.select(F.explode(F.array("a", "b")).alias("id")))), "links")
    groups = components(links)
    others = leaves.where(f"total > 2 AND NOT ({is_pivot})")
    placed = stored(others.join(groups, others["id"] == groups["node"], "left")
                    .select("key", "id", "s1", "n", "w", "guest", F.coalesce("component", "id").alias("comp")), "placed")
    left = stored(possible_partners(_mixed(placed), bitmaps, "comp <> major").select("key", "id", "comp").distinct(), "left")
    texts = texts_of(left.select("id"))
    tokens = stored(texts.mapInArrow(_token_sets, "id bigint, tokens binary"), "tokens")
    second = stored(tree_candidates(left, tokens), "pairs")
    more = stored(verified(second, texts), "links")
    groups = stored(components(links.unionByName(more)), "components")
    named = sig.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    return named.join(groups, named["rep"] == groups["node"], "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: of each group those with the smallest doc_id; all columns.
    Rows with a null doc_id or without words stay."""
    groups = near_duplicates(documents.select("doc_id", "text"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_d")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["_d"], "left_anti")
