"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes (a blank and the text): byte-level BPE (A) and SentencePiece BPE with
byte fallback (B). Offsets where tokens of both end are shared cuts; between two neighbouring
shared cuts lies a group. Two tokens of a group are linked when their byte ranges overlap.

1. *Division.* Before a blank or a line end that follows no white space, and between a letter and one of
   the signs ``SIGNS``, neither tokenizer's token goes on: A's pattern takes no blank into a token but at
   its beginning and parts letters from signs, and B's vocabulary, which is checked, has no piece with
   a blank or line end behind another character or a sign behind a letter. These shared cuts are
   known before encoding and divide a text into units. Equal units have equal alignments, so a task
   remembers them (two bounded generations; what is met again stays).
2. *Conquest.* Within a unit a common end is looked for by bisecting B's ends for A's ends, from the
   middle of the interval outwards; both halves follow, until an interval has no cut: a group.
3. *Corpus counts.* Each document's links are kept as (pair of ids, frequency); one grouped sum counts pairs
   over all documents, and the largest count of each B id is joined to them.
4. *Scores.* The ``HEAD`` most frequent pairs, a fixed number, travel to the tasks with their counts and
   are summed in place; all other (document, pair, frequency) rows join the table of pairs. So the
   pairs that would be hot in a join never enter one.

Null and empty texts have no tokens. Neither have texts whose tokens' bytes are not the text's, such as
those that hold U+2581, which B takes for a blank. Special strings inside texts are plain text. Rows that
repeat a doc_id are aligned each, and count each. Ties of the largest count are all best. Very long
texts are aligned whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
BLANK = "▁"
MEMORY = 300_000  # units in a generation that a task remembers
BATCH = 512  # texts in an output batch
HEAD = 1 << 17
SHIFT = 32  # a pair of ids as a number: A's above, B's below

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SIGNS = '.,;:!?)("|'
#: units: white space and a word before a sign, blank or line end; or whatever stands up to the next
#: blank or line end behind other characters
UNITS = re.compile(rf"\s+[{LETTERS}]+(?=[{SIGNS} \n]|\Z)|(?:\s+\S*|\S+)(?:[^\S \n]\s*\S*)*")


def path_of(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# ---- alignment of two lists of ends ----

def shared_cut(a: list[int], b: list[int], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> tuple[int, int] | None:
    """Positions in ``a`` and ``b`` of a common end strictly inside the interval, near its middle."""
    middle, last_b = (lo_a + hi_a - 1) // 2, hi_b - 1
    for i in chain(range(middle, hi_a - 1), range(middle - 1, lo_a - 1, -1)) if hi_a - lo_a < 8 else _outwards(middle, lo_a, hi_a - 1):
        j = bisect_left(b, a[i], lo_b, last_b)
        if j < last_b and b[j] == a[i]:
            return i, j
    return None


def _outwards(middle: int, low: int, end: int) -> Iterator[int]:
    """The numbers from ``low`` up to ``end``, nearest to the middle first."""
    for distance in range(end - low):
        if middle + distance < end:
            yield middle + distance
        if distance and middle - distance >= low:
            yield middle - distance


def groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Token ranges (from and to in ``a``, from and to in ``b``) between neighbouring shared cuts, in order.
    ``a`` and ``b`` are the tokens' rising ends, and end together."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        cut = shared_cut(a, b, lo_a, hi_a, lo_b, hi_b) if hi_a - lo_a > 1 and hi_b - lo_b > 1 else None
        if cut is None:
            found.append((lo_a, hi_a, lo_b, hi_b))
        else:
            i, j = cut
            todo += [(i + 1, hi_a, j + 1, hi_b), (lo_a, i + 1, lo_b, j + 1)]
    return found


def overlaps(a: list[int], b: list[int], group: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Positions of the tokens of a group whose ranges overlap."""
    i, hi_a, j, hi_b = group
    if hi_a - i == 1 or hi_b - j == 1:
        return [(x, y) for x in range(i, hi_a) for y in range(j, hi_b)]
    found = []
    while i < hi_a and j < hi_b:
        found.append((i, j))
        end_a, end_b = a[i], b[j]
        i += end_a <= end_b
        j += end_b <= end_a
    return found


# ---- the tokenizers ----

def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable signs: those of Latin-1 as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, with the bytes of each entry."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        sign = _byte_of_sign()
        entries = self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(sign[c] for c in entry) if all(c in sign for c in entry) else entry.encode()
        sp = self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode()
                        for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))]
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        if any(re.search(f"[^{BLANK}]{BLANK}|.\n|\n.|[{LETTERS}][{SIGNS}]", p) for p in pieces):
            raise ValueError("a piece goes on over the beginning of a word, a line end, or a sign")

        ranks = self._ranks()
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken
            self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ranks(self) -> dict[bytes, int] | None:
        """A's entries as ranks, where its file is plain byte-level BPE whose merges are in the order of
        their ids: then the encoder for ranks gives the same ids at a third of the time."""
        file = json.loads(self.a.to_str())
        model, before = file["model"], file["pre_tokenizer"] or {}
        if (model["type"], before.get("type"), before.get("use_regex"), file["normalizer"]) != ("BPE", "ByteLevel", True, None):
            return None
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if before.get("add_prefix_space") or any(model["vocab"][m] != 256 + k for k, m in enumerate(merges)):
            return None
        added = {x["id"] for x in file["added_tokens"]}
        return {self.bytes_a[i]: i for i in model["vocab"].values() if i not in added}

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick:
            return list(map(self.quick.encode_ordinary, texts))
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [x.ids for x in encode(texts, add_special_tokens=False)]

    def encode_b(self, unit: str) -> list[int]:
        """Ids of a unit as it stands. B adds a blank before a text, which is the unit's first; a line end put
        before other units keeps them apart from it, and both go again."""
        if unit[0] == " " and len(unit) > 1:
            return self.b.encode(unit[1:])
        return self.b.encode("\n" + unit)[2:]


class Aligned:
    """Alignments by unit: (A ids, B ids, groups, written groups, linked pairs), or None where bytes differ."""

    def __init__(self, tokenizers: Tokenizers, most: int = MEMORY):
        self.tokenizers, self.most = tokenizers, most
        self.now: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}
        self.links: dict[int, int] = {}
        self.text_a = list(map(str, range(len(tokenizers.bytes_a))))
        self.text_b = list(map(str, range(len(tokenizers.bytes_b))))

    def of(self, units: list[str]) -> list[tuple | None]:
        """The units' alignments; those that are not known are made."""
        if len(self.now) > self.most:
            self.now, self.before, self.links = {}, self.now, {}
        now, before = self.now, self.before
        missing = [u for u in set(units) if u not in now]
        new = []
        for u in missing:
            if u in before:
                now[u] = before[u]
            else:
                new.append(u)
        if new:
            for unit, ids in zip(new, self.tokenizers.encode_a(new)):
                now[unit] = self._align(unit, ids, self.tokenizers.encode_b(unit))
        return list(map(now.__getitem__, units))

    def _align(self, unit: str, ids_a: list[int], ids_b: list[int]) -> tuple | None:
        a, b = list(map(self.tokenizers.bytes_a.__getitem__, ids_a)), list(map(self.tokenizers.bytes_b.__getitem__, ids_b))
        data = unit.encode()
        if b"".join(a) != data or b"".join(b) != data:
            return None
        ends_a, ends_b = list(accumulate(map(len, a))), list(accumulate(map(len, b)))
        found = groups(ends_a, ends_b)
        text_a, text_b = list(map(self.text_a.__getitem__, ids_a)), list(map(self.text_b.__getitem__, ids_b))
        text = ";".join([",".join(text_a[g[0]:g[1]]) + "|" + ",".join(text_b[g[2]:g[3]]) for g in found])
        same = self.links  # one object for each pair, as most units share theirs with others
        links = [same.setdefault(x := ids_a[i] << SHIFT | ids_b[j], x) for g in found for i, j in overlaps(ends_a, ends_b, g)]
        return len(ids_a), len(ids_b), len(found), text, links


_loaded: dict[tuple[str, str], Tokenizers] = {}


def load(path_a: str, path_b: str) -> Tokenizers:
    """The tokenizers, once for each Python worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


# ---- documents ----

ALIGNED = ("doc_id bigint, text_hash bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups_sha256 string, pairs array<bigint>, freqs array<int>")
_NAMES = ["doc_id", "text_hash", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "freqs"]
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def units_of(text: str) -> list[str]:
    """The units of a text with the blank before it; none of a text that has the sign B takes for a blank."""
    return UNITS.findall(" " + text) if text and BLANK not in text else []


def aligned_documents(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every row's counts, its groups' digest and its linked pairs with their frequencies, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligned(load(path_a, path_b))

        def of(text: str | None) -> tuple:
            parts = known.of(units_of(text or ""))
            if not parts or None in parts:
                return 0, 0, 0, 0, "", [], []
            n_a, n_b, n_groups, written, linked = zip(*parts)
            links = Counter(chain.from_iterable(linked))
            digest = hashlib.sha256(";".join(written).encode()).hexdigest()
            return sum(n_a), sum(n_b), sum(n_groups), links.total(), digest, list(links), list(links.values())

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = list(map(of, part.column("text").to_pylist()))
                yield pa.record_batch([part.column("doc_id"), part.column("text_hash"),
                                       *[pa.array(c, k) for c, k in zip(zip(*rows), _KINDS[2:])]], names=_NAMES)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return stored(rows.mapInArrow(run, ALIGNED), "alignments")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, links, best``: how many links hold a pair of ids, and whether no other pair of its B id has more; stored."""
    pairs = rows.select(F.explode(F.arrays_zip("pairs", "freqs")).alias("x")).select(
        F.col("x.pairs").alias("pair"), F.col("x.freqs").cast("bigint").alias("f"))
    counted = stored(pairs.groupBy("pair").agg(F.sum("f").alias("links")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counted.groupBy(b_id.alias("b")).agg(F.max("links").alias("most"))  # one row an entry of B's vocabulary
    return stored(counted.join(most, b_id == most["b"]).select(
        "pair", "links", (F.col("links") == F.col("most")).alias("best")), "pairs")


def most_frequent(pairs: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts and best flags at or over a count that at most ``head`` pairs reach, in order of the pair."""
    step = F.floor(F.log2(F.col("links")) * 8)
    levels = pairs.groupBy(step.alias("level")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("level")).collect()
    taken, cut = 0, None
    for level, c in levels:  # a few hundred at most
        if taken + c > head:
            break
        taken, cut = taken + c, level
    rows = [] if cut is None else pairs.where(step >= cut).collect()
    table = np.array(sorted((r.pair, r.links, r.best) for r in rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


SPREAD = ("doc_id bigint, text_hash bigint, pair bigint, f bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
          "groups_sha256 string, n_best bigint, count_sum bigint")


def align(documents: DataFrame, path_a: str | None = None, path_b: str | None = None, head: int = HEAD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    documents = documents.select("doc_id", "text")
    rows = aligned_documents(documents, path_a or path_of(TOKENIZER_A), path_b or path_of(TOKENIZER_B))
    pairs = pair_counts(rows)
    known = documents.sparkSession.sparkContext.broadcast(most_frequent(pairs, head))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (sums over its frequent pairs) and for each other pair of it."""
        table, counts, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            pair = lists.flatten().to_numpy()
            f = batch.column("freqs").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(table, pair), max(0, len(table) - 1))
            there = table[at] == pair if len(table) else np.zeros(len(pair), bool)
            hit, own = at[there], owner[there]
            total, n_best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if len(table):
                np.add.at(total, own, f[there] * counts[hit])
                np.add.at(n_best, own, f[there] * best[hit])
            rest = pa.array(owner[~there])
            n = len(rest)
            empty = lambda kind, k: pa.nulls(k, kind)
            both = lambda name: pa.chunked_array([batch.column(name), empty(batch.column(name).type, n)]).combine_chunks()
            keyed = lambda name: pa.chunked_array([batch.column(name), batch.column(name).take(rest)]).combine_chunks()
            joined = lambda x, y: pa.chunked_array([x, y]).combine_chunks()
            yield pa.record_batch(
                [keyed("doc_id"), keyed("text_hash"), joined(empty(pa.int64(), batch.num_rows), pa.array(pair[~there])),
                 joined(empty(pa.int64(), batch.num_rows), pa.array(f[~there])),
                 *[both(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")],
                 joined(pa.array(n_best), empty(pa.int64(), n)), joined(pa.array(total), empty(pa.int64(), n))],
                names=[c.split()[0] for c in SPREAD.split(", ")])

    spread_rows = rows.mapInArrow(spread, SPREAD)
    own = spread_rows.where("pair IS NULL")
    rare = spread_rows.where("pair IS NOT NULL").join(pairs, "pair").select(
        "doc_id", "text_hash", *[F.lit(None).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
        F.lit(None).cast("string").alias("groups_sha256"), (F.col("f") * F.col("best").cast("bigint")).alias("n_best"),
        (F.col("f") * F.col("links")).alias("count_sum"))
    both = own.drop("pair", "f").unionByName(rare)
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    # rows of one doc_id and text are equal: their sums are divided by their number
    sums = both.groupBy("doc_id", "text_hash").agg(
        *[F.max(c).alias(c) for c in counts], F.max("groups_sha256").alias("groups_sha256"), F.sum("n_best").alias("b"),
        F.sum("count_sum").alias("s"), F.count("n_a").alias("rows"))
    each = sums.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("_row"))
    return each.select("doc_id", *counts, F.expr("b div rows").alias("n_best"), F.expr("s div rows").alias("count_sum"),
                       "groups_sha256")
