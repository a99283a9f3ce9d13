"""Spelling variant grouping by blocked Gram matrices of letter counts.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. By a rule on the document
and the run some occurrences lose one character (``misspelt``). The vocabulary is the distinct
results of at least ``MIN_CHARS`` characters and ``MIN_COUNT`` occurrences in all documents.

1. *Vocabulary.* One pass counts words in each task and a grouped sum adds them up, so a word that
   every document holds is one row a task. All characters of a run are Latin-1, one byte each.
2. *Blocks.* Two words one edit apart differ by at most one in length, and by at most one in the
   number of letters of each class of ``CLASSES``; a cell is a length and these numbers, and a large
   cell is cut into blocks of about ``BLOCK`` words. A block meets itself, the other blocks of its
   cell and those of the cells that one edit leads to; every other pair of blocks is left out
   without loss.
3. *Gram matrices.* For two blocks, the product of their letter-count matrices gives all squared
   distances ``|x|^2 + |y|^2 - 2xy`` at once. An inserted or deleted letter makes 1, a replaced one
   2; pairs with more are dropped where they stand, in slices of bounded size.
4. *Verification* of the pairs left: one mismatch in words of one length, or a common beginning and
   a common end that cover the shorter word.
5. A word's form is its near word of the largest count, if that is at least ``RATIO`` times its own;
   roots follow forms by pointer doubling, a few joins on the vocabulary.

The pairs compared grow with the square of the vocabulary, which is what the method asks for;
the vocabulary grows far slower than the corpus. Memory is bounded by two blocks and a slice.

Null or empty text has no words. A null doc_id reads as the empty string in the rule. Rows that repeat a
doc_id are counted each. Ties of the largest count go to the smallest word by code points. Very long
runs are words of their length. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import broadcast_if_small, stored

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
MISSPELT = 199
BLOCK = 4096  # words in a block, and fewer of long words:
BLOCK_CHARS = 1 << 18
SLICE = 1 << 22  # distances that are held at once
HELD = 400_000  # distinct words that a task holds
#: letters of these classes are counted to form the cells; the rest is the third class
CLASSES = ("aeiouyàáâäèéêëíîïóôöúü", "lnrst")
#: what one edit does to (length, class counts), seen from the block that is listed first
STEPS = [(0, 0, 0), (0, 0, 1), (0, 1, -1), (0, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0)]

#: Latin-1 bytes: letters as they are but A-Z lower-cased, everything else a blank
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: a letter's column in the count matrix
_COLUMN = np.zeros(256, np.int64)
_COLUMN[97:123] = np.arange(26)
_COLUMN[0xC0:] = np.arange(26, 26 + 64)
LETTERS = 26 + 64


def runs(text: bytes, least: int = 1) -> list[bytes]:
    """The words of a UTF-8 text that have at least so many characters, as Latin-1 bytes."""
    if text.isascii():
        found = text.translate(_LETTERS).split()
    else:
        found = text.decode().encode("latin-1", "replace").translate(_LETTERS).split()
    return [w for w in found if len(w) >= least]


class _Utf8(dict):
    """UTF-8 form of Latin-1 words, remembered (bounded)."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > HELD:
            self.clear()
        self[word] = x = word if word.isascii() else word.decode("latin-1").encode()
        return x


def misspelt(doc_id, words: set[bytes], utf8: dict, every: int = MISSPELT) -> Iterator[tuple[bytes, bytes]]:
    """The words of a document that lose a character, with what is left."""
    begin = crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for word in words:
        h = crc32(utf8[word], begin)
        if h % every == 0:
            at = h % len(word)
            yield word, word[:at] + word[at + 1:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    utf8 = _Utf8()

    def out() -> pa.RecordBatch:
        found = pa.record_batch([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                 pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return found

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            words = runs(text, MIN_CHARS)
            held.update(words)
            for word, left in misspelt(doc_id, set(words), utf8):
                n = words.count(word)
                held[word] -= n
                if len(left) >= MIN_CHARS:
                    held[left] += n
            if len(held) > HELD:
                yield out()
    yield out()


def vocabulary(documents: DataFrame) -> DataFrame:
    """``word, n`` of the corpus."""
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return (rows.mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= MIN_COUNT))


# ---- blocks ----

def _cell():
    """Length and class counts of ``word``, as columns."""
    in_class = [F.char_length(F.regexp_replace("word", f"[^{letters}]", "")) for letters in CLASSES]
    return [F.char_length("word").alias("len"), *[c.alias(f"c{k}") for k, c in enumerate(in_class)]]


CELL = ["len", "c0", "c1"]


def block_rows(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``pair, side, word``: every block at every meeting it has, once for each side of it.

    A meeting of a cell's block k with a block j of the cell a step away is named by cell, step, k and j.
    """
    placed = words.select("word", *_cell())
    cells = stored(placed.groupBy(CELL).agg(F.count(F.lit(1)).alias("c")).select(
        *CELL, F.ceil(F.col("c") / F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_CHARS) / F.col("len")))))
        .cast("int").alias("blocks")), "cells")
    placed = placed.join(broadcast_if_small(cells), CELL).withColumn(
        "k", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), *[F.lit(d).alias(f"d{c}") for c, d in zip(CELL, s)])
                               for i, s in enumerate(STEPS)])).alias("s")
    to = cells.select(step, *CELL, "blocks").select(
        "s.step", *[(F.col(c) - F.col(f"s.d{c}")).alias(c) for c in CELL], F.col("blocks").alias("others"))
    meets = stored(cells.join(to, CELL).select(
        *CELL, "step", "others", F.col("blocks").alias("own")), "meetings")  # cell, step, blocks at the other end
    first = placed.join(broadcast_if_small(meets), CELL)
    j = F.explode(F.when(F.col("step") == 0, F.sequence("k", F.col("others") - 1))
                  .otherwise(F.sequence(F.lit(0), F.col("others") - 1))).alias("j")
    one = first.select(*CELL, "step", "k", j, F.lit(0).alias("side"), "word")
    back = meets.select("step", *[(F.col(c) + _delta(i)).alias(c) for i, c in enumerate(CELL)],
                        *[F.col(c).alias(f"from_{c}") for c in CELL], "own")
    second = placed.join(broadcast_if_small(back), CELL)
    k = F.explode(F.when(F.col("step") == 0, F.sequence(F.lit(0), "k")).otherwise(F.sequence(F.lit(0), F.col("own") - 1)))
    two = second.select(*[F.col(f"from_{c}").alias(c) for c in CELL], "step", k.alias("_k"), F.col("k").alias("j"),
                        F.lit(1).alias("side"), "word").withColumnRenamed("_k", "k")
    return one.unionByName(two).select(F.struct(*CELL, "step", "k", "j").alias("pair"), "side", "word")


def _delta(part: int):
    """A step's change of a part of the cell, by the column ``step``."""
    changes = F.array(*[F.lit(s[part]) for s in STEPS])
    return F.element_at(changes, F.col("step") + 1)


# ---- Gram matrices ----

def count_matrix(words: list[bytes]) -> np.ndarray:
    """Letter counts of words of one length."""
    letters = _COLUMN[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), -1)
    at = letters + np.arange(len(words))[:, None] * LETTERS
    counts = np.bincount(at.ravel(), minlength=len(words) * LETTERS).reshape(len(words), LETTERS)
    return counts.astype(np.float32 if letters.shape[1] < 2048 else np.float64)  # sums stay exact


def near_letters(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of ``x`` and ``y`` whose squared distance is at most two, slice by slice."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    step = max(1, SLICE // max(1, len(y)))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        distance = xx[part, None] + yy[None, :] - 2 * (x[part] @ y.T)
        i, j = np.nonzero(distance <= 2)
        yield i + at, j


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words, as rows of bytes, are exactly one edit apart; those of ``y`` may be one longer."""
    n = x.shape[1]
    if n == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    begin = np.logical_and.accumulate(x == y[:, :n], axis=1).sum(axis=1)
    end = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return begin + end >= n


def block_pairs(xs: list[bytes], ys: list[bytes], same: bool) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The words one edit apart of two blocks; ``same``: both sides are one block, each pair is found once."""
    if not xs or not ys:
        return
    a, b = (np.frombuffer(b"".join(w), np.uint8).reshape(len(w), -1) for w in (xs, ys))
    for i, j in near_letters(count_matrix(xs), count_matrix(ys)):
        if same:
            i, j = i[i < j], j[i < j]
        width = max(1, SLICE // a.shape[1])
        for at in range(0, len(i), width):
            p, q = i[at:at + width], j[at:at + width]
            ok = one_edit(a[p], b[q])
            yield [xs[k] for k in p[ok]], [ys[k] for k in q[ok]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (pair, side): the two blocks of each meeting."""
    now, sides = None, ([], [])

    def met() -> Iterator[pa.RecordBatch]:
        if now is not None:
            same = now["step"] == 0 and now["k"] == now["j"]
            # a shuffle brings the sides in any order, and numbers tell a pair's halves apart only in one
            for a, b in block_pairs(sides[0], sides[0] if same else sides[1], same):
                yield pa.record_batch([pa.array([w.decode("latin-1") for w in x], pa.string()) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        for pair, side, word in zip(batch.column("pair").to_pylist(), batch.column("side").to_pylist(), words):
            if pair != now:
                yield from met()
                now, sides = pair, ([], [])
            sides[side].append(word)
    yield from met()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: every two words exactly one edit apart, once."""
    rows = block_rows(words, block)
    return rows.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(_meet, "a string, b string")


# ---- forms ----

def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form (word, form; stored): pointer doubling until nothing moves.
    A form's count is ``RATIO`` times its word's, so paths are short and have no circle."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(broadcast_if_small(ahead), "root", "left")
                    .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(documents: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    words = stored(vocabulary(documents.select("doc_id", "text")), "vocabulary")
    pairs = stored(near_words(words, block), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = broadcast_if_small(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")))
    near = (both.join(counts, "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("order"), F.col("b").alias("form"))).alias("best")))
    near = near.select(F.col("a").alias("word"), "n_near", "best.form", (-F.col("best.order")).alias("form_n"))
    named = words.join(near, "word", "left")
    far = F.col("form_n") >= ratio * F.col("n")
    named = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")), "forms")
    last = broadcast_if_small(roots(named.where("form IS NOT NULL")))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                   "n", "n_near", "form_n")
