"""Toxicity: class-conditional Kneser-Ney models compared by length-normalised likelihood.

Words are modelled byte by byte (up to ``ORDER`` bytes). Each class has its own counts of full
n-grams with absolute discounting; below them both classes share one Kneser-Ney distribution of
the shorter n-grams, whose counts are the numbers of distinct left neighbours in all labelled
training texts. So an expression that a class has rarely or never seen is smoothed alike in
both, and only evidence of the class moves the ratio.

1. All labelled training texts are counted: words by partition, then n-grams by a grouped sum with
   a column for each class and fold. All distinct n-grams make the model.
2. The two models become one table of log-likelihood ratios. A text's ratio is the sum over its
   words, divided by their number, once for all words and once for those whose ratio is decisive. Up
   to ``BROADCAST_NGRAMS`` n-grams the table is sent to the tasks and scoring is a projection over the
   scan. A larger one stays a table: ratios come from grouped sums (:func:`ratio_table`), each distinct
   word is scored once by a join, and texts by a join with the words (:func:`ratios_by_join`). Both ways
   give the same ratios.
3. A logistic curve over the two normalised ratios makes a probability. It is fitted on all
   labelled training texts, each scored by a model that has not seen its fold; the fit sees them
   as a grouped table of the two ratios in steps of ``STEP``.

Null or empty text, or a text without letters, has ratio 0 and gets the curve's value there.
Labels that are null, or of documents that are not there, are not used; without labels of both
classes every score is the share of toxic ones (0 if there are none). Rows that repeat a doc_id are
scored each by its own text. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.byte_ngrams import TAG, WordScores, contexts, ngrams, slices, suffix, weighted_counts, words_of
from tarmac.llm.common import broadcast_if_small, stored

ORDER = 6
DISCOUNT = 0.75
MARGIN = 2.0  # standard errors by which a ratio of counts is shrunk
DECISIVE = 2.5  # a word's ratio, in nats, from which it is evidence by itself
BROADCAST_NGRAMS = 1 << 20  # n-grams up to which the model is sent to the tasks
FREQUENT_WORDS = 50_000  # words whose scores are sent to the tasks when the others are joined
STEP = 0.02
THRESHOLD = 0.3
FOLDS = (0, 1, 3)  # remainders that may be learned from
HELD_OUT = 2


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)).cast("int")


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic, fold`` of the labelled texts that may be learned from."""
    fold = remainder(F.col("doc_id"))
    usable = (labels.select("doc_id", "toxic").where("toxic IN (0, 1)").select("doc_id", "toxic", fold.alias("fold"))
              .where(F.col("fold") != HELD_OUT))
    usable = broadcast_if_small(stored(usable, "labels"))
    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(usable, "doc_id")


_COUNTED = [f"c{f}{c}" for f in FOLDS for c in (0, 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {name: Counter() for name in _COUNTED}

    def out() -> Iterator[pa.RecordBatch]:
        parts = {name: weighted_counts(words, ORDER) for name, words in held.items()}
        keys = np.unique(np.concatenate([k for k, _ in parts.values()]))
        columns = []
        for name, (k, n) in parts.items():
            column = np.zeros(len(keys), np.int64)
            column[np.searchsorted(keys, k)] = n
            columns.append(pa.array(column))
            held[name].clear()
        yield pa.record_batch([pa.array(keys.view(np.int64)), *columns], names=["key", *_COUNTED])

    for batch in batches:
        for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
            held[f"c{fold}{toxic}"].update(words_of(text or b""))
        if sum(map(len, held.values())) > 300_000:
            yield from out()
    if any(held.values()):
        yield from out()


def ngram_counts(training: DataFrame) -> DataFrame:
    """``key`` and a count for each fold and class, over all training texts; stored."""
    kinds = ", ".join(["key bigint", *(f"{c} bigint" for c in _COUNTED)])
    rows = training.select("text", "toxic", "fold").mapInArrow(_count, kinds)
    return stored(rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in _COUNTED]), "ngrams")


def _suffix_of(key: Column, length: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 8 * length) - 1)).bitwiseOR(F.lit(length << 56))


def _context_of(key: Column) -> Column:
    bytes_before = F.shiftright(key.bitwiseAND(F.lit((1 << 56) - 1)), 8)
    return bytes_before.bitwiseOR(F.shiftleft(F.shiftright(key, 56) - 1, 56))


def backoff_table(counts: DataFrame) -> DataFrame:
    """``low, shared``: the shared Kneser-Ney probability of an n-gram's last byte, by the n-gram less its first byte."""
    key, lows = F.col("key"), []
    for m in range(1, ORDER):
        longer = counts.where(F.shiftright(key, 56) > m).select(_suffix_of(key, m + 1).alias("key")).distinct()
        own = stored(longer.groupBy(_suffix_of(key, m).alias("low")).agg(F.count(F.lit(1)).alias("seen")), "continuations")
        if m == 1:
            total = own.agg(F.sum("seen")).first()[0] or 0
            found = own.select("low", ((F.col("seen") + 0.5) / F.lit(total + 128.0)).alias("shared"))
        else:
            context = _context_of(F.col("low"))
            whole = own.groupBy(context.alias("context")).agg(F.sum("seen").alias("whole"), F.count(F.lit(1)).alias("kinds"))
            back = lows[-1].select(F.col("low").alias("lower"), F.col("shared").alias("back"))
            p = (F.greatest(F.col("seen") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("back")) / F.col("whole")
            found = (own.withColumns({"context": context, "lower": _suffix_of(F.col("low"), m - 1)})
                     .join(whole, "context").join(back, "lower").select("low", p.alias("shared")))
        lows.append(stored(found, "backoff"))
    return reduce(DataFrame.unionByName, lows)


def ratio_table(counts: DataFrame) -> DataFrame:
    """``key`` and its ratios as :class:`Ratio` has them, from all training texts (``v``) and without each fold
    (``v0``, ``v1``, ``v3``); stored."""
    models = {"v": None, **{f"v{f}": f for f in FOLDS}}
    summed = {f"{m}_{c}": sum((F.col(f"c{f}{c}") for f in FOLDS if f != but), F.lit(0)) for m, but in models.items() for c in (0, 1)}
    rows = counts.select("key", *[e.alias(n) for n, e in summed.items()])
    context = _context_of(F.col("key"))
    places = rows.groupBy(context.alias("context")).agg(
        *[F.sum(n).alias(f"whole_{n}") for n in summed], *[F.sum((F.col(n) > 0).cast("long")).alias(f"kinds_{n}") for n in summed])
    low = reduce(lambda e, m: F.when(F.shiftright(F.col("key"), 56) == m + 1, _suffix_of(F.col("key"), m)).otherwise(e),
                 range(1, ORDER), F.lit(None).cast("bigint"))
    met = rows.withColumns({"context": context, "low": low}).join(places, "context").join(backoff_table(counts), "low")

    def log_likelihood(n: str) -> Column:
        whole = F.col(f"whole_{n}")
        own = F.when(whole > 0, F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / whole).otherwise(0.0)
        return F.log(own + F.when(whole > 0, DISCOUNT * F.col(f"kinds_{n}") / whole).otherwise(1.0) * F.col("shared"))

    def ratio(m: str) -> Column:
        value = log_likelihood(f"{m}_1") - log_likelihood(f"{m}_0")
        margin = MARGIN * F.sqrt(1 / (F.col(f"{m}_0") + 1) + 1 / (F.col(f"{m}_1") + 1))
        return (F.signum(value) * F.greatest(F.abs(value) - margin, F.lit(0.0))).cast("float")

    return stored(met.select("key", *[ratio(m).alias(m) for m in models]), "ratios")


def _text_key() -> Column:
    return F.sha2(F.coalesce("text", F.lit(b"")), 256)


def ratios_by_join(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """``text_key`` and the two ratios (``<model>_ratio``, ``<model>_decisive``) of every distinct text in a column
    ``text`` of bytes, under each model of :func:`ratio_table`; stored.

    Words are counted by text and scored once: their n-grams meet the ratios in a join. The scores of the
    most frequent words are sent to the tasks, so the join that the other words go through has no hot key.
    """
    models = [c for c in ratios.columns if c != "key"]

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist()):
                words = Counter(words_of(text))
                for part in slices(list(words.items()), 50_000):
                    yield pa.record_batch([pa.array([key] * len(part), pa.string()), pa.array([w for w, _ in part], pa.binary()),
                                           pa.array([n for _, n in part], pa.int64())], names=["text_key", "word", "f"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("word").to_pylist(), 5_000):
                keys, number = ngrams(words, ORDER)
                yield pa.record_batch([pa.array([words[k] for k in number], pa.binary()), pa.array(keys.view(np.int64))], names=["word", "key"])

    keyed = texts.select(_text_key().alias("text_key"), F.coalesce("text", F.lit(b"")).alias("text"))
    every = stored(keyed.select("text_key").distinct(), "text-keys")
    words = stored(keyed.dropDuplicates(["text_key"]).mapInArrow(count_words, "text_key string, word binary, f bigint"), "text-words")
    known = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("texts")), "words")
    scores = stored(known.select("word").mapInArrow(spell, "word binary, key bigint").join(ratios, "key")
                    .groupBy("word").agg(*[F.sum(F.col(m).cast("double")).alias(m) for m in models])
                    .join(known, "word"), "word-scores")
    frequent = stored(scores.orderBy(F.desc("texts"), "word").limit(FREQUENT_WORDS).select("word", *[F.col(m).alias(f"_{m}") for m in models]), "frequent")
    seen = words.join(F.broadcast(frequent), "word", "left")  # FREQUENT_WORDS rows at most
    in_place = seen.where(F.col(f"_{models[0]}").isNotNull()).select("text_key", "f", *[F.col(f"_{m}").alias(m) for m in models])
    others = (seen.where(F.col(f"_{models[0]}").isNull()).select("text_key", "word", "f").join(scores.drop("texts"), "word", "left")
              .select("text_key", "f", *models))
    sums = [F.sum("f").alias("n")]
    for m in models:
        value = F.coalesce(F.col(m), F.lit(0.0))
        sums += [F.sum(value * F.col("f")).alias(f"{m}_all"), F.sum(F.when(value >= DECISIVE, value * F.col("f")).otherwise(0.0)).alias(f"{m}_high")]
    added = every.join(in_place.unionByName(others).groupBy("text_key").agg(*sums), "text_key", "left").na.fill(0)
    return stored(added.select("text_key", *[e for m in models for e in (
        (F.col(f"{m}_all") / F.greatest("n", F.lit(1))).alias(f"{m}_ratio"),
        F.log(F.col(f"{m}_high") / (F.col("n") + 20) + 0.01).alias(f"{m}_decisive"))]), "text-ratios")


def _group_sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=values, minlength=len(found))


def shared_backoff(keys: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each n-gram's last byte after its context less one byte, from the
    distinct n-grams of both classes."""
    length = keys >> TAG
    prob = np.zeros(len(keys))
    low_keys = low_prob = None
    for m in range(1, ORDER):
        longer = np.unique(suffix(keys[length > m], m + 1))
        own, seen = _group_sum(suffix(longer, m), np.ones(len(longer)))
        if m == 1:
            p = (seen + 0.5) / (seen.sum() + 128)
        else:
            ctx, at = np.unique(contexts(own), return_inverse=True)
            whole, kinds = np.bincount(at, weights=seen), np.bincount(at)
            back = low_prob[np.searchsorted(low_keys, suffix(own, m - 1))]
            p = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * kinds[at] * back) / whole[at]
        here = length == m + 1
        prob[here] = p[np.searchsorted(own, suffix(keys[here], m))]
        low_keys, low_prob = own, p
    return prob


class Ratio:
    """Log-likelihood ratio (toxic over ordinary) of n-grams, brought nearer to 0 by ``MARGIN`` standard
    errors of its counts. An n-gram that no class has goes to the shared distribution in both: 0."""

    def __init__(self, keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray):
        order = np.argsort(keys)
        keys, counts = keys[order], (ordinary[order].astype(float), toxic[order].astype(float))
        shared = shared_backoff(keys) if len(keys) else np.zeros(0)
        places, at = np.unique(contexts(keys), return_inverse=True)
        logs = []
        for c in counts:
            whole = np.bincount(at, weights=c, minlength=len(places))
            kinds = np.bincount(at, weights=c > 0, minlength=len(places))
            back = np.where(whole > 0, DISCOUNT * kinds / np.maximum(whole, 1), 1.0)
            logs.append(np.log(np.where(whole[at] > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(whole[at], 1), 0)
                               + back[at] * shared))
        value = logs[1] - logs[0]
        margin = MARGIN * np.sqrt(1 / (counts[0] + 1) + 1 / (counts[1] + 1))
        self.keys = keys
        self.values = (np.sign(value) * np.maximum(np.abs(value) - margin, 0)).astype(np.float32)

    def of_ngrams(self, found: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(found))
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return np.where(self.keys[at] == found, self.values[at], 0.0)

    def of_words(self, words: list[bytes]) -> list[float]:
        keys, number = ngrams(words, ORDER)
        return np.bincount(number, weights=self.of_ngrams(keys), minlength=len(words)).tolist()


FEATURES = ("ratio", "decisive")


def text_ratios(ratio: Ratio, scores: WordScores, texts: list[bytes]) -> list[tuple[float, float]]:
    """Of each text, the log-likelihood ratio by word, and the same of its decisive words alone: the
    first also drifts with the language that a text is in, the second does not."""
    counted = [Counter(words_of(t or b"")) for t in texts]
    scores.learn(set().union(*counted))
    out = []
    for words in counted:
        n = sum(words.values())
        values = [(scores[w], f) for w, f in words.items()]
        out.append((sum(v * f for v, f in values) / max(n, 1),
                    float(np.log(sum(v * f for v, f in values if v >= DECISIVE) / (n + 20) + 0.01))))
    return out


def fit_curve(x: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Slopes and intercept of a logistic curve over points that stand for ``n`` texts, ``toxic`` of them
    toxic, by Newton steps with a small ridge."""
    if n.sum() == 0 or toxic.sum() in (0, n.sum()):
        share = float(toxic.sum() / n.sum()) if n.sum() else 0.0
        return [0.0] * x.shape[1] + [float(np.log((share + 1e-9) / (1 - share + 1e-9)))]
    scale = np.sqrt(np.cov(x, rowvar=False, fweights=n, ddof=0).diagonal())
    scale = np.where(scale > 0, scale, 1.0)
    design = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-1 * np.eye(len(w))
        step = np.linalg.solve(hessian, design.T @ (n * p - toxic) + 1e-1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [*(w[:-1] / scale).tolist(), float(w[-1])]


def _columns(found: list[tuple[float, float]]) -> list[pa.Array]:
    return [pa.array([x[k] for x in found], pa.float64()) for k in range(len(FEATURES))]


def _broadcast_ratios(rows: DataFrame, training: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, ratio, decisive`` of all rows and ``ratio, decisive, y`` of the training texts, each of these
    scored without its fold, with the model in every task."""
    spark = rows.sparkSession
    table = counts.toArrow()  # at most BROADCAST_NGRAMS rows
    keys = table["key"].to_numpy().view(np.uint64)
    counts = {c: table[c].to_numpy() for c in _COUNTED}
    summed = lambda c, but=None: sum(counts[f"c{f}{c}"] for f in FOLDS if f != but)
    final = spark.sparkContext.broadcast(Ratio(keys, summed(0), summed(1)))
    unseen = spark.sparkContext.broadcast({f: Ratio(keys, summed(0, f), summed(1, f)) for f in FOLDS})

    def by_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {f: (r, WordScores(r.of_words, 100_000)) for f, r in unseen.value.items()}
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))))
            x, y = [], []
            for f, (ratio, scores) in models.items():
                own = [r for r in rows if r[2] == f]
                for part in slices(own, 500):
                    x += text_ratios(ratio, scores, [r[0] for r in part])
                    y += [r[1] for r in part]
            yield pa.record_batch([*_columns(x), pa.array(y, pa.int32())], names=[*FEATURES, "y"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = final.value
        scores = WordScores(ratio.of_words)
        for batch in batches:
            found = [x for part in slices(batch.column("text").to_pylist(), 500) for x in text_ratios(ratio, scores, part)]
            yield pa.record_batch([batch.column("doc_id"), *_columns(found)], names=["doc_id", *FEATURES])

    return (rows.mapInArrow(score, "doc_id bigint, ratio double, decisive double"),
            training.select("text", "toxic", "fold").mapInArrow(by_fold, "ratio double, decisive double, y int"))


def _joined_ratios(rows: DataFrame, training: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same two tables as :func:`_broadcast_ratios`, without a model on the driver or in a task."""
    found = ratios_by_join(rows.select("text"), ratio_table(counts))
    own = lambda c: reduce(lambda e, f: F.when(F.col("fold") == f, F.col(f"v{f}_{c}")).otherwise(e),
                           FOLDS, F.lit(None).cast("double")).alias(c)
    scored = rows.select("doc_id", _text_key().alias("text_key")).join(found, "text_key")
    points = training.select("fold", F.col("toxic").cast("int").alias("y"), _text_key().alias("text_key")).join(found, "text_key")
    return (scored.select("doc_id", *[F.col(f"v_{c}").alias(c) for c in FEATURES]), points.select(*map(own, FEATURES), "y"))


def score_documents(documents: DataFrame, labels: DataFrame, most: int = BROADCAST_NGRAMS) -> DataFrame:
    """``doc_id, held_out, score, predicted, ratio`` of every row. A model of more than ``most`` n-grams stays a table."""
    training = training_rows(documents, labels)
    counts = ngram_counts(training)
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    ratios = _broadcast_ratios if counts.limit(most + 1).count() <= most else _joined_ratios
    scored, points = ratios(rows, training, counts)
    steps = [F.round(F.greatest(F.least(F.col(c), F.lit(20.0)), F.lit(-20.0)) / STEP).cast("int").alias(c) for c in FEATURES]
    # one row a cell of steps: 2 001 x 2 001 at most
    table = points.select(*steps, "y").groupBy(*FEATURES).agg(F.count("y").alias("n"), F.sum("y").alias("toxic")).toArrow()
    *slopes, intercept = fit_curve(np.column_stack([table[c].to_numpy() * STEP for c in FEATURES]),
                                   table["n"].to_numpy(), table["toxic"].to_numpy())
    curve = 1 / (1 + F.exp(-sum((F.lit(a) * F.col(c) for a, c in zip(slopes, FEATURES)), F.lit(intercept))))
    scored = scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        curve.alias("score"), "ratio")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "ratio")
