"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the languages that labelled texts have:

* *text*: likelihood of the page's visible words under byte-trigram models of the languages,
  counted over all labelled documents; its logarithm is divided by the square root of the number
  of words, as neighbouring words are far from independent;
* *markup*: the language that the page's ``<html lang>`` declares, by how often pages whose text
  is in a language declare it;
* *address*: the two-letter first segment of the path, else the top-level domain, likewise;
* *host*: a prior from the other pages of the host, smoothed towards its registered domain
  (``HOST_WEIGHT`` pages' worth), and that towards all pages.

The last three are learned from the pages by grouped aggregation over the text's best guess: tables
of (value, language) counts, combined before the shuffle, so a host with a third of the pages is
a few rows per map task. Host counts go back to the pages in a join on the host, whose hot
partitions the adaptive planner splits; codes of at most three letters bound the other tables.

Null or empty html or url: that evidence is absent; a page with none at all gets the most common
language. Without labelled documents every language is null. Rows that repeat a page_id are
judged each by its own content and vote each. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.byte_ngrams import WordScores, contexts, ngrams, weighted_counts, words_of
from tarmac.llm.common import stored
from tarmac.llm.url_filter import split_url

ORDER = 3
ALPHA = 0.1
HOST_WEIGHT = 5.0
CODE_WEIGHT = 5.0
WORD_CELLS = 2_000_000  # words times languages whose scores a task remembers

_HIDDEN = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(rb"<[^>]*>")


def visible_words(html: bytes) -> list[bytes]:
    text = _TAG.sub(b" ", _HIDDEN.sub(b" ", html))
    return words_of(html_lib.unescape(text.decode("utf-8", "replace")).encode() if b"&" in text else text)


def language_counts(documents: DataFrame) -> DataFrame:
    """``lang, key, n``: byte trigrams of every labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                keys, n = weighted_counts(words, ORDER)
                yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                                      names=["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > 300_000:
                yield from out()
        yield from out()

    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class _Sparse:
    """Rows of (column, value) pairs, added into rows of a dense array."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int):
        order = np.argsort(rows, kind="stable")
        self.columns, self.values = columns[order].astype(np.int32), values[order].astype(np.float32)
        self.begin = np.searchsorted(rows[order], np.arange(size + 1))

    def add(self, out: np.ndarray, targets: np.ndarray, rows: np.ndarray) -> None:
        n = self.begin[rows + 1] - self.begin[rows]
        at = np.repeat(self.begin[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, int)
        np.add.at(out, (np.repeat(targets, n), self.columns[at]), self.values[at])


class TrigramModel:
    """Log-likelihoods of words under each language, for any number of languages.

    Only the trigrams and contexts that a language has are held: all others have the same likelihood in it, that of
    an unseen trigram. So the size is that of the table of counts, some thousand trigrams a language.
    """

    def __init__(self, table: pa.Table):
        self.langs = sorted(set(table["lang"].to_pylist()))
        key, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(float)
        lang = np.searchsorted(self.langs, table["lang"].to_pylist()) if self.langs else np.empty(0, int)
        self.keys, at = np.unique(key, return_inverse=True)
        places, self.place = np.unique(contexts(self.keys), return_inverse=True)
        self.unseen = np.float32(-np.log(64))
        self.own = _Sparse(at, lang, np.log((n + ALPHA) / ALPHA), len(self.keys))
        width = max(len(self.langs), 1)
        cell, of = np.unique(self.place[at] * width + lang, return_inverse=True)  # contexts of a language
        whole = np.bincount(of, weights=n, minlength=len(cell))
        self.context = _Sparse(cell // width, cell % width, np.log(ALPHA * 64 / (whole + ALPHA * 64)), len(places))

    def of_words(self, words: list[bytes]) -> list[np.ndarray]:
        keys, number = ngrams(words, ORDER)
        found = np.zeros((len(words), len(self.langs)), np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys  # a trigram that no language has says nothing
            found += (np.bincount(number[known], minlength=len(words)) * self.unseen).astype(np.float32)[:, None]
            self.own.add(found, number[known], at[known])
            self.context.add(found, number[known], self.place[at[known]])
        return list(found)


FEATURES = "page_id bigint, host string, domain string, declared string, suffix string, loglik array<float>, guess int"


def page_features(pages: DataFrame, model: TrigramModel) -> DataFrame:
    """Evidence of each page by itself; stored."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = WordScores(m.of_words, max(1_000, min(200_000, WORD_CELLS // max(len(m.langs), 1))))
        for batch in batches:
            logs, guesses = [], []
            for html in batch.column("html").to_pylist():
                words = Counter(visible_words(html or b""))
                scores.learn(set(words))
                n = sum(words.values())
                total = sum((f * scores[w] for w, f in words.items()), np.zeros(len(m.langs))) / max(n, 1) ** 0.5
                logs.append(total.tolist())
                guesses.append(int(np.argmax(total)) if n and len(total) else None)
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "domain", "declared", "suffix")),
                                   pa.array(logs, pa.list_(pa.float32())), pa.array(guesses, pa.int32())],
                                  names=["page_id", "host", "domain", "declared", "suffix", "loglik", "guess"])

    host, path = split_url(F.col("url"))
    code = lambda c: F.when(c.rlike("^[a-z]{2,3}$"), c)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rows = parts.select(
        "page_id", "host", F.substring_index("host", ".", -2).alias("domain"),
        code(F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))).alias("declared"),
        F.coalesce(code(F.regexp_extract("path", "^/([a-z]{2})(/|$)", 1)),
                   code(F.substring_index("host", ".", -1))).alias("suffix"),
        F.col("html").cast("binary").alias("html"))
    return stored(rows.mapInArrow(run, FEATURES), "page-features")


def _counts(features: DataFrame, by: str) -> DataFrame:
    """``by`` and its pages by guessed language, as an array of (language, number): those that it has."""
    known = features.where(F.col("guess").isNotNull() & F.col(by).isNotNull())
    counts = known.groupBy(by, "guess").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.groupBy(by).agg(F.collect_list(F.struct("guess", "n")).alias(f"{by}_counts"))


def _dense(entries: list | None, size: int) -> np.ndarray:
    out = np.zeros(size)
    for e in entries or ():
        out[e["guess"]] = e["n"]
    return out


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``page_id, host, declared, suffix, text_lang, lang, confidence`` of every row."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    model = TrigramModel(language_counts(documents.select("text", "lang")).toArrow())
    langs = model.langs
    features = page_features(pages, model)
    if not langs:
        none = F.lit(None).cast("string")
        return features.select("page_id", "host", "declared", "suffix", none.alias("text_lang"), none.alias("lang"),
                               F.lit(None).cast("double").alias("confidence"))
    codes = {by: {r[0]: _dense(r[1], len(langs)) for r in _counts(features, by).collect()}
             for by in ("declared", "suffix")}  # codes of two or three letters: bounded
    total = features.where("guess IS NOT NULL").groupBy("guess").count().collect()  # a row for each language
    every = np.zeros(len(langs))
    for guess, n in total:
        every[guess] = n
    hosts = stored(_counts(features, "host"), "host-counts")
    domains = _counts(features, "domain").withColumnRenamed("domain", "d")
    hosts = stored(hosts.join(domains, F.substring_index(hosts["host"], ".", -2) == domains["d"], "left")
                   .select(hosts["host"].alias("h"), "host_counts", "domain_counts"), "host-priors")
    known = spark.sparkContext.broadcast((langs, codes, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, codes, every = known.value
        base = (every + 1) / (every + 1).sum()
        zeros = np.zeros(len(langs))

        def given(table: dict, code: str | None) -> np.ndarray:
            """Log-probability that a page in each language shows the code."""
            if code is None or code not in table:
                return zeros
            n = table[code]
            return np.log((n + CODE_WEIGHT * n.sum() / max(every.sum(), 1) + 1e-9) / (every + CODE_WEIGHT))

        for batch in batches:
            text_lang, best, sure = [], [], []
            for declared, suffix, loglik, guess, host, domain in zip(*(batch.column(c).to_pylist() for c in (
                    "declared", "suffix", "loglik", "guess", "host_counts", "domain_counts"))):
                own = np.eye(len(langs))[guess] if guess is not None else zeros  # a page is no evidence of itself
                domain, host = (np.maximum(_dense(x, len(langs)) - own, 0) for x in (domain, host))
                prior = (domain + HOST_WEIGHT * base) / (domain.sum() + HOST_WEIGHT)
                prior = (host + HOST_WEIGHT * prior) / (host.sum() + HOST_WEIGHT)
                log = np.array(loglik) + np.log(prior) + given(codes["declared"], declared) + given(codes["suffix"], suffix)
                p = np.exp(log - log.max())
                p /= p.sum()
                k = int(np.argmax(p))
                text_lang.append(langs[guess] if guess is not None else None)
                best.append(langs[k])
                sure.append(round(float(p[k]), 6))
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "declared", "suffix")),
                                   pa.array(text_lang, pa.string()), pa.array(best, pa.string()), pa.array(sure, pa.float64())],
                                  names=["page_id", "host", "declared", "suffix", "text_lang", "lang", "confidence"])

    return features.join(hosts, features["host"] == hosts["h"], "left").drop("h").mapInArrow(
        run, "page_id bigint, host string, declared string, suffix string, text_lang string, lang string, confidence double")
