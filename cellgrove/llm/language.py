"""Language identification as inference of a mixture: every document's language proportions by expectation-maximisation.

The likelihood of a word in a language is the product of its letter trigrams' (word ends marked, case folded),
smoothed, from a hashed table of trigram counts by language. A document's words are drawn from a mixture of
languages; its proportions come from expectation-maximisation over the words, until none moves by more than ``SETTLED``. The set of
languages comes from a penalised likelihood, the log-likelihood less half the logarithm of the words for each language beyond the
first: of the nested sets of the most present 1, 2, 3, ... languages, it is grown for as long as that rises.

The classifier is fitted on a bounded sample of labelled rows, at most about ``SAMPLE`` documents of each language, drawn by a hash of
the id; all labelled languages are learned, and the counts are of whole texts. Inference covers every letter of every text.

Defined results: a null text or one without letters (Unicode's, so digits, superscripts and fractions are none) is ``und`` with
score 0; with nothing to learn from, all texts are ``und``, and ``keep`` keeps those with a letter. Ties go to the language first in sorted
order. Equal texts get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import small_batches

SAMPLE = 6000
BUCKETS, SMOOTH = 1 << 16, 0.1
SETTLED = 1e-3
#: Words that a worker keeps and code points that it infers together, both for four languages and fewer for more.
CACHE, TOGETHER = 300_000, 2_000_000
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in small letters. Word characters without digits and underscores are letters but for numbers such as fractions, which are rare."""
    words = WORDS.findall(text.lower())
    if "".join(words).isalpha() or not words:
        return words
    return [w for x in words for w in "".join(c if c.isalpha() else " " for c in x).split()]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's letter trigrams (its ends count as a letter), and where each word's begin."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mid = np.flatnonzero(points[1:-1] != 32) + 1  # one trigram around each letter
    h = (points[mid - 1] * np.uint64(0x9E3779B1) + points[mid]) * np.uint64(0x85EBCA77) + points[mid + 1]
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return h.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def fit(documents: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages in order, log-likelihoods by bucket and language) from labelled rows for which ``learn`` holds."""
    small_batches(documents.sparkSession)
    rows = documents.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & learn)
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    part = F.create_map(*(x for k in names for x in (F.lit(k), F.lit(min(1.0, SAMPLE / sizes[k])))))
    drawn = rows.filter(u < F.coalesce(part[F.col(lang)], F.lit(0.0))).select(lang, text)
    place = {k: i for i, k in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                if words:
                    found = total.setdefault(place[k], np.zeros(BUCKETS, np.int64))
                    found += np.bincount(trigrams(words)[0], minlength=BUCKETS)
        for k, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["k", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(names)))
    got = drawn.mapInArrow(run, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[got["bucket"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    return names, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)).astype(np.float32)


class Mixtures:
    """Proportions of languages in texts; the words seen last are kept with their likelihoods."""

    def __init__(self, table: np.ndarray):
        self.table, self.number = table, {}
        self.rows = np.zeros((0, table.shape[1]), np.float32)

    def _numbers(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.number]
        if not new:
            return
        got = []
        for i in range(0, len(new), 50_000):
            h, starts = trigrams(new[i : i + 50_000])
            got.append(np.add.reduceat(self.table[h], starts, axis=0))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.rows = np.concatenate([self.rows, *got])

    def infer(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """For each text its languages' proportions and the number of languages, or nothing if it has no letter."""
        k = self.table.shape[1]
        if len(self.number) > CACHE * 4 // max(4, k):
            self.number, self.rows = {}, self.rows[:0]
        counts = [Counter(words_of(t)) if t else Counter() for t in texts]
        some = [i for i, c in enumerate(counts) if c]
        out: list[tuple[np.ndarray, int] | None] = [None] * len(texts)
        if not some:
            return out
        if not k:
            for i in some:
                out[i] = (np.zeros(0, np.float32), 0)
            return out
        self._numbers(list({w: None for i in some for w in counts[i]}))
        get = self.number.__getitem__
        sizes = np.array([len(counts[i]) for i in some])
        ids = np.fromiter((get(w) for i in some for w in counts[i]), np.int64, int(sizes.sum()))
        n = np.fromiter((c for i in some for c in counts[i].values()), np.float32, len(ids))[:, None]
        logs = self.rows[ids]
        peak = logs.max(1, keepdims=True)
        like = np.exp(logs - peak)
        words = Bag(like, n, (n * peak)[:, 0], sizes)
        full = words.settle(np.full((len(some), k), 1 / k, np.float32))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        theta = (rank < 1).astype(np.float32)
        best, chosen = words.fit(theta), np.ones(len(some), np.int64)
        fee = 0.5 * np.log(np.maximum(words.total[:, 0], 2))
        rising = np.arange(len(some))
        for m in range(2, k + 1):
            part = words.of(rising)
            start = np.where(rank[rising] < m, np.maximum(full[rising], 1e-6), 0).astype(np.float32)
            own = part.settle(start / start.sum(1, keepdims=True))
            value = part.fit(own) - fee[rising] * (m - 1)
            better = value > best[rising] + 1e-6
            own, value, rising = own[better], value[better], rising[better]
            if not len(rising):
                break
            best[rising], theta[rising], chosen[rising] = value, own, m
        for j, i in enumerate(some):
            out[i] = (theta[j], int(chosen[j]))
        return out


class Bag:
    """Words of documents, one document after another: likelihoods by language (the largest is 1), how often each comes, and its log peak times that."""

    def __init__(self, like: np.ndarray, n: np.ndarray, peak: np.ndarray, sizes: np.ndarray):
        self.like, self.n, self.peak, self.sizes = like, n, peak, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.total = np.add.reduceat(n, self.starts)

    def of(self, docs: np.ndarray) -> Bag:
        if len(docs) == len(self.sizes):
            return self
        sizes = self.sizes[docs]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[docs], sizes)
        return Bag(self.like[at], self.n[at], self.peak[at], sizes)

    def settle(self, theta: np.ndarray) -> np.ndarray:
        """Proportions by expectation-maximisation from ``theta`` on; documents that have settled are left out of further rounds."""
        theta, open_, part = theta.copy(), np.arange(len(theta)), self
        while len(open_):
            now = theta[open_]
            share = part.like * now[part.doc]
            share *= part.n / np.maximum(share.sum(1, keepdims=True), 1e-30)
            new = np.add.reduceat(share, part.starts) / part.total
            theta[open_] = new
            moving = np.flatnonzero(np.abs(new - now).max(1) > SETTLED)
            if len(moving) < len(open_):
                open_, part = open_[moving], part.of(moving)
        return theta

    def fit(self, theta: np.ndarray) -> np.ndarray:
        """Log-likelihood of each document."""
        own = np.log(np.maximum((self.like * theta[self.doc]).sum(1), 1e-30)) * self.n[:, 0]
        return np.add.reduceat((own + self.peak).astype(np.float64), self.starts)


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, lang_pred, score, languages) of every whole text; ``score`` is the first language's proportion, ``languages`` a map of those of the chosen set.

    With ``keep``: the rows of ``documents`` themselves, all columns, less those that are ``und``.
    """
    small_batches(documents.sparkSession)
    names, table = model
    sent = documents.sparkSession.sparkContext.broadcast(table)
    place = documents.columns.index(text) if keep else 1
    step = TOGETHER * 4 // max(4, len(names))

    def results(found: Mixtures, texts: list[str | None]) -> list:
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size > step:
                out += found.infer(some)
                some, size = [], 0
        return out + (found.infer(some) if some else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Mixtures(sent.value)
        for batch in batches:
            got = results(found, batch.column(place).to_pylist())
            if keep:
                yield batch.filter(pa.array([x is not None for x in got], pa.bool_()))
                continue
            got = [x if names else None for x in got]
            lang = ["und" if x is None else names[int(x[0].argmax())] for x in got]
            score = [0.0 if x is None else min(1.0, float(x[0].max())) for x in got]
            sets = [[] if x is None else [(names[i], float(x[0][i])) for i in np.flatnonzero(x[0] > 0)] for x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], [key, "lang_pred", "score", "languages"])

    if keep:
        return documents.mapInArrow(run, documents.schema)
    return documents.select(key, text).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, lang_pred string, score double, languages map<string,double>")
