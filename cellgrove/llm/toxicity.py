"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word ends marked) and of itself, each hashed to a row of one
embedding table; a document is the average of its words' bags; two softmax outputs stand on top, and table and outputs
are trained together by Adam. Misspellings never seen share n-grams with words that were. After training the outputs
are folded into the table: a row then adds one number to the log-odds, so that scoring needs one small vector.

Every row of the table that a training document has is trained, with weight decay. A row counts in its bags by the evidence that its
presence depends on the label: chi-square of the four counts of documents over ``EVIDENCE``, at most 1, to the power ``SHARPNESS``. The null
distribution of chi-square is the same at every sample size, so chance rows stay faint however many there are, and rare
toxic words are learned as far as their documents bear them out.

The classifier is fitted on a bounded sample of labelled rows: at most about ``SAMPLE`` documents of each label, drawn
by a hash of the id, each with its whole text. The log-odds are then corrected for the drawing. Scoring covers every word of every text.

Defined results: null or empty texts, and texts without words, get the share of label 1 among the labelled rows; if
one label has no rows the score is that share everywhere. A label above 0 is toxic, others are not; labels may repeat an
id: the largest counts; labels without an id and null labels are left out. Rows with equal texts get equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import runs, small_batches, texts_of

SAMPLE = 3000
BUCKETS, DIM, SIZES = 1 << 17, 4, (3, 4, 5)
EPOCHS, RATE, DECAY, SEED = 40, 0.05, 0.3, 7
EVIDENCE, SHARPNESS = 30.0, 3

#: Words whose sums a worker keeps at a time, and bytes of text that it scores together.
CACHE, TOGETHER = 300_000, 2 << 20

#: Bytes to bytes: A-Z to a-z, other ASCII but digits and letters to a space, beyond ASCII as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word, one after another, and where each word's begin. N-grams are of code points."""
    points = np.frombuffer((" " + " ".join(w.decode("utf-8", "replace") for w in words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = points == 32
    word = np.cumsum(gap) - 1
    n, out_word, out_row = len(points), [], []
    mix = lambda h: (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 17)
    state, inner = points.copy(), np.ones(n, bool)
    for size in range(2, max(SIZES) + 1):
        m = n - size + 1
        if m <= 0:
            break
        state = state[:m] * np.uint64(0x100000001B3) + points[size - 1 :]
        inner = inner[:m] & ~gap[size - 2 : size - 2 + m] if size > 2 else inner[:m]
        if size in SIZES:
            at = np.flatnonzero(inner)
            out_word.append(word[at])
            out_row.append(mix(state[at] + np.uint64(size)))
    out_word.append(np.arange(len(words)))
    out_row.append(np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.uint64, len(words)))
    w, r = np.concatenate(out_word), np.concatenate(out_row).astype(np.int64)
    order = np.argsort(w, kind="stable")
    return r[order], np.searchsorted(w[order], np.arange(len(words)))


class Bags:
    """A sparse matrix of averages: entry, row and weight triples, as a sum over rows and its transpose."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        a = np.argsort(rows, kind="stable")
        self.forth = self._plan(rows[a], cols[a], weight[a])
        b = np.argsort(cols, kind="stable")
        self.back = self._plan(cols[b], rows[b], weight[b])

    @staticmethod
    def _plan(to: np.ndarray, of: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.flatnonzero(np.diff(to, prepend=-1))
        return to[first], first, of, weight.astype(np.float32)[:, None]

    def _sum(self, plan: tuple[np.ndarray, ...], x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, x.shape[1]), np.float32)
        if len(plan[1]):
            out[plan[0]] = np.add.reduceat(x[plan[2]] * plan[3], plan[1], axis=0)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sum(self.forth, x, self.shape[0])

    def transposed(self, x: np.ndarray) -> np.ndarray:
        return self._sum(self.back, x, self.shape[1])


def evidence(rows: np.ndarray, sizes: np.ndarray, docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The weight of every row of the table, 0 to 1, from how many documents of each label have it."""
    starts = np.cumsum(sizes) - sizes
    seen = np.zeros((2, BUCKETS))
    for words, label in zip(docs, labels):
        size = sizes[words]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[words], size)
        seen[label, np.unique(rows[at])] += 1
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    a, b = seen[1], seen[0]
    c, d = n1 - a, n0 - b
    chi = (a * d - b * c) ** 2 * (n0 + n1) / np.maximum((a + b) * (c + d) * n0 * n1, 1)
    return np.minimum(1, chi / EVIDENCE) ** SHARPNESS


def train(documents: Iterable[tuple[list[bytes], np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The folded model: what each row of the table adds to a document's log-odds, and the bias. Documents are their distinct words and how often each comes; they are taken one by one and kept as numbers."""
    number: dict[bytes, int] = {}
    own, times = [], []
    for words, n in documents:
        own.append(np.fromiter((number.setdefault(x, len(number)) for x in words), np.int32, len(words)))
        times.append(np.asarray(n, np.float32))
    vocabulary = list(number)
    parts = [grams(vocabulary[i : i + 50_000]) for i in range(0, len(vocabulary), 50_000)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    ends = np.cumsum([0, *(len(r) for r, _ in parts)])
    rows = np.concatenate([r.astype(np.int32) for r, _ in parts])
    starts = np.concatenate([s + e for (_, s), e in zip(parts, ends)])
    del parts, number
    sizes = np.diff(np.append(starts, len(rows)))
    total = np.array([max(1.0, float(x.sum())) for x in times])
    weight = evidence(rows, sizes, own, labels)
    used, place = np.unique(rows, return_inverse=True)
    word_of = np.repeat(np.arange(len(vocabulary), dtype=np.int32), sizes)
    words = Bags(word_of, place.astype(np.int32), (weight[rows] / sizes[word_of]).astype(np.float32), (len(vocabulary), len(used)))
    del word_of, rows, place
    d = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
    texts = Bags(d, np.concatenate(own), (np.concatenate(times) / total[d]).astype(np.float32), (len(own), len(vocabulary)))

    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    top = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # a factor that makes the average of a usual document about the sum of its words sets the pace of learning
    scale = np.float32(np.median(total))
    params = [table, top, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    truth = np.eye(2, dtype=np.float32)[labels]
    for step in range(1, EPOCHS + 1):
        hidden = texts(words(table)) * scale
        z = hidden @ top + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = p - truth
        slopes = [words.transposed(texts.transposed(g @ top.T * scale)) + DECAY * table, hidden.T @ g + 0.1 * top, g.sum(0)]
        for x, s, (m, v) in zip(params, slopes, moments):
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    odds = np.zeros(BUCKETS, np.float32)
    odds[used] = table @ (top[:, 1] - top[:, 0]) * scale * weight[used]
    return odds, float(bias[1] - bias[0])


def fit(documents: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float, float]:
    """Trains on labelled rows for which ``learn`` (a condition on ``key``) holds. (the table's odds, bias, share of label 1)."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & learn).groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("_label"))
    n = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if not n.get(0) or not n.get(1):
        return np.zeros(BUCKETS, np.float32), 0.0, share
    part = {k: min(1.0, SAMPLE / n[k]) for k in (0, 1)}
    u = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.filter(u < F.when(F.col("_label") == 1, part[1]).otherwise(part[0]))
    drawn = drawn.select(F.col(key).alias("_key"), "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sorted(Counter(words_of(t)).items()) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[w for w, _ in c] for c in counts], pa.list_(pa.binary())), pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int32()))], ["key", "label", "words", "times"])

    kind = drawn.schema["_key"].dataType.simpleString()
    # at most about 2 SAMPLE ids
    own = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_key").select("_key", "_label", "_text")
    found = own.mapInArrow(run, f"key {kind}, label int, words array<binary>, times array<int>").withColumn("order", F.xxhash64("words", "times")).toArrow().sort_by([("key", "ascending"), ("order", "ascending")])
    y = found["label"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0, share
    odds, bias = train(((x.as_py(), t.values.to_numpy()) for x, t in zip(found["words"], found["times"])), y)
    return odds, bias - float(np.log(part[1] / part[0])), share


class Scorer:
    """Log-odds of texts; the words seen last are kept with their sums."""

    def __init__(self, odds: np.ndarray):
        self.odds, self.known = odds, {}

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            rows, starts = grams(some)
            sizes = np.diff(np.append(starts, len(rows)))
            self.known.update(zip(some, (np.add.reduceat(self.odds[rows], starts) / sizes).tolist()))

    def means(self, texts: list[bytes]) -> list[float | None]:
        out: list[float | None] = []
        for group in runs(((len(t) + 1, t) for t in texts), TOGETHER):
            counts = [Counter(words_of(t)) for t in group]
            if len(self.known) > CACHE:
                self.known.clear()
            known = self.known
            if new := list({w: None for c in counts for w in c if w not in known}):
                self._learn(new)
            out += [sum(known[w] * n for w, n in c.items()) / c.total() if c else None for c in counts]
        return out


def score(documents: DataFrame, model: tuple[np.ndarray, float, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability of label 1 for every whole text."""
    spark = documents.sparkSession
    small_batches(spark)
    odds, bias, share = model
    sent = spark.sparkContext.broadcast(odds)
    flat = not odds.any()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            means = scorer.means(texts_of(batch.column(1)))
            s = [share if m is None or flat else float(1 / (1 + np.exp(-min(500.0, max(-500.0, m + bias))))) for m in means]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], [key, "score"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, score double")
