"""Language-model scores from subword lattices.

The pieces of an existing tokenizer (never trained here; its path is a parameter) span a lattice over every word: all
ways to spell the word in pieces, and every code point in its bytes. The file's scores order the pieces; they become
unigram weights by Zipf's law and weight all segmentations in one expectation step over every training word, whose
expected piece counts, with the file's weights as prior, are the model's unigram weights. A word's probability is the
sum over its segmentations, by forward recursion in log space; a text's is the product over its words and one end.

Words are scored once each in a table of the whole corpus's distinct words, which grows with the input. The most
frequent ``FREQUENT`` words of up to 256 bytes, a bounded table, are sent to the tasks; all others are joined by
the word. So neither frequent words nor long documents meet in one task. Words are walked many side by side; few long ones, one by
one in pieces of ``PART`` positions, so a word of a million code points takes seconds and memory in proportion.

Defined results: a null or empty text is only its end; with no training rows the weights are the file's. Equal texts
get equal scores up to the order of floating-point sums; repeated rows each get their own row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import small_batches, texts_of, written

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT, LONG = 100_000, 256
BYTE_SHARE, PRIOR, ZIPF = 1e-3, 1000.0, 2.7
#: Words in one recursion, and distinct words that a worker counts before it hands them on.
SIDE_BY_SIDE, HELD = 8192, 400_000
#: Fewer words than ``FEW`` of more than ``LONG`` code points are walked one by one; positions whose pieces are looked up at once.
FEW, PART = 64, 1 << 16
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = "▁"
BASE = 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1


def read_pieces(path: str = PIECES) -> tuple[list[str], np.ndarray]:
    """The file's ordinary pieces and their log weights; 256 bytes and the end of a text follow them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in own]
    rank = np.argsort(np.argsort(-np.array([model.get_score(i) for i in own]), kind="stable"), kind="stable")
    p = 1 / (rank + ZIPF)
    p = np.concatenate([p / p.sum() * (1 - 2 * BYTE_SHARE), np.full(256, BYTE_SHARE / 256), [BYTE_SHARE]])
    return pieces, np.log(p)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * BASE + ord(c) + 1) & WRAP
    return h


class Lattice:
    """The pieces by their hash, in a main table and one for those whose slots clash."""

    def __init__(self, pieces: list[str]):
        usable = [(i, p) for i, p in enumerate(pieces) if SPACE not in p[1:]]
        self.n = len(pieces)
        self.longest = max((len(p) for _, p in usable), default=1)
        self.keys = np.array([_hash(p) for _, p in usable] or [0], np.uint64)
        self.ids = np.array([i for i, _ in usable] or [0], np.int64)
        slot = self._main(self.keys)
        first = np.unique(slot, return_index=True)[1]
        self.main = np.full(1 << 20, -1, np.int32)
        self.main[slot[first]] = first
        rest = np.setdiff1d(np.arange(len(self.keys)), first)
        for self.spin in range(1, 1 << 20):
            at = self._side(self.keys[rest])
            if len(np.unique(at)) == len(at):
                break
        self.side = np.full(1 << 18, -1, np.int32)
        self.side[at] = rest

    def _main(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).astype(np.int64)

    def _side(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ h >> np.uint64(32)) * np.uint64(0xA0761D6478BD642F + 2 * self.spin) >> np.uint64(46)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of pieces with these hashes, or -1."""
        k = self.main[self._main(h)]
        miss = np.flatnonzero((k < 0) | (self.keys[k] != h))
        s = self.side[self._side(h[miss])]
        k[miss] = np.where((s >= 0) & (self.keys[s] == h[miss]), s, -1)
        return k

    def walk(self, words: list[str], logs: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word and, with ``weight``, the expected counts of pieces and bytes over all words."""
        out = np.zeros(len(words))
        counts = np.zeros(len(logs)) if weight is not None else None
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            # as many words as fit when all are as wide as the widest
            width = np.maximum(24, size[order[i : i + SIDE_BY_SIDE]])
            step = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), SIDE_BY_SIDE * 24, "right")))
            some = order[i : i + step]
            if step < FEW and width[step - 1] > LONG:
                for j in some:
                    out[j] = self._long(words[j], logs, None if weight is None else weight[j], counts)
            else:
                out[some] = self._block([words[j] for j in some], logs, None if weight is None else weight[some], counts)
            i += step
        return out, counts

    def _long(self, word: str, logs: np.ndarray, weight: float | None, counts: np.ndarray | None) -> float:
        """What ``_block`` gives for one word: the pieces that end in a part of the word are found at once, only the recursion goes by position."""
        whole = SPACE + word
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        spelled = np.frombuffer(whole.encode("utf-8", "replace"), np.uint8)
        first = np.flatnonzero((spelled & 0xC0) != 0x80)
        byte_logs = logs[self.n + spelled.astype(np.int64)]
        raw = np.add.reduceat(byte_logs, first).tolist()
        top = len(points)
        powers = np.full(top + 1, BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        back = np.full(top, pow(BASE, -1, 1 << 64), np.uint64)
        np.multiply.accumulate(back, out=back)
        prefix = np.zeros(top + 1, np.uint64)
        prefix[1:] = np.cumsum((points + np.uint64(1)) * back, dtype=np.uint64) * powers[1:]

        def arcs(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
            """End, length and piece of all that end at ``lo`` to ``hi``, in order of the end, and where each end's begin."""
            ends, lengths, found = [], [], []
            for k in range(1, min(hi, self.longest) + 1):
                j = np.arange(max(lo, k), hi + 1)
                which = self.find(prefix[j] - prefix[j - k] * powers[k])
                at = np.flatnonzero(which >= 0)
                ends.append(j[at])
                lengths.append(np.full(len(at), k))
                found.append(self.ids[which[at]])
            end = np.concatenate(ends)
            by_end = np.argsort(end, kind="stable")
            end = end[by_end]
            return end, np.concatenate(lengths)[by_end], np.concatenate(found)[by_end], np.searchsorted(end, np.arange(lo, hi + 2)).tolist()

        def plus(x: float, y: float) -> float:
            return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))

        parts = [(lo, min(top, lo + PART - 1)) for lo in range(1, top + 1, PART)]
        alpha = [0.0] * (top + 1)
        for lo, hi in parts:
            _, length, piece, begin = arcs(lo, hi)
            length, own = length.tolist(), logs[piece].tolist()
            for j in range(lo, hi + 1):
                a = alpha[j - 1] + raw[j - 1]
                for i in range(begin[j - lo], begin[j - lo + 1]):
                    a = plus(a, alpha[j - length[i]] + own[i])
                alpha[j] = a
        total = alpha[top]
        if counts is None:
            return total
        beta = [-math.inf] * top + [0.0]
        for lo, hi in reversed(parts):
            end, length, piece, begin = arcs(lo, hi)
            starts, own = (end - length).tolist(), logs[piece].tolist()
            for j in range(hi, lo - 1, -1):
                b = beta[j]
                beta[j - 1] = plus(beta[j - 1], raw[j - 1] + b)
                for i in range(begin[j - lo], begin[j - lo + 1]):
                    beta[starts[i]] = plus(beta[starts[i]], own[i] + b)
            if len(end):
                low = max(0, lo - self.longest)
                a, b = np.array(alpha[low:hi]), np.array(beta[lo : hi + 1])
                counts += np.bincount(piece, np.exp(a[end - length - low] + logs[piece] + b[end - lo] - total) * weight, len(counts))
        by_bytes = np.exp(np.array(alpha[:-1]) + np.array(raw) + np.array(beta[1:]) - total) * weight
        counts += np.bincount(self.n + spelled.astype(np.int64), np.repeat(by_bytes, np.diff(np.append(first, len(spelled)))), len(counts))
        return total

    def _block(self, words: list[str], logs: np.ndarray, weight: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        n, size = len(words), np.array([len(w) + 1 for w in words])
        top = int(size.max())
        points = np.zeros((top, n), np.uint64)
        flat = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        points[col, row] = flat
        raw = np.zeros((top, n))  # log weight of each code point in bytes
        spelled = [np.frombuffer(w.encode("utf-8", "replace"), np.uint8) for w in ("".join(SPACE + w for w in words),)][0]
        lead = (spelled & 0xC0) != 0x80
        raw[col, row] = np.add.reduceat(logs[self.n + spelled.astype(np.int64)], np.flatnonzero(lead))
        prefix = np.zeros((top + 1, n), np.uint64)
        for j in range(top):
            prefix[j + 1] = prefix[j] * np.uint64(BASE) + points[j] + np.uint64(1)
        power = [np.uint64(pow(BASE, k, 1 << 64)) for k in range(self.longest + 1)]
        alpha = np.full((top + 1, n), -np.inf)
        alpha[0] = 0
        arcs = []
        for j in range(1, top + 1):
            live = int(np.searchsorted(size, j))  # words are in order of length
            a = alpha[j]
            a[live:] = alpha[j - 1, live:] + raw[j - 1, live:]
            for k in range(1, min(j, self.longest) + 1):
                found = self.find(prefix[j, live:] - prefix[j - k, live:] * power[k])
                at = np.flatnonzero(found >= 0)
                if len(at):
                    piece = self.ids[found[at]]
                    at += live
                    a[at] = np.logaddexp(a[at], alpha[j - k, at] + logs[piece])
                    if counts is not None:
                        arcs.append((j, k, at, piece))
        total = alpha[size, np.arange(n)]
        if counts is None:
            return total
        beta = np.full((top + 1, n), -np.inf)
        beta[size, np.arange(n)] = 0
        by_end: dict[int, list] = {}
        for j, k, at, piece in arcs:
            by_end.setdefault(j, []).append((k, at, piece))
        bytes_of = np.zeros((top, n))
        for j in range(top, 0, -1):
            live = int(np.searchsorted(size, j))
            bytes_of[j - 1, live:] = np.exp(alpha[j - 1, live:] + raw[j - 1, live:] + beta[j, live:] - total[live:]) * weight[live:]
            beta[j - 1, live:] = np.logaddexp(beta[j - 1, live:], raw[j - 1, live:] + beta[j, live:])
            for k, at, piece in by_end.get(j, ()):
                counts += np.bincount(piece, np.exp(alpha[j - k, at] + logs[piece] + beta[j, at] - total[at]) * weight[at], len(counts))
                beta[j - k, at] = np.logaddexp(beta[j - k, at], logs[piece] + beta[j, at])
        per_byte = np.repeat(bytes_of[col, row], np.diff(np.append(np.flatnonzero(lead), len(spelled))))
        counts += np.bincount(self.n + spelled.astype(np.int64), per_byte, len(counts))
        return total


def _words(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in texts_of(column)]


def vocabulary(documents: DataFrame, text: str, learn: str) -> DataFrame:
    """(word, c): every distinct word of all texts, and how often it is in those of rows where ``learn`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = list(every)
            every.clear()
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen.get(w, 0) for w in words], pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        every: dict[bytes, None] = {}
        seen: Counter = Counter()
        for batch in batches:
            for t, own in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                words = t.translate(FOLD).split()
                if own:
                    seen.update(words)
                every.update(dict.fromkeys(words))
                if len(every) > HELD:
                    yield out()
        if every:
            yield out()

    return documents.select(text, learn).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(documents: DataFrame, learn, key: str = "doc_id", text: str = "text", pieces: str = PIECES) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` is the condition of training rows."""
    spark = documents.sparkSession
    small_batches(spark)
    own = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), learn.alias("_learn"))
    names, logs = read_pieces(pieces)
    words = written(vocabulary(own, "_text", "_learn"))
    ends = own.filter("_learn").count()
    r = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    tokens, distinct = r.n + ends, r.v + (ends > 0)
    lattice = spark.sparkContext.broadcast(Lattice(names))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(logs))
        for batch in batches:
            total += lattice.value.walk(_words(batch.column(0)), logs, batch.column(1).to_numpy(zero_copy_only=False).astype(float))[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "x"])

    got = words.filter("c > 0").mapInArrow(expect, "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).toArrow()
    counts = np.zeros(len(logs))
    counts[got["piece"].to_numpy()] = got["x"].to_numpy()
    counts[-1] = ends
    fitted = np.log((counts + PRIOR * np.exp(logs)) / (counts.sum() + PRIOR)) / math.log(10)
    natural = fitted * math.log(10)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.value.walk(_words(batch.column(0)), natural)[0] / math.log(10))], ["word", "c", "lat"])

    scored = written(words.mapInArrow(weigh, "word binary, c long, lat double"))
    scored = scored.withColumn("base", F.log10((F.col("c") + 0.5) / F.lit(float(tokens + 0.5 * (distinct + 1)))))
    often = scored.filter(F.length("word") <= LONG).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    table = spark.sparkContext.broadcast({w: (k > 0, b, x) for w, k, b, x in zip(often["word"].to_pylist(), often["c"].to_pylist(), often["base"].to_pylist(), often["lat"].to_pylist())})
    end = (1, int(ends > 0), math.log10((ends + 0.5) / (tokens + 0.5 * (distinct + 1))), float(fitted[-1]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.get
        for batch in batches:
            rows = []
            for t in texts_of(batch.column(1)):
                n, known, base, lat = end
                rare = []
                for w, k in Counter(t.translate(FOLD).split()).items():
                    n += k
                    if (x := get(w)) is None:
                        rare.append((w, k))
                    else:
                        known += k * x[0]
                        base += k * x[1]
                        lat += k * x[2]
                rows.append((n, known, base, lat, [w for w, _ in rare], [k for _, k in rare]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["_key", "n", "known", "base", "lat", "words", "times"])

    kind = own.schema["_key"].dataType.simpleString()
    parts = own.select("_key", "_text").mapInArrow(split, f"_key {kind}, n long, known long, base double, lat double, words array<binary>, times array<int>")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    sums = rare.join(scored, "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known2"), F.sum(F.col("k") * F.col("base")).alias("base2"), F.sum(F.col("k") * F.col("lat")).alias("lat2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("words", "times").join(sums, "row", "left").select(F.col("_key").alias(key), F.col("n").alias("n_tokens"), (F.col("known") + zero("known2")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("base2")).alias("base_score"), (F.col("lat") + zero("lat2")).alias("score"))
