"""Benchmark decontamination over suffix arrays of the training text.

Training documents are gathered into shards of about ``SHARD_WORDS`` words. All words of a shard become one word-level suffix array, by
prefix doubling over what is not told apart yet, as deep as the longest item. Every suffix of the benchmark (from each word of an item on
that leaves a window's length, or the whole of a shorter item) is searched for in every shard's array by binary search. That gives the interval of training suffixes
that begin with the same window; the interval is then narrowed word by word, which gives the longest verbatim matches and their
places. The words and documents of the intervals are hit; documents with a hit are removed.

The benchmark is cut into pieces of at most ``PIECE_WORDS`` words (overlapping by a window less one word, so no window is lost) and dealt into
blocks; a block has at most ``BLOCK_WORDS`` words, which is checked before one is sent to the tasks. Each block is one pass over the
documents, and only one block is on the driver and in the workers at a time. Several passes are merged by row, through tables.

Defined results: null texts and texts without words have no words and no hit; items without words match nothing; a
null item id counts as the empty string; repeated items count once; repeated documents each get their own row. The longest match of an
item of more than ``PIECE_WORDS`` words is that within a piece. Of equally long matches the first place in the document counts, then the
first item id as a string. With one block nothing is shuffled, so hot groups and many copies cost no more than their
own words. A document is never cut, so a task's memory grows with the longest one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import runs, small_batches, texts_of, written

#: Words of the benchmark in one pass and in one piece, and words of training text in one suffix array.
BLOCK_WORDS, PIECE_WORDS, SHARD_WORDS = 2_000_000, 250_000, 400_000

#: Bytes to bytes: A-Z to a-z, other ASCII but digits and letters to a space, beyond ASCII as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """All places, sorted by the ``depth`` tokens from there on; beyond the end is least. ``rank`` is where a place's group of equals begins; each round doubles the width and sorts groups of two and more only."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    first = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order[0]] - 1))
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    open_ = order[np.repeat(sizes > 1, sizes)]
    width = 1
    while width < depth and len(open_):
        ahead = open_ + width
        key = rank[open_] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        at = np.arange(len(open_))
        begins = np.diff(key, prepend=key[0] - 1) != 0
        group = np.maximum.accumulate(np.where(begins, at, 0))
        whole = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, at, 0))
        rank[open_] = old + group - whole
        sizes = np.diff(np.append(np.flatnonzero(begins), len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        width *= 2
    return np.argsort(rank, kind="stable")


class Block:
    """Items of one block as numbers. Suffixes are in the order of item id and word: ``at`` where each begins in ``tokens``, ``window`` how many words must match, ``left`` how many it has, ``item`` and ``word``."""

    def __init__(self, items: list[tuple[str, int, bytes]], window: int):
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids = sorted({i for i, _, _ in items})
        place = {x: k for k, x in enumerate(self.ids)}
        tokens, at, left, need, item, word, n = [], [], [], [], [], [], 0
        for name, first, text in sorted(set(items)):
            seq = list(map(number.__getitem__, words_of(text)))
            if not seq:
                continue
            k = min(window, len(seq))
            own = np.arange(len(seq) - k + 1)
            tokens.append(np.array(seq, np.int32))
            at.append(n + own)
            left.append(len(seq) - own)
            need.append(np.full(len(own), k))
            item.append(np.full(len(own), place[name]))
            word.append(first + own)
            n += len(seq)
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.vocabulary, self.tokens = list(number), flat(tokens, np.int32)
        self.at, self.left, self.window, self.item, self.word = flat(at, np.int64), flat(left, np.int64), flat(need, np.int64), flat(item, np.int64), flat(word, np.int64)
        self.longest = int(self.left.max(initial=0))


class Shard:
    """The suffix array of all words of some documents. Token 0 ends a document."""

    def __init__(self, texts: list[bytes], depth: int):
        self.number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        parts = [np.fromiter(map(self.number.__getitem__, w), np.int32, len(w)) for w in map(words_of, texts)]
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]).astype(np.int64)
        self.tokens = np.zeros(int(self.lengths.sum()) + len(parts), np.int32)
        for s, x in zip(self.starts, parts):
            self.tokens[s : s + len(x)] = x
        self.array = suffix_array(self.tokens, depth)
        #: where the suffixes that begin with each token start in the array
        self.bucket = np.concatenate([[0], np.cumsum(np.bincount(self.tokens, minlength=len(self.number) + 1))])

    def token(self, suffix: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        at = self.array[suffix] + depth
        return np.where(at < len(self.tokens), self.tokens[np.minimum(at, len(self.tokens) - 1)], -1)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals that agree in ``depth`` tokens, the parts whose next token is ``token``: two binary searches for each, all side by side."""
        ends = []
        for upper in (False, True):
            a, b = lo.copy(), hi.copy()
            open_ = np.flatnonzero(a < b)
            while len(open_):
                mid = (a[open_] + b[open_]) >> 1
                seen = self.token(mid, depth)
                right = seen <= token[open_] if upper else seen < token[open_]
                a[open_[right]] = mid[right] + 1
                b[open_[~right]] = mid[~right]
                open_ = open_[a[open_] < b[open_]]
            ends.append(a)
        return ends[0], ends[1]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) for every place of the intervals."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def search(shard: Shard, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Narrows the intervals of all suffixes of ``block`` word by word: (depth, suffixes still matched, lo, hi) at every depth from 1 on."""
    get = shard.number.get
    known = np.fromiter((get(w, -1) for w in block.vocabulary), np.int32, len(block.vocabulary))
    tokens = known[block.tokens] if len(block.tokens) else block.tokens
    stop = np.where(tokens < 0, np.arange(len(tokens)), len(tokens))
    run = (np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(tokens))) if len(tokens) else stop
    which = np.flatnonzero(run[block.at] >= block.window)  # others have a word within the window that no document of the shard has
    first = tokens[block.at[which]]
    lo, hi = shard.bucket[first], shard.bucket[first + 1]
    depth = 1
    while len(which):
        yield depth, which, lo, hi
        on = block.left[which] > depth
        which, lo, hi = which[on], lo[on], hi[on]
        lo, hi = shard.narrow(lo, hi, depth, tokens[block.at[which] + depth])
        on = lo < hi
        which, lo, hi = which[on], lo[on], hi[on]
        depth += 1


def hits(texts: list[bytes], block: Block) -> list[dict]:
    """For each text: ``n_words``; ``spans``, the runs of words inside an occurrence of a window; ``items`` with an occurring window; ``longest``, the longest verbatim match: words, word of the text, item, word of the item."""
    shard = Shard(texts, block.longest)
    edge = np.zeros(len(shard.tokens) + 1, np.int64)
    pairs: list[np.ndarray] = []
    best = np.zeros((len(texts), 3), np.int64)  # words, place, suffix
    for depth, which, lo, hi in search(shard, block):
        due = np.flatnonzero(block.window[which] == depth)
        if len(due):  # windows are whole: every place of an interval is hit, by each item that has the window
            one = np.unique(lo[due], return_index=True)[1]
            at = shard.array[_spread(lo[due][one], hi[due][one])[1]]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + depth, -1)
            each, at = _spread(lo[due], hi[due])
            pairs.append(np.unique(shard.document(shard.array[at]) * len(block.ids) + block.item[which[due]][each]))
        done = np.flatnonzero(block.window[which] <= depth)
        if len(done):  # longer matches come later and take the place of shorter ones
            one = np.unique(lo[done], return_index=True)[1]
            each, at = _spread(lo[done][one], hi[done][one])
            place = shard.array[at]
            doc = shard.document(place)
            by = np.lexsort((which[done][one][each], place, doc))
            head = by[np.flatnonzero(np.diff(doc[by], prepend=-1))]
            best[doc[head]] = np.stack([np.full(len(head), depth), place[head], which[done][one][each[head]]], 1)
    on = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
    begin, end = np.flatnonzero(np.diff(on, prepend=0) == 1), np.flatnonzero(np.diff(on, append=0) == -1) + 1
    spans: list[list] = [[] for _ in texts]
    for d, a, b in zip(shard.document(begin).tolist(), begin.tolist(), end.tolist()):
        spans[d].append((a - int(shard.starts[d]), b - int(shard.starts[d])))
    items: list[list] = [[] for _ in texts]
    for x in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
        items[x // len(block.ids)].append(block.ids[x % len(block.ids)])
    out = []
    for d, (words, place, s) in enumerate(best.tolist()):
        longest = (words, place - int(shard.starts[d]), block.ids[block.item[s]], int(block.word[s])) if words else None
        out.append({"n_words": int(shard.lengths[d]), "spans": spans[d], "items": items[d], "longest": longest})
    return out


def longest(texts: list[bytes], block: Block) -> list[tuple[str, int, int, int, int]]:
    """(item, word of the item, text, word of the text, words): for every benchmark suffix its longest verbatim match in these texts, at its first place."""
    shard = Shard(texts, block.longest)
    n, place = np.zeros(len(block.at), np.int64), np.zeros(len(block.at), np.int64)
    for depth, which, lo, hi in search(shard, block):
        due = np.flatnonzero(block.window[which] <= depth)
        if len(due):
            one, back = np.unique(lo[due], return_index=True, return_inverse=True)[1:]
            each, at = _spread(lo[due][one], hi[due][one])
            least = np.minimum.reduceat(shard.array[at], np.flatnonzero(np.diff(each, prepend=-1)))
            n[which[due]], place[which[due]] = depth, least[back]
    found = np.flatnonzero(n)
    doc = shard.document(place[found])
    return [(block.ids[block.item[s]], int(block.word[s]), int(d), int(place[s] - shard.starts[d]), int(n[s])) for s, d in zip(found, doc)]


def _shards(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Batches with their texts, gathered to about ``SHARD_WORDS`` words; more than that within one batch are several shards."""
    held, texts, size = [], [], 0
    for batch in batches:
        own = texts_of(batch.column(column))
        held.append(batch)
        texts += own
        size += sum(map(len, own))
        if size > SHARD_WORDS * 6:
            yield held, list(runs(((len(t) // 6 + 1, t) for t in texts), SHARD_WORDS))
            held, texts, size = [], [], 0
    if held:
        yield held, list(runs(((len(t) // 6 + 1, t) for t in texts), SHARD_WORDS))


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[list[tuple[str, int, bytes]]]:
    """The benchmark's pieces (item id, first word, text) in blocks of at most ``BLOCK_WORDS`` words, one at a time."""
    small_batches(benchmark.sparkSession)
    size = max(PIECE_WORDS, 2 * window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words = words_of(t)
                step = size - window + 1
                for a in range(0, max(1, len(words) - window + 1), step):
                    part = words[a : a + size]
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([a], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([b" ".join(part)], pa.binary())], ["item", "first", "n", "body"])

    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("body"))
    pieces = written(named.mapInArrow(cut, "item string, first long, n long, body binary"))
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // BLOCK_WORDS))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "first", "body"), F.lit(parts)) if parts > 1 else F.lit(0))
        largest, pieces_in_it = dealt.groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("k")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max_by("k", "n"), F.lit(0))).first()
        if largest <= BLOCK_WORDS or pieces_in_it <= 1:
            break
        parts *= 2
    for k in range(parts):
        yield [(r.item, r.first, bytes(r.body)) for r in dealt.filter(F.col("block") == k).select("item", "first", "body").collect()]


FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, longest struct<words:long,doc_word:long,item:string,item_word:long>"
KINDS = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.struct([("words", pa.int64()), ("doc_word", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])]


def _pass(documents: DataFrame, block: list[tuple[str, int, bytes]], text: str, window: int, only_hit: bool = False) -> DataFrame:
    """The columns of ``documents`` but the text, and what ``hits`` finds."""
    sent = documents.sparkSession.sparkContext.broadcast(Block(block, window))  # at most BLOCK_WORDS words
    at = documents.columns.index(text)
    rest = [i for i in range(len(documents.columns)) if i != at]
    shown = documents.drop(text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, groups in _shards(batches, at):
            found = [h for texts in groups for h in hits(texts, sent.value)]
            names = [*shown.names, "n_words", "spans", "items", "longest"]
            place = 0
            for batch in held:
                own = found[place : place + batch.num_rows]
                place += batch.num_rows
                cols = [[h["n_words"] for h in own], [[{"start": a, "end": b} for a, b in h["spans"]] for h in own], [h["items"] for h in own], [h["longest"] and dict(zip(("words", "doc_word", "item", "item_word"), h["longest"])) for h in own]]
                out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *(pa.array(c, k) for c, k in zip(cols, KINDS))], names)
                yield out.filter(pa.array([bool(h["spans"]) for h in own], pa.bool_())) if only_hit else out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown), FOUND])
    return documents.mapInArrow(run, schema)


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(key, n_words, n_hit, spans, items, longest, contaminated) of every row of ``documents``; ``items`` are sorted ids as strings. A word is hit if a window of any block hits it."""
    small_batches(documents.sparkSession)
    todo = blocks(benchmark, item_id, item_text, window)
    first, second = next(todo), next(todo, None)
    own = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if second is None:
        found = _pass(own, first, "_text", window)
    else:
        own = written(own.withColumn("_row", F.monotonically_increasing_id()))
        parts = written(_pass(own, first, "_text", window))
        rows = parts.select("_key", "_row", "n_words")
        parts = parts.filter(F.size("spans") > 0).drop("_key", "n_words")
        more = second
        while more is not None:
            parts = parts.unionByName(written(_pass(own.drop("_key"), more, "_text", window, only_hit=True).drop("n_words")))
            more = next(todo, None)
        # a document's rows are one a block; its spans are merged where they touch
        merged = parts.groupBy("_row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sort_array(F.collect_list(F.struct(-F.col("longest.words"), "longest.doc_word", "longest.item", "longest.item_word", "longest"))).getItem(0)["longest"].alias("longest"))
        last = lambda a: F.element_at(a, -1)
        join = lambda a, s: F.when((F.size(a) > 0) & (last(a)["end"] >= s["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s)))
        none = F.array().cast("array<struct<start:int,end:int>>")
        merged = merged.withColumn("spans", F.aggregate("spans", none, join))
        found = rows.join(merged, "_row", "left").withColumn("spans", F.coalesce("spans", none)).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("_key").alias(key), "n_words", n_hit.alias("n_hit"), "spans", "items", "longest", (F.size("spans") > 0).alias("contaminated"))


def longest_matches(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 10) -> DataFrame:
    """(item_id, item_word, key, doc_word, n_words): the longest verbatim match, of ``least`` words or more, of every benchmark suffix in every shard, and where it stands. Shards are runs of documents of bounded size, so the rows of a suffix are its best place in each shard."""
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    out = None
    for block in blocks(benchmark, item_id, item_text, least):
        sent = documents.sparkSession.sparkContext.broadcast(Block(block, least))  # at most BLOCK_WORDS words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for held, groups in _shards(batches, 1):
                keys = pa.concat_arrays([b.column(0) for b in held])
                base = 0
                for texts in groups:
                    rows = longest(texts, sent.value)
                    cols = list(zip(*rows)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), keys.take(pa.array([base + d for d in cols[2]], pa.int64())), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["item_id", "item_word", key, "doc_word", "n_words"])
                    base += len(texts)

        part = documents.select(key, text).mapInArrow(run, f"item_id string, item_word long, `{key}` {kind}, doc_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``documents`` without those in which a benchmark suffix matches a window or more. The verdict rides along with the row, so rows with equal or null keys keep their own. Further blocks are further passes over what is left."""
    small_batches(documents.sparkSession)
    schema, place, docs = documents.schema, documents.columns.index(text), documents
    for k, block in enumerate(blocks(benchmark, item_id, item_text, window)):
        sent = documents.sparkSession.sparkContext.broadcast(Block(block, window))  # at most BLOCK_WORDS words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for held, groups in _shards(batches, place):
                clean = [not h["spans"] for texts in groups for h in hits(texts, sent.value)]
                at = 0
                for batch in held:
                    yield batch.filter(pa.array(clean[at : at + batch.num_rows], pa.bool_()))
                    at += batch.num_rows

        docs = (written(docs) if k else docs).mapInArrow(run, schema)
    return docs
