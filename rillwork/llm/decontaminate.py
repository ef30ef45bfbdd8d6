"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

Index.  Test items are cut into segments of at most ``PASSAGE`` words.  A segment's BM25 weights are divided by the segment's
score for itself, so a passage that holds the whole segment scores 1 and one threshold serves all items.  Postings are flat arrays sorted by
term and segment, and cut into blocks of ``BLOCK`` segments with the largest weight of each term in each block that holds it.

Search.  Every document is read as passages of ``PASSAGE`` words, one every half passage.  For many passages at once the terms' maxima
are summed: a passage that can't reach the threshold has no pivot and is done.  Of the others the block maxima are summed, and those that
no block can lift to the threshold are done too.  For the rest block-max WAND walks the postings: it picks the pivot by the terms' maxima,
skips to the next block where block maxima fall short, scores exactly where they don't, and returns every segment at or above the
threshold (there is no top-k cut).

Verification.  An item is a question (all but the last sentence) and an answer (the last sentence; none if there is one sentence).  A
hit counts if at least half of the question's five-word shingles and half of the answer's stand in the words around the passage.

Scale.  One narrow pass over documents.  The index is broadcast in shards of at most ``SHARD_ITEMS`` items and ``SHARD_WORDS`` words (one
item may be longer), one pass a shard, so what is broadcast never exceeds that bound: about 16 bytes a word, and the words themselves.  A usual
benchmark is one shard.  Document frequencies, the number of segments and their mean length are counted over all items first (on the driver, in
proportion to the distinct words), so scores and hits don't depend on the shards.  A worker holds term numbers of ``SLICE_CHARS`` characters of
text at a time, and words only of the documents with candidates.

Defined results.  Null and empty texts or items give no hits.  An item without words is ignored.  Items of equal text each report.  Repeated rows each
report; (doc_id, item_id) is reported once a row, with the best passage (ties: the first).  Case, punctuation and spacing are ignored.  Extra columns
are ignored by ``search`` and passed on by ``remove``.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import bounded_batches, sliced, stored

PASSAGE = 64
HALF = PASSAGE // 2
THRESHOLD = 0.5
BLOCK = 8
SHINGLE = 5
OVERLAP = 0.5
SHARD_ITEMS = 16_384
SHARD_WORDS = 1 << 20
#: Characters of text that a worker reads at once (a longer text is read alone), and entries of block maxima summed at once.
SLICE_CHARS = 512 << 10
SUMMED = 1 << 20
_K1, _B = 1.2, 0.75
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def share(part: list[str], around: list[str]) -> float:
    """Share of part's shingles (of SHINGLE words, or of all its words if fewer) that stand in around."""
    n = min(SHINGLE, len(part))
    own = _shingles(part, n)
    return len(own & _shingles(around, n)) / len(own) if own else 1.0


def question_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def _bags(text: str) -> list[dict[str, int]]:
    """The words of each segment of an item, with their counts."""
    q, a = question_answer(text)
    words, bags = q + a, []
    if words:
        size = -(-len(words) // -(-len(words) // PASSAGE))
        for k in range(0, len(words), size):
            bag: dict[str, int] = {}
            for w in words[k : k + size]:
                bag[w] = bag.get(w, 0) + 1
            bags.append(bag)
    return bags


class Statistics:
    """What BM25 knows of all items: the number of segments, their words, and how many segments hold each word."""

    def __init__(self, texts=()):
        self.segments, self.words = 0, 0
        self.df: dict[str, int] = {}
        for t in texts:
            self.add(t)

    def add(self, text: str) -> None:
        for bag in _bags(text):
            self.segments += 1
            self.words += sum(bag.values())
            for w in bag:
                self.df[w] = self.df.get(w, 0) + 1


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+size[0]-1, first[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)


class Index:
    """Normalised BM25 postings of one shard of items, with block maxima; the statistics are those of all shards (by default, of this one).

    Term t has the postings segment[at[t]:at[t + 1]] with their weights, and the blocks block[block_at[t]:block_at[t + 1]] with their maxima."""

    def __init__(self, items: list[tuple[int, str]], of_all: Statistics | None = None):
        of_all = of_all or Statistics(t for _, t in items)
        self.items = [(i, *question_answer(t)) for i, t in items if words_of(t)]
        self.segments: list[int] = []
        bags: list[dict[str, int]] = []
        for at, t in enumerate(t for _, t in items if words_of(t)):
            own = _bags(t)
            bags += own
            self.segments += [at] * len(own)
        self.term = {w: i for i, w in enumerate(sorted({w for bag in bags for w in bag}))}
        n, mean = of_all.segments, of_all.words / max(1, of_all.segments)
        size = sum(map(len, bags))
        term, segment, weight, k = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size), 0
        for seg, bag in enumerate(bags):
            norm = _K1 * (1 - _B + _B * sum(bag.values()) / mean)
            own = [math.log1p((n - of_all.df[w] + 0.5) / (of_all.df[w] + 0.5)) * tf * (_K1 + 1) / (tf + norm) for w, tf in bag.items()]
            term[k : k + len(own)], segment[k : k + len(own)], weight[k : k + len(own)] = [self.term[w] for w in bag], seg, np.array(own) / math.fsum(own)
            k += len(own)
        order = np.lexsort((segment, term))
        term, self.segment, self.weight = term[order], segment[order], weight[order]
        self.at = _starts(np.bincount(term, minlength=len(self.term)))
        self.blocks = max(1, -(-len(bags) // BLOCK))
        edge = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (self.segment[1:] // BLOCK != self.segment[:-1] // BLOCK))[:size])
        self.block = self.segment[edge] // BLOCK
        self.block_max = np.maximum.reduceat(self.weight, edge) if size else self.weight
        self.block_at = _starts(np.bincount(term[edge], minlength=len(self.term)))
        self.most = np.maximum.reduceat(self.weight, self.at[:-1]) if size else self.weight

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every (segment, score) with a score of at least the threshold, for a set of terms."""
        end = len(self.segments)
        part = lambda array, of, t: array[of[t] : of[t + 1]].tolist()
        lists = [list(zip(part(self.segment, self.at, t), part(self.weight, self.at, t))) for t in terms]
        blocks = [dict(zip(part(self.block, self.block_at, t), part(self.block_max, self.block_at, t))) for t in terms]
        most = [float(self.most[t]) for t in terms]
        at = [0] * len(terms)
        found = []
        order = sorted(range(len(terms)), key=lambda i: lists[i][0][0])
        here = lambda i: lists[i][at[i]][0] if at[i] < len(lists[i]) else end

        def forward(i: int, seg: int) -> None:
            at[i] = bisect.bisect_left(lists[i], (seg,), at[i])

        slack = threshold - 1e-9  # sums in another order may differ so much
        while True:
            total, pivot = 0.0, None
            for k, i in enumerate(order):
                total += most[i]
                if total >= slack:
                    pivot = k
                    break
            if pivot is None or here(order[pivot]) >= end:
                return found
            seg = here(order[pivot])
            while pivot + 1 < len(order) and here(order[pivot + 1]) == seg:
                pivot += 1
            block = seg // BLOCK
            if sum(blocks[i].get(block, 0.0) for i in order[: pivot + 1]) < slack:
                # No segment up to the block's end, or to the next list's place, can reach the threshold.
                skip = min((block + 1) * BLOCK, here(order[pivot + 1]) if pivot + 1 < len(order) else end)
                for i in order[: pivot + 1]:
                    forward(i, max(skip, seg + 1))
            elif here(order[0]) == seg:
                score = math.fsum(lists[i][at[i]][1] for i in order[: pivot + 1])
                if score >= threshold:
                    found.append((seg, score))
                for i in order[: pivot + 1]:
                    at[i] += 1
            else:
                for i in order[:pivot]:
                    forward(i, seg)
            order = sorted((i for i in order if at[i] < len(lists[i])), key=here)

    def _reachable(self, terms: np.ndarray, size: np.ndarray, slack: float) -> np.ndarray:
        """Whether some block's maxima reach the threshold, for sets of distinct terms of the given sizes laid end to end."""
        out = np.zeros(len(size), dtype=bool)
        edge, entries = _starts(size), np.append(0, np.cumsum(self.block_at[terms + 1] - self.block_at[terms]))[_starts(size)]
        a = 0
        while a < len(size):
            z = max(a + 1, min(int(np.searchsorted(entries, entries[a] + SUMMED, side="right")) - 1, a + max(1, SUMMED // self.blocks)))
            own = terms[edge[a] : edge[z]]
            n = self.block_at[own + 1] - self.block_at[own]
            of = np.repeat(np.repeat(np.arange(z - a), size[a:z]), n)
            where = _spread(self.block_at[own], n)
            total = np.bincount(of * self.blocks + self.block[where], weights=self.block_max[where], minlength=(z - a) * self.blocks)
            out[a:z] = total.reshape(z - a, self.blocks).max(1) >= slack
            a = z
        return out

    def hits(self, texts: list[str | None], threshold: float = THRESHOLD) -> list[list[tuple[int, float, float, float]]]:
        """For each text the verified (item_id, score, question share, answer share), by item_id."""
        none, slack = len(self.term), threshold - 1e-9
        numbers = [self._numbers(t) for t in texts]
        size = np.array([len(d) for d in numbers], dtype=np.int64)
        ids = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int32)
        halves = -(-size // HALF)
        first = np.cumsum(halves) - halves
        half = np.repeat(first, size) + (np.arange(len(ids)) - np.repeat(_starts(size)[:-1], size)) // HALF
        keys = np.unique((half * none + ids)[ids < none])
        out: list[dict[int, tuple[int, float, float, float]]] = [{} for _ in texts]
        if not len(keys):
            return [[] for _ in texts]
        n = int(halves.sum())
        term_of, edge = keys % none, np.searchsorted(keys, np.arange(n + 1) * none)
        single = np.bincount(keys // none, weights=self.most[term_of], minlength=n + 1)
        last = np.zeros(n, dtype=bool)
        last[(first + halves - 1)[halves > 0]] = True
        alone = np.zeros(n, dtype=bool)
        alone[first[halves == 1]] = True
        alive = np.flatnonzero((single[:n] + np.where(last, 0, single[1:]) >= slack) & (~last | alone))
        stop = edge[alive + np.where(last[alive], 1, 2)]
        # The distinct terms of each passage: of its two halves together.
        count = stop - edge[alive]
        pairs = np.unique(np.repeat(np.arange(len(alive)), count) * none + term_of[_spread(edge[alive], count)])
        terms, count = pairs % none, np.bincount(pairs // none, minlength=len(alive))
        keep = self._reachable(terms, count, slack)
        begin, owner, words = _starts(count), np.searchsorted(first + halves, alive, side="right"), (None, [])
        for k in np.flatnonzero(keep).tolist():
            d = int(owner[k])
            for seg, score in self.search(terms[begin[k] : begin[k + 1]].tolist(), threshold):
                item, q, a = self.items[self.segments[seg]]
                if item in out[d] and out[d][item][1] >= score:
                    continue
                if words[0] != d:
                    words = d, words_of(texts[d])
                at = (int(alive[k]) - int(first[d])) * HALF
                reach = len(q) + len(a)
                around = words[1][max(0, at - reach) : at + PASSAGE + reach]
                in_q, in_a = share(q, around), share(a, around)
                if in_q >= OVERLAP and in_a >= OVERLAP:
                    out[d][item] = (item, score, in_q, in_a)
        return [[o[k] for k in sorted(o)] for o in out]

    def _numbers(self, text: str | None) -> np.ndarray:
        """The number of each word's term; the number of terms for words of no item."""
        get, none = self.term.get, len(self.term)
        return np.array([get(w, none) for w in words_of(text)], dtype=np.int32)


def _groups(rows: DataFrame):
    """Items within the bounds of a shard; they arrive in order of id, so only one shard is held."""
    held, words = [], 0
    for r in rows.toLocalIterator():
        n = len(words_of(r.text))
        if held and (len(held) >= SHARD_ITEMS or words + n > SHARD_WORDS):
            yield held
            held, words = [], 0
        held.append((r.item_id, r.text))
        words += n
    if held:
        yield held


def _shards(benchmark: DataFrame):
    """Indexes of bounded size, weighted by the statistics of all items: a first pass counts, and a second, if there are several shards, builds."""
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    of_all, first, several = Statistics(), None, False
    for held in _groups(rows):
        for _, text in held:
            of_all.add(text)
        first, several = first or held, first is not None
    for held in _groups(rows) if several else [first] if first else []:
        yield Index(held, of_all)


_HITS = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_share", pa.float64()), ("answer_share", pa.float64())]


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share): every verified hit of every row."""
    found, docs = None, bounded_batches(docs)
    schema = "doc_id long, item_id long, score double, question_share double, answer_share double"
    for index in _shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for part in sliced(batches, 1, SLICE_CHARS):
                hits = shared.value.hits(part.column(1).to_pylist(), threshold)
                rows = [(i, *h) for i, own in zip(part.column(0).to_pylist(), hits) for h in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _HITS)], names=[n for n, _ in _HITS])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def remove(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows without a verified hit, all columns kept; one narrow pass a shard of the index, each stored before the next."""
    n_text, first = bounded_batches(docs).columns.index("text"), True
    for index in _shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for part in sliced(batches, n_text, SLICE_CHARS):
                yield part.filter(pa.array([not h for h in shared.value.hits(part.column(n_text).to_pylist(), threshold)], pa.bool_()))

        docs, first = (docs if first else stored(docs)).mapInArrow(run, docs.schema), False
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
