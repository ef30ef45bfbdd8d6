"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  A text is parsed greedily against each automaton: a phrase
is the longest match from the current place; the language that needs the fewest phrases a character wins.

The automaton is a table of transitions, so all windows of a batch of texts walk it together, one numpy step for a
character place.  Texts are cut into windows of ``WINDOW`` characters that are parsed separately (a phrase ends at a
window's edge, for all languages alike); every character of every text is parsed.

Training takes a bounded sample: at most ``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS`` normalised characters a language (``ALL_CHARS`` over all
languages, so with very many each gets less), picked by a hash of doc_id among all labelled rows, and learned in that order with near copies of earlier
texts last.  Of a document a piece of at most ``SAMPLE_DOC_CHARS`` characters is learned, from a place that the hash sets.  The model's size depends
on those bounds alone, so it may be broadcast.

Defined results.  Text that is null, empty or without a letter gives ``und`` and score 0.  Equal phrase counts go to the language first in
alphabetical order.  With one learned language it always wins with score 1; with none all texts are ``und``.  Repeated rows
each give a row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import bounded_batches, hash_sample, sliced

SAMPLE_DOCS = 200
SAMPLE_CHARS = 24_000
ALL_CHARS = 240_000
#: At most so many characters of one document, so that one text doesn't fill the sample.
SAMPLE_DOC_CHARS = 1_000
#: Texts are near copies if they share half of their strings of so many characters.
NEAR_CHARS = 24
WINDOW = 1024
#: Characters of text that a worker parses at once.
SLICE_CHARS = 2 << 20
UNKNOWN = "und"


@functools.cache
def _is_letter() -> np.ndarray:
    """By code point."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


@functools.cache
def _table() -> np.ndarray:
    """Code point to its lower-case code point for letters, to itself for marks, to 32 for all others."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = ord(chr(c).lower()[0])
        elif kind == "M":
            table[c] = c
    return table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def normalise(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters, with one space for each run of other characters."""
    c = _table()[codes]
    if not len(c):
        return c
    keep = c != 32
    keep[1:] |= c[:-1] != 32
    return c[keep]


def suffix_automaton(codes: list[int], letters: int) -> np.ndarray:
    """Transitions [state, letter] of the suffix automaton of a sequence, -1 where there is none; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.full((len(step), letters), -1, dtype=np.int32)
    for s, moves in enumerate(step):
        for c, t in moves.items():
            table[s, c] = t
    return table


class Model:
    """Automata of the learned languages over a shared alphabet."""

    def __init__(self, texts: dict[str, list[str]], chars: int = SAMPLE_CHARS):
        samples = {}
        for lang, own in sorted(texts.items()):
            parts, n = [], 0
            for t in own:
                p = normalise(_codes(t)[:SAMPLE_DOC_CHARS])
                if n < chars and len(p):
                    parts.append(p[: chars - n])
                    n += len(parts[-1])
            if n:
                samples[lang] = np.concatenate(parts)
        self.langs = list(samples)
        self.alphabet = np.unique(np.concatenate([*samples.values(), np.array([32], dtype=np.uint32)]))
        self.letters = len(self.alphabet) + 1  # the last stands for letters that no sample holds
        # A walk that can't go on ends a phrase and starts again from the root with the same letter; a letter that the root
        # lacks is a phrase by itself.  Each cell holds the next state and, in its two lowest bits, the phrases that ended.
        self.walks = []
        for codes in samples.values():
            table = suffix_automaton(np.searchsorted(self.alphabet, codes).tolist(), self.letters)
            lacks = table[0] < 0
            stuck = np.where(lacks, 2, table[0] * 4 + 1)
            walk = np.where(table >= 0, table * 4, stuck[None, :]).astype(np.int32)
            walk[0, lacks] = 1
            self.walks.append(walk.reshape(-1))

    def _index(self) -> np.ndarray:
        if not hasattr(self, "_at"):
            at = np.full(sys.maxunicode + 1, self.letters - 1, dtype=np.int16)
            at[self.alphabet] = np.arange(len(self.alphabet))
            self._at = at
        return self._at

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_at"}

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases a character [text, language], and whether each text has a letter."""
        index = self._index()
        raw = [_codes(t) if t else np.zeros(0, dtype=np.uint32) for t in texts]
        letters = np.array([bool(_is_letter()[c].any()) for c in raw], dtype=bool)
        docs = [normalise(c) for c in raw]
        size = np.array([len(d) for d in docs], dtype=np.int64)
        flat = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
        flat = index[flat]
        begin = np.cumsum(size) - size
        pieces = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(docs)), pieces)
        offset = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOW
        length = np.minimum(WINDOW, size[owner] - offset)
        order = np.argsort(-length, kind="stable")
        first, length, owner = (begin[owner] + offset)[order], length[order], owner[order]
        alive = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")  # windows with a character at a place
        counts = np.zeros((len(docs), len(self.langs)))
        for k, walk in enumerate(self.walks):
            state = np.zeros(len(first), dtype=np.int64)
            phrases = np.zeros(len(first), dtype=np.int32)
            for place, n in enumerate(alive.tolist()):
                s = walk[state[:n] * self.letters + flat[first[:n] + place]]
                phrases[:n] += s & 3
                state[:n] = s >> 2
            counts[:, k] = np.bincount(owner, weights=phrases + (state > 0), minlength=len(docs))
        return counts / np.maximum(size, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score: how much dearer the second-best parse is, from 0 to 1."""
        rates, letters = self.rates(texts)
        out = []
        for r, n in zip(rates, letters):
            if not n or not self.langs:
                out.append((UNKNOWN, 0.0))
            elif len(r) == 1:
                out.append((self.langs[0], 1.0))
            else:
                best = int(np.argmin(r))
                out.append((self.langs[best], float(1 - r[best] / np.delete(r, best).min())))
        return out


def fit(labelled: DataFrame) -> Model:
    """Learns from rows (doc_id, text, lang) with a non-null lang, by a bounded sample."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    chosen = hash_sample(known, "lang", "doc_id", SAMPLE_DOCS)
    langs = {g for g, *_ in chosen}
    chars = min(SAMPLE_CHARS, ALL_CHARS // max(1, len(langs)))
    # A language with few characters to learn needs few texts; so both ids and texts are bounded over all languages.
    most = -(-SAMPLE_DOCS * chars // SAMPLE_CHARS)
    by: dict[str, list[tuple]] = {}
    for g, k, x in chosen:
        by.setdefault(g, []).append((k, g, x))
    picked = [r for own in by.values() for r in own[: max(1, most)]]
    texts: dict[str, list[tuple]] = {}
    if picked:
        ids = labelled.sparkSession.createDataFrame(picked, "doc_id long, lang string, h long")
        size = 2 * SAMPLE_DOC_CHARS
        piece = F.substring("text", (1 + F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - size + 1))).cast("int"), F.lit(size))
        rows = known.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", piece.alias("text"), F.struct("h", "doc_id").alias("at"))
        for r in rows.groupBy("lang", "text").agg(F.min("at").alias("at")).collect():
            texts.setdefault(r.lang, []).append((*r["at"], r.text))
    return Model({lang: varied([text for *_, text in sorted(own)]) for lang, own in texts.items()}, chars)


def varied(texts: list[str]) -> list[str]:
    """The texts in their order, those last that share half of their learned part's pieces with texts before, so that a group of near copies can't fill the sample."""
    seen: set[bytes] = set()
    new, near = [], []
    for t in texts:
        p = normalise(_codes(t)[:SAMPLE_DOC_CHARS])
        own = {p[i : i + NEAR_CHARS].tobytes() for i in range(max(1, len(p) - NEAR_CHARS + 1))}
        (near if 2 * len(own & seen) >= len(own) else new).append(t)
        seen |= own
    return new + near


def _predict(batches, model):
    for b in sliced(batches, 1, SLICE_CHARS):
        found = model.value.predict(b.column(1).to_pylist())
        cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i) for i in range(2, b.num_columns)], *cols], names=[b.schema.names[0], *b.schema.names[2:], "lang_pred", "score"])


def held_out(doc_id=None):
    """The rows that are not learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.coalesce(doc_id if doc_id is not None else F.col("doc_id"), F.lit(-1)).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns in keep, lang_pred and score of every row."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)
    frame = docs.select("doc_id", "text", *(keep or []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "text")
    return frame.mapInArrow(lambda it: _predict(it, shared), f"{fields}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language can be told, all columns kept; a null lang is filled in."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)
    n_text, n_lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for part in sliced(batches, n_text, SLICE_CHARS):
            found = [f[0] for f in shared.value.predict(part.column(n_text).to_pylist())]
            cols = list(part.columns)
            cols[n_lang] = pa.array([own if own is not None else new for own, new in zip(cols[n_lang].to_pylist(), found)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(pa.array([f != UNKNOWN for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["held_out"])
