"""Removal of repeated passages by longest-previous-factor arrays.

The longest previous factor (LPF) of a place is the longest string that starts there and also starts at an earlier place; in suffix order it is
found at the previous or the next place that is smaller.  Its mirror image (LNF) looks at later places.  A string of ``length`` bytes is repeated
exactly if one of the two reaches ``length``.  One suffix array of a whole corpus isn't distributable, so the corpus is first dealt out so
that equal strings meet:

1. Anchors.  Every string of ``least`` bytes is assigned to its anchor, the leftmost smallest hash of its ``GRAM``-byte grams.  Equal strings have
   equal anchors.  The places assigned to one anchor are a run, so a text is a sequence of about least / 2 byte long runs.
2. Only anchors that occur twice matter.  Which do is counted over all texts (two hashes a key, on the map side first); the result is a
   bit filter of bounded size.  A false positive ships a run in vain and changes no result.
3. The bytes of those runs (to ``length`` bytes after each place) go to the anchor's bucket; equal runs are collapsed on the map side and
   again there.  A run with several places of origin is repeated throughout.  Where an anchor has several different runs, the places whose first
   ``least`` bytes are unique are dropped, the rest is put in suffix order to the depths ``least`` and ``length``, and LPF and LNF of every place come from the
   previous and next smaller (larger) places in that order.
   Suffix order to two depths is all that two thresholds need: suffixes stand together if their first ``least`` bytes are equal, and within
   these if their first ``length`` bytes are.  Bytes are compared by 64-bit fingerprints, so a match is exact but for collisions.
4. The places whose factors reach ``length`` are merged to spans and joined to the texts.  Those that reach ``least`` give the passages: maximal
   runs of more than ``PASSAGE_WORDS`` words that also stand elsewhere.  They are counted, and removed only where they reach ``length``.

Equal texts are one text with a count: all copies share one result, and a text that occurs twice is repeated throughout.

Scale and skew.  A bucket is worked through an anchor at a time, in chunks of ``CHUNK`` bytes.  Equal runs of one anchor shrink to one on the map side, so a
passage that very many texts share costs one run a task and the two runs at its edges, which differ from text to text: those meet in one group
(at most ``least`` places of each text that holds the passage).

Defined results.  Null text is empty.  Texts shorter than ``length`` lose nothing, texts shorter than ``least`` hold no passage.  With keep_first=False (the
query) every occurrence of a repeated string goes; with keep_first=True the first stays: of equal texts the rows of the smallest doc_id, of other
matches the first by (MD5 of the text, place).  Repeated rows are copies like any others.  Extra columns are ignored.  A null doc_id gives a row like any
other.  Matches never cross texts; overlaps count; strings are judged on the input.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import bounded_batches, sliced, stored, trim, trimmed

LENGTH = 400
#: The shortest string that is looked at, in bytes, and how many words a passage has more than.
LEAST = 200
PASSAGE_WORDS = 50
GRAM = 32
#: Bits of the filter: 16 a shared anchor, and at most so many (32 MB).
FILTER_BITS = 1 << 28
#: Shared anchors a bucket, about.
PER_BUCKET = 8_192
#: Bytes of runs that are ranked together (one anchor's runs may be more).
CHUNK = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * _MUL))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each gram; gram is a power of two."""
    h, step = _BYTE[data], 1
    while step < gram:
        h = h[:-step] * np.uint64(2 * step + 0x9E3779B1) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return _mix(h * _MUL)


_PLACE = np.uint64((1 << 18) - 1)


def anchors(data: np.ndarray, length: int = LEAST, gram: int = GRAM, piece: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, places) of each run of places with one anchor; the runs cover 0 .. len - length.

    Texts are read in pieces, so that what is held at eight bytes a byte stays small; a run may be cut at a piece's edge."""
    out, w = [], length - gram + 1
    for begin in range(0, len(data) - length + 1, piece):
        h = gram_hashes(data[begin : begin + piece + length - 1], gram)
        n = len(h) - w + 1
        # The smallest (hash, place) of each window: of the end of one block of w and the start of the next.
        v = np.full(-(-len(h) // w) * w, ~np.uint64(0))
        v[: len(h)] = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        v = v.reshape(-1, w)
        ends = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        starts = np.minimum.accumulate(v, axis=1).reshape(-1)
        at = (np.minimum(ends[:n], starts[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)
        edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out.append((h[at[edge]], begin + edge, np.diff(np.append(edge, n))))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _texts(batches, seen_most: int = 50_000):
    """(key of the text, bytes) of the texts not seen lately in this task."""
    seen: dict[bytes, None] = {}
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k in seen:
                continue
            seen[k] = None
            if len(seen) > seen_most:
                del seen[next(iter(seen))]
            yield k, t.encode("utf-8", "surrogatepass")


def _half(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _keys(batches, least: int):
    """Rows (key, text, repeats): an anchor of a text, and whether the text holds it twice."""
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush():
        size = [len(x) for x in held]
        keys, texts = np.concatenate(held), np.repeat(np.array(owner, dtype=np.int64), size)
        order = np.lexsort((keys, texts))
        keys, texts = keys[order], texts[order]
        edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])))
        twice = np.diff(np.append(edge, len(keys))) > 1
        return pa.RecordBatch.from_arrays([pa.array(keys[edge].view(np.int64)), pa.array(texts[edge]), pa.array(twice)], names=["key", "owner", "twice"])

    n = 0
    for k, raw in _texts(batches):
        held.append(anchors(np.frombuffer(raw, dtype=np.uint8), least)[0])
        owner.append(_half(k))
        n += len(held[-1])
        if n >= 100_000:
            yield flush()
            held, owner, n = [], [], 0
    if n:
        yield flush()


def _bit(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a = _mix(keys * np.uint64(0xA24BAED4963EE407))
    return (a & np.uint64(bits - 1)).astype(np.int64), ((a >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


_SEGMENT = 1 << 16


def _filter(shared: DataFrame, bits: int) -> np.ndarray:
    """A bit filter of the shared anchors.  It is joined by segment on the executors; the driver receives its bits / 8 bytes."""

    def places(batches):
        for b in batches:
            at = np.unique(np.concatenate(_bit(b.column(0).to_numpy().view(np.uint64), bits)))
            cut = np.flatnonzero(np.append(True, at[1:] // _SEGMENT != at[:-1] // _SEGMENT))
            parts = np.split((at % _SEGMENT).astype("<u2"), cut[1:])
            yield pa.RecordBatch.from_arrays([pa.array((at[cut] // _SEGMENT).astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "places"])

    def whole(table: pa.Table) -> pa.Table:
        own = np.zeros(_SEGMENT, dtype=bool)
        for p in table.column("places").to_pylist():
            own[np.frombuffer(p, dtype="<u2")] = True
        return pa.table({"segment": table.column("segment").slice(0, 1), "places": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in shared.mapInArrow(places, "segment int, places binary").groupBy("segment").applyInArrow(whole, "segment int, places binary").toLocalIterator():
        out[r.segment * (_SEGMENT // 8) :][: _SEGMENT // 8] = np.frombuffer(r.places, dtype=np.uint8)[: bits // 8]
    return out


#: A run: its anchor, places, bytes, and the places that it stands at (text and first place).
_RUN = np.dtype([("key", "<u8"), ("places", "<i4"), ("size", "<i4"), ("refs", "<i4")])
_REF = np.dtype([("text", "V16"), ("first", "<i8")])


def _runs(batches, shared, bits: int, buckets: int, least: int, length: int):
    """Rows (bucket, runs, refs, bytes): the bytes of the runs whose anchor the filter holds; equal runs of a batch once, with all their places."""
    held: dict[tuple[int, int, int, bytes], list[tuple[bytes, int]]] = {}
    size = 0

    def flush():
        by: dict[int, list] = {}
        for (b, key, places, raw), refs in held.items():
            by.setdefault(b, []).append(((key, places, len(raw), len(refs)), refs, raw))
        rows = [(b, np.array([x[0] for x in own], dtype=_RUN).tobytes(), np.array([r for x in own for r in x[1]], dtype=_REF).tobytes(), b"".join(x[2] for x in own)) for b, own in by.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "runs", "refs", "bytes"])

    table = shared.value
    for k, raw in _texts(batches):
        keys, first, places = anchors(np.frombuffer(raw, dtype=np.uint8), least)
        a, b = _bit(keys, bits)
        hit = np.flatnonzero((table[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (table[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1)
        to = (_mix(keys[hit]) % np.uint64(buckets)).astype(np.int64)
        for b, key, at, n in zip(to.tolist(), keys[hit].tolist(), first[hit].tolist(), places[hit].tolist()):
            part = raw[at : at + n - 1 + length]
            refs = held.setdefault((b, key, n, part), [])
            if not refs:
                size += len(part) + 100
            refs.append((k, at))
            size += 24
        if size >= (16 << 20):
            yield flush()
            held, size = {}, 0
            trim()
    if size:
        yield flush()


_INVERSE = np.uint64(pow(int(_MUL), -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the fingerprints' base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_MUL, _INVERSE):
            x = np.full(1 << (n - 1).bit_length(), base, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers = tuple(made)
    return _powers


class _Prints:
    """Polynomial fingerprints of the strings of some bytes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.total[1:])

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.total[at + length] - self.total[at]) * self.inverse[at])


def nearest_smaller(places: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest entry before it that is smaller, or -1: pointers jump over what is larger, twice as far each round."""
    n = len(places)
    value = np.append(places, np.iinfo(np.int64).min)  # the last entry, -1, is smaller than all
    prev = np.append(np.arange(-1, n - 1), -1)
    open_ = np.flatnonzero(value[prev[:n]] > places)
    while len(open_):
        prev[open_] = prev[prev[open_]]
        open_ = open_[value[prev[open_]] > places[open_]]
    return prev[:n]


def factors(prints: _Prints, at: np.ndarray, room: np.ndarray, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(LPF, LNF) of the places at, in order, to the depths: the greatest depth that the longest match with an earlier (later) of these places
    reaches, or 0.  From each place room bytes may be read, and at least the first depth."""
    keys = []
    for d in depths:
        key = _mix(at.astype(np.uint64) * _MUL + np.uint64(d))  # where there is no room nothing is equal
        enough = np.flatnonzero(room >= d)
        key[enough] = prints(at[enough], d)
        keys.append(key)
    sa = np.lexsort(keys[::-1])  # stable: suffixes equal to the last depth stand in order of place
    keys = [k[sa] for k in keys]
    steps = np.diff([0, *depths])
    out = []
    for order in (sa, -sa):
        best = np.zeros(len(at), dtype=np.int64)
        for near in (nearest_smaller(order), len(sa) - 1 - nearest_smaller(order[::-1])[::-1]):
            own = np.flatnonzero((near >= 0) & (near < len(sa)))
            other, reach, same = near[own], np.zeros(len(own), dtype=np.int64), np.ones(len(own), dtype=bool)
            for step, key in zip(steps, keys):
                same &= key[own] == key[other]
                reach += step * same
            best[sa[own]] = np.maximum(best[sa[own]], reach)
        out.append(best)
    return out[0], out[1]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+size[0]-1, first[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)


def _repeated(work: list[tuple[bytes, int]], depths: list[int], keep_first: bool):
    """For runs (bytes, places) of which several share an anchor, in order: (run, depth, first, stop) of places whose factor reaches the depth."""
    size, places = np.array([len(raw) for raw, _ in work]), np.array([n for _, n in work])
    begin = np.cumsum(size) - size
    prints = _Prints(np.frombuffer(b"".join(raw for raw, _ in work), dtype=np.uint8))
    at = _spread(begin, places)
    # Places whose first bytes are unique have no factor.
    first = prints(at, depths[0])
    order = np.argsort(first)
    same = first[order][1:] == first[order][:-1]
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    run, at = np.repeat(np.arange(len(work)), places)[again], at[again]
    lpf, lnf = factors(prints, at, (begin + size)[run] - at, depths)
    reach = lpf if keep_first else np.maximum(lpf, lnf)
    for depth in depths:
        hit = np.flatnonzero(reach >= depth)
        if len(hit):
            new = np.append(True, (np.diff(at[hit]) > 1) | (np.diff(run[hit]) > 0))
            edge = np.flatnonzero(new)
            w, x = run[hit][edge], (at[hit] - begin[run[hit]])[edge]
            yield from zip(w.tolist(), [depth] * len(w), x.tolist(), (x + np.diff(np.append(edge, len(hit)))).tolist())


def _matches(table: pa.Table, least: int, length: int, keep_first: bool) -> pa.Table:
    """Step 3, in a bucket: rows (text, depth, first, stop) of places that match elsewhere (with keep_first: earlier, by text key and place)."""
    groups: dict[int, dict[tuple[int, bytes], set[tuple[bytes, int]]]] = {}
    for runs, refs, data in zip(*(table.column(c).to_pylist() for c in ("runs", "refs", "bytes"))):
        own, refs = np.frombuffer(runs, dtype=_RUN), np.frombuffer(refs, dtype=_REF)
        origin = list(zip((t.tobytes() for t in refs["text"]), refs["first"].tolist()))
        at = ref = 0
        for key, places, size, n in own.tolist():
            groups.setdefault(key, {}).setdefault((places, data[at : at + size]), set()).update(origin[ref : ref + n])
            at, ref = at + size, ref + n
    found: list[tuple[bytes, int, int, int]] = []
    work: list[tuple[bytes, int, list[tuple[bytes, int]]]] = []
    depths = sorted({least, length})

    def rank() -> None:
        work.sort(key=lambda w: w[2][0])
        for w, depth, x, y in _repeated([(raw, places) for raw, places, _ in work], depths, keep_first):
            found.extend((text, depth, first + x, first + y) for text, first in work[w][2])
        work.clear()

    held = 0
    for variants in groups.values():
        own = [(raw, places, sorted(refs)) for (places, raw), refs in variants.items()]
        for raw, places, refs in own:
            if len(refs) > 1:
                for depth in depths:
                    if (stop := min(places, len(raw) - depth + 1)) > 0:
                        found += [(text, depth, first, first + stop) for text, first in (refs[1:] if keep_first else refs)]
        if len(own) > 1:
            work += own
            held += sum(len(raw) for raw, *_ in own)
            if held >= CHUNK:
                rank()
                held = 0
    if work:
        rank()
    cols = list(zip(*found)) or [(), (), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("text_key", "depth", "first", "stop"), cols, (pa.binary(), pa.int32(), pa.int64(), pa.int64()))})


def matched_places(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, least: int | None = None) -> DataFrame:
    """(text_key, depth, first, stop): runs of places whose next depth bytes occur elsewhere in a different text, or elsewhere in the same; depth is
    length or least."""
    least = min(length, LEAST) if least is None else least
    spark = bounded_batches(docs).sparkSession
    texts = docs.where(F.octet_length("text") >= least).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    keys = texts.mapInArrow(lambda it: _keys(it, least), "key long, owner long, twice boolean")
    shared = stored(keys.groupBy("key").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.max("twice").alias("t")).where("a <> b or t").select("key"))
    n = shared.count()
    bits = min(FILTER_BITS, max(_SEGMENT, 1 << (16 * max(1, n)).bit_length()))
    buckets = max(64, -(-n // PER_BUCKET))
    table = spark.sparkContext.broadcast(_filter(shared, bits))
    runs = texts.mapInArrow(lambda it: _runs(it, table, bits, buckets, least, length), "bucket int, runs binary, refs binary, bytes binary")
    return runs.groupBy("bucket").applyInArrow(trimmed(lambda t: _matches(t, least, length, keep_first)), "text_key binary, depth int, first long, stop long")


def _passages(raw: bytes, places: list[tuple[int, int]], least: int) -> int:
    """How many maximal runs of places, with the least bytes after the last, hold more than PASSAGE_WORDS whole words."""
    merged: list[list[int]] = []
    for first, stop in sorted(places):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([first, stop])
    n = 0
    for first, stop in merged:
        stop += least - 1
        words = len(raw[first:stop].split())
        words -= first > 0 and raw[first - 1 : first].strip() != b"" and raw[first : first + 1].strip() != b""
        words -= stop < len(raw) and raw[stop - 1 : stop].strip() != b"" and raw[stop : stop + 1].strip() != b""
        n += words > PASSAGE_WORDS
    return n


def _cut(batches, length: int, least: int, keep_bytes: bool):
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()] + [pa.binary()] * keep_bytes
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept"][: len(kinds)]
    for b in sliced(batches, 1, 2 << 20):
        out = []
        for doc_id, text, whole, spans in zip(*(b.column(i).to_pylist() for i in range(4))):
            raw = text.encode("utf-8", "surrogatepass")
            spans = [(0, len(raw) - d + 1, d) for d in {length, least} if d <= len(raw)] if whole else [(x["first"], x["stop"], x["depth"]) for x in spans or ()]
            merged: list[list[int]] = []
            for a, z in sorted((first, stop - 1 + length) for first, stop, depth in spans if depth == length):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            parts, at = [], 0
            for a, z in merged:
                parts.append(raw[at:a])
                at = z
            kept = b"".join([*parts, raw[at:]])
            passages = _passages(raw, [(first, stop) for first, stop, depth in spans if depth == least], least)
            out.append((doc_id, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), passages, kept)[: len(kinds)])
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, keep_first: bool = False, raw: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages) of every row, with raw=True also kept binary: every byte covered by a repeated
    string of length bytes goes, or with keep_first only by one that an earlier place holds.  n_passages counts the repeated passages of more than
    PASSAGE_WORDS words and at least ``LEAST`` bytes."""
    least = min(length, LEAST)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    places = matched_places(docs, length, keep_first, least)
    spans = places.groupBy("text_key").agg(F.collect_list(F.struct("first", "stop", "depth")).alias("spans"))
    keyed = docs.withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    long = keyed.where(F.octet_length("text") >= least)
    copies = long.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    what = copies.join(spans, "text_key", "full")
    found = long.join(what, "text_key", "left")
    whole = F.coalesce((F.col("copies") > 1) & (F.lit(not keep_first) | ~F.col("doc_id").eqNullSafe(F.col("first_id"))), F.lit(False))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * raw
    done = found.select("doc_id", "text", whole.alias("whole"), "spans").mapInArrow(lambda it: _cut(it, length, least, raw), schema)
    size = F.octet_length("text").cast("long")
    short = docs.where(F.octet_length("text") < least)
    none = F.lit(0).cast("long")
    kept = [F.col("text").cast("binary").alias("kept")] * raw
    return done.unionByName(short.select("doc_id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), none.alias("n_passages"), *kept))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
