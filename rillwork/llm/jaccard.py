"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct five-word shingles (64-bit hashes).  Documents with equal sets form a class, and classes are joined.

1. Shared shingles.  Tokens go to token buckets, packed by class.  A bucket knows the exact document frequency of its tokens;
   those that no other class holds can't be part of an intersection and end here (they still count in the set's size).
2. Prefixes.  In a global order by frequency (unshared tokens first), two sets can link only if they share a token among the first
   n - ceil(0.75 n) + 1 of each.  Classes whose prefix is all unshared are finished; that is most of them.
3. Candidate clusters.  In each list of a prefix token, postings are kept in blocks by size, each with the bound that positions set: where i
   tokens stand before a posting, at most n - i can be shared, which bounds the size of its partners, and blocks beyond are skipped at once.  Compatible neighbours are joined to clusters,
   inside each task first, so that what is shuffled of a list is one interval a task.
4. Verification.  Within a cluster a set's overlaps with all others are derived from those of the most similar of the last ``KNOWN`` sets
   done, by walking the lists of the differing tokens only (sets are taken by size, so near copies follow each other; a set that resembles none of
   them walks all its lists).  Clusters of more than ``BLOCK`` classes are verified in blocks, then by classes that
   stand for the components found so far, and in pairs of blocks only where several components are left.
5. Verified links are joined to components by star contraction.

Every pair of texts at or above the threshold ends in one component; no list, cluster or class is capped.

Scale and skew.  Copies collapse to a class inside each batch.  A token held by many classes of one batch is known to be shared: only a
mark of it is sent to its bucket, and not its classes.  Shuffles carry packed bytes in proportion to the text.

Defined results.  Words are maximal runs without ASCII white space, A-Z lower-cased.  Fewer than five words: the whole sequence is one shingle.  Null, empty and blank
texts have no shingles and link with nothing, also not with each other.  A null doc_id is kept, and is the component of a row only if nothing else is linked.  Repeated rows each
give a row.  Extra columns are ignored.  Hash collisions (chance about 2**-54 for a pair of tokens that meet in a bucket) are the only
departure from exactness.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import bounded_batches, components, stored, trim, trimmed

WORDS = 5
#: Percent.
THRESHOLD = 75
#: Classes verified together.
BLOCK = 512
#: Sets whose overlaps are kept to derive others from.
KNOWN = 8
#: A token in so many classes of one batch is sent as a mark.
HOT = 24
BATCH_CHARS = 4 << 20
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Documents a bucket, about; the number of buckets is a power of two that grows with the input (2**24 buckets are 34 thousand million documents).
PER_BUCKET = 2048
_LEAST_BITS, _MOST_BITS = 6, 24
#: A token is the top 54 bits of its hash, the bucket's bits first; a key has the frequency (8 bits) above it.
_TOKEN_BITS = 54
_DF_MOST = 255

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_ODD, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers = tuple(made)
    return _powers


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):  # in pieces that end at white space: what is held at eight bytes a byte of text stays small
        end = min(len(data), at + PIECE)
        while end < len(data) and not _WHITE[data[end - 1]]:
            rest = np.flatnonzero(_WHITE[data[end : end + PIECE]])
            end = end + int(rest[0]) + 1 if len(rest) else min(len(data), end + PIECE)
        own = data[at:end]
        white = _WHITE[own]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        first = edge if white[0] else np.append(0, edge)
        start, stop = first[0::2], first[1::2]
        power, inverse = _power_tables(len(own) + 1)
        total = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[own] * power[: len(own)], out=total[1:])
        hashes.append(_mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        starts.append(start + at)
        at = end
    word, start = np.concatenate(hashes), np.concatenate(starts)
    edges = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    count = np.diff(edges)
    n = len(word)
    gram = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        gram[: max(0, n - k)] += word[k:] * _power_tables(64)[0][2 * k + 1]
    gram = _mix(gram + np.uint64(words))
    out = []
    for d, (a, c) in enumerate(zip(edges.tolist(), count.tolist())):
        if c >= words:
            out.append(np.unique(gram[a : a + c - words + 1]))
        elif c:
            h = np.full(1, c, dtype=np.uint64)
            for k in range(a, a + c):
                h = _mix(h * _ODD + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


# Rows between the steps: bucket, kind, doc_id, n, class and a packed blob.
_ROW = "bucket int, kind int, doc_id long, n long, class long, blob binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = ["bucket", "kind", "doc_id", "n", "class", "blob"]
DOC, TOKENS, MARKS, SHARED, SET = range(5)
_GROUP = np.dtype([("class", "<i8"), ("n", "<i4"), ("count", "<i4")])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], names=_NAMES)


def _pack(classes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> bytes:
    """Tokens in class order: runs of (class, n, count), then six bytes a token (48 bits), then the byte above."""
    edge = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    head = np.zeros(len(edge), dtype=_GROUP)
    head["class"], head["n"], head["count"] = classes[edge], sizes[edge], np.diff(np.append(edge, len(classes)))
    low = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return len(edge).to_bytes(4, "little") + head.tobytes() + low.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The runs' heads, and the tokens in their order."""
    k = int.from_bytes(blob[:4], "little")
    head = np.frombuffer(blob, dtype=_GROUP, count=k, offset=4)
    low = np.frombuffer(blob, dtype=np.uint8, offset=4 + k * _GROUP.itemsize).reshape(-1, 6)
    tokens = np.zeros((len(low), 8), dtype=np.uint8)
    tokens[:, :6] = low
    return head, tokens.view("<u8").reshape(-1)


def _bucket_low(token: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and what is left below it (48 bits at most)."""
    return (token >> np.uint64(_TOKEN_BITS - bits)).astype(np.int64), token & np.uint64((1 << (_TOKEN_BITS - bits)) - 1)


def _by_value(values: np.ndarray, order: np.ndarray):
    """(value, its part of order) for each value of the sorted values."""
    edge = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(values)]):
        yield int(values[a]), order[a:z]


def _split(batches, words: int, bits: int):
    """Step 1, before the shuffle: rows of documents, and each batch's tokens by bucket."""
    turn, buckets = 0, 1 << bits

    def emit(ids, texts, names):
        nonlocal turn
        sets = shingle_sets(texts, words)
        rows, seen = [], {}
        for i, s, name in zip(ids, sets, names):
            c = class_of(s) if len(s) else None
            rows.append((turn % buckets, DOC, i, len(s), c, name))
            turn += 1
            if c is not None:
                seen.setdefault(c, s)
        if seen:
            own = sorted(seen)
            size = np.array([len(seen[c]) for c in own])
            token = np.concatenate([seen[c] for c in own]) >> np.uint64(64 - _TOKEN_BITS)
            classes, sizes = np.repeat(np.array(own, dtype=np.int64), size), np.repeat(size, size)
            order = np.argsort(token, kind="stable")
            edge = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))
            df = np.diff(np.append(edge, len(token)))
            hot = np.zeros(len(token), dtype=bool)
            hot[order] = np.repeat(df >= HOT, df)
            to, low = _bucket_low(token[order][edge][df >= HOT], bits)
            for b in np.unique(to).tolist():
                rows.append((b, MARKS, None, None, None, low[to == b].astype("<u8").tobytes()))
            if hot.any():
                rows += _shared_rows(classes[hot], sizes[hot], np.uint64(_DF_MOST << _TOKEN_BITS) | token[hot], turn, buckets)
            to, low = _bucket_low(token, bits)
            order = np.flatnonzero(~hot)
            order = order[np.argsort(to[order], kind="stable")]
            for b, at in _by_value(to[order], order):
                rows.append((b, TOKENS, None, None, None, _pack(classes[at], sizes[at], low[at])))
        return _table(rows)

    held, chars = [], 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(3))):
            held.append(row)
            chars += len(row[1] or "") + 100
            if chars >= BATCH_CHARS:
                yield emit(*zip(*held))
                held, chars = [], 0
                trim()
    if held:
        yield emit(*zip(*held))
    trim()


def _shared_rows(classes, sizes, keys, spread: int, buckets: int) -> list[tuple]:
    """Packed keys of classes, by class bucket (in n; the row's own bucket only spreads it)."""
    to = (classes.view(np.uint64) & np.uint64(buckets - 1)).astype(np.int64)
    order = np.lexsort((classes, to))
    rows = []
    for c, at in _by_value(to[order], order):
        own, n, key = classes[at], sizes[at], keys[at]
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        head = np.zeros(len(edge), dtype=_GROUP)
        head["class"], head["n"], head["count"] = own[edge], n[edge], np.diff(np.append(edge, len(own)))
        rows.append(((spread + c) % buckets, SHARED, None, c, None, len(edge).to_bytes(4, "little") + head.tobytes() + key.astype("<u8").tobytes()))
    return rows


def _unpack_keys(blob: bytes):
    k = int.from_bytes(blob[:4], "little")
    head = np.frombuffer(blob, dtype=_GROUP, count=k, offset=4)
    return head, np.frombuffer(blob, dtype="<u8", offset=4 + k * _GROUP.itemsize)


def _by_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.compute.equal(table.column("kind"), kind))


def _share(table: pa.Table, bits: int) -> pa.Table:
    """Step 1, in a token bucket: keys (frequency, bucket, token) of the tokens that two classes or more hold."""
    import pyarrow.compute  # noqa: F401

    passing = [_by_kind(table, DOC), _by_kind(table, SHARED)]
    parts = [_unpack(x) for x in _by_kind(table, TOKENS).column("blob").to_pylist()]
    rows = []
    if parts:
        b = table.column("bucket")[0].as_py()
        marked = [np.frombuffer(x, dtype="<u8") for x in _by_kind(table, MARKS).column("blob").to_pylist()]
        marks = np.unique(np.concatenate(marked)) if marked else np.zeros(0, dtype=np.uint64)
        heads, token = np.concatenate([h for h, _ in parts]), np.concatenate([t for _, t in parts])
        del parts
        run_of = np.repeat(np.arange(len(heads), dtype=np.int32), heads["count"])
        order = np.argsort(token, kind="stable")
        run_of, token = run_of[order], token[order]
        del order
        edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        run = np.diff(np.append(edge, len(token)))
        several = run >= 2
        if len(marks):
            several |= np.isin(token[edge], marks)
        keep = np.repeat(several, run)
        run_of, token = run_of[keep], token[keep]
        classes, sizes = heads["class"][run_of], heads["n"][run_of]
        order = np.lexsort((classes, token))  # now few: order by class too, to drop the copies from other batches
        classes, sizes, token = classes[order], sizes[order], token[order]
        new = np.append(True, (token[1:] != token[:-1]) | (classes[1:] != classes[:-1]))[: len(token)]
        classes, sizes, token = classes[new], sizes[new], token[new]
        if len(token):
            edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            run = np.diff(np.append(edge, len(token)))
            df = np.minimum(run, _DF_MOST)
            if len(marks):
                df[np.isin(token[edge], marks)] = _DF_MOST
            df = np.repeat(df, run).astype(np.uint64)
            keep = df >= 2
            key = (df << np.uint64(_TOKEN_BITS)) | np.uint64(b << (_TOKEN_BITS - bits)) | token
            rows = _shared_rows(classes[keep], sizes[keep], key[keep], b, 1 << bits)
    out = pa.concat_tables([*passing, pa.Table.from_batches([_table(rows)])]).combine_chunks()
    # Shared keys go on to their class's bucket.
    to = pa.compute.if_else(pa.compute.equal(out.column("kind"), SHARED), out.column("n").cast(pa.int32()), out.column("bucket"))
    return out.set_column(0, "bucket", to)


def prefix_length(n):
    """How many tokens of a set of n are to be looked at."""
    return n - -(-n * THRESHOLD // 100) + 1


def _live(table: pa.Table) -> pa.Table:
    """Step 2, in a class bucket: the sets (shared keys only, in order) of classes that may link."""
    import pyarrow.compute  # noqa: F401

    rows = []
    parts = [_unpack_keys(x) for x in _by_kind(table, SHARED).column("blob").to_pylist()]
    if parts:
        classes = np.concatenate([np.repeat(h["class"], h["count"]) for h, _ in parts])
        sizes = np.concatenate([np.repeat(h["n"], h["count"]) for h, _ in parts])
        keys = np.concatenate([k for _, k in parts])
        order = np.lexsort((keys, classes))
        classes, sizes, keys = classes[order], sizes[order], keys[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1]))[: len(keys)]
        classes, sizes, keys = classes[new], sizes[new], keys[new]
        edge = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
        stop = np.append(edge[1:], len(classes))
        n = sizes[edge]
        for a, z, m, c in zip(edge.tolist(), stop.tolist(), n.tolist(), classes[edge].tolist()):
            if m - (z - a) < prefix_length(m):
                rows.append((0, SET, None, m, c, keys[a:z].astype("<u8").tobytes()))
    return pa.concat_tables([_by_kind(table, DOC), pa.Table.from_batches([_table(rows)])]).combine_chunks()


class _Union:
    """Disjoint sets; the root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self):
        return [(x, self.find(x)) for x in self.up if self.find(x) != x]


_INTERVAL = np.dtype([("key", "<u8"), ("low", "<i8"), ("high", "<i8"), ("class", "<i8")])


def _chains(p: np.ndarray, union: _Union) -> np.ndarray:
    """Joins the intervals of each key that are of compatible size, and returns the joined intervals.

    An interval is a block of postings: its smallest size, and the largest size of a partner that a posting of it may have by its size and position.
    Two sets that link do so in the list of their first shared token, where the larger is no larger than the smaller's bound; so a block that
    begins above all bounds before it skips everything before."""
    p = p[np.lexsort((p["low"], p["key"]))]
    if not len(p):
        return p
    edge = np.flatnonzero(np.append(True, p["key"][1:] != p["key"][:-1]))
    # The largest bound up to each posting of a key, by adding the key's rank times more than any size.
    rank = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(p))))
    reach = np.maximum.accumulate(p["high"] + rank * (1 << 40)) - rank * (1 << 40)
    same = np.append(False, (p["key"][1:] == p["key"][:-1]) & (p["low"][1:] <= reach[:-1]))
    for i in np.flatnonzero(same).tolist():
        union.join(int(p["class"][i - 1]), int(p["class"][i]))
    first = np.flatnonzero(~same)
    out = p[first].copy()
    out["high"] = np.maximum.reduceat(p["high"], first)
    return out


def _postings(batches, buckets: int):
    """Step 3, before the shuffle: prefix postings, chained within the task; rows (bucket, kind 0 intervals / 1 edges, blob)."""

    def emit(n, classes, sets):
        union = _Union()
        parts = []
        for m, c, s in zip(n, classes, sets):
            keys = np.frombuffer(s, dtype="<u8")
            unshared = m - len(keys)
            k = min(len(keys), prefix_length(m) - unshared)
            # By position: where the first shared token has i before it at most m - i can be shared, which bounds a partner's size.
            left = m - unshared - np.arange(k)
            own = np.zeros(k, dtype=_INTERVAL)
            own["key"], own["low"], own["high"], own["class"] = keys[:k], m, left * (100 + THRESHOLD) // THRESHOLD - m, c
            parts.append(own)
        p = _chains(np.concatenate(parts), union)
        to = (_mix(p["key"]) & np.uint64(buckets - 1)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        rows = [(b, 0, p[at].tobytes()) for b, at in _by_value(to[order], order)]
        pairs = np.array(union.edges(), dtype="<i8").reshape(-1, 2)
        for b in range(min(buckets, len(pairs))):
            mine = pairs[b::buckets]
            if len(mine):
                rows.append((b, 1, mine.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])

    held, size = [], 0
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(3))):
            held.append(r)
            size += len(r[2])
            if size >= (16 << 20):
                yield emit(*zip(*held))
                held, size = [], 0
    if held:
        yield emit(*zip(*held))


def _candidates(table: pa.Table) -> pa.Table:
    """Step 3, in a bucket of prefix tokens: a spanning forest of the candidate pairs."""
    union = _Union()
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    parts = [np.frombuffer(x, dtype=_INTERVAL) for k, x in zip(kinds, blobs) if k == 0]
    for k, x in zip(kinds, blobs):
        if k == 1:
            for a, b in np.frombuffer(x, dtype="<i8").reshape(-1, 2).tolist():
                union.join(a, b)
    if parts:
        _chains(np.concatenate(parts), union)
    pairs = np.array(union.edges(), dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def link_cluster(classes: list[int], n: np.ndarray, sets: list[np.ndarray], union: _Union) -> None:
    """Step 4: joins every pair of the cluster at or above the threshold."""
    m = len(classes)
    need = lambda i, j, both: 100 * both >= THRESHOLD * (n[i] + n[j] - both)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if need(0, 1, both):
            union.join(classes[0], classes[1])
        return
    size = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum(size)[:-1]
    own = np.split(token, cut)
    holder = np.repeat(np.arange(m), size)
    by_token = holder[np.argsort(token, kind="stable")]
    at = np.append(0, np.cumsum(np.bincount(token)))

    def walk(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each class holds."""
        length = at[tokens + 1] - at[tokens]
        ends = np.cumsum(length)
        if not len(ends):
            return np.zeros(m, dtype=np.int64)
        place = np.arange(ends[-1]) - np.repeat(ends - length, length) + np.repeat(at[tokens], length)
        return np.bincount(by_token[place], minlength=m)

    known: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(n, kind="stable").tolist():
        best = max(known, key=lambda k: k[1][i], default=None)
        if best is not None and 2 * (size[i] + size[best[0]] - 2 * best[1][i]) < size[i]:
            other = own[best[0]]
            both = best[1] + walk(np.setdiff1d(own[i], other, assume_unique=True)) - walk(np.setdiff1d(other, own[i], assume_unique=True))
        else:
            both = walk(own[i])
        known = [*known[1 - KNOWN :], (i, both)]
        for j in np.flatnonzero(100 * both >= THRESHOLD * (n[i] + n - both)).tolist():
            if j != i:
                union.join(classes[i], classes[j])


def _verify(table: pa.Table) -> pa.Table:
    """Step 4: links of the clusters of a bin, as a spanning forest."""
    union = _Union()
    cluster, part = table.column("cluster").to_numpy(), table.column("part").to_numpy()
    order = np.lexsort((part, cluster))
    classes, n = table.column("class").to_numpy(), table.column("n").to_numpy()
    blobs = table.column("blob").combine_chunks()
    if isinstance(blobs, pa.ChunkedArray):
        blobs = pa.concat_arrays(blobs.chunks) if blobs.num_chunks else pa.array([], pa.binary())
    new = np.flatnonzero(np.append(True, (cluster[order][1:] != cluster[order][:-1]) | (part[order][1:] != part[order][:-1])))
    for a, z in zip(new.tolist(), [*new[1:].tolist(), len(order)]):
        if z - a > 1:
            at = order[a:z]
            link_cluster(classes[at].tolist(), n[at], [np.frombuffer(blobs[i].as_buffer(), dtype="<u8") for i in at.tolist()], union)
    pairs = np.array(union.edges(), dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def bucket_bits(docs: DataFrame) -> int:
    return min(_MOST_BITS, max(_LEAST_BITS, (docs.count() // PER_BUCKET).bit_length()))


def _row_key(doc_id: Column, text: Column) -> Column:
    """A name of (doc_id, text)."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(text.isNull(), "-").otherwise(F.concat(F.lit(":"), text))).cast("binary"))


def classes_of(docs: DataFrame, bits: int, words: int = WORDS, named: bool = False) -> DataFrame:
    """Rows of documents (kind DOC: doc_id, n, class, and with named the row_key as blob) and the sets of the classes that may link
    (kind SET), stored once."""
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("row_key", F.unhex(_row_key(F.col("doc_id"), F.col("text"))) if named else F.lit(None).cast("binary"))
    rows = texts.mapInArrow(lambda it: _split(it, words, bits), _ROW)
    shared = rows.groupBy("bucket").applyInArrow(trimmed(lambda t: _share(t, bits)), _ROW)
    return stored(shared.groupBy("bucket").applyInArrow(trimmed(_live), _ROW))


def link_classes(rows: DataFrame, bits: int) -> DataFrame:
    """(node, component) of the classes that link with another class."""
    sets = rows.where(F.col("kind") == SET).select("n", "class", "blob")
    postings = sets.mapInArrow(lambda it: _postings(it, 1 << bits), "bucket int, kind int, blob binary")
    cluster = stored(components(postings.groupBy("bucket").applyInArrow(trimmed(_candidates), "a long, b long")))
    size = cluster.groupBy("component").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).select(F.col("component").alias("cluster"), "blocks")
    of_class = cluster.select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    member = of_class.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))

    def verified(units: DataFrame) -> DataFrame:
        """Links among the classes of each (cluster, part): a row of units is a class and a part that it is verified in."""
        work = sets.join(units, "class").select("n", "class", "blob", "cluster", F.xxhash64("part").alias("part"))
        return work.withColumn("bin", F.pmod(F.xxhash64("cluster", "part"), F.lit(4 << bits)).cast("int")).groupBy("bin").applyInArrow(trimmed(_verify), "a long, b long")

    links = stored(verified(member.select("class", "cluster", F.col("block").alias("part"))))
    found = components(links)
    large = member.where("blocks > 1")
    if large.isEmpty():
        return found

    # Clusters of several blocks.  First one class of each component so far stands for it: these are verified in units of a block, again and
    # again, so that a group of near copies of any size comes together in a few rounds.
    def labelled() -> DataFrame:
        own = found.select(F.col("node").alias("class"), "component")
        return stored(large.join(own, "class", "left").withColumn("component", F.coalesce("component", "class")))

    def apart(frame: DataFrame) -> int:
        """How many components there are beyond one a cluster."""
        n = frame.select("cluster", "component").distinct().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("clusters")).first()
        return n.n - n.clusters

    now = labelled()
    left = apart(now)
    while left:
        stand = now.groupBy("cluster", "component").agg(F.min("class").alias("class"))
        units = stand.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("units"), F.count(F.lit(1)).alias("left")).where("left > 1")
        unit = stand.join(units, "cluster").select("class", "cluster", F.concat(F.lit("u"), F.pmod(F.xxhash64("class"), F.col("units"))).alias("part"))
        links = stored(links.union(verified(unit)))
        found = components(links)
        now = labelled()
        before, left = left, apart(now)
        if left == before:
            break
    if not left:
        return found
    # Then, where a cluster still has several components, every pair of its blocks.
    several = now.groupBy("cluster").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("cluster")
    rest = now.join(several, "cluster", "left_semi")
    j = F.explode(F.sequence(F.lit(0), F.col("blocks") - 2)).alias("j")
    other = F.col("j") + (F.col("j") >= F.col("block")).cast("int")
    pair = rest.select("class", "cluster", "block", j).select("class", "cluster", F.concat_ws("-", F.least("block", other), F.greatest("block", other)).alias("part"))
    return components(links.union(verified(pair)))


def _joined(docs: DataFrame, words: int, named: bool) -> DataFrame:
    """(doc_id, n_shingles, class, component_id, row_key) of every row."""
    bits = bucket_bits(docs)
    rows = classes_of(docs, bits, words, named)
    of_doc = rows.where(F.col("kind") == DOC).select("doc_id", F.col("n").alias("n_shingles"), "class", F.hex("blob").alias("row_key"))
    linked = link_classes(rows, bits)
    own = of_doc.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first"))
    own = own.join(linked.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = own.groupBy("component").agg(F.min("first").alias("component_id"))
    to = own.join(first, "component").select("class", "component", "component_id")
    return of_doc.join(to, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def join(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return _joined(docs, words, False).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each group of linked rows, all columns kept: that of the smallest doc_id, of equal ids the first by content.  Rows
    without a shingle link with nothing and all stay; rows equal in doc_id and text are one."""
    found = _joined(docs, words, True).where(F.col("class").isNotNull())
    chosen = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("best")).select(F.lower("best.row_key").alias("row_key"))
    # The user's columns travel in a struct, so that none can clash with ours.
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    has_words = F.col("row.text").rlike("[^\\x20\\x09-\\x0D]")
    named = rows.where(has_words).select("row", _row_key(F.col("row.doc_id").cast("long"), F.col("row.text")).alias("row_key"))
    kept = named.join(chosen, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row")
    return kept.unionByName(rows.where(~has_words | F.col("row.text").isNull())).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w
), x AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), e AS (
  SELECT a.doc_id AS p, b.doc_id AS q FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM s UNION SELECT e.q, r.c FROM r JOIN e ON e.p = r.doc_id
)
SELECT s.doc_id, CAST(any_value(len(s.g)) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""
