"""Byte-level BPE encoding and decoding with Spark higher-order functions.

How it works
    1. The JVM cuts every text into pieces with the tokenizer's pattern.
    2. The commonest pieces of a bounded sample of documents are folded once and broadcast as a dictionary of at most
       ``DICTIONARY`` pieces, beside the tokens that are whole pieces.  It is a cache: it changes how often a piece is folded, and no result.
    3. Each task packs its rows into *pages*: the distinct pieces of the page that the dictionary lacks, and for every document the
       sequence of piece numbers.  A piece is held as the array of its bytes.
    4. A higher-order fold merges the adjacent pair of lowest rank of every distinct piece until no pair has a rank.  Ranks come
       from a rank map that is a constant of the query.
    5. The page is stored and unpacked: a document's ids are gathered by piece number, and its text is decoded by joining the binary
       pieces of its ids.

    No step shuffles documents, so no key can be hot; memory is bounded by the page size and by the longest text.

Defined results
    null text is encoded as the empty text: no ids, empty bytes.  Repeated rows each give a row.  Extra
    columns are ignored.  An empty table gives no rows.  Pieces longer than ``FOLD_BYTES`` are merged by a heap
    in linear-logarithmic time instead of by the quadratic fold; both give the ids of the public library.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import bounded_batches, stored, trim

#: White space by the Unicode property; Java's \s has only ASCII.
_SPACE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Longer pieces are merged with a heap.
FOLD_BYTES = 64
#: A page ends after so many characters of text (a longer text is a page of its own).
PAGE_CHARS = 3 << 20
#: Documents of the sample (about) that the dictionary is taken from, and the most pieces it holds.
SAMPLE_DOCS = 40_000
DICTIONARY = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def java_pattern(pattern: str) -> str:
    """The same pattern for java.util.regex: \\s and \\S with all Unicode white space, inside classes and outside."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if c == "\\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif c == "\\S":
            out.append(f"[^{_SPACE}]")
        else:
            inside = c == "[" or (inside and c != "]")
            out.append(c)
        i += len(c)
    return "".join(out)


#: Bits of an id, and of a byte's place in a piece.  The last id stands for what is before and after a piece.
_ID, _PLACE = 20, 7
_GUARD = (1 << _ID) - 1


class RankMap:
    """A map from pairs of adjacent ids to the rank (which is the id) of what they merge to, as a constant of a query.

    A map of Spark is searched from its start, so this one is laid out as a perfect hash: each bucket of pairs has a displacement that
    sends its pairs to free slots of one flat table, and a lookup reads one slot.  Flat arrays also keep the plan quick to send."""

    def __init__(self, ranks: dict[bytes, int]):
        merges = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    merges[a << _ID | b] = rank
        self.slots = 1 << max(4, (len(merges) * 5 // 4).bit_length())
        self.buckets = max(1, self.slots // 4)
        hashes = np.array([xxhash.xxh64_intdigest(pair.to_bytes(8, "little"), seed=42) for pair in merges], dtype=np.uint64)
        # The slot's bits of the hash begin where no two pairs of a bucket have the same.
        mask = self.slots - 1
        of, slot = hashes & np.uint64(self.buckets - 1), lambda k: hashes >> np.uint64(k) & np.uint64(mask)
        self.above = next(k for k in range(17, 47) if len(np.unique(of << np.uint64(32) | slot(k))) == len(hashes))
        by_bucket: dict[int, list[tuple[int, int, int]]] = {}
        for (pair, rank), bucket, h in zip(merges.items(), of.tolist(), slot(self.above).tolist()):
            by_bucket.setdefault(bucket, []).append((h, pair, rank))
        #: pair << _ID | rank; -1 where a slot is free
        self.table, self.shift = [-1] * self.slots, [0] * self.buckets
        for bucket, items in sorted(by_bucket.items(), key=lambda kv: -len(kv[1])):
            d = next(d for d in itertools.count(bucket * 7919) if all(self.table[(h ^ d) & mask] < 0 for h, _, _ in items)) & mask
            self.shift[bucket] = d
            for h, pair, rank in items:
                self.table[(h ^ d) & mask] = pair << _ID | rank
        self.table, self.shift = np.array(self.table, dtype=np.int64), np.array(self.shift, dtype=np.int32)
        self.bytes = [ranks[bytes((b,))] for b in range(256)]
        self.pairs = [ranks.get(bytes((a, b)), 1 << _ID) for a in range(256) for b in range(256)]
        self.by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.by_id[rank] = token
        if len(self.by_id) > _GUARD:
            raise ValueError(f"ids must be below {_GUARD}")


def _literal(values: list, kind: str) -> Column:
    """A list as a foldable column."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _let(value: Column, use) -> Column:
    """Evaluates value once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_MAP, _PARTS = "rank_map", {"table": pa.int64(), "shift": pa.int32(), "pairs": pa.int64(), "bytes": pa.int64()}


def beside_map(rows: DataFrame, ranks: RankMap) -> DataFrame:
    """The rows with the rank map, a constant of the query, as a column for `with_map`.

    It is a scalar subquery over one local row: Spark puts its value into the tasks, but not into the text of plans.  There a literal takes 3 MB, and
    Spark keeps the texts of plans and of their nodes on the driver for every query that was run.  (Higher-order functions can't hold a
    subquery themselves; Spark joins this projection with the one that reads it, so no row holds a copy.)"""
    row = [pa.array([getattr(ranks, k)], pa.list_(pa.field("element", kind, nullable=False))) for k, kind in _PARTS.items()]
    table = rows.sparkSession.createDataFrame(pa.table(row, names=list(_PARTS)))
    return rows.select("*", table.select(F.struct(*_PARTS)).scalar().alias(_MAP))


def with_map(use) -> Column:
    """use(map) in a row of beside_map; the map's fields are read once a row, however often they are used."""
    return _let(F.col(_MAP), lambda m: _let(F.struct(*(m[k].alias(k) for k in _PARTS)), use))


def fold(ranks: RankMap, table: Column, codes: Column) -> Column:
    """The ids (array<int>) of one piece, given as the array of its bytes (0 to 255); table is what with_map passes.

    The state is one number for each id so far: the rank of the pair that it begins (2**20 if it has none), then the place of its first byte, then
    the id; with a guard at either end that merges with nothing.  The least number is thus the pair of lowest rank, the leftmost of equals.  A
    step merges it and looks up the two pairs that this makes."""
    long = lambda n: F.lit(n).cast("bigint")
    none, low = 1 << _ID, _ID + _PLACE
    id_of = lambda x: x.bitwiseAND(long(_GUARD))

    def rank(a: Column, b: Column) -> Column:
        """What the slot of a pair holds, less the pair: its rank, or, as an unsigned number, at least 2**20."""
        pair = F.shiftleft(a, _ID).bitwiseOR(b)
        h = F.xxhash64(pair)
        moved = F.get(table["shift"], h.bitwiseAND(F.lit(ranks.buckets - 1)).cast("int"))
        slot = F.shiftrightunsigned(h, ranks.above).bitwiseXOR(moved).bitwiseAND(F.lit(ranks.slots - 1)).cast("int")
        return F.shiftleft(F.least((F.get(table["table"], slot).bitwiseXOR(F.shiftleft(pair, _ID))).bitwiseAND(long((1 << 63) - 1)), long(none)), low)

    def step(x: Column, _: Column) -> Column:
        def merge(best: Column) -> Column:
            new, place = F.shiftright(best, low), best.bitwiseAND(long(((1 << _PLACE) - 1) << _ID))

            def put(j: Column) -> Column:
                """Element j is best; the one before it gets a new rank, and the one after it goes.  (Slices and concatenations cost several times as much.)"""

                def at(e: Column, i: Column) -> Column:
                    before = rank(id_of(e), new).bitwiseOR(e.bitwiseAND(long((1 << low) - 1)))
                    merged = rank(new, id_of(F.get(x, j + 2))).bitwiseOR(place).bitwiseOR(new)
                    return F.when(i < j - 1, e).when(i > j + 1, e).when(i == j, merged).when(i < j, before).otherwise(gone)

                return F.array_remove(F.transform(x, at), gone)

            return F.when(best >= long(none << low), x).otherwise(_let(F.array_position(x, best).cast("int") - 1, put))

        return _let(F.array_min(x), merge)

    gone = long(-1)
    end = F.array(long(none << low | _GUARD))
    first = F.transform(codes, lambda c, i: F.shiftleft(F.coalesce(F.get(table["pairs"], c * 256 + F.get(codes, i + 1)), long(none)), low).bitwiseOR(F.shiftleft(i.cast("bigint"), _ID)).bitwiseOR(F.get(table["bytes"], c)))
    steps = F.sequence(F.lit(2), F.greatest(F.size(codes), F.lit(2)))
    return F.aggregate(steps, F.concat(end, first, end), step, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 2), id_of)).cast("array<int>")


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long piece: lowest rank first, leftmost among equals, with a heap over a linked list."""
    n = len(piece)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    rank = lambda i: ranks.get(piece[i : end[nxt[i]]]) if nxt[i] < n else None
    heap = [(r, i, nxt[i], end[nxt[i]]) for i in range(n) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] != j or j >= n or not alive[j] or end[j] != e:
            continue
        alive[j], end[i], nxt[i] = False, e, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        for k in (prev[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, nxt[k], end[nxt[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Dictionary:
    """Pieces and their ids, in flat arrays."""

    def __init__(self, words: pa.Array, size: np.ndarray, ids: np.ndarray):
        self.words, self.size, self.ids = words, size.astype(np.int64), ids.astype("<u4")
        self.first = np.cumsum(self.size) - self.size


_PAGE = "words array<array<int>>, long_at array<int>, long_words array<binary>, ids binary, nulls binary, counts binary, numbers binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed, all lowest bytes first, then all of the next, and so on."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed, n: int) -> np.ndarray:
    plain = pa.decompress(packed, decompressed_size=4 * n, codec="zstd") if n else b""
    return np.ascontiguousarray(np.frombuffer(plain, dtype=np.uint8).reshape(4, n).T).view("<i4").reshape(-1)


def _pages(batches, known, page_chars: int):
    """Arrow batches of (doc_id, pieces, chars) to pages.  Piece numbers below the dictionary's size are its own."""
    known_words = known.value

    def page(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(0) for b in parts])
        lists = pa.concat_arrays([b.column(1) for b in parts])
        words = lists.flatten().dictionary_encode()
        counts = np.diff(lists.offsets.to_numpy())
        found = pc.index_in(words.dictionary, value_set=known_words)
        number = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        new = np.flatnonzero(number < 0)
        number[new] = len(known_words) + np.arange(len(new))
        names = words.dictionary.take(pa.array(new)).cast(pa.binary()).to_pylist()
        numbers = number[words.indices.to_numpy(zero_copy_only=False)] if len(words) else number[:0]
        long = [i for i, w in enumerate(names) if len(w) > FOLD_BYTES]
        short = [w if len(w) <= FOLD_BYTES else b"" for w in names]
        codes = pa.ListArray.from_arrays(np.cumsum([0, *map(len, short)]).astype(np.int32), pa.array(np.frombuffer(b"".join(short), dtype=np.uint8).astype(np.int32)))
        row = {
            "words": pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), codes), "long_at": [long], "long_words": [[names[i] for i in long]],
            "ids": [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], "nulls": [ids.is_null().to_numpy(zero_copy_only=False).tobytes()],
            "counts": [counts.astype("<i8").tobytes()], "numbers": [_packed(numbers)],
        }
        kinds = [None, pa.list_(pa.int32()), pa.list_(pa.binary()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([v if k is None else pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

    held, chars = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            sizes = np.cumsum(b.column(2).to_numpy(zero_copy_only=False)[at:])
            n = min(b.num_rows - at, max(1, int(np.searchsorted(sizes, page_chars - chars, side="right"))))
            held.append(b.slice(at, n))
            chars += int(sizes[n - 1])
            at += n
            if chars >= page_chars or at < b.num_rows:
                yield page(held)
                held, chars = [], 0
                trim()
    if held:
        yield page(held)
    held = []
    trim()


class Decoder:
    """Joins the binary pieces of ids."""

    def __init__(self, by_id: list[bytes]):
        self.size = np.array([len(x) for x in by_id], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        parts = (ids[i : i + (1 << 16)] for i in range(0, len(ids), 1 << 16))  # a long text bit by bit
        return b"".join(self.bytes[_ranges(self.first[p], self.size[p])].tobytes() for p in parts)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+size[0]-1, first[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)


def _documents(batches, ranks_of: dict[bytes, int], known, decoder: Decoder, raw: bool):
    """Pages with the fold's results to rows of documents."""
    kinds = [pa.int64(), *([pa.list_(pa.int32()), pa.binary()] if raw else [pa.string(), pa.string()])]
    names = ["doc_id", "n_tokens", *(["ids", "decoded"] if raw else ["ids_sha256", "decoded_sha256"])]
    d = known.value
    for b in batches:
        for row in range(b.num_rows):
            col = lambda c: b.column(b.schema.get_field_index(c))[row]
            codes = col("codes").values
            size, tokens = np.diff(codes.offsets.to_numpy()).astype(np.int64), codes.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            first = np.cumsum(size) - size
            for at, w in zip(col("long_at").as_py(), col("long_words").as_py()):
                ids = np.array(merge_long(w, ranks_of), dtype="<u4")
                first[at], size[at], tokens = len(tokens), len(ids), np.concatenate([tokens, ids])
            first, size, tokens = np.concatenate([d.first, first + len(d.ids)]), np.concatenate([d.size, size]), np.concatenate([d.ids, tokens])
            read = lambda c, kind: np.frombuffer(col(c).as_buffer(), dtype=kind)
            doc_ids, nulls, counts = read("ids", "<i8"), read("nulls", "?"), read("counts", "<i8")
            numbers = _unpacked(col("numbers").as_buffer(), int(counts.sum()))
            out, at = [], 0
            for n in counts.tolist():
                which = numbers[at : at + n]
                at += n
                ids = tokens[_ranges(first[which], size[which])]
                text = decoder(ids)
                out.append((len(ids), ids.tolist(), text) if raw else (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
            columns = [pa.array(doc_ids, pa.int64(), mask=nulls), *(pa.array([o[i] for o in out], kinds[i]) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            trim()


def _counts(batches):
    for b in batches:
        c = b.column(0).flatten().value_counts()
        yield pa.RecordBatch.from_arrays([c.field(0), c.field(1)], names=["word", "n"])


def build_dictionary(pieces: DataFrame, ranks: dict[bytes, int], table: RankMap, most: int = DICTIONARY) -> Dictionary:
    """All pieces that are tokens themselves, and the commonest others of the sample (of two occurrences or more) with their ids: at most
    ``most`` of these, by a count that splits no tie."""
    tokens = {}
    for token, rank in ranks.items():
        try:
            tokens[token.decode()] = [rank]
        except UnicodeDecodeError:  # part of a character: never a whole piece
            continue
    counts = stored(pieces.select("pieces").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= 2 AND octet_length(word) <= {FOLD_BYTES}"))
    least, total = None, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += r["count"]
        if total > most:
            break
        least = r.n
    words, size, ids = pa.array(list(tokens), pa.string()), np.ones(len(tokens), dtype=np.int64), np.array([r for r, in tokens.values()])
    if least is not None:
        codes = F.transform(F.split(F.decode(F.col("word").cast("binary"), "ISO-8859-1"), ""), F.ascii)
        rows = beside_map(counts.where(F.col("n") >= least), table).select("word", with_map(lambda t: fold(table, t, codes)).alias("ids")).toArrow()
        rows = rows.filter(pc.invert(pc.is_in(rows.column("word"), value_set=words))).combine_chunks()
        lists = rows.column("ids").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        size = np.concatenate([size, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
        ids = np.concatenate([ids, lists.flatten().to_numpy(zero_copy_only=False)])
        words = pa.concat_arrays([words, *(c.cast(pa.string()) for c in rows.column("word").chunks)])
    return Dictionary(words, size, ids)


@functools.lru_cache(1)
def _tables(rank_file: str) -> tuple[dict[bytes, int], RankMap]:
    ranks = load_ranks(rank_file)
    return ranks, RankMap(ranks)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, *, raw: bool = False, page_chars: int = PAGE_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; with raw=True (doc_id, n_tokens, ids, decoded)."""
    docs = bounded_batches(docs)
    ranks, table = _tables(rank_file)
    decoder = Decoder(table.by_id)
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = lambda df: df.select(F.col("doc_id").cast("long"), F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0)).alias("pieces"), F.length(text).cast("long").alias("chars"))
    part = max(1, -(-docs.count() // SAMPLE_DOCS))
    known = build_dictionary(cut(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)), ranks, table)
    trim()
    sc = docs.sparkSession.sparkContext
    known_words = sc.broadcast(known.words)
    known.words = None  # the last step needs the ids alone
    known_ids = sc.broadcast(known)
    pages = cut(docs).mapInArrow(lambda it: _pages(it, known_words, page_chars), _PAGE)
    codes = with_map(lambda t: F.transform("words", lambda w: F.when(F.size(w) > 0, fold(table, t, w)).otherwise(F.array().cast("array<int>"))))
    # Stored, so that a task has one Python worker at a time, and a lost executor costs no fold.
    coded = stored(beside_map(pages, table).select(codes.alias("codes"), "long_at", "long_words", "ids", "nulls", "counts", "numbers"))
    schema = "doc_id long, n_tokens long, " + ("ids array<int>, decoded binary" if raw else "ids_sha256 string, decoded_sha256 string")
    return coded.mapInArrow(lambda it: _documents(it, ranks, known_ids, decoder, raw), schema)


def decode_ids(tokens: DataFrame, rank_file: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded binary: the pieces of the ids joined, natively.  Null ids give null."""
    by_id = _literal([t.decode("latin-1") for t in _tables(rank_file)[1].by_id], "array<string>")
    return tokens.withColumn("decoded", F.encode(F.array_join(F.transform(ids_col, lambda i: F.get(by_id, i)), ""), "ISO-8859-1"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
