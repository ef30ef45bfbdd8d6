import random
import re

import numpy as np
import pytest

from rillwork.llm import jaccard as J
from rillwork.llm.common import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    """(doc_id, n, component) of each row, by comparing all pairs."""
    sets, up = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((d, len(s), min(ids[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n):
    """Copies, near copies at all distances around the threshold, shared passages, short and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = ["", None, " \n\t", "One", "one", "one two", "ONE TWO", "a b c d e", "a b c d e f", "x " * 3000, "x " * 3001]
    while len(texts) < n:
        base = [word() for _ in range(r.randrange(4, 80))]
        if r.random() < 0.3:
            base += passage.split()
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice([" ", "\n", "  "]).join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_as_all_pairs(spark, docs, seed):
    rows = list(enumerate(corpus(seed, 400)))
    got = J.join(docs(rows, extra=True)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_small_batches_hot_tokens_and_blocks(spark, docs, monkeypatch):
    """A large group of near copies and a passage in every text, with many batches, marks and blocks."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        w = list(base)
        w[r.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:25] + [f"u{i}_{k}" for k in range(40)])) for i in range(120)]
    want = brute(rows)
    monkeypatch.setattr(J, "HOT", 4)
    monkeypatch.setattr(J, "BLOCK", 16)
    sets = J.shingle_sets([t for _, t in rows])
    assert [len(s) for s in sets] == [len(s) for s in sets_of([t for _, t in rows])]
    assert sorted(map(tuple, J.join(docs(rows).repartition(6)).collect())) == want
    # The same steps in this process, with batches and blocks far smaller than in use.
    union = J._Union()
    for block in range(0, len(rows), 16):
        for other in range(block, len(rows), 16):
            at = [*range(block, min(block + 16, len(rows))), *range(other, min(other + 16, len(rows)))]
            at = sorted(set(at))
            J.link_cluster(at, np.array([len(sets[i]) for i in at]), [sets[i] for i in at], union)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(union.find(i), []).append(d)
    assert sorted((d, len(sets[i]), min(low[union.find(i)])) for i, (d, _) in enumerate(rows)) == want


def test_large_clusters_that_stay_apart(spark, docs, monkeypatch):
    """Chains of near copies: linked neighbours, far ends that aren't, over many blocks."""
    monkeypatch.setattr(J, "BLOCK", 8)
    rows = []
    for c in range(3):
        w = [f"c{c}w{i}" for i in range(60)]
        for i in range(60):
            rows.append((c * 100 + i, " ".join(w)))
            w[(i * 7) % 60] = f"new{c}_{i}" if i % 20 else w[(i * 7) % 60]
            if i % 20 == 19:
                for k in range(12):
                    w[(i + 5 * k) % 60] = f"far{c}_{i}_{k}"
    assert sorted(map(tuple, J.join(docs(rows)).collect())) == brute(rows)


def test_repeats_nulls_and_empty(spark, docs):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (None, text), (None, None), (2, ""), (3, ""), (9, text.upper())]
    got = sorted(map(tuple, J.join(docs(rows)).collect()), key=str)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (None, 0, None), (2, 0, 2), (3, 0, 3), (9, 3, 5)], key=str)
    assert J.join(docs(["x"]).where("false")).collect() == []


def test_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(map(tuple, J.query(spark, d).collect())) == sorted(c.sql(J.SQL).fetchall())


def test_keep_one(spark, docs):
    rows = list(enumerate(corpus(3, 200)))
    df = docs([*rows, rows[50], rows[51]], extra=True)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    by = {tuple(r)[:2]: tuple(r) for r in df.collect()}
    assert all(tuple(r) == by[tuple(r)[:2]] for r in kept.collect())  # the user's row_key and the like pass through
    sets = sets_of([t for _, t in rows])
    want = sorted({c for (d, n, c) in brute(rows) if n} | {i for i, s in enumerate(sets) if not s})
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {x for a, b in edges if a != b for x in (a, b)}}
    with pytest.raises(RuntimeError, match="not complete after 1 rounds"):
        components(spark.createDataFrame(edges, "a long, b long"), rounds=1)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), rounds=0).collect() == []


def test_hashing_in_pieces(monkeypatch):
    texts = [*corpus(7, 60), "y" * 500, " " * 300, "é " * 200]
    whole = J.shingle_sets(texts)
    monkeypatch.setattr(J, "PIECE", 37)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, J.shingle_sets(texts), strict=True))
    assert [len(s) for s in whole] == [len(s) for s in sets_of(texts)]


def test_positions_narrow_candidates():
    """Random sets: every pair at the threshold is a candidate, and a token late in both prefixes alone makes none."""
    import pyarrow as pa

    def clusters(sets):
        frame = pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array(range(len(sets)), pa.int64()), pa.array([np.array(s, dtype="<u8").tobytes() for s in sets], pa.binary())], names=["n", "class", "blob"])
        out = pa.Table.from_batches(list(J._postings([frame], 1)))
        union = J._Union()
        for a, b in zip(*J._candidates(out).to_pydict().values()):
            union.join(a, b)
        return [union.find(i) for i in range(len(sets))]

    r = random.Random(6)
    for _ in range(200):
        base = [sorted(r.sample(range(60), r.randrange(4, 40))) for _ in range(3)]
        sets = base + [sorted({x for x in r.choice(base) if r.random() > 0.1} | {r.randrange(60) for _ in range(r.randrange(3))}) for _ in range(9)]
        sets = [list(s) for s in sorted({tuple(s) for s in sets if s})]
        root = clusters(sets)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len({*a} & {*b}) >= J.THRESHOLD * len({*a} | {*b}):
                    assert root[i] == root[j]
    one, two = [*range(0, 5), 50, *range(100, 114)], [*range(5, 11), 50, *range(200, 219)]  # 20 and 26 tokens; 50 has 5 and 6 before it
    assert J.prefix_length(20) == 6 and J.prefix_length(26) == 7
    assert clusters([one, two]) == [0, 1]


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from rillwork.llm import common

    unset = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=jsc))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(cluster)
