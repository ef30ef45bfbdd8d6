import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import suffix_dedup as S


def brute(rows, length):
    raw, least = [(d, (t or "").encode()) for d, t in rows], min(length, S.LEAST)
    seen, some = (Counter(t[i : i + n] for _, t in raw for i in range(len(t) - n + 1)) for n in (length, least))
    out = []
    for d, t in raw:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if cover[i] and (i == 0 or not cover[i - 1]))
        kept = bytes(c for c, x in zip(t, cover) if not x)
        again = [some[t[i : i + least]] > 1 for i in range(len(t) - least + 1)]
        edge = [i for i in range(len(again) + 1) if (i < len(again) and again[i]) != (i > 0 and again[i - 1])]
        passages = 0
        for a, z in zip(edge[0::2], edge[1::2]):
            whole = [w for w in re.finditer(rb"\S+", t) if w.start() >= a and w.end() <= z - 1 + least]
            passages += len(whole) > S.PASSAGE_WORDS
        out.append((d, len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest(), passages))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [text(n) for n in (38, 39, 40, 41, 60, 200)]
    out = ["", None, "a" * 39, "a" * 40, "b" * 41, "c" * 300, "ab" * 100, "abc" * 60 + "x" + "abc" * 60]
    for _ in range(80):
        parts = [text(r.randrange(0, 90))]
        for _ in range(r.randrange(0, 3)):
            parts += [r.choice(shared), text(r.randrange(0, 60))]
        out.append("".join(parts))
    return [*out, *out[20:30], out[21]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_brute_force(spark, docs, seed):
    rows = list(enumerate(corpus(seed)))
    got = sorted(map(tuple, S.remove_repeats(docs(rows, extra=True).repartition(3), 40).collect()), key=str)
    assert got == brute(rows, 40)


def test_keep_first(spark, docs):
    rows = [*enumerate(corpus(4)), (3, "a" * 40)]
    got = S.remove_repeats(docs(rows), 40, keep_first=True, raw=True).collect()
    texts = {(t or "").encode() for _, t in rows}
    seen, want = set(), {}
    for t in sorted(texts, key=lambda t: hashlib.md5(t).digest()):
        cover = bytearray(len(t))
        for i in range(len(t) - 39):
            if t[i : i + 40] in seen:
                cover[i : i + 40] = b"\1" * 40
            seen.add(t[i : i + 40])
        want[t] = bytes(c for c, x in zip(t, cover) if not x)
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        first[raw] = min(first.get(raw, d), d)
    out = sorted((d, want[t] if d == first[t] or len(t) < 40 else b"") for d, t in ((d, (t or "").encode()) for d, t in rows))
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == out


def test_defaults_repeats_nulls_and_empty(spark, docs):
    long = "".join(random.Random(1).choice("abcdef ") for _ in range(900))
    rows = [(1, long), (1, long), (None, long[:500]), (2, None), (3, "short"), (4, "z" * 100_000), (5, long[100:400])]
    assert sorted(map(tuple, S.remove_repeats(docs(rows)).collect()), key=str) == brute(rows, 400)
    assert S.remove_repeats(docs(["x"]).where("false")).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text("ab", min_size=1, max_size=60), st.lists(st.integers(1, 12), min_size=1, max_size=3, unique=True).map(sorted))
def test_factors(text, depths):
    """LPF and LNF by the definition: all pairs of places."""
    data, n = np.frombuffer(text.encode(), dtype=np.uint8), len(text)
    at = np.array([i for i in range(n - depths[0] + 1) if i % 7 != 3], dtype=np.int64)
    lpf, lnf = S.factors(S._Prints(data), at, n - at, depths)
    for k, i in enumerate(at.tolist()):
        for got, others in ((lpf[k], at[:k].tolist()), (lnf[k], at[k + 1 :].tolist())):
            assert got == max((d for d in depths for j in others if max(i, j) + d <= n and text[i : i + d] == text[j : j + d]), default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60))
def test_nearest_smaller(values):
    got = S.nearest_smaller(np.array(values))
    assert got.tolist() == [max((j for j in range(i) if values[j] <= values[i]), default=-1) for i in range(len(values))]


@settings(max_examples=40, deadline=None)
@given(st.text("abc", min_size=60, max_size=400), st.sampled_from([64, 1 << 17]))
def test_anchors_depend_on_the_string_alone(text, piece):
    data = text.encode()
    of, places = {}, 0
    for key, first, n in zip(*map(np.ndarray.tolist, S.anchors(np.frombuffer(data, dtype=np.uint8), 50, 8, piece))):
        assert first == places
        places += n
        for i in range(first, first + n):
            assert of.setdefault(data[i : i + 50], key) == key
    assert places == len(data) - 49 and len(of) == len({data[i : i + 50] for i in range(places)})


def test_passages_of_many_words(spark, docs):
    """Passages of over 50 words under and over 400 bytes, of 50 words, and under 200 bytes; in other texts, in one text, and in copies."""
    r = random.Random(11)
    word = lambda n=6: "".join(r.choice("abcdefghij") for _ in range(n))
    text = lambda n, size=6: " ".join(word(size) for _ in range(n))
    short, long, fifty, tiny, dear = text(51, 5), text(90), text(50), text(60, 2), text(52, 9)
    texts = [f"{text(40)} {p} {text(40)}" for p in (short, short, long, long, fifty, fifty, tiny, tiny, dear, dear)]
    texts += [f"{text(3)} {short} {text(20)} {long} {text(9)}", f"{text(5)} {dear} {text(30)} {dear}", text(120), text(120), short, text(70)]
    rows = [*enumerate(texts), (100, texts[15]), (101, None), (102, "")]
    got = sorted(map(tuple, S.remove_repeats(docs(rows)).collect()), key=str)
    assert got == brute(rows, 400)
    n = {r[0]: r[5] for r in got}
    assert [n[i] for i in range(10)] == [1, 1, 1, 1, 0, 0, 0, 0, 1, 1] and n[10] == 2 and n[11] == 2 and n[12] == n[13] == 0 and n[14] == 1 and n[15] == n[100] == 1


def test_many_runs_of_one_anchor(spark, docs, monkeypatch):
    """A notice in very many different texts, in several chunks."""
    monkeypatch.setattr(S, "CHUNK", 2000)
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    notice = text(70)
    rows = [(i, f"{text(50)}{notice}{text(50)}") for i in range(300)]
    assert sorted(map(tuple, S.remove_repeats(docs(rows).repartition(5), 40).collect()), key=str) == brute(rows, 40)


def test_query_as_brute_force(spark):
    """The registered query over the whole smallest tables, at 400 bytes."""
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, S.query(spark, d).collect()), key=str) == brute(rows, 400)


def test_every_oracle_is_sql():
    import __spark_entry__ as entry

    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())
    assert "op7_suffix_array_dedup" not in entry.oracle_sql()  # its reference is the brute force above
