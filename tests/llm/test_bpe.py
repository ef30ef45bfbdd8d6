import hashlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import bpe

FILE = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", None, " ", "\n\n  \t", "a", "The cat's hat, isn't it? 12345 6789", "Übergrößenträger für señor — 世界 \U0001f600\U0001f600", "x" * 5000, "thonthsh " * 300, "-" * 300 + " " * 200 + "end",
    "a b c　 d\u0085e", "<|endoftext|>", "tab\tand\r\nlines\r\n\r\n", "the the the", "the the the", "​﻿", "ǅungla ½ ² ٣",
]


def check(rows, texts):
    for i, n, ids, text in rows:
        own = (texts[i] or "")
        want = LIBRARY.encode_ordinary(own)
        assert (n, ids, text) == (len(want), hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(own.encode()).hexdigest())


@pytest.mark.parametrize("page", [1, 1000, 1 << 20])
def test_as_the_library(spark, docs, page):
    rows = bpe.encode_decode(docs(TEXTS, extra=True), FILE, P.PATTERN, page_chars=page).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    check(rows, TEXTS)


def test_real_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = bpe.encode_decode(df, FILE, P.PATTERN).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_round_trip_and_native_decoding(spark, docs):
    got = bpe.decode_ids(bpe.encode_decode(docs(TEXTS), FILE, P.PATTERN, raw=True).withColumnRenamed("decoded", "joined"), FILE).collect()
    for r in got:
        assert bytes(r.joined) == bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode()


def test_null_id_repeats_and_empty(spark, docs):
    rows = bpe.encode_decode(docs([(None, "a b"), (1, "a b"), (1, "a b")]), FILE, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 2), (False, 2), (True, 2)]
    assert bpe.encode_decode(docs(["x"]).where("false"), FILE, P.PATTERN).collect() == []


def test_plans_do_not_hold_the_rank_map(spark, docs):
    """Spark keeps the text of every plan, and of its nodes, on the driver."""
    kept, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def runs():
        bus.waitUntilEmpty(30_000)
        found = kept.executionsList()
        return {e.executionId(): e for e in (found.apply(i) for i in range(found.size()))}

    before = runs()
    check(bpe.encode_decode(docs(TEXTS), FILE, P.PATTERN).collect(), TEXTS)
    own = {k: e for k, e in runs().items() if k not in before}
    assert any("Subquery" in e.physicalPlanDescription() for e in own.values())
    for k, e in own.items():
        nodes = kept.planGraph(k).allNodes()
        assert len(e.physicalPlanDescription()) + sum(len(nodes.apply(i).desc()) for i in range(nodes.size())) < 100_000


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60) | st.text("aeno tish", min_size=1, max_size=80).map(str.encode))
def test_heap_merges_as_the_simple_rule(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        r, i = min((RANKS.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if r == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert bpe.merge_long(piece, RANKS) == [RANKS[p] for p in parts]
