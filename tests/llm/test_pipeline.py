"""The pipeline against plain versions of its stages, and what a missing package leaves."""

import hashlib
import os
import shutil
import subprocess
import sys

import pytest
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from rillwork.llm import bpe, decontaminate, pii
from test_jaccard import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with planted cases, and the benchmark."""
    d = tmp_path_factory.mktemp("data")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()
    leak = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    rows = [tuple(r) for r in base]
    rows += [(9001, base[0].text, "en", "s", 1), (9002, base[1].text + " one more word", None, "s", 1), (9003, None, None, "s", 0), (9004, "12 34 !!", "en", "s", 8), (9005, f"{base[2].text} {leak}", "en", "s", 1), (9006, "call +1 (209) 555-1594 or mail a.b1@x.example.com", "en", "s", 1), tuple(base[3])]
    spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    shutil.copy("/root/testdata/sf0.001/benchmark.parquet", f"{d}/benchmark.parquet")
    return str(d)


def test_stages_and_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    # Plain versions
    known = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    of = brute([(r.doc_id, r.text) for r in known])
    best = {d for d, n, c in of if d == c}
    kept = {r.doc_id: r for r in known if r.doc_id in best}
    items = spark.read.parquet(f"{tables}/benchmark.parquet").collect()
    clean = {i: r for i, r in kept.items() if not any(" ".join(decontaminate.words_of(x.text)) in " ".join(decontaminate.words_of(r.text)) for x in items)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((i, len(lib.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, r in clean.items() for t in (pii.pseudonymise(r.text)[0],))
    got = corpus_pipeline.run(spark, tables).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == want
    assert 9005 not in clean and 9006 in clean and 9001 not in clean and 9003 not in clean and 9004 not in clean
    # Each stage passes the columns of documents on.
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns


def test_empty_table(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{tables}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_rest_works_without_this_package(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in os.listdir(root):
        if name not in (".git", "corpus_pipeline.py"):
            src = os.path.join(root, name)
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__", ".pytest_cache")) if os.path.isdir(src) else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_count' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})

