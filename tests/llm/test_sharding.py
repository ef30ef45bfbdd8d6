import shutil
import zlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rillwork.llm import sharding as S


def placed(spark, df, shards=5):
    first = S.slot_map(spark, shards)
    return S.place(df, first, S.grow(first)).collect()


def test_places(spark, docs):
    texts = ["", None, "é" * 10, "same", "same", "long " * 20000, *(f"text {i}" for i in range(300))]
    rows = placed(spark, docs([*enumerate(texts), (3, "same"), (None, "no id"), *[(7, "hot")] * 200], extra=True))
    assert len(rows) == len(texts) + 202
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(5))
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(texts) and r.doc_id not in (3, 7):
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_the_law(spark, docs):
    """doc_id and the number of shards decide, whatever else the table holds."""
    a = {r.doc_id: (r.shard, r.grown_shard) for r in placed(spark, docs(["x"] * 50))}
    b = {r.doc_id: (r.shard, r.grown_shard) for r in placed(spark, docs([f"other {i}" for i in range(90)]))}
    assert all(b[i] == a[i] for i in a)


def test_growing_is_even_and_moves_only_to_the_new_shard(spark):
    old = S.slot_map(spark, 40)
    new = S.grow(old)
    at = {r.vslot: r.shard for r in old.collect()}
    sizes = {}
    for r in new.collect():
        assert r.version == 1 and r.shard in (at[r.vslot], 40)
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert len(sizes) == 41 and max(sizes.values()) - min(sizes.values()) <= 4


def test_stored_versions_and_rebalancing(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    df = docs([(i, "x" * (5000 if i < 5 else 10)) for i in range(400)])
    sizes = S.slot_bytes(df, slots=64)
    S.write_version(S.slot_map(spark, 4, 64, sizes), path, 0)
    S.write_version(S.rebalance(S.read_version(spark, path)), path, 1)

    def spread(m):
        load = [r["sum(bytes)"] for r in m.groupBy("shard").agg(F.sum("bytes")).collect()]
        return max(load) - min(load)

    assert spread(S.read_version(spark, path)) < spread(S.read_version(spark, path, 0))
    assert S.read_version(spark, path).first().version == 1
    assert sum(r.bytes for r in S.read_version(spark, path, 0).collect()) == 5 * 5016 + 395 * 26
    with pytest.raises(AnalysisException):
        S.write_version(S.read_version(spark, path, 0), path, 1)  # a stored version stays as it is


def test_the_query_goes_by_the_stored_map(spark, docs, tmp_path):
    """Version 0 with the bytes of every slot, version 1 made of it; without the map there is no result."""
    path = str(tmp_path / "map")
    df = docs([(i, "é" * (i % 50)) for i in range(300)] + [(None, None)])
    out = S.shard(df, 7, path)
    maps = [{r.vslot: r for r in S.read_version(spark, path, v).collect()} for v in (0, 1)]
    assert all(len(m) == S.SLOTS for m in maps) and sum(r.rows for r in maps[0].values()) == 301
    for r in out.collect():
        assert (r.shard, r.grown_shard) == (maps[0][r.vslot].shard, maps[1][r.vslot].shard)
    shutil.rmtree(path)
    with pytest.raises(Exception, match="(?i)does not exist|not found"):
        out.select("shard").collect()


def test_sql(spark, tmp_path):
    """Copies, nulls and a hot doc_id by the SQL that checks the query."""
    import duckdb

    rows = [(i % 70 if i % 3 else 5, f"text {i % 40} é" * (i % 5)) for i in range(400)] + [(None, "x"), (None, None), (1, None), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet" + ("'" if "sf0" in d else "/*.parquet'"))
        assert sorted(map(tuple, S.query(spark, d).collect()), key=str) == sorted(c.sql(S.SQL).fetchall(), key=str)


def test_empty(spark, docs):
    assert placed(spark, docs(["x"]).where("false")) == []
