import zlib
from collections import Counter

from lexweave.llm.sharding import shard

from .conftest import same


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_slots_and_growth(documents, rows, clashing):
    got = shard(documents, "doc_id", "text", 24).collect()
    text = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == text
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25), "key")
        assert r.grown_shard in (r.shard, 24)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert same(shard(clashing, "doc_id", "text", 24), shard(documents, "doc_id", "text", 24))


def test_slots_over_blocks_negative_keys_and_empty_table(spark, empty):
    keys = spark.range(-500, 500).selectExpr("id as doc_id", "'a' as text").unionAll(spark.range(400).selectExpr("7L as doc_id", "'b' as text"))
    got = shard(keys, "doc_id", "text", 5, rows_per_block=20, copies_per_row=30).collect()
    assert all(r.shard == jump(r.doc_id, 5) for r in got)
    for s in range(5):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
    assert shard(empty, "doc_id", "text", 24).count() == 0


def test_slots_are_in_order_of_the_rows_and_free_of_layout(spark, documents, rows):
    """Against one sort per shard, whatever the partitions and ranges."""
    plain = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows]
    want, slots = [], Counter()
    for i, size, crc in sorted(plain, key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1])):
        s = jump(i or 0, 6)
        want.append((i, size, crc, s, slots[s]))
        slots[s] += 1
    for some, per_block in ((documents, 20), (documents.repartition(13, "text"), 20), (documents.coalesce(1), 7), (documents, 100_000)):
        got = shard(some, "doc_id", "text", 6, rows_per_block=per_block)
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.size, r.text_crc32, r.shard, r.slot)) for r in got.collect())


def test_sql_agrees_over_many_ranges(spark, documents, monkeypatch, tmp_path):
    import duckdb

    from lexweave.llm import oracle, queries, sharding

    documents.where("doc_id is not null and length(text) < 5000").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(sharding.shard, "__defaults__", (20, 10))
    got = queries.op6_jump_sharding(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle.OP6})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
