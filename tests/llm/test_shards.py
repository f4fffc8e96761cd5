import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import shards

from .conftest import KIND


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 1000, 4097])
def test_a_permutation_and_its_inverse(n):
    shuffle = shards.Shuffle(n, 8)
    at = shuffle.position(np.arange(n))
    assert sorted(at.tolist()) == list(range(n))
    for row in range(0, n, max(1, n // 50)):
        assert shuffle.place(row) == (at[row] % 8, at[row] // 8) and shuffle.row_at(*shuffle.place(row)) == row


def test_it_shuffles():
    """Neighbours are dealt apart, other seeds deal otherwise, and large numbers work."""
    n = 100_000
    at = shards.Shuffle(n, 8).position(np.arange(n))
    assert abs(np.corrcoef(np.arange(n), at)[0, 1]) < 0.02 and abs(np.corrcoef(at[:-1], at[1:])[0, 1]) < 0.02
    assert abs(np.bincount(at[::8] % 8, minlength=8) - n / 64).max() < 5 * (n / 64) ** 0.5
    assert (at == shards.Shuffle(n, 8, "other").position(np.arange(n))).sum() < 20
    big = shards.Shuffle(3 * 10**17, 1000)
    for row in (0, 1, 10**17, 3 * 10**17 - 1):
        assert big.row_at(*big.place(row)) == row


def contract(rows, got):
    """What the query's rows must be for these documents."""
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[i]) for i in range(8)]
    assert max(counts) - min(counts) <= 1


def test_query_by_brute_force(spark, odd_rows, tmp_path):
    """Places as computed from file names and rows' places in them; the same from other splits."""
    docs = spark.createDataFrame(odd_rows, KIND).withColumns({c: F.lit("x") for c in ("row", "number", "shard", "slot", "_file")})
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = shards.op12_shards(spark, str(tmp_path)).collect()
    contract(odd_rows, got)
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "documents.parquet").glob("*.parquet"))
    ids = [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()]
    shuffle = shards.Shuffle(len(ids), 8)
    assert collections.Counter((r.doc_id, r.shard, r.slot) for r in got) == collections.Counter((d, *shuffle.place(i)) for i, d in enumerate(ids))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert sorted(map(str, shards.op12_shards(spark, str(tmp_path)).collect())) == sorted(map(str, got))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_shards_hold_whole_rows_in_order(spark, odd, odd_rows, tmp_path):
    rows = shards.numbered(odd, ["doc_id", "text"])
    shuffle = shards.Shuffle(len(odd_rows), 3, "mine")
    back = shards.write_shards(rows, shuffle, f"file://{tmp_path}/out", file_rows=7)
    key = lambda r: str((r.doc_id, r.text, r.lang, r.source))
    got = back.collect()
    assert sorted(map(key, (r.row for r in got))) == sorted(map(key, odd.collect())) and {r.row["kept"] for r in got} == {"x"}
    assert {(r.number, r.shard, r.slot) for r in got} == {(i, *shuffle.place(i)) for i in range(len(odd_rows))}
    import pyarrow.parquet as pq

    for f in (tmp_path / "out").glob("shard=*/*.parquet"):  # consecutive slots, in order, at most 7 of them
        slots = pq.read_table(f)["slot"].to_pylist()
        assert slots == list(range(slots[0], slots[0] + len(slots))) and len(slots) <= 7 + len(odd_rows) % 7


def test_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert shards.op12_shards(spark, str(tmp_path)).isEmpty()
    assert shards.write_shards(shards.numbered(none, ["doc_id"]), shards.Shuffle(0, 4), f"file://{tmp_path}/out").isEmpty()
