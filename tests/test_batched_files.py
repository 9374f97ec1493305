"""Steps over many small files hand on a batch for a batch of names."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tableproof.sources import files
from tableproof.sources.scan import BATCH_ROWS, scan_parquet, schema_of

N = 50


@pytest.fixture
def small(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(N):
        (tmp_path / "in" / f"f{i}").write_bytes(b"x" * i)
    root = f"file:{tmp_path}/in"
    return pa.RecordBatch.from_pydict({"root": [root] * N, "rel": [f"f{i}" for i in range(N)]}), f"file:{tmp_path}/out"


def test_hashing_hands_on_one_batch(small):
    (out,) = files._hash_files(iter([small[0]]))
    assert [(r["rel"], r["bytes"], r["sha256"]) for r in out.to_pylist()] == [
        (f"f{i}", i, hashlib.sha256(b"x" * i).hexdigest()) for i in range(N)]


def test_copying_moving_and_deleting_hand_on_one_batch(small, tmp_path):
    names, there = small
    (copied,) = files._copy_files(iter([names.append_column("target", pa.array([there] * N))]))
    assert copied.num_rows == N and len(list((tmp_path / "out").iterdir())) == N
    (tmp_path / "end").mkdir()
    landed = pa.RecordBatch.from_pydict({"root": [there] * N, "rel": names.column("rel"), "target": [f"file:{tmp_path}/end"] * N})
    (moved,) = files._move_files(iter([landed]))
    assert moved.num_rows == N and not list((tmp_path / "out").iterdir())
    (gone,) = files._delete_files(iter([pa.RecordBatch.from_pydict({"root": [f"file:{tmp_path}/end"] * N, "rel": names.column("rel")})]))
    assert gone.num_rows == N and gone.schema.names == ["root", "rel", "target"] and not list((tmp_path / "end").iterdir())


def test_small_files_and_a_large_one_are_read_whole(spark, tmp_path):
    sizes = {"large": 2 * BATCH_ROWS + 5, "none": 0} | {f"small-{i}": i for i in range(1, 40)}
    for at, (name, n) in enumerate(sizes.items()):
        pq.write_table(pa.table({"idx": pa.array([at] * n, pa.int64()), "pos": pa.array(range(n), pa.int64())}), tmp_path / name)
    held = files.list_files(spark, str(tmp_path)).selectExpr("root", "rel", "bytes", "rel AS name")
    rows = scan_parquet(held, schema_of(spark, [str(tmp_path / "large")]), keep=["name"]).groupBy("name").agg({"pos": "count", "idx": "max"})
    assert {r["name"]: (r["count(pos)"], r["max(idx)"]) for r in rows.collect()} == {n: (size, at) for at, (n, size) in enumerate(sizes.items()) if size}
