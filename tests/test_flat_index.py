"""Index files: round trip, completeness, broken files; hashes of terms."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import term_hash
from paperloom.sources.flat_index import decode_index, encode_index, is_complete, read_flat_index, write_flat_index


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i * 7 - 3, [float(x) for x in rng.random(5).astype(np.float32)], "x") for i in range(50)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 5, "x"), (900, None, "x")], "id long, embedding array<float>, shard string").repartition(3)
    folder = (tmp_path / "index").as_uri()
    shards = write_flat_index(df, folder, "l2").collect()
    assert sum(r.n for r in shards) == 50 and {r.dim for r in shards} == {5}
    assert {(r.id, tuple(r.embedding)) for r in read_flat_index(spark, folder).collect()} == {(i, tuple(v)) for i, v, _ in rows}
    assert is_complete(folder, 5, 50) and not is_complete(folder, 5, 51) and not is_complete(folder, 4, 50)
    # Written again: the same shards, not more of them.
    write_flat_index(df, folder, "l2").collect()
    assert read_flat_index(spark, folder).count() == 50
    assert write_flat_index(df.limit(0), (tmp_path / "none").as_uri()).count() == 0 and is_complete((tmp_path / "none").as_uri(), 5, 0)


def test_broken_files(spark):
    data = encode_index(np.array([1, 2]), np.ones((2, 3)), "inner")
    ids, vectors = decode_index(data)
    assert ids.tolist() == [1, 2] and vectors.tolist() == [[1.0] * 3] * 2
    for bad in (b"", data[:-1], b"XXXX" + data[4:], data[:4] + b"\x09" + data[5:]):
        with pytest.raises(ValueError):
            decode_index(bad)


def test_several_dimensions_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="several dimensions"):
        write_flat_index(df, (tmp_path / "bad").as_uri()).collect()


def test_term_hash(spark):
    df = spark.createDataFrame([("gene",), ("",), (None,), ("é",)], "t string")
    got = [r[0] for r in df.select(term_hash(F.col("t"))).collect()]
    assert got == [None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in ("gene", "", None, "é")]
