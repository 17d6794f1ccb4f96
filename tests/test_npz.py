"""Archives written by Spark read by numpy, those of numpy read by Spark, and what is refused."""

import json

import numpy as np
import pytest

from rankforge.sources import npz


def test_round_trip_with_configuration(spark, tmp_path):
    npz.register(spark)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>").repartition(3)
    config = {"noise": 0.1, "dims": [1, 2], "name": "é"}
    df.write.format("npz").option("name", "ultra").option("config", json.dumps(config)).option("stats", '{"mean": 1.5}').mode("append").save(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("*"))
    assert len(files) == 3 and all(f.suffix == ".npz" for f in files)
    seen = {}
    for f in files:
        a = np.load(f, allow_pickle=False)
        assert json.loads(str(a["ultra_config"])) == config and json.loads(str(a["ultra_stats"])) == {"mean": 1.5}
        seen |= dict(zip(a["ultra_keys"].tolist(), a["ultra"]))
    assert sorted(seen) == list(range(500)) and all((seen[i] == v[i]).all() for i in seen)
    back = spark.read.format("npz").load(str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() == 3
    keys = {(r.file, r.row): int(r.numbers[0]) for r in back.where("array = 'ultra_keys'").collect()}
    rows = back.where("array = 'ultra'").collect()
    assert len(rows) == 500 and all(r.numbers == v[keys[r.file, r.row]].tolist() for r in rows)
    assert {json.loads(r.texts[0])["name"] for r in back.where("array = 'ultra_config'").collect()} == {"é"}
    df.limit(3).write.format("npz").mode("overwrite").save(str(tmp_path / "out"))
    assert spark.read.format("npz").option("array", "embeddings").load(str(tmp_path / "out")).count() == 3


def test_arrays_of_every_kind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(npz, "BLOCK_BYTES", 64)
    a = np.arange(60, dtype=np.float32).reshape(20, 3)
    kinds = {"f": a, "order": np.asfortranarray(a), "i": np.arange(7, dtype=">i2"), "b": np.array([True, False]), "s": np.array(["a", "ñé"]), "y": np.array([b"xy"]), "one": np.array(2.5), "none": np.zeros((0, 4)), "cube": np.arange(24.0).reshape(2, 3, 4)}
    np.savez_compressed(tmp_path / "x.npz", **kinds)
    npz.register(spark)
    rows = spark.read.format("npz").load(str(tmp_path / "x.npz")).collect()
    for name, want in kinds.items():
        own = [r for r in sorted(rows, key=lambda r: r.row) if r.array == name]
        flat = want.reshape(len(want) if want.shape else 1, -1) if want.size else []
        if name in "sy":
            assert [r.texts for r in own] == [[str(np.array(x).astype("U"))] for x in want]
        else:
            assert [r.numbers for r in own] == [x.astype(float).tolist() for x in flat]


def test_objects_are_refused(spark, tmp_path):
    np.savez(tmp_path / "bad.npz", x=np.array([{"a": 1}], dtype=object))
    npz.register(spark)
    with pytest.raises(Exception, match="unpickled"):
        spark.read.format("npz").load(str(tmp_path / "bad.npz")).collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("npz").load(str(tmp_path / "empty")).collect() == []
