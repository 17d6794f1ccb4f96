"""Files: round trips and defaults."""

import json

from rankforge.sources import files


def test_chunks_and_qrels(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "text": "síntomas", "doc_id": "d"}\n{"id": "b", "text": "x", "doc_id": "d", "position": 2, "embedding": [0.5, 1], "meta": {"k": "v"}}\n', encoding="utf-8")
    a, b = files.read_chunks(spark, str(tmp_path / "c.jsonl")).orderBy("id").collect()
    assert (a["text"], a["position"], a["embedding"], a["meta"]) == ("síntomas", 0, None, {}) and (b["position"], b["embedding"], b["meta"]) == (2, [0.5, 1.0], {"k": "v"})
    rows = [{"query": "q", "relevant_ids": ["a", "b"]}, {"query": "r", "relevant_ids": []}]
    (tmp_path / "q.json").write_text(json.dumps(rows, indent=1))
    assert [r.asDict() for r in files.read_qrels(spark, str(tmp_path / "q.json")).collect()] == rows


def test_text_dir_and_writers(spark, tmp_path):
    d = tmp_path / "texts"
    d.mkdir()
    (d / "a.txt").write_bytes("niño\n".encode())
    (d / "b.txt").write_bytes("niño".encode("latin-1"))
    (d / "c.md").write_text("no")
    assert {r["doc"]: r["text"] for r in files.read_text_dir(spark, str(d)).collect()} == {"a.txt": "niño\n", "b.txt": "niño"}
    df = spark.createDataFrame([(1, 'say "a,b"\nnext', 0.5), (2, None, None)], "i int, s string, x double")
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(files.read_csv(spark, str(tmp_path / "out"), "i int, s string, x double").collect()) == sorted(df.collect())
    files.write_lines(df, str(tmp_path / "lines"))
    assert sorted(spark.read.schema("i int, s string, x double").json(str(tmp_path / "lines")).collect()) == sorted(df.collect())
