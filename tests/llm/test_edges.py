"""Rows without an id, repeated ids, long texts and clashing columns in the operators on fingerprints, lines, windows and tokens."""

import hashlib

import pytest

from rankforge.llm.line_dedup import dedup_lines, line_dedup_digest
from rankforge.llm.simhash import simhash_groups
from rankforge.llm.substring_dedup import substring_digest
from rankforge.llm.token_counts import token_counts

WINDOW = " ".join(f"w{i}" for i in range(13))


def test_fingerprints_of_rows_without_an_id(spark):
    rows = [(5, "a b c d", 1), (None, "A b c  d", 2), (3, "a b c d", 3), (3, None, 4), (None, None, 5), (9, "", 6), (7, "quite other words stand here", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint long")
    got = simhash_groups(docs).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    [(same, least)] = seen[5]
    assert least == 3 and seen[9] == {("0" * 16, 3)} and (same, 3) in seen[3] and ("0" * 16, 3) in seen[3]  # id 3 holds both texts
    assert {f for f, _ in seen[None]} == {same, "0" * 16} and seen[7].isdisjoint(seen[5])


def test_windows_of_rows_without_an_id(spark):
    rows = [(4, WINDOW + " x", "k"), (2, "y " + WINDOW, "k"), (None, WINDOW, "k"), (None, None, "k"), (2, WINDOW, "k"), (6, (WINDOW + " ") * 3000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_digest(docs).collect())
    # The smallest id keeps its words in both of its rows; a row without an id neither gives nor loses windows.
    assert [g for g in got if g[0] in (0, 2, 4)] == [(0, 0, 0), (0, 13, 0), (2, 13, 0), (2, 14, 0), (4, 14, 13)]
    [long] = [g for g in got if g[0] == 6]
    assert long[1] == 39000 and long[2] == 39000


def test_tokens_of_long_texts_and_rows_without_an_id(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    texts = ["ab" * 40_000, "word " * 30_000, "é́漢字 🙂 " * 5_000, "1234567890" * 3_000, None, ""]
    docs = spark.createDataFrame([(None if i % 2 else i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, path).collect())
    assert got == sorted((len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for t in texts)


def test_hashes_of_kept_lines(spark):
    line = "a line of more than twenty characters"
    rows = [(1, f"{line}\nown", 0), (2, f"own\n {line.upper()} ", 0), (3, line, 0), (None, line, 0), (4, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: r for r in line_dedup_digest(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1]["n_dropped"], got[1]["kept_sha256"]) == (1, sha("own")) and got[2]["kept_sha256"] == sha("own")
    assert (got[3]["n_dropped"], got[3]["kept_sha256"]) == (0, sha(line)) and (got[4]["n_lines"], got[4]["n_dropped"]) == (1, 0)
    assert dedup_lines(docs).count() == len(rows)
