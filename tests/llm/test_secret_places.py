"""Secrets in long words, without digits and with marks: candidates, and what is read around each."""

from rankforge.llm.secret_scan import candidates, labelled_findings, scan_secrets, train_forest, with_features

HEX = "908038b7daaf91e730d2f64001c52934d43d9336"
KEY = "Zq8vT3nLw0XyRb61KdPf"
JSON = '{"commit":"' + HEX + '","note":"' + "lorem" * 30 + '","password":"' + KEY + '","sha":"' + HEX[::-1] + '"}'


def test_cues_stand_next_to_the_finding(spark):
    docs = spark.createDataFrame([(1, JSON), (2, "\U0001f600" * 200 + "&api_key=" + KEY + "&sha=" + HEX)], "doc_id long, text string")
    got = {(r["_id"], r["finding"]): (r["speaks_for"], r["speaks_against"]) for r in with_features(candidates(docs)).collect()}
    assert got[1, HEX] == (0, 1) and got[1, KEY] == (1, 0) and got[1, HEX[::-1]] == (0, 1)
    assert got[2, KEY] == (1, 0) and got[2, HEX] == (0, 1)


def test_distinct_characters_of_the_whole_finding(spark):
    docs = spark.createDataFrame([(1, "a1" * 150 + "bcdefghijk")], "doc_id long, text string")
    assert with_features(candidates(docs)).first()["distinct"] == 12 / 310


def test_candidates_without_digits_and_with_marks(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    rows = [(1, "password=QwErTyUiOpAsDfGh now"), (2, 'x {"secret":"Tr0ub.4dor!x@q$9"} y'), (3, f"Authorization: Bearer {jwt} end"), (4, "password: QwErTyUi.OpAs!DfGh next"), (5, "token = QwErTyUiOpAsDf."), (6, "the implementation of characteristically plain words"), (7, "mail john.smith99@example.com now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["_id"], r["finding"]) for r in candidates(docs).collect()}
    assert got == {(1, "QwErTyUiOpAsDfGh"), (2, "Tr0ub.4dor!x@q$9"), (3, jwt), (4, "QwErTyUi.OpAs!DfGh"), (5, "QwErTyUiOpAsDf"), (7, "john.smith99@example.com")}
    secret = {r["doc_id"]: r["secret"] for r in scan_secrets(docs, train_forest(labelled_findings(spark, 3000))).collect()}
    assert secret[1] and secret[2] and secret[3] and secret[4] and not secret[7]
