"""Tables that findings of the fourth review were about."""

from __future__ import annotations

import duckdb

from lectern.operators import overlay
from lectern.plans import registry


def test_verified_chapters_of_odd_documents(spark, tmp_path):
    """every document has its row and what the SQL says: without a paragraph, null, with a repeated id or none, with characters that XML refuses."""
    texts = ["", " \t\n\r\n", None, "one", "one\ntwo & <b>", "\x01\na\x0bb\x1c", "x\n\x85\n\u2028  ", "\xa0\n\u3000\nx", "x\uffff\n\ufffe", "same\nsame\n\nsame"]
    ids = [*range(5), 10**12, 10**12 + 1, None]
    rows = [(k, x) for k in ids for x in texts] + [(1, "one\ntwo & <b>")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    columns = ["chapter_idx", "n_paragraphs", "verified", "broken"]
    got = [repr(tuple(r)) for r in registry.queries()["verified_chapters"](spark, str(tmp_path)).select(*columns).collect()]
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = [repr(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['verified_chapters']})").fetchall()]
    assert sorted(got) == sorted(expected) and len(got) == len(rows)


def test_verified_rows(spark):
    """The rows of verified_chapters, and those without any element."""
    page = "<d><p>a</p><div> b </div><p/></d>"
    rows = [(1, page, [0, 1], ["a", "b"]), (2, "<d><p>A</p></d>", [0], ["a"]), (3, page, [5], ["a"]), (4, "<p>x", [0], ["x"]), (5, "<d/>", [], []), (6, None, None, None), (7, page, [2, None, -1, 1], ["", "a", "", None]), (None, page, [0], ["a"])]
    chapters = spark.createDataFrame(rows, "chapter_idx int, xhtml string, tags array<long>, texts array<string>")
    found = {r.chapter_idx: (r.n_paragraphs, r.n_wrong, r.problem is None, r.verified) for r in overlay.verified_rows(chapters).collect()}
    assert found == {1: (2, 0, True, True), 2: (1, 1, True, False), 3: (1, 1, True, False), 4: (1, 1, False, False), 5: (0, 0, True, True), 6: (0, 0, False, False), 7: (4, 3, True, False), None: (1, 0, True, True)}
