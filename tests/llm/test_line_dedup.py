from collections import Counter

from rampart.llm import line_dedup
from rampart.llm.line_dedup import cleaned, dedup_lines

from .helpers import none, odd_docs, table


def test_ratio_is_of_the_host(spark):
    rows = [(i, f"head\nbody {i}\n  head  \n\nfoot", None, "a") for i in range(10)] + [(10 + i, f"text {i}" + ("\nhead" if i < 3 else ""), None, "b") for i in range(30)] + [(50, "head", None, None)]
    got = {r.doc_id: r for r in cleaned(table(spark, rows)).collect()}
    assert got[3].text == "body 3\n" and got[3].n_chars == len("body 3\n")
    assert got[10].text == "text 0\nhead"  # 3 of 30 pages are not over a tenth
    assert got[50].text == "head"  # too few pages


def test_against_plain(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, total = Counter(), Counter()
    for _, t, s in docs:
        total[s] += 1
        n.update((s, x) for x in {y.strip(" \t\r\x0b\x0c") for y in (t or "").split("\n")} if x)
    drop = {k for k, c in n.items() if c >= line_dedup.MIN_PAGES and c * 100 > total[k[0]] * line_dedup.MAX_PERCENT}
    want = {i: "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r\x0b\x0c")) not in drop) for i, t, s in docs}
    assert {r.doc_id: r.text for r in cleaned(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == want
    assert drop


def test_large_line_sets_are_joined(spark, monkeypatch):
    rows = [(i, f"head\nbody {i}", None, "a") for i in range(10)]
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", 0)
    assert all(r.text.startswith("body") for r in cleaned(table(spark, rows)).collect())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = cleaned(docs)
    assert got.columns == docs.columns and got.count() == 12 and got.where("_host = 'mine' AND kept = 'mine' AND n_lines = 'mine'").count() == 12
    assert got.where("doc_id = 2").first().text is None and got.where("doc_id = 4").first().text == " \n\t "
    assert cleaned(none(spark)).count() == 0


def test_no_python(spark, sf):
    plan = dedup_lines(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
