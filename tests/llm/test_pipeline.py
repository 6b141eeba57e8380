import corpus_pipeline
from rampart.llm import line_dedup, mixing
from rampart.llm.language_id import has_letter
from rampart.llm.packing import Ids, tokenizer_path

from .helpers import none, odd_docs
from .test_minhash import plain_components


def plain(spark, docs, sf):
    """The stages but for language scores and packing places, in plain Python: ids and tokens that are left."""
    import pandas as pd

    frame = docs.toPandas()
    frame = frame[frame["text"].map(has_letter)]
    total = frame.groupby("source").size()
    lines = [(s, x) for s, t in zip(frame["source"], frame["text"], strict=True) for x in {y.strip(" \t\r\x0b\x0c") for y in t.split("\n")} if x]
    n = pd.Series(lines).value_counts()
    drop = {k for k, c in n.items() if c >= line_dedup.MIN_PAGES and c * 100 > total[k[0]] * line_dedup.MAX_PERCENT}
    frame["text"] = ["\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r\x0b\x0c")) not in drop) for s, t in zip(frame["source"], frame["text"], strict=True)]
    parts = plain_components(list(zip(frame["doc_id"], frame["text"], strict=True)), 5, 80)
    frame = frame[[parts[i][1] == i for i in frame["doc_id"]]]
    kept = {r.doc_id for r in mixing.mix(spark.createDataFrame(frame[["doc_id", "text", "lang", "source"]])).where("_kept").collect()}
    ids = Ids(tokenizer_path())
    return {i: len(ids.of(t)) // 4 + 1 for i, t in zip(frame["doc_id"], frame["text"], strict=True) if i in kept}


def test_run_against_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == plain(spark, docs, sf)
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_stages_bear_odd_rows(spark, sf):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= 12
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "pack"]


def test_stages_bear_an_empty_table(spark, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none(spark), sf)
        assert out.columns == none(spark).columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none(spark), sf).count() == 0
