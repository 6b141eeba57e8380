"""Language ID and the quality classifier."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rampart.llm import language_id, quality_crf
from rampart.llm.common import held_out
from rampart.llm.language_id import fit, keep_known, ngram_ids, op8_language_id, predict
from rampart.llm.quality_crf import forward_backward, line_features, op7_quality_classifier, score, train

from .helpers import none, odd_docs, table


def test_language_accuracy_on_held_out_rows(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in op8_language_id(spark, sf).collect() if r.held_out]
    assert len(got) > 20 and sum(langs[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_a_text_scores_alike_in_any_batch(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (model,) = fit(docs).blocks()
    texts = [r.text for r in docs.limit(20).collect()] + ["", "\0a\0", "x"]
    together, alone = model.predict(texts), [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and together[1] == pytest.approx([a[1][0] for a in alone])
    ids, starts = ngram_ids(["ab", "cd"])
    assert starts.tolist() == [0, 3] and ids[1][1] == ids[1][2] == language_id.BUCKETS


def test_no_letter_is_und(spark, sf):
    model = fit(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r.doc_id: r for r in predict(odd_docs(spark), model).collect() if r.doc_id is not None}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 9)) and got[8].lang_pred != "und"


def test_language_without_rows(spark):
    assert predict(none(spark), fit(none(spark))).count() == 0
    blank = table(spark, [(1, "abc"), (2, None)])
    assert [r.lang_pred for r in predict(blank, fit(blank)).collect()] == ["und", "und"] and keep_known(blank).count() == 0
    kept = keep_known(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns


def bucket(chars):
    """The bucket of an n-gram, one step a character."""
    mixed = 0
    for order, c in enumerate(chars, 1):
        mixed = (mixed + ord(c) + order) * int(language_id._MULT[order - 1]) % 2**64
        mixed ^= mixed >> 29
    return mixed * 0x9E3779B97F4A7C15 % 2**64 >> 49


def grams(text):
    low = text.lower()
    return [bucket(low[i : i + n]) for n in language_id.ORDERS for i in range(len(low) - n + 1)]


def test_against_plain_naive_bayes(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    learned = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5 and t is not None and x is not None]
    counts, docs = {}, Counter(x for _, x in learned)
    for t, x in learned:
        counts.setdefault(x, Counter()).update(grams(t))
    total = {x: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for x, c in counts.items()}
    got = {r.doc_id: r for r in op8_language_id(spark, sf).collect()}
    for i, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        n = Counter(grams(t))
        w = {x: math.log((docs[x] + 1) / (len(learned) + len(docs))) + sum(k * math.log((counts[x][b] + language_id.SMOOTHING) / total[x]) for b, k in n.items()) for x in sorted(docs)}
        best = max(w, key=w.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(v - w[best]) for v in w.values()), rel=1e-2)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_blocks_of_languages_give_what_one_gives(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    one, many = ({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in predict(docs, fit(docs, block=k)).collect()} for k in (64, 1))
    assert one == many and len({x for x, _ in one.values()}) > 1
    wide = table(spark, [(i, f"word{i} {i}", f"l{i:03d}") for i in range(300)])
    got = predict(wide, fit(wide)).collect()
    assert len(got) == 300 and {r.lang_pred for r in got} <= {f"l{i:03d}" for i in range(300)}


def test_a_bounded_sample_keeps_rare_languages(spark):
    docs = table(spark, [(i, "common words here", "en") for i in range(3000)] + [(5000 + i, "xyzzy quux", "xx") for i in range(6)])
    model = fit(docs, max_train_docs=50, language_docs=20)
    (block,) = model.blocks()
    assert block.languages == ["en", "xx"] and model.total > 2000
    assert model.sums.where(f"lang = 'en' AND bucket < {language_id.BUCKETS}").agg({"n": "max"}).first()[0] < 500
    assert [r.lang_pred for r in predict(table(spark, [(1, "xyzzy")]), model).collect()] == ["xx"]


def test_held_out_rows_are_not_learned_from(spark):
    docs = table(spark, [(i, "aaa bbb" if i % 2 else "xyz", f"l{i}") for i in range(40)])
    learned = {x for b in fit(docs, block=7).blocks() for x in b.languages}
    assert learned == {f"l{r.doc_id}" for r in docs.where(~held_out()).collect()}


def paths(emit, move):
    """Marginals by listing all paths."""
    n, total, good = len(emit), 0.0, np.zeros(len(emit))
    for k in range(2**n):
        y = [(k >> i) & 1 for i in range(n)]
        w = math.exp(sum(e for e, s in zip(emit, y, strict=True) if s) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.array(y)
    return good / total, math.log(total)


@pytest.mark.parametrize("segment", [1024, 1, 2, 3])
def test_marginals_are_those_of_all_paths(monkeypatch, segment):
    monkeypatch.setattr(quality_crf, "SEGMENT", segment)
    rng = np.random.default_rng(2)
    move, first = rng.normal(size=(2, 2)), np.array([0, 5, 6, 9])
    emit = rng.normal(size=13) * 2
    good, moves, log = forward_backward(emit, move, first)
    parts = [paths(emit[a:b], move) for a, b in zip(first, [5, 6, 9, 13], strict=True)]
    assert good == pytest.approx(np.concatenate([p for p, _ in parts])) and log == pytest.approx([x for _, x in parts])
    assert moves.sum(axis=(1, 2)) == pytest.approx([4, 0, 2, 3])


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(5)
    x, first, labels, theta = rng.normal(size=(12, 3)), np.array([0, 4, 5, 11]), np.array([1, 0, 0, 1]), rng.normal(size=8)
    _, grad = quality_crf.objective(theta, x, first, labels)
    for k in range(8):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert grad[k] == pytest.approx((quality_crf.objective(up, x, first, labels)[0] - quality_crf.objective(down, x, first, labels)[0]) / 2e-5, abs=1e-6)


def test_document_score_is_the_weighted_mean_of_line_marginals():
    field = train(line_features(["good words here\nmore of them", "### $$$\n***"])[0].astype(float), np.array([0, 2]), np.array([1, 0]))
    text = "some words\n\n### $$\nand the last line"
    features, chars, _ = line_features([text])
    good, _ = paths(field.emit(features), field.move)
    sizes = np.array([len(x) + 1 for x in text.split("\n")])
    assert chars.tolist() == [len(x) for x in text.split("\n")]
    assert field.score([text, "x"])[0] == pytest.approx((good * sizes).sum() / sizes.sum())


def test_lines_of_the_sample_are_bounded(spark):
    docs = table(spark, [(i, "word words\n" * (400 if i == 3 else 9)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality_crf.fit(docs, labels, max_train_lines=100) is not None and quality_crf.fit(docs, labels, max_train_lines=5) is None


def test_features_do_not_cross_texts():
    both, _, first = line_features(["a b\n### x\na b", "q\n"])
    alone, _, _ = line_features(["q\n"])
    assert first.tolist() == [0, 3] and both[3:] == pytest.approx(alone) and both[2, 4] == 1 and both[0, 4] == 0


def test_field_learns_from_neighbours():
    texts = ["fine words here\n" * 4 + "so"] * 30 + ["###*** $$$\n" * 3 + "$$$"] * 10
    features, _, first = line_features(texts)
    field = train(features.astype(float), first, np.array([1] * 30 + [0] * 10))
    assert field.score(["fine words here\nmore words", "*** $$$\n###"]).round().tolist() == [1, 0]
    assert 0 <= field.score([None])[0] <= 1


def test_quality_on_held_out_rows(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.score, r.predicted) for r in op7_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s, _ in got if y], [s for y, s, _ in got if not y]
    assert good and all(p == int(s >= quality_crf.THRESHOLD) for _, s, p in got)
    assert not bad or np.mean([[g > b for g in good] for b in bad]) > 0.9


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (6, 0, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    got = score(docs, quality_crf.fit(docs, labels)).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score(docs, quality_crf.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert score(none(spark), None).count() == 0
