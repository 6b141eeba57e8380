import math
import random
import re
from collections import Counter

from rampart.llm.quality_rules import PRIOR_DOCS, PRIOR_VOTES, WINDOW, estimates, expectation_maximisation, features, label, log_odds, op5_quality_rules

from .helpers import none, odd_docs, table


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    n, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if n[w] > 1:
            covered.update(range(k, k + WINDOW))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op5_quality_rules(spark, sf).collect()}
    for i, t in texts.items():
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_repeats_that_overlap(spark):
    a, b = " ".join("abcdefgh"), " ".join("ijklmnop")
    rows = [(1, f"{a} x {a} y {b} {b} {b}"), (2, "z " * 40), (3, "a\na\nb\n\n\na"), (4, f"{a}{a}")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in features(table(spark, rows)).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_estimation_finds_the_odd_class():
    # Two rules that go together make a class; a vote that goes with nothing is no evidence by itself.
    patterns = [((1, 1, 1), 900), ((-1, 1, -1), 60), ((-1, 1, 1), 10), ((1, 1, -1), 10), ((0, 1, 0), 20)]
    share, weights = expectation_maximisation(patterns, 3)
    assert log_odds(share, weights, (1, 1, 1)) > 0 > log_odds(share, weights, (-1, 1, -1)) and 0.7 < share < 0.99
    assert all(w[-1] <= 0 <= w[1] for w in weights)


def density(patterns, n_rules, rounds):
    """Log posterior density of the estimates after some rounds, by their definition."""
    share, rates = estimates(patterns, n_rules, rounds)
    total = sum(n * math.log(sum(s * math.prod(by[c][v] for by, v in zip(rates, votes, strict=True)) for c, s in ((1, share), (0, 1 - share)))) for votes, n in patterns)
    return total + sum(k * math.log(s) for k, s in zip(PRIOR_DOCS, (1 - share, share), strict=True)) + sum(PRIOR_VOTES[c][v] * math.log(by[c][v]) for by in rates for c in (0, 1) for v in (-1, 0, 1))


def test_each_round_raises_the_density():
    rng = random.Random(4)
    patterns = [(tuple(rng.choice((-1, 0, 1, 1)) for _ in range(4)), rng.randint(1, 90)) for _ in range(30)]
    found = [density(patterns, 4, k) for k in (0, 1, 2, 3, 5, 10, 50)]
    assert all(a < b + 1e-9 for a, b in zip(found, found[1:], strict=False)) and found[0] < found[-1]


def test_junk_goes_and_prose_stays(spark, sf):
    made = lambda seed, n: ["".join(random.Random(seed * 1000 + k).choices("aeioustnrl", k=5)) for k in range(n)]
    rows = [(i, " ".join(made(i, 90)) + ".") for i in range(60)] + [(100 + i, " ".join(w + "***" for w in made(500 + i, 60))) for i in range(6)]
    got = {r.doc_id: r.kept for r in label(features(table(spark, rows))).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(6))


def test_odd_rows(spark):
    got = label(features(odd_docs(spark))).collect()
    assert len(got) == 12 and all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (2, 3, 4))
    assert label(features(none(spark))).count() == 0


def test_no_python(spark, sf):
    plan = op5_quality_rules(spark, sf)._jdf.queryExecution().toString() + features(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
