import random
import re
from collections import Counter

from rampart.llm import divergence
from rampart.llm.divergence import TERM, audit, term_counts

from .helpers import none, odd_docs, table


def plain(rows, min_docs, top):
    """The contract, by loops over every term of every pair."""
    docs = [((lang or ""), (source or ""), re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs, total = Counter(), Counter()
        for _, _, words in own:
            in_docs.update(set(words))
            total.update(words)
        kept = sorted((t for t in in_docs if in_docs[t] >= min_docs), key=str.encode)
        v, counts = len(kept), {d[1]: Counter() for d in own}
        for _, source, words in own:
            counts[source].update(words)
        sums = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sums[s] + 5 * v) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (total[t] + 5) // (sum(total[x] for x in kept) + 5 * v) for t in kept}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", o, -value, i) for i, (value, o) in enumerate(pairs, 1)]
            terms = sorted(((q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "term", t, -value, i) for i, (value, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def same(spark, rows, min_docs, top):
    got = audit(table(spark, rows), min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, min_docs, top)


def test_against_every_term_of_every_pair(spark):
    random.seed(7)
    words = ["Der", "der", "été", "ÉTÉ", "x1y", "über", "don't", "東京", "a", "bb", "CC"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(260):
        lang, source = random.choice(["en", "de", None, ""]), random.choice(["a", "b", "c", "d", None, "é", "Z"])
        few = words[: random.choice([3, 11, 30, 71])]
        rows.append((i, " ".join(random.choices(few, k=random.randint(0, 40))), lang, source))
    same(spark, rows, 5, 4)
    same(spark, rows, 30, 50)


def test_language_without_kept_terms_and_group_without_terms(spark):
    rows = [(1, "one two", "en", "a"), (2, "three", "en", "b"), (3, None, "en", "c"), (4, "alone", "fr", "a")]
    same(spark, rows, 30, 50)
    assert {(r.source, r.item, r.value) for r in audit(table(spark, rows)).collect()} == {(s, o, 0) for s in "abc" for o in "abc" if s != o}
    same(spark, [*rows, (5, "one", "en", "b"), (6, "12 34 !", "en", "d")], 2, 50)


def test_terms_are_ranked_by_value_then_bytes(spark):
    rows = [(i, "zz yy éé " * 3, "en", "a") for i in range(3)] + [(i, "other", "en", "b") for i in range(3)]
    top = [(r.item, r.rank) for r in audit(table(spark, rows), 3).collect() if r.part == "term" and r.source == "a"]
    assert sorted(top, key=lambda x: x[1]) == [("yy", 1), ("zz", 2), ("éé", 3)]
    same(spark, rows, 3, 2)


def test_counts_go_on_in_pieces_and_flushes(spark, monkeypatch):
    rows = [(i, f"ab{'c' * 30} Long, words-of a {'q' * 7}" * (i + 1), "en", "s") for i in range(6)]
    whole = sorted(map(tuple, term_counts(table(spark, rows)).groupBy("term").agg({"docs": "sum", "n": "sum"}).collect()))
    monkeypatch.setattr(divergence, "PIECE", 11)
    pieces = [w for t in [rows[5][1]] for p in divergence._pieces(t) for w in re.findall(TERM, p)]
    assert pieces == re.findall(TERM, rows[5][1]) and len(list(divergence._pieces(rows[5][1]))) > 5
    monkeypatch.undo()
    assert {t: n for t, _, n in whole} == dict(Counter(w.lower() for r in rows for w in re.findall(TERM, r[1])))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [tuple(r)[:4] for r in docs.collect()]
    assert sorted(map(tuple, audit(docs, 2, 3).collect())) == plain(rows, 2, 3)
    assert audit(none(spark)).collect() == []
