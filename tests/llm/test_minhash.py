from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rampart.llm import minhash
from rampart.llm.components import components
from rampart.llm.minhash import near_duplicates, one_of_each, op1_minhash, part_links, shingle_sets

from .helpers import none, odd_docs, prose, table


def plain_sets(rows, size):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])))
    return out


def plain_components(rows, size, percent):
    sets = {i: s for i, s in plain_sets(rows, size)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, ids = defaultdict(list), sorted(i for i in sets if sets[i])
    for i in ids:
        both = Counter(j for h in sets[i] for j in holders[h])
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for h in sets[i]:
            holders[h].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op1_minhash(spark, sf).collect()
    want = plain_components(rows, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(n, words=150, edits=4):
    base = prose(9, words).split()
    out = [(0, " ".join(base))]
    for k in range(1, n):
        w = list(base)
        for e in range(1 + k % edits):
            w[(k * 37 + e * 41) % words] = f"new{k}x{e}"
        out.append((k, " ".join(w)))
    return out


def test_crowd_in_several_parts(spark, monkeypatch):
    rows = family(300) + [(1000 + k, prose(100 + k, 60)) for k in range(40)]
    monkeypatch.setattr(minhash, "REGION_SETS", 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, rows), 4, 80).collect()}
    assert got == plain_components(rows, 4, 80)


def test_odd_rows(spark):
    got = near_duplicates(odd_docs(spark), 5, 80).collect()
    assert len(got) == 12
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[7]] == [1, 1] and not any(r.kept for r in by[7])
    assert all(r.component_id is None and r.kept for r in by[None])
    assert by[2][0].n_shingles == by[3][0].n_shingles == by[4][0].n_shingles == 0 and by[2][0].kept and by[8][0].n_shingles == 1
    kept = one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id IS NULL").count() == 2
    assert near_duplicates(none(spark)).count() == 0 and one_of_each(none(spark)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té\x0b\xa0x", max_size=40)), min_size=1, max_size=6), st.integers(1, 5))
def test_shingles(texts, size):
    sets = shingle_sets(texts, size)
    want = [s for _, s in plain_sets(list(enumerate(texts)), size)]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(np.intersect1d(sets[a], sets[b])) == len(want[a] & want[b])


def test_pivots_join_a_star():
    hub = np.arange(100, dtype=np.uint64)
    leaves = [np.unique(np.concatenate([np.delete(hub, np.arange(5) + 5 * k), np.arange(1000 + 10 * k, 1006 + 10 * k, dtype=np.uint64)])) for k in range(18)]
    keys = [bytes([k]) * 20 for k in range(19)]  # no two share a prefix
    assert part_links(keys, [hub, *leaves], [], 80) == []
    assert len(part_links(keys, [hub, *leaves], [0], 80)) == 18


def templates(n, pairs, extra, words=89):
    """n texts of a long template and words of their own, mutually below 0.8; k and k + n / 3 share `extra` of these for `pairs` k from n / 3 on, far from each other and from the smallest ids."""
    base = [f"t{k}" for k in range(words)]
    out = []
    for i in range(n):
        shared = [f"s{i % (n // 3)}x{k}" for k in range(extra if i >= n // 3 and i % (n // 3) < pairs else 0)]
        out.append((i, " ".join(base + shared + [f"o{i}x{k}" for k in range(14 - len(shared))])))
    return out


def test_pairs_in_a_template_crowd(spark):
    for extra in (3, 6):
        rows = templates(1500, 100, extra)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, rows), 4, 80).collect()}
        want = plain_components(rows, 4, 80)
        assert got == want and sum(i != c for i, (_, c) in want.items()) == 100


def test_pairs_in_a_template_crowd_of_several_parts(spark, monkeypatch):
    rows = templates(600, 60, 4)
    monkeypatch.setattr(minhash, "REGION_SETS", 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, rows), 4, 80).collect()}
    want = plain_components(rows, 4, 80)
    assert got == want and sum(i != c for i, (_, c) in want.items()) == 60


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(12, 60), st.sampled_from([50, 80, 90]))
def test_rest_is_exact(seed, n, percent):
    r = np.random.default_rng(seed)
    sets = [np.unique(np.concatenate([np.arange(30)[r.random(30) < 0.95], 100 + r.integers(0, 200, r.integers(0, 9))])).astype(np.uint64) for _ in range(n)]
    sets = [s for s in sets if len(s)]
    keys = [k.to_bytes(20) for k in r.permutation(len(sets)).tolist()]
    found, want = minhash.Forest(len(sets)), minhash.Forest(len(sets))
    for a, b in part_links(keys, sets, [], percent, exact=True):
        assert minhash.alike(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), percent)
        found.link(a, b)
    for a in range(len(sets)):
        for b in range(a):
            if minhash.alike(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), percent):
                want.link(a, b)
    assert [found.root(k) for k in range(len(sets))] == [want.root(k) for k in range(len(sets))]


def test_words_that_share_every_hash_modulo_2_64(spark):
    word = [bin(i).count("1") & 1 for i in range(1024)]
    docs = table(spark, [(1, "".join("ab"[b] for b in word)), (2, "".join("ba"[b] for b in word)), (3, "".join("AB"[b] for b in word))])
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 4).collect()} == {1: 1, 2: 2, 3: 1}
