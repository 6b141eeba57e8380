import numpy as np
import pandas as pd
import pytest

from rampart.llm.mixing import DIMS, fill, mix, mixed, rake, shares

from .helpers import none, odd_docs, prose, table


def cells():
    rng = np.random.default_rng(1)
    rows = [(s, x, t, int(rng.integers(1, 1000))) for s in "abcd" for x in ("en", "de") for t in ("p", "q")]
    return pd.DataFrame(rows, columns=[*DIMS, "tokens"])


def test_margins_meet_their_targets():
    c = cells()
    targets = ({"a": 0.2, "b": 0.25, "c": 0.3, "d": 0.25}, {"en": 0.55, "de": 0.45}, 1.0)
    got = rake(c, targets, 0.3)
    fitted = c["tokens"] * got["_p"]
    assert fitted.sum() == pytest.approx(0.3 * c["tokens"].sum()) and (got["_p"] <= 1).all()
    for dim, target in zip(DIMS[:2], targets[:2], strict=True):
        share = fitted.groupby(c[dim]).sum() / fitted.sum()
        assert all(share[k] == pytest.approx(v, abs=1e-6) for k, v in target.items())
    assert (got[[f"_gap{d}" for d in DIMS]] == 0).all(axis=None)


def test_what_a_value_lacks_goes_to_the_others():
    sums, share = np.array([10.0, 100.0, 1000.0, 0.0]), np.array([0.3, 0.3, 0.4, 0.0])
    goal = fill(share, sums, 555.0)
    assert goal.tolist() == pytest.approx([10, 100, 445, 0])
    c = cells()
    c.loc[c["_source"] == "a", "tokens"] //= 20
    got = rake(c, ({"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}, {"en": 0.5, "de": 0.5}, 1.0), 0.5)
    fitted = c["tokens"] * got["_p"]
    assert fitted.sum() == pytest.approx(0.5 * c["tokens"].sum(), rel=1e-4) and got["_p"][c["_source"] == "a"].min() > 0.999
    by = fitted.groupby(c["_source"]).sum()
    assert by["b"] == pytest.approx(by["c"], rel=1e-3) == by["d"] and (got["_gap_source"][c["_source"] == "a"] < -5000).all()


def test_free_values_share_what_is_left():
    got = shares(["a", "b", "c"], np.array([10.0, 30.0, 10.0]), {"a": 0.6})
    assert got.tolist() == pytest.approx([0.6, 0.3, 0.1])


def rows():
    return [(i, prose(i, 20 + i % 9), ("en", "de")[i % 2], "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(120)]


@pytest.mark.parametrize("targets", [(0.5, 0.7, 0.8), ({"hot": 0.2}, {"en": 0.5, "de": 0.5}, 1.0)])
def test_table_and_driver_agree(spark, targets):
    docs = table(spark, rows())
    a, b = ({(r.doc_id, r._probability, r._kept) for r in mix(docs, targets, rounds=2, driver_cells=n).collect()} for n in (1000, 0))
    assert a == b


def test_sample_follows_the_probabilities(spark):
    docs = table(spark, [(i, "a b c d", "en", "x" if i % 4 else "y") for i in range(4000)])
    rows = mix(docs, ({"x": 0.5, "y": 0.5}, 1.0, 1.0), keep=0.4)
    p = {r["_source"]: (r["max(_probability)"] / 1e6, r["max(_gap_source)"]) for r in rows.groupBy("_source").agg({"_gap_source": "max", "_probability": "max"}).collect()}
    kept = {r["source"]: r["count"] for r in rows.where("_kept").groupBy("row.source").count().collect()}
    assert p["y"] == (pytest.approx(0.8, abs=1e-3), 0) and p["x"] == (pytest.approx(0.8 / 3, abs=1e-3), 0) and all(abs(k - 800) < 80 for k in kept.values())
    more = {r["_source"]: (r["max(_probability)"] / 1e6, r["max(_gap_source)"]) for r in mix(docs, ({"x": 0.5, "y": 0.5}, 1.0, 1.0), keep=0.6).groupBy("_source").agg({"_gap_source": "max", "_probability": "max"}).collect()}
    assert more["y"] == (1.0, -1667) and more["x"] == (pytest.approx(1400 / 3000, abs=1e-3), 1667)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert mix(docs).count() == 12
    got = mixed(docs)
    assert got.columns == docs.columns and got.where("doc_id = 7").count() in (0, 2)
    assert mixed(none(spark)).count() == 0
