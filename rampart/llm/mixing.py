"""Mixing sources to target weights by iterative proportional fitting.

Token sums per cell (source, language, topic) are raked, one margin after the
other, until each margin has its goal. A cell's documents are kept with the
probability that its fitted sum has of its own sum. A document's draw is a hash
of its id, so a rerun keeps the same ones.

A margin's target is given as shares by value, or as an exponent: the margin's
own shares to that power, which lifts small sources and lowers hot ones. Of all
tokens `keep` are wanted. No document is kept more than once, so a value may hold
less than its target: its goal is then all it holds, and what it leaves goes to the
others in proportion to their targets. Raking keeps to the same bound: a cell at
its whole sum stays there, and the others of the margin make up for it. How far each
value is from its target is reported with every row.

Up to DRIVER_CELLS cells (12 MB) are raked in numpy on the driver. Beyond, the
same steps run as grouped sums and joins over a table of cells, written after
each margin, until a round moves no probability by more than a billionth.

Defined cases: null and empty source, language or topic are the same value; a
document without words weighs nothing and is kept with its cell's probability; a
cell without tokens is kept with probability `keep`; a value without a target keeps
its own share of what the targets leave; repeated rows share one draw; a null id draws
as the empty text; an empty table gives an empty one; other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

DIMS = ("_source", "_lang", "_topic")
TARGETS = (0.5, 0.7, 0.8)
KEEP = 0.75
ROUNDS = 60
SETTLED = 1e-9
#: A cell from this part of its sum on counts as whole.
FULL = 1 - 1e-9
DRIVER_CELLS = 200_000
STEPS = 1_000_000  # probabilities are whole millionths
#: Patterns that name a topic, each with a text that it needs and that is cheap to look for; the first that matches, else `prose`.
Topics = tuple[tuple[str, str, str], ...]
TOPICS: Topics = (("legal", "", "[Cc]opyright|[Ll]icen[cs]e"), ("contact", "@", "[A-Za-z0-9._]@[A-Za-z0-9]+[.][a-z]"), ("noisy", "", "[#*$%&]{3}"), ("figures", "", "[0-9]{4}"))
Target = float | dict[str, float]


def topic(text: Column, topics: Topics = TOPICS) -> Column:
    found = F.lit("prose")
    for name, needs, pattern in reversed(topics):
        found = F.when(F.contains(text, F.lit(needs)) & text.rlike(pattern), name).otherwise(found)
    return F.when(text.isNull(), "prose").otherwise(found)


def weighed(docs: DataFrame, columns: list[str] | None = None, topics: Topics = TOPICS) -> DataFrame:
    """row (the given columns of docs, else all, as a struct, so that no name clashes), doc_id, the three margins' values and _tokens, the number of words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns)).alias("row")
    tokens = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")
    return docs.select(row, "doc_id", blank("source").alias("_source"), blank("lang").alias("_lang"), topic(F.col("text"), topics).alias("_topic"), tokens.alias("_tokens"))


def shares(values: list[str], sums: np.ndarray, target: Target) -> np.ndarray:
    """The target share of each value of a margin."""
    if isinstance(target, dict):
        left = max(0.0, 1 - sum(target.get(v, 0.0) for v in values))
        free = np.array([0.0 if v in target else s for v, s in zip(values, sums, strict=True)])
        got = np.array([target.get(v, 0.0) for v in values]) + (left * free / free.sum() if free.sum() else 0)
    else:
        got = np.where(sums > 0, np.maximum(sums, 1e-300) ** target, 0.0)
    return got / got.sum() if got.sum() else got


def fill(share: np.ndarray, sums: np.ndarray, wanted: float) -> np.ndarray:
    """Goal of each value: its share of `wanted`, or all it holds, so that the goals sum to `wanted`."""
    ratio = np.divide(sums, share, out=np.full(len(sums), 1e300), where=share > 0)
    order = np.argsort(ratio, kind="stable")
    s, h = sums[order], share[order]
    left = (wanted - (np.cumsum(s) - s), 1 - (np.cumsum(h) - h))
    taken = left[0] >= ratio[order] * left[1]
    level = (wanted - s[taken].sum()) / max(1 - h[taken].sum(), 1e-300)
    goal = np.empty(len(sums))
    goal[order] = np.where(taken, s, np.minimum(s, h * level))
    return goal


def rake(cells: pd.DataFrame, targets: tuple[Target, ...] = TARGETS, keep: float = KEEP, rounds: int = ROUNDS) -> pd.DataFrame:
    """cells (DIMS, tokens) with _p, the probability of each, and _gap_<dim>, how far its value of that margin is from its target, in hundredths of a percent."""
    held = cells["tokens"].to_numpy(dtype=np.float64)
    fitted, margins = held * keep, []
    wanted = fitted.sum()
    for dim, target in zip(DIMS, targets, strict=True):
        codes, values = pd.factorize(cells[dim], sort=True)
        sums = np.bincount(codes, held, len(values))
        share = shares(list(values), sums, target)
        margins.append((codes, fill(share, sums, wanted), share * wanted))
    for _ in range(rounds):
        for codes, goal, _ in margins:
            full = fitted >= held * FULL
            stays = np.bincount(codes, np.where(full, fitted, 0), len(goal))
            sums = np.bincount(codes, fitted, len(goal))
            down = np.divide(goal, sums, out=np.ones_like(goal), where=sums > 0)
            up = np.divide(goal - stays, sums - stays, out=np.ones_like(goal), where=sums > stays)
            fitted = np.where((sums >= goal)[codes], fitted * down[codes], np.where(full, fitted, np.minimum(held, fitted * up[codes])))
    out = cells.assign(_p=np.divide(fitted, held, out=np.full(len(held), float(keep)), where=held > 0))
    for dim, (codes, _, target) in zip(DIMS, margins, strict=True):
        got = np.bincount(codes, fitted, len(target))
        gap = np.divide(got, target, out=np.ones_like(got), where=target > 0) - 1
        out[f"_gap{dim}"] = np.floor(gap * 1e4 + 0.5).astype(np.int64)[codes]
    return out


def _goals(cells: DataFrame, dim: str, target: Target, keep: float) -> DataFrame:
    """dim, _goal and _target of each value of a margin of a table of cells."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("_s"))
    if isinstance(target, dict):
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], f"{dim} string, _t double")
        sums = sums.join(F.broadcast(given), dim, "left")  # as many rows as the caller gave
        used = sums.agg(F.sum("_t"), F.sum(F.when(F.col("_t").isNull(), F.col("_s")))).first()
        left, free = max(0.0, 1 - (used[0] or 0.0)), used[1] or 0.0
        share = F.coalesce("_t", F.col("_s") * (left / free if free else 0.0))
    else:
        share = F.when(F.col("_s") > 0, F.pow("_s", F.lit(target))).otherwise(0.0)
    sums = materialise(sums.select(dim, "_s", share.alias("_share")), "mix-goal")
    whole = sums.agg(F.sum("_share"), F.sum("_s")).first()
    wanted, level, before = (whole[1] or 0.0) * keep, (whole[1] or 0.0) * keep, None
    part = F.col("_share") / F.lit(whole[0] or 1.0)
    while level != before:  # it rises until no more values are taken whole
        taken = F.col("_s") <= part * level
        s, h = sums.agg(F.sum(F.when(taken, F.col("_s")).otherwise(0.0)), F.sum(F.when(taken, 0.0).otherwise(part))).first()
        before, level = level, max(level, (wanted - (s or 0.0)) / h) if h else level
    return materialise(sums.select(dim, F.least("_s", part * level).alias("_goal"), (part * wanted).alias("_target")), "mix-goal")


def rake_table(cells: DataFrame, targets: tuple[Target, ...] = TARGETS, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """The same over a table of cells that is too large for the driver."""
    goals = [_goals(cells, dim, target, keep) for dim, target in zip(DIMS, targets, strict=True)]
    fitted = cells.withColumn("_w", F.col("tokens") * F.lit(float(keep)))
    full = F.col("_w") >= F.col("tokens") * F.lit(FULL)
    for _ in range(rounds):
        start = fitted
        for dim, goal in zip(DIMS, goals, strict=True):
            sums = fitted.groupBy(dim).agg(F.sum("_w").alias("_sum"), F.sum(F.when(full, F.col("_w")).otherwise(0.0)).alias("_stays")).join(goal, dim)
            down = F.when(F.col("_sum") > 0, F.col("_goal") / F.col("_sum")).otherwise(1.0)
            up = F.when(F.col("_sum") > F.col("_stays"), (F.col("_goal") - F.col("_stays")) / (F.col("_sum") - F.col("_stays"))).otherwise(1.0)
            ratio = sums.select(dim, (F.col("_sum") >= F.col("_goal")).alias("_less"), down.alias("_down"), up.alias("_up"))
            w = F.when(F.col("_less"), F.col("_w") * F.col("_down")).when(full, F.col("_w")).otherwise(F.least(F.col("tokens").cast("double"), F.col("_w") * F.col("_up")))
            fitted = materialise(fitted.join(ratio, dim).select(*DIMS, "tokens", w.alias("_w")), "mix-cells")
        moved = fitted.join(start.select(*DIMS, F.col("_w").alias("_was")), list(DIMS)).agg(F.max(F.abs(F.col("_w") - F.col("_was")) / F.greatest("tokens", F.lit(1)))).first()[0]
        if (moved or 0.0) < SETTLED:
            break
    out = fitted
    for dim, goal in zip(DIMS, goals, strict=True):
        got = fitted.groupBy(dim).agg(F.sum("_w").alias("_got")).join(goal, dim)
        gap = F.when(F.col("_target") > 0, F.col("_got") / F.col("_target") - 1).otherwise(0.0)
        out = out.join(got.select(dim, F.floor(gap * 1e4 + 0.5).alias(f"_gap{dim}")), dim)
    p = F.when(F.col("tokens") > 0, F.col("_w") / F.col("tokens")).otherwise(F.lit(float(keep)))
    return out.select(*DIMS, p.alias("_p"), *(f"_gap{d}" for d in DIMS))


def mix(docs: DataFrame, targets: tuple[Target, ...] = TARGETS, keep: float = KEEP, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS, columns: list[str] | None = None, topics: Topics = TOPICS) -> DataFrame:
    """weighed() with _probability (in millionths), _gap_<dim> of its values (hundredths of a percent) and _kept."""
    rows = materialise(weighed(docs, columns, topics), "mix-rows")  # texts are read once
    cells = materialise(rows.groupBy(*DIMS).agg(F.sum("_tokens").alias("tokens")), "mix-cells")
    if cells.count() <= driver_cells:
        found = cells.toPandas().sort_values(list(DIMS), ignore_index=True)
        found = rake(found, targets, keep, rounds) if len(found) else found.assign(_p=0.0, **{f"_gap{d}": 0 for d in DIMS})
        ddl = ", ".join([*(f"{d} string" for d in DIMS), "_p double", *(f"_gap{d} long" for d in DIMS)])
        odds = F.broadcast(docs.sparkSession.createDataFrame(found[[*DIMS, "_p", *(f"_gap{d}" for d in DIMS)]], ddl))
    else:
        odds = rake_table(cells, targets, keep, rounds)
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % STEPS
    joined = rows.join(odds, list(DIMS)).withColumn("_probability", F.floor(F.col("_p") * STEPS + 0.5).cast("long"))
    return joined.withColumn("_kept", draw < F.col("_probability")).drop("_p")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])
    gaps = [F.col(f"_gap{d}").alias(f"{d[1:]}_gap") for d in DIMS]
    return docs.select("row.doc_id", "row.source", "row.lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_probability").alias("probability_millionths"), *gaps, F.col("_kept").alias("kept"))


def mixed(docs: DataFrame) -> DataFrame:
    """documents in, the sampled documents out."""
    return mix(docs).where("_kept").select("row.*")


def _oracle() -> str:
    case = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, _, p in TOPICS)
    steps = [
        f"d AS (SELECT doc_id, source, lang, coalesce(source, '') AS _source, coalesce(lang, '') AS _lang, CASE {case} ELSE 'prose' END AS _topic, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents)",
        "c AS (SELECT _source, _lang, _topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        f"t AS (SELECT {KEEP} * sum(tokens) AS wanted FROM c)",
    ]
    for dim, power in zip(DIMS, TARGETS, strict=True):
        steps += [
            f"s{dim} AS (SELECT {dim}, sum(tokens) AS s, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {power}) ELSE 0 END AS g FROM c GROUP BY {dim})",
            f"h{dim} AS (SELECT {dim}, s, g / (SELECT sum(g) FROM s{dim}) AS h, CASE WHEN g > 0 THEN s / (g / (SELECT sum(g) FROM s{dim})) ELSE 'inf'::DOUBLE END AS r FROM s{dim})",
            f"o{dim} AS (SELECT *, wanted - (sum(s) OVER w - s) >= r * (1 - (sum(h) OVER w - h)) AS taken FROM h{dim}, t WINDOW w AS (ORDER BY r, {dim} ROWS UNBOUNDED PRECEDING))",
            f"l{dim} AS (SELECT (any_value(wanted) - coalesce(sum(s) FILTER (WHERE taken), 0)) / greatest(1 - coalesce(sum(h) FILTER (WHERE taken), 0), 1e-300) AS level FROM o{dim})",
            f"g{dim} AS (SELECT {dim}, CASE WHEN taken THEN s ELSE least(s, h * level) END AS goal, h * wanted AS target FROM o{dim}, l{dim})",
        ]
    body = "f"
    for dim in DIMS:
        total, stays = f"sum(w) OVER (PARTITION BY x.{dim})", f"sum(CASE WHEN w >= tokens * {FULL} THEN w ELSE 0 END) OVER (PARTITION BY x.{dim})"
        sums = f"(SELECT k, x._source, x._lang, x._topic, tokens, w, goal, {total} AS total, {stays} AS stays FROM {body} x JOIN g{dim} g ON x.{dim} = g.{dim})"
        less = "w * CASE WHEN total > 0 THEN goal / total ELSE 1 END"
        more = "least(tokens, w * CASE WHEN total > stays THEN (goal - stays) / (total - stays) ELSE 1 END)"
        body = f"(SELECT k, _source, _lang, _topic, tokens, CASE WHEN total >= goal THEN {less} WHEN w >= tokens * {FULL} THEN w ELSE {more} END AS w FROM {sums})"
    steps.append(f"f AS (SELECT 0 AS k, _source, _lang, _topic, tokens, {KEEP} * tokens AS w FROM c UNION ALL SELECT k + 1, _source, _lang, _topic, tokens, w FROM {body} WHERE k < {ROUNDS})")
    gaps = ", ".join(f"floor((CASE WHEN g{d}.target > 0 THEN sum(w) OVER (PARTITION BY f.{d}) / g{d}.target ELSE 1 END - 1) * 10000 + 0.5)::BIGINT AS {d[1:]}_gap" for d in DIMS)
    joins = " ".join(f"JOIN g{d} ON f.{d} = g{d}.{d}" for d in DIMS)
    steps.append(f"p AS (SELECT f._source, f._lang, f._topic, floor(CASE WHEN tokens > 0 THEN w / tokens ELSE {KEEP} END * {STEPS} + 0.5)::BIGINT AS probability, {gaps} FROM f {joins} WHERE k = {ROUNDS})")
    return "WITH RECURSIVE " + ",\n".join(steps) + f"""
SELECT doc_id, source, lang, d._topic AS topic, tokens AS n_tokens, probability AS probability_millionths, {", ".join(f"{d[1:]}_gap" for d in DIMS)},
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {STEPS} < probability AS kept
FROM d JOIN p USING (_source, _lang, _topic)
"""


OP6_SQL = _oracle()
