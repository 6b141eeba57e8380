"""Rule packs as an indexed table: literals that a rule's matches must hold, found in a text in one pass, lead to the rules worth trying.

A pack is a table of rules (schemas.RULE) of any make: written down here, read from JSON, or derived by Spark. Its
inverted index has a row for each literal and rule. An automaton over all literals reads each text once, in Arrow
batches, and gives the rules that could match; Spark's own regex functions then try just these. So the cost of a text
grows with what it holds, not with the pack, and a verdict's plan has one expression instead of one for each rule.

For verdicts a pack is a dimension: it is brought to the driver and sent to the tasks as one broadcast, and more than
MAX_RULES rules are refused. A pack that grows with the data goes to rule_hits(), which holds it nowhere whole: what texts
and literals are made of meets in joins. Rules without a literal are tried on every text.

Defined cases: a null or empty text has no candidates; of rules with one id the last counts; an empty pack finds nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FLAGS
from ..rules import Rule
from ..sources.shared import materialised
from .literals import guarded, required

MAX_RULES = 1_000_000
CANDIDATES = "array<struct<rule_id: string, category: string, weight: int, regex: string, place: int>>"
LITERALS = "rule_id string, category string, weight int, regex string, literals array<string>"


def _regex(patterns: Iterable[str]) -> str:
    """The rule's regex for text in lower case, without flags where it has no capitals."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    plain = re.sub(r"\\.", "", joined)
    return ("" if plain == plain.lower() else FLAGS) + joined


def _literals(patterns: Iterable[str]) -> list[str]:
    """Literals one of which is in every text in lower case that one of the patterns matches; none if a pattern has none."""
    found: set[str] = set()
    for p in patterns:
        # Letters match in either case, so capitals may be read as small; escapes keep theirs.
        own = required(re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), p))
        if not own:
            return []
        found.update(own)
    return sorted(found)


def literal_table(rules: DataFrame, dotall: bool = False) -> DataFrame:
    """A row for each rule of a pack: what verdicts need of it, its regex, and its literals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            patterns = [[p for p in own or [] if p] for own in rows["patterns"]]
            regexes = [("(?s)" if dotall else "") + _regex(own) for own in patterns]
            columns = [pa.array(rows["rule_id"], pa.string()), pa.array(rows["category"], pa.string()), pa.array([round((w or 0) * 100) for w in rows["weight"]], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(regexes, pa.string()), pa.array(list(map(_literals, patterns)), pa.list_(pa.string()))], names=["rule_id", "category", "weight", "regex", "literals"])

    return rules.where("rule_id IS NOT NULL AND size(patterns) > 0").select("rule_id", "category", "weight", "patterns").mapInArrow(run, LITERALS)


def inverted(rules: DataFrame) -> DataFrame:
    """The index as a table: literal (null for rules without one) and the ids of its rules."""
    return literal_table(rules).select(F.explode_outer("literals").alias("literal"), "rule_id").groupBy("literal").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


_automata: dict[str, tuple] = {}
#: A pack of up to so many rules is written into the plan as constants, each of which Spark compiles once a task and not once a row.
MOST_CONSTANTS = 256
#: Candidates of texts that a task holds before it hands them on.
PIECE = 50_000
_CANDIDATE = pa.struct([("rule_id", pa.string()), ("category", pa.string()), ("weight", pa.int32()), ("regex", pa.string()), ("place", pa.int32())])


def _automaton(key: str, rules: list[tuple], bare: bool) -> tuple:
    """The automaton of an index, built once in a Python worker (literal to the numbers of its rules), the numbers of rules without literals, and the rules as candidates."""
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        by_literal: dict[str, list[int]] = {}
        always = []
        for k, (*_, literals) in enumerate(rules):
            if not literals:
                always.append(k)
            for x in literals:
                by_literal.setdefault(x, []).append(k)
        tree = ahocorasick.Automaton()
        for x, numbers in by_literal.items():
            tree.add_word(x, numbers)
        if by_literal:
            tree.make_automaton()
        named = pa.array([(*r[:3], None if bare else r[3], k) for k, r in enumerate(rules)], _CANDIDATE)
        _automata[key] = (tree if by_literal else None, always, named)
    return _automata[key]


def _candidate_lists(texts: pa.Array, tree, always: list[int], named: pa.Array) -> Iterator[pa.Array]:
    """Lists of candidates of texts, in pieces of PIECE and one text's more at most."""
    ends, flat = [0], []
    for held in texts:
        text = held.as_py()
        found = set(always) if text else set()
        if text and tree is not None:
            for _, numbers in tree.iter(text):
                found.update(numbers)
        flat += sorted(found)
        ends.append(len(flat))
        if len(flat) >= PIECE:
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named.take(pa.array(flat, pa.int32())))
            ends, flat = [0], []
    if len(ends) > 1 or not len(texts):
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named.take(pa.array(flat, pa.int32())))


@dataclass(frozen=True)
class RuleIndex:
    """A pack ready for matching. constants: its regexes by place, if they are few enough to be constants of a plan."""

    candidates_of: object
    regexes: tuple[str, ...]
    constants: tuple[str, ...]

    @staticmethod
    def of(spark: SparkSession, rules: Sequence[Rule] | DataFrame, dotall: bool = False, constant: bool = False) -> RuleIndex:
        """constant: candidates of a small pack come without their regexes, and matching() and hits() are given its constants."""
        if isinstance(rules, DataFrame):
            held = {r.rule_id: tuple(r) for r in literal_table(rules, dotall).limit(MAX_RULES + 1).toLocalIterator()}
        else:
            held = {r.rule_id: (r.rule_id, r.category, r.weight, ("(?s)" if dotall else "") + _regex(r.patterns), _literals(r.patterns)) for r in rules}
        if len(held) > MAX_RULES:
            raise ValueError(f"a pack may have {MAX_RULES} rules; match several packs instead")
        # Strongest first, then by id: the order of matches.
        ordered = sorted(held.values(), key=lambda r: (-r[2], r[0]))
        bare = constant and len(ordered) <= MOST_CONSTANTS
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, ordered, bare))

        @F.arrow_udf(CANDIDATES)
        def candidates(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                yield from _candidate_lists(batch, *_automaton(*sent.value))

        regexes = tuple(r[3] for r in ordered)
        return RuleIndex(candidates, regexes, tuple(map(guarded, regexes)) if bare else ())

    def candidates(self, text: Column) -> Column:
        """The rules whose literals a text in lower case holds. A column of its own: a UDF isn't to be copied into other expressions."""
        return self.candidates_of(text)


def _tried(candidate: Column, constants: Sequence[str], by: Callable[[Column], Column]) -> Column:
    """by() of a candidate's regex, as a constant if there are some."""
    if not constants:
        return by(candidate["regex"])
    out = F
    for k, regex in enumerate(constants):
        out = out.when(candidate["place"] == k, by(F.lit(regex)))
    return out


def matching(text: Column, candidates: Column, constants: Sequence[str] = ()) -> Column:
    """Those of the candidates that match a text in lower case."""
    return F.filter(candidates, lambda c: _tried(c, constants, lambda regex: F.rlike(text, regex)))


def hits(text: Column, matches: Column, keep: int = 8, length: int = 180, constants: Sequence[str] = ()) -> Column:
    """Array of (rule_id, category, weight, evidence) of rules that match: what scoring.hits gives for a pack of constants."""

    def evidence(match: Column) -> Column:
        found = F.transform(_tried(match, constants, lambda regex: F.regexp_extract_all(text, regex, F.lit(0))), lambda e: F.substring(F.trim(e), 1, length))
        return F.slice(F.array_distinct(found), 1, keep)

    return F.transform(matches, lambda m: F.struct(m["rule_id"].alias("rule_id"), m["category"].alias("category"), m["weight"].alias("weight"), evidence(m).alias("evidence")))


#: What is looked up of a literal: the longest of its runs of small letters and digits, up to so many characters of it.
ANCHOR = 32
#: A run of a text is looked through in parts that start so many characters apart and overlap, so that any anchor lies whole in one.
PART = 1_000
_RUN = "[a-z0-9]"


def _anchored(pack: DataFrame) -> DataFrame:
    """literal_table() with one row an id, the anchors of its literals (none if the rule is to be tried on every text), and whether each text that holds an anchor matches."""
    last = pack.withColumn("_n", F.monotonically_increasing_id()).groupBy("rule_id").agg(F.max_by(F.struct("category", "weight", "regex", "literals"), "_n").alias("r")).select("rule_id", "r.*")

    def anchor(literal: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(literal, F.lit(f"{_RUN}+"), F.lit(0)), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
        return F.coalesce(F.substring(F.array_max(runs)["r"], 1, ANCHOR), F.lit(""))

    rows = last.withColumn("anchors", F.array_distinct(F.transform("literals", anchor)))
    words = F.concat(F.lit("(?:"), F.array_join("anchors", ")|(?:"), F.lit(")"))
    rows = rows.withColumn("sure", F.col("regex").isin(words, F.concat(F.lit("(?s)"), words)))
    return rows.select("rule_id", "category", "weight", "regex", F.when(~F.array_contains("anchors", ""), F.col("anchors")).otherwise(F.array().cast("array<string>")).alias("anchors"), "sure")


def _windows(run: Column, lengths: Sequence[int]) -> Column:
    """All parts of a run that are as long as an anchor."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(run) - n + 1)
        return F.when(F.length(run) >= n, F.transform(starts, lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, lengths)))


def rule_hits(texts: DataFrame, text: str, rules: DataFrame, dotall: bool = False) -> DataFrame:
    """A row for each row of texts and rule that matches its text in lower case: the other columns of texts, rule_id, category and weight.

    Packs and texts may be of any size. Runs of letters and digits of all texts meet the anchors that lie in them, once
    for each different run; then the texts that hold a run meet its rules. Only rules that are more than words are tried
    on the texts themselves.
    """
    pack = materialised(_anchored(literal_table(rules, dotall)), "pack")
    lengths = sorted(r.n for r in pack.select(F.explode(F.transform("anchors", F.length)).alias("n")).distinct().collect())
    left = pack.agg(F.expr("count_if(size(anchors) > 0 AND NOT sure)").alias("tried"), F.expr("count_if(size(anchors) = 0)").alias("open")).first()
    own, rule = [c for c in texts.columns if c != text], ["rule_id", "category", "weight"]
    rows = texts.where(F.col(text) != "").withColumn("_row", F.monotonically_increasing_id())
    if left.tried or left.open:
        rows = materialised(rows, "texts")
    found = []
    if lengths:
        part = f"(?=({_RUN}{{{lengths[0]},{PART + ANCHOR - 1}}})){_RUN}{{1,{PART}}}"
        held = materialised(rows.select("_row", *own, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(part), F.lit(1)))).alias("_run")), "runs")
        runs = held.select("_run").distinct().select("_run", F.explode(_windows(F.col("_run"), lengths)).alias("_anchor"))
        named = runs.join(pack.select(F.explode("anchors").alias("_anchor"), *rule, "regex", "sure"), "_anchor").drop("_anchor")
        found.append(held.join(named.where("sure").drop("regex", "sure"), "_run").drop("_run").distinct())
        if left.tried:
            candidates = held.select("_row", "_run").join(named.where("NOT sure").drop("sure"), "_run").drop("_run").distinct()
            found.append(rows.join(candidates, "_row").where(F.rlike(text, "regex")))
    if left.open:
        found.append(rows.join(pack.where("size(anchors) = 0"), F.rlike(text, "regex")))
    return reduce(DataFrame.unionByName, (f.select(*own, *rule) for f in found or [rows.limit(0).crossJoin(pack)]))
