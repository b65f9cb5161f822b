"""Rules by containment over many terms: each text is scanned once for all of them, and rules are tables that terms join to."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.columns import text
from textloom.functions.text import haystack
from textloom.operators import rules as R

#: Stand before and after a field that is scanned, so that a term can ask for its ends.
START, END = "\u0002", "\u0003"
#: The most rows of a rule table that go to all tasks; a larger one is shuffled by term.
BROADCAST_ROWS = 50_000
#: The bit of terms that a rule excludes; the others are clauses.
NONE_BIT = 62


@dataclass(frozen=True)
class TermRule:
    """Holds for a text that has a term of each clause and none of the excluded ones. A clause is (field, terms). Rules of one
    name are alternatives."""

    name: str
    clauses: tuple[tuple[str, tuple[str, ...]], ...]
    excluded: tuple[tuple[str, tuple[str, ...]], ...] = ()


def scan_pattern(terms: Iterable[str]) -> str:
    """A pattern whose first group is, at each place of a text, the longest of the terms that begins there.

    Terms lie in a tree by their characters, so a place is left at the first character that no term goes on with. The tree's
    first characters stand before it as one class, which most places fail. The match itself is empty, so all places are tried.
    """
    tree: dict = {}
    for term in terms:
        node = tree
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def quoted(c: str) -> str:
        return f"\\x{{{ord(c):x}}}"

    def below(node: dict) -> str:
        parts = [quoted(c) + below(child) for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        if len(parts) == 1 and "" not in node:
            return parts[0]
        return "(?:" + "|".join(parts) + ")" + ("?" if "" in node else "")

    return f"(?=[{''.join(quoted(c) for c in sorted(tree))}])(?=({below(tree)}))"


class TermRules:
    """Rules compiled to one pattern for each field and one table of terms.

    The plan of `hits` does not grow with the rules: a text gives the terms that it has, each term its rules, and a rule's
    clauses are bits that are joined by or. A text's rows lie in one task and are aggregated there first.
    """

    def __init__(self, rules: Iterable[TermRule]):
        self.names = []
        bits: dict[tuple[str, str], dict[int, int]] = defaultdict(lambda: defaultdict(int))
        full = []
        for n, rule in enumerate(rules):
            if not rule.clauses or len(rule.clauses) >= NONE_BIT:
                raise ValueError(f"rule {rule.name} has {len(rule.clauses)} clauses")
            self.names.append(rule.name)
            full.append((1 << len(rule.clauses)) - 1)
            for i, (field, terms) in [*enumerate(rule.clauses), *((NONE_BIT, x) for x in rule.excluded)]:
                if not terms or "" in terms:
                    raise ValueError(f"rule {rule.name} has an empty term or clause")
                for term in terms:
                    bits[field, term][n] |= 1 << i
        terms = defaultdict(set)
        for field, term in bits:
            terms[field].add(term)
        self.patterns = {field: scan_pattern(found) for field, found in terms.items()}
        # where a term begins, those that it begins with begin too
        self.postings = []
        for field, longest in bits:
            joined: dict[int, int] = defaultdict(int)
            for end in range(1, len(longest) + 1):
                for n, b in bits.get((field, longest[:end]), {}).items():
                    joined[n] |= b
            self.postings += [(field, longest, n, self.names[n], b, full[n]) for n, b in joined.items()]

    def found(self, fields: dict[str, Column]) -> Column:
        """Distinct (field, term) of a row: the longest at each place. Null fields are empty."""

        def scanned(field: str, pattern: str) -> Column:
            terms = F.regexp_extract_all(F.concat(F.lit(START), text(fields[field]), F.lit(END)), F.lit(pattern), F.lit(1))
            return F.transform(F.array_distinct(terms), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

        return F.concat(*(scanned(f, p) for f, p in self.patterns.items()))

    def hits(self, rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
        """(key, rule) of the rules that hold for rows; each once for a key. Rows of one key count as one text."""
        if not self.names:
            return rows.select(key, F.lit("").alias("rule")).limit(0)
        table = rows.sparkSession.createDataFrame(self.postings, "field string, term string, n int, rule string, bits long, full long")
        met = rows.select(key, F.explode(self.found(fields)).alias("t")).select(key, "t.field", "t.term")
        joined = met.join(F.broadcast(table) if len(self.postings) <= BROADCAST_ROWS else table, ["field", "term"])
        out = joined.groupBy(key, "n", "rule", "full").agg(F.bit_or("bits").alias("bits")).where("bits = full").select(key, "rule")
        return out if len(set(self.names)) == len(self.names) else out.distinct()


def trigger_rules(name: str, trigger: R.Trigger) -> list[TermRule]:
    """A trigger on the field `q` as rules of one name."""
    clauses = [("q", (t,)) for t in trigger.all] + ([("q", trigger.any)] if trigger.any else [])
    excluded = [("q", trigger.none)] if trigger.none else []
    known = {
        "": [([], [])],
        "time": [([("q", tuple(R.TIME))], [])],
        "founding": [([("q", tuple(R.FOUNDING))], [])],
        "exact_url": [([("q", tuple(R.EXACT_URL))], []), ([("q", (t,)) for t in R.EXACT_URL_BOTH], [("q", tuple(R.EXACT_URL_NOT))])],
    }
    return [TermRule(name, (*clauses, *more), (*excluded, *less)) for more, less in known[trigger.predicate]]


def step_rule(name: str, condition: tuple[tuple[str, tuple[str, ...]], ...]) -> TermRule:
    """A step's condition on a candidate as a rule."""
    clauses = []
    for field, terms in condition:
        if field == "both":
            clauses += [("hay", (t,)) for t in terms]
        elif field == "title_is":
            clauses.append(("title", tuple(START + t + END for t in terms)))
        else:
            clauses.append((field, terms))
    return TermRule(name, tuple(clauses))


class BoostTable:
    """The boosts of a rule table. What a chunk holds and what a question asks for is found once for each, not for each pair."""

    def __init__(self, boosts: list[R.Boost]):
        self.questions = TermRules(r for i, b in enumerate(boosts) for r in trigger_rules(str(i), b.trigger))
        self.steps = TermRules(step_rule(f"{i}.{j}", condition) for i, b in enumerate(boosts) for j, (condition, _) in enumerate(b.steps))
        self.deltas = [(f"{i}.{j}", str(i), j, float(delta)) for i, b in enumerate(boosts) for j, (_, delta) in enumerate(b.steps)]

    def asked(self, questions: DataFrame) -> DataFrame:
        """(qid, boost) of questions (qid, q): the boosts whose trigger holds."""
        return self.questions.hits(questions, "qid", {"q": F.col("q")}).withColumnRenamed("rule", "boost")

    def held(self, chunks: DataFrame) -> DataFrame:
        """(idx, boost, delta) of chunks (idx, title, url, text): the first step of each boost that holds."""
        title = text("title")
        fields = {"hay": haystack(title, F.col("url"), F.col("text")), "url": F.lower(text("url")), "title": title, "title_low": F.lower(title)}
        deltas = chunks.sparkSession.createDataFrame(self.deltas, "rule string, boost string, step int, delta double")
        met = self.steps.hits(chunks, "idx", fields)
        joined = met.join(F.broadcast(deltas) if len(self.deltas) <= BROADCAST_ROWS else deltas, "rule")
        return joined.groupBy("idx", "boost").agg(F.min_by("delta", "step").alias("delta"))

    def scores(self, pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
        """(qid, idx, boost) of distinct pairs (qid, idx): the sum of what is asked for and held; 0 where nothing is."""
        met = pairs.join(asked, "qid").join(held, ["idx", "boost"])
        total = met.groupBy("qid", "idx").agg(F.sum("delta").alias("boost"))
        return pairs.join(total, ["qid", "idx"], "left").select("qid", "idx", F.coalesce("boost", F.lit(0.0)).alias("boost"))
