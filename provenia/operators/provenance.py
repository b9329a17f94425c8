"""Where each field of a result comes from: one of seven classes, carried with the columns and derived for new ones.

A class is declared where a column is born (``classified``) and stands in the metadata of its field. Spark itself
carries it through selections, filters, joins and Parquet files as long as the column is only copied. For computed
columns ``lineage`` reads the analysed plan and joins the classes of what a column was computed from:

* a copy keeps its class; a value computed from one row has the class of its inputs, at least ``script-output``;
* a count, a sum, a rate or a rank is ``script-output``, and remembers in ``rests_on`` which classes lie under it;
* rows of a union have the class that is furthest from an observation; a constant is ``script-output``, a null ``missing``.

Nothing is executed for any of this: only schemas and plans are read.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The seven classes. From an observation outwards; the order is that of the join. What is missing adds nothing.
CLASSES = ("missing", "record", "local-evidence", "external-source", "script-output", "your-input", "model-inference")
#: Classes that a reader has to weigh in another way than the rest.
MARKED = ("model-inference", "your-input", "missing")

KEY, UNDER = "provenance", "rests_on"

#: Aggregates that pick one or several values as they are, where the others count or compute.
PICKS = {"First", "Last", "Max", "Min", "MaxBy", "MinBy", "AnyValue", "Mode", "CollectList", "CollectSet", "ListAgg"}
#: Relations that stand in the plan itself, as literals do.
WRITTEN_OUT = ("LocalRelation", "OneRowRelation", "Range")
RANKS = {"RowNumber", "Rank", "DenseRank", "PercentRank", "CumeDist", "NTile"}

Origin = tuple[str, frozenset]


def join_classes(origins) -> Origin | None:
    """The least class that covers all of them and everything they rest on; None if one of them is unknown."""
    origins = list(origins)
    if not origins or any(o is None for o in origins):
        return None
    return max((o[0] for o in origins), key=CLASSES.index), frozenset().union(*(o[1] for o in origins))


def classified(df: DataFrame, classes: dict[str, str] | str) -> DataFrame:
    """Declares the class of columns, by name or one for all. Values, names and order stay; the rest keeps what it has."""
    named = dict.fromkeys(df.columns, classes) if isinstance(classes, str) else classes
    if wrong := sorted({c for c in named.values() if c not in CLASSES}):
        raise ValueError(f"not a class of provenance: {', '.join(wrong)}")
    if unknown := sorted(named.keys() - set(df.columns)):
        raise ValueError(f"no such field: {', '.join(unknown)}")
    for name, value in named.items():
        df = df.withMetadata(name, {KEY: value})
    return df


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


class _Plan:
    """Definitions of the attributes of one analysed plan: attribute -> [(inputs, how)]."""

    def __init__(self, plan):
        self.declared: dict[int, Origin] = {}
        self.made: dict[int, list] = defaultdict(list)
        self.joined: dict[int, set] = defaultdict(set)
        self.tables: dict[int, list[int]] = {}
        self.known: dict[int, Origin | None] = {}
        self.expressions(json.loads(plan.toJSON()))
        self.output = self.nodes(plan)

    def expressions(self, nodes: list) -> set[int]:
        """Reads every expression of a plan given as JSON; returns all attributes it mentions."""
        seen = set()
        for node in nodes:
            generated = []
            for name, value in node.items():
                trees = value if isinstance(value, list) else []
                for tree in [t for t in trees if isinstance(t, list)] or ([trees] if trees and isinstance(trees[0], dict) else []):
                    refs = self.expression(tree)
                    seen |= refs
                    if name == "generator":
                        generated = refs
            if node["class"].endswith(".Generate"):
                for tree in node["generatorOutput"]:
                    self.made[tree[0]["exprId"]["id"]].append((generated, "row"))
        return seen

    def expression(self, tree: list) -> set[int]:
        """Reads one expression in prefix order; named parts become definitions."""

        def walk(at: int) -> tuple[int, set, set, bool]:
            e, end, refs, kinds, empty = tree[at], at + 1, set(), set(), True
            kind = e.get("class", "").rsplit(".", 1)[-1]
            for _ in range(e.get("num-children", 0)):
                end, r, k, n = walk(end)
                refs, kinds, empty = refs | r, kinds | k, empty and n
            if isinstance(e.get("plan"), list):
                mentioned, top = self.expressions(e["plan"]), e["plan"][0]
                named = top.get("projectList") or top.get("aggregateExpressions")
                refs = refs | ({t[0]["exprId"]["id"] for t in named} if named else mentioned)
            if kind == "Literal":
                empty = e.get("value") is None
            elif end == at + 1:
                empty = False
            if kind == "AttributeReference":
                refs = {e["exprId"]["id"]}
            if kind == "Alias":
                counted = ("AggregateExpression" in kinds or kinds & RANKS) and not kinds & PICKS
                copy = tree[at + 1].get("class", "").endswith(".AttributeReference")
                how = "copy" if copy else "count" if counted else "null" if empty and not refs else "row"
                self.made[e["exprId"]["id"]].append((refs, how))
                refs = {e["exprId"]["id"]}
            return end, refs, kinds | {kind}, empty

        return walk(0)[1] if tree and "class" in tree[0] else set()

    def nodes(self, node) -> list[int]:
        """Reads declared classes and what nodes make without naming an expression; returns the node's output."""
        kind, output = node.nodeName(), []
        below = [self.nodes(child) for child in _items(node.children())]
        for subquery in _items(node.subqueries()):
            self.nodes(subquery)
        for a in _items(node.output()):
            number = a.exprId().id()
            output.append(number)
            if a.metadata().contains(KEY):
                value = json.loads(a.metadata().json())
                self.declared.setdefault(number, (value[KEY], frozenset(value.get(UNDER, [value[KEY]]))))
            elif kind in WRITTEN_OUT:
                self.declared.setdefault(number, ("script-output", frozenset()))
        if kind in ("Union", "Intersect", "Intersect All"):
            for part in below:
                for number, other in zip(output, part):
                    self.joined[number] |= {other} - {number}
        elif kind == "CTERelationDef":
            self.tables[node.id()] = output
        elif kind == "CTERelationRef":
            for number, other in zip(output, self.tables.get(node.cteId(), [])):
                self.made[number].append(({other}, "copy"))
        elif below:
            for number in set(output) - {n for part in below for n in part} - self.made.keys():
                self.made[number].append(({n for part in below for n in part}, "row"))
        return output

    def origin(self, number: int) -> Origin | None:
        if number not in self.known:
            self.known[number] = None
            parts = [self.declared[number]] if number in self.declared else [self.derived(*d) for d in self.made.get(number, [])]
            self.known[number] = join_classes([*parts, *(self.origin(n) for n in self.joined.get(number, ()))])
        return self.known[number]

    def derived(self, refs, how: str) -> Origin | None:
        if not refs:
            return ("missing" if how == "null" else "script-output"), frozenset()
        found = join_classes(self.origin(n) for n in refs)
        if found is None or how == "copy":
            return found
        return ("script-output" if how == "count" else join_classes([found, ("script-output", frozenset())])[0]), found[1]


def lineage(df: DataFrame) -> list[tuple[str, str | None, list[str]]]:
    """(field, class, classes it rests on) of each column, in order. No class: something under it was never declared."""
    plan = _Plan(df._jdf.queryExecution().analyzed())
    found = [plan.origin(n) for n in plan.output]
    return [(c, o and o[0], sorted(o[1], key=CLASSES.index) if o else []) for c, o in zip(df.columns, found)]


def published(df: DataFrame) -> DataFrame:
    """The same rows with the class of every field in its metadata; a field without a class refuses publication."""
    fields = lineage(df)
    if bare := [name for name, value, _ in fields if value is None]:
        raise ValueError("not classified: " + ", ".join(bare))
    return df.toDF(*df.columns).select(*[F.col(f"`{c}`").alias(c, metadata={KEY: value, UNDER: under}) for c, value, under in fields])


def field_table(df: DataFrame) -> DataFrame:
    """(field, class, rests_on, marked, present, absent): the classes as a relation, with how many rows hold a value.

    One pass over the rows whatever the number of fields; an empty frame gives its fields with zeros. Column names have to
    differ. ``marked`` says that the class must be shown wherever the field is.
    """
    fields = lineage(published(df))
    n = df.select(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)], F.count(F.lit(1)).alias("_n"))
    rows = [
        F.struct(F.lit(c).alias("field"), F.lit(value).alias("class"), F.lit(" ".join(under)).alias("rests_on"), F.lit(value in MARKED).alias("marked"), F.col(f"_{i}").alias("present"), (F.col("_n") - F.col(f"_{i}")).alias("absent"))
        for i, (c, value, under) in enumerate(fields)
    ]
    return n.select(F.inline(F.array(*rows)))


def table_lines(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """(place, line): rows as lines of a table, in order, without sorting them in one task; nulls show as 'withheld'."""
    shown = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("withheld")) for c in columns]
    return rows.select(F.col(order).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"))
