"""Rules over DataFrames: each rule is a join of its body, their fixpoint a semi-naive loop over written tables.

A rule is a pair (head, body) of atoms: ``(Atom("head", (X, Y)), [Atom("body", (X, Z)), Atom("other", (Z, Y))])`` with
``X, Y, Z = variables("X Y Z")``. A term that is no variable is a constant; a variable that stands twice must be equal.
There is no negation and no aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import discard, materialize


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple


def variables(names: str) -> list[Variable]:
    return [Variable(n) for n in names.split()]


def _bound(atom: Atom, facts: DataFrame) -> DataFrame:
    """Bindings of the atom's variables, one column each."""
    seen, keep = {}, F.lit(True)
    for i, t in enumerate(atom.terms):
        column = F.col(f"arg{i}")
        if not isinstance(t, Variable):
            keep &= column == F.lit(t)
        elif t in seen:
            keep &= column == seen[t]
        else:
            seen[t] = column
    return facts.where(keep).select(*[c.alias(v.name) for v, c in seen.items()])


def match(body: list[Atom], facts: dict[str, DataFrame], delta: tuple[int, DataFrame] | None = None) -> DataFrame:
    """Bindings that satisfy all atoms; ``delta`` replaces the facts of one of them. Atoms join on the variables they
    share with those before, so the order of a body should keep them connected."""
    out = None
    for i, atom in enumerate(body):
        found = _bound(atom, delta[1] if delta and delta[0] == i else facts[atom.name])
        if out is None:
            out = found
        else:
            shared = [c for c in found.columns if c in out.columns]
            if not shared:
                raise ValueError(f"{atom.name} shares no variable with the atoms before it")
            out = out.join(found, shared)
    return out


def _head(atom: Atom, bindings: DataFrame) -> DataFrame:
    return bindings.select(*[(F.col(t.name) if isinstance(t, Variable) else F.lit(t)).alias(f"arg{i}") for i, t in enumerate(atom.terms)])


def fixpoint(rules: list[tuple[Atom, list[Atom]]], facts: dict[str, DataFrame], max_rounds: int = 10_000) -> dict[str, DataFrame]:
    """All facts that follow, by predicate, each once. Facts: columns arg0, arg1, ... Every round joins only what the
    round before found; rounds are written, so none is computed twice."""
    derived = {head.name for head, _ in rules}
    facts = {k: materialize(v.distinct(), k) for k, v in facts.items()}
    for head, _ in rules:
        if head.name not in facts:
            empty = next(iter(facts.values())).select(*[F.lit("").alias(f"arg{i}") for i in range(len(head.terms))]).limit(0)
            facts[head.name] = materialize(empty, head.name)
    delta = dict(facts)
    for _ in range(max_rounds):
        new = {}
        for head, body in rules:
            for i, atom in enumerate(body):
                if atom.name in delta:
                    found = _head(head, match(body, facts, (i, delta[atom.name])))
                    new[head.name] = new[head.name].union(found) if head.name in new else found
        fresh = {k: materialize(v.distinct().join(facts[k], facts[k].columns, "left_anti"), k) for k, v in new.items()}
        fresh = {k: v for k, v in fresh.items() if not v.isEmpty()}
        if not fresh:
            return {k: v for k, v in facts.items() if k in derived}
        for k, v in fresh.items():
            old, facts[k] = facts[k], materialize(facts[k].union(v), k)
            if old is not delta.get(k):
                discard(old)
        delta = fresh
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def query(goal: list[Atom], facts: dict[str, DataFrame]) -> DataFrame:
    """Distinct bindings of the goal's variables; of a ground goal that holds, one row."""
    found = match(goal, facts)
    return found.distinct() if found.columns else found.limit(1)
