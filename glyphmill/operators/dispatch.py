"""Which of many patterns matches a node first, for all nodes in one pass.

Patterns are names from the outside in (``div/p``, ``app//lem``, ``/TEI/text``,
``*``), with tests of attributes (``[@a]``, ``[@a='v']``, ``[not(@a)]``).  All
of them make one automaton over the names on the way from the root: a state is
the set of steps that ended at a node or, before ``//``, at a node above it.  A
pass over a tree carries states down; each pair of a state and a tag is worked
out once a task and remembered.  The least rule that a node's state completes
is the node's.

Defined results: nodes that no pattern matches have no row; equal patterns are
the first one's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.tours import carried_down

_STEP = re.compile(r"(//?)?([^/\[\]]+)((?:\[[^\]]*\])*)")
_TEST = re.compile(r"\[(?:not\(@([\w:.-]+)\)|@([\w:.-]+)(?:\s*=\s*(?:'([^']*)'|\"([^\"]*)\"))?)\]")


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Part:
    """A step of a pattern: whether anything may stand before it, its name, and the tests of its attributes (name, value or None, wanted)."""

    anywhere: bool
    name: str
    tests: tuple[tuple[str, str | None, bool], ...]

    def fits(self, name: str, attrs: dict[str, str]) -> bool:
        return self.name in ("*", name) and all((a in attrs and v in (None, attrs[a])) == wanted for a, v, wanted in self.tests)


def parse(pattern: str) -> tuple[Part, ...]:
    out, at = [], 0
    while at < len(pattern):
        m = _STEP.match(pattern, at)
        if not m or (out and not m.group(1)):
            raise PatternError(f"no pattern: {pattern!r}")
        tests, left = [], m.group(3)
        while left:
            t = _TEST.match(left)
            if not t:
                raise PatternError(f"no test of an attribute: {left!r}")
            value = t.group(3) if t.group(3) is not None else t.group(4)
            tests.append((t.group(1) or t.group(2), value, t.group(1) is None))
            left = left[t.end() :]
        out.append(Part(m.group(1) != "/", m.group(2).strip(), tuple(tests)) if not out else Part(m.group(1) == "//", m.group(2).strip(), tuple(tests)))
        at = m.end()
    if not out:
        raise PatternError("an empty pattern")
    return tuple(out)


class Automaton:
    """States are numbers; each stands for steps that are done (rule, number of steps) here, and for those that wait for any node below."""

    def __init__(self, patterns: list[str]):
        self.rules = [parse(p) for p in patterns]
        self.attributes = sorted({a for r in self.rules for part in r for a, _, _ in part.tests})
        starts = frozenset((r, 0) for r in range(len(self.rules)))
        anywhere = frozenset((r, 0) for r, parts in enumerate(self.rules) if parts[0].anywhere)
        #: Above the root all patterns may begin; below it those that may begin anywhere.
        self.states = [(starts, anywhere)]
        self.numbers = {self.states[0]: 0}
        self.known: dict[tuple, tuple[int, int | None]] = {}

    def step(self, state: int, name: str | None, values: tuple[str | None, ...]) -> tuple[int, int | None]:
        """The state of a node under one of ``state``, and the least rule that it completes."""
        key = state, name, values
        if key not in self.known:
            here, waiting = self.states[state]
            attrs = {a: v for a, v in zip(self.attributes, values, strict=True) if v is not None}
            done = {(r, i + 1) for r, i in here | waiting if (self.rules[r][i].fits(name or "", attrs))}
            complete = [r for r, i in done if i == len(self.rules[r])]
            open_ = {(r, i) for r, i in done if i < len(self.rules[r])}
            new = frozenset(x for x in open_ if not self.rules[x[0]][x[1]].anywhere), waiting | {x for x in open_ if self.rules[x[0]][x[1]].anywhere}
            if new not in self.numbers:
                self.numbers[new] = len(self.states)
                self.states.append(new)
            self.known[key] = self.numbers[new], min(complete, default=None)
        return self.known[key]


def first_rules(nodes: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, pre, name, rule): of each tag the number, from 0, of the first pattern that matches it."""
    attributes = Automaton(patterns).attributes
    values = F.array(*[F.try_element_at("attrs", F.lit(a)) for a in attributes]).cast("array<string>")
    machine: list[Automaton] = []  # made in each task

    def step(above, own):
        if not machine:
            machine.append(Automaton(patterns))
        if own["kind"] == "tree":
            return 0, None
        return machine[0].step(above[0] if above else 0, own["name"], tuple(own["values"]))

    tags = nodes.where("kind in ('tag', 'tree')").select("doc_id", "pre", "level", "name", F.struct("kind", "name", values.alias("values")).alias("rule"))
    return carried_down(tags, "rule", step, lambda v: v[1], "int").where("rule is not null").select("doc_id", "pre", "name", "rule")
