"""Walks over syntax trees: a visitor with a hook for each kind of node, and parents."""

from __future__ import annotations

from . import syntax
from .analysis import children


class Visitor:
    """Calls ``visit_<kind>`` for each node from above; a hook that is overridden calls ``walk`` to go on below its node."""

    def visit(self, node):
        return getattr(self, f"visit_{type(node).__name__.lower()}", self.walk)(node)

    def walk(self, node) -> None:
        for child in children(node):
            self.visit(child)

    def visit_schema(self, rules: list[syntax.Rule]) -> None:
        for rule in rules:
            self.visit(rule)


class Parents:
    """The node above each node of some rules, by identity: equal nodes at several places have parents of their own."""

    def __init__(self, rules: list[syntax.Rule]):
        self._above: dict[int, object] = {}
        self._kept = rules
        for rule in rules:
            self._fill(rule)

    def _fill(self, node) -> None:
        for child in children(node):
            self._above[id(child)] = node
            self._fill(child)

    def of(self, node):
        """The node above, None for a rule."""
        return self._above.get(id(node))

    def rule_of(self, node) -> syntax.Rule:
        while (above := self.of(node)) is not None:
            node = above
        return node
