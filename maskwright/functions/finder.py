"""Spans of one text: candidates of all detectors, then the claim. Time grows in proportion to the text."""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from .registry import Detector, folded

MANY_LITERALS = 16  # from here on one automaton looks for all literals at once


class Span(NamedTuple):
    start: int
    end: int
    value: str
    key: str
    detector: Detector

    def ckey(self) -> str:
        """The key that has one alias: plain values by category, values of an entity by entity and prefix."""
        d = self.detector
        return "\0".join(("C", d.category, self.key) if d.entity_id is None else ("E", d.entity_id, d.prefix, self.key))


class Finder:
    """Built on the driver, sent to tasks as detectors only and made ready there."""

    def __init__(self, detectors, allow=frozenset()):
        self.detectors, self.allow = tuple(detectors), frozenset(allow)
        self.ready = False

    def __getstate__(self):
        return {"detectors": self.detectors, "allow": self.allow, "ready": False}

    def prepare(self) -> None:
        self.plain, self.literals, self.patterns = [], defaultdict(list), {}
        for order, d in enumerate(self.detectors):
            if d.needle is None:
                test = d.guard and (self._search(d.guard[3:]) if d.guard.startswith("re:") else self._holds(d.guard))
                self.plain.append((order, test))
            elif d.needle:
                self.literals[d.needle].append(order)
        self.automaton = None
        if len(self.literals) >= MANY_LITERALS:
            try:
                import ahocorasick
            except ImportError:  # then each literal is looked for by itself
                pass
            else:
                self.automaton = ahocorasick.Automaton()
                for needle in self.literals:
                    self.automaton.add_word(needle, needle)
                self.automaton.make_automaton()
        self.ready = True

    @staticmethod
    def _search(pattern: str):
        import re

        return re.compile(pattern).search

    @staticmethod
    def _holds(part: str):
        return lambda text: part in text

    def _may_match(self, text: str) -> list[int]:
        """Detectors whose guard or literal is in the text."""
        out = [order for order, test in self.plain if test is None or test(text)]
        if self.literals:
            low = folded(text)
            met = {n for _, n in self.automaton.iter(low)} if self.automaton else [n for n in self.literals if n in low]
            out += [order for n in met for order in self.literals[n]]
        return out

    def candidates(self, text: str) -> list[tuple]:
        """(-priority, -length, start, detector's number, end, value), without empty and allowed values."""
        if not self.ready:
            self.prepare()
        found = []
        for order in self._may_match(text):
            d = self.detectors[order]
            p = self.patterns.get(order) or self.patterns.setdefault(order, d.compiled())
            group = "pii" if "pii" in p.groupindex else 2 if d.split else 0
            for m in p.finditer(text):
                start, end = m.span(group)
                if start < end and (d.accept is None or d.accept(m, text)):
                    value = text[start:end]
                    if not self.allow or value.casefold() not in self.allow:
                        found.append((-d.priority, start - end, start, order, end, value))
        return found

    def spans(self, text: str | None) -> list[Span]:
        """By start. Of overlapping candidates the one of highest priority stays, then the longest, then the first.

        Claimed characters are marked, so that a candidate costs its own length, however many others there are.
        """
        found = self.candidates(text) if text else []
        if len(found) > 1:
            marks, taken = bytearray(len(text)), []
            for c in sorted(found):
                start, end = c[2], c[4]
                if marks.find(1, start, end) < 0:
                    marks[start:end] = b"\1" * (end - start)
                    taken.append(c)
            found = sorted(taken, key=lambda c: c[2])
        pick = self.detectors.__getitem__
        return [Span(s, e, v, v.casefold() if pick(o).fold else v, pick(o)) for _, _, s, o, e, v in found]
