"""Many phrase patterns against many lines: a multi-pattern search for the letters that a pattern cannot do without decides
which patterns are tried at all. Results are those of the patterns alone."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

try:
    import ahocorasick
except ImportError:  # the patterns are then tried on every line
    ahocorasick = None


def _stems(parsed) -> set[str] | None:
    """Literals of which every match of the parsed pattern holds at least one, or None if there are no such."""
    best, run = None, []

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and "" not in found and (best is None or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
            best = found

    def close() -> None:
        offer({"".join(run)} if run else None)
        run.clear()

    for op, arg in parsed:
        if op is C.LITERAL:
            run.append(chr(arg))
            continue
        if op is not C.AT:
            close()
        if op is C.SUBPATTERN:
            offer(_stems(arg[3]))
        elif op is C.BRANCH:
            parts = [_stems(x) for x in arg[1]]
            offer(None if None in parts else set().union(*parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            offer(_stems(arg[2]))
    close()
    return best


class Phrases:
    """Named patterns over texts in lower case."""

    def __init__(self, patterns: dict[str, str]):
        self.patterns = {k: re.compile(v) for k, v in patterns.items()}
        self.always, stems = [], {}
        for name, pattern in patterns.items():
            found = _stems(_parser.parse(pattern)) if ahocorasick else None
            if found is None:
                self.always.append(name)
            for stem in found or ():
                stems.setdefault(stem, []).append(name)
        self.automaton = None
        if stems:
            self.automaton = ahocorasick.Automaton()
            for stem, names in stems.items():
                self.automaton.add_word(stem, tuple(names))
            self.automaton.make_automaton()

    def candidates(self, text: str) -> set[str]:
        """The names of the patterns that ``text`` may match: all that it does match are among them."""
        out = set(self.always)
        if self.automaton is not None:
            for _, names in self.automaton.iter(text):
                out.update(names)
        return out

    def matching(self, text: str) -> list[str]:
        """The names, in their given order, of the patterns that ``text`` matches."""
        tried = self.candidates(text)
        return [k for k, p in self.patterns.items() if k in tried and p.search(text)] if tried else []
