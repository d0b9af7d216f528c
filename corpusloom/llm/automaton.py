"""A lexicon trie intersected with Levenshtein automata, determinised as it is used.

A state is a set of (trie node, edits so far); reading a character moves along
the trie (match), stays (insertion) or takes any child (substitution), and
skipping a trie character is a deletion. Every term has its own number of
edits; a node allows as many as the most tolerant term below it. Sets that
occur are numbered once and their moves remembered, so a word costs a few
dictionary lookups, and most words die within their first letters.
"""

from __future__ import annotations

DEAD = 0


def tolerance(term: str) -> int:
    """Edits that a term allows, by its length."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.allowed: list[int] = [0]
        for i, t in enumerate(terms):
            node, k = 0, tolerance(t)
            self.allowed[0] = max(self.allowed[0], k)
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.allowed.append(0)
                node = self.children[node][ch]
                self.allowed[node] = max(self.allowed[node], k)
            self.term[node] = i
        self.sets: list[tuple[tuple[int, int], ...]] = [()]
        self.number: dict[tuple[tuple[int, int], ...], int] = {(): DEAD}
        self.moves: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, int] | None] = [None]
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        todo = list(edits)
        while todo:  # deletions
            n = todo.pop()
            for c in self.children[n].values():
                e = edits[n] + 1
                if e <= self.allowed[c] and e < edits.get(c, 99):
                    edits[c] = e
                    todo.append(c)
        key = tuple(sorted(edits.items()))
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= tolerance(self.terms[self.term[n]])]
            self.accepts.append(min(hits) if hits else None)
        return self.number[key]

    def step(self, state: int, ch: str) -> int:
        to = self.moves[state].get(ch)
        if to is None:
            edits: dict[int, int] = {}

            def reach(node: int, e: int) -> None:
                if e <= self.allowed[node] and e < edits.get(node, 99):
                    edits[node] = e

            for n, e in self.sets[state]:
                reach(n, e + 1)
                for c, child in self.children[n].items():
                    reach(child, e + (c != ch))
            to = self.moves[state][ch] = self._state(edits)
        return to

    def match(self, word: str) -> tuple[int, int, bool] | None:
        """(term, edits, whole) of the best match of the word or of a beginning of it; None if there is none."""
        state, best, found = self.start, None, None
        moves = self.moves
        for ch in word:
            to = moves[state].get(ch)
            state = self.step(state, ch) if to is None else to
            if state == DEAD:
                return None if best is None else (best[1], best[0], False)
            found = self.accepts[state]
            if found is not None and (best is None or found < best):
                best = found
                if best[0] == 0:
                    return best[1], 0, True
        if found is not None and found[0] == best[0]:
            return found[1], found[0], True
        return None if best is None else (best[1], best[0], False)
