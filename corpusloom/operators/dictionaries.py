"""Dictionaries of any size on tokens: one automaton for all entries, whatever key they are under.

An entry is a sequence of words; in a word "*" stands for any letters and "?" for
one. The automaton is a trie of words: a token leads on by its own name, by
the prefixes that entries such as "job*" ask for, and by the few other globs that a state has. So a token
costs what it matches, not what the dictionary holds. Of matches that lie within one another the
longest counts, of whatever key, so "not good" under one key hides the "good" of another;
matches of the same tokens count for each of their keys.
"""

from __future__ import annotations

import re
from fnmatch import translate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Automaton:
    """The trie of a dictionary's entries; `scan` finds the matches that count."""

    def __init__(self, dictionary: dict[str, list[str]]) -> None:
        self.keys = list(dictionary)
        self.exact: list[dict[str, int]] = [{}]
        self.starts: list[dict[str, int]] = [{}]  # by prefix
        self.globs: list[list[tuple[re.Pattern, int]]] = [[]]
        self.ends: list[tuple[int, ...]] = [()]
        named: list[dict[str, int]] = [{}]
        for k, key in enumerate(self.keys):
            for entry in dictionary[key]:
                state = 0
                for word in entry.lower().split():
                    state = self._edge(named, state, word)
                if state and k not in self.ends[state]:
                    self.ends[state] = (*self.ends[state], k)
        self.spans = [sorted({len(p) for p in s}) for s in self.starts]

    def _edge(self, named: list[dict[str, int]], state: int, word: str) -> int:
        if word in named[state]:
            return named[state][word]
        new = len(self.ends)
        named[state][word] = new
        for table, empty in ((self.exact, {}), (self.starts, {}), (self.globs, []), (self.ends, ()), (named, {})):
            table.append(empty)
        if not set(word) & set("*?"):
            self.exact[state][word] = new
        elif word[-1] == "*" and not set(word[:-1]) & set("*?"):
            self.starts[state][word[:-1]] = new
        else:
            self.globs[state].append((re.compile(translate(word.replace("[", "[[]"))), new))
        return new

    def follow(self, state: int, token: str) -> list[int]:
        out = []
        if (to := self.exact[state].get(token)) is not None:
            out.append(to)
        starts = self.starts[state]
        for n in self.spans[state]:
            if n > len(token):
                break
            if (to := starts.get(token[:n])) is not None:
                out.append(to)
        out.extend(to for pattern, to in self.globs[state] if pattern.match(token))
        return out

    def scan(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, key) of the matches that lie in no longer one, by start and end."""
        found: list[tuple[int, int, set[int]]] = []
        begins: dict[str, list[int]] = {}
        for i, t in enumerate(tokens):
            states = begins.get(t)
            if states is None:
                states = begins[t] = self.follow(0, t)
            j, best = i + 1, None
            while states:
                keys = {k for s in states for k in self.ends[s]}
                if keys:
                    best = (i, j, keys)
                if j == len(tokens):
                    break
                states = [x for s in states for x in self.follow(s, tokens[j])]
                j += 1
            if best:  # shorter ones from here lie in the longest
                found.append(best)
        out, reach = [], 0
        for i, j, keys in found:
            if j > reach:  # else within one that began earlier
                out.extend((i, j, k) for k in sorted(keys))
                reach = j
        return out


def counts(toks: Column, dictionary: dict[str, list[str]]) -> Column:
    """A struct of counts by key, on arrays of tokens; null tokens match nothing, a null array has zeros."""
    automaton = Automaton(dictionary)
    fields = ", ".join(f"`{k}` long" for k in dictionary)

    @F.pandas_udf(f"struct<{fields.replace(' long', ': long')}>")
    def count(held: pd.Series) -> pd.DataFrame:
        rows = []
        for tokens in held:
            n = [0] * len(automaton.keys)
            for _, _, k in automaton.scan(["" if t is None else t for t in tokens]) if tokens is not None else ():
                n[k] += 1
            rows.append(n)
        return pd.DataFrame(rows, columns=automaton.keys, dtype="int64")

    return count(toks)


def tone(toks: Column, dictionary: dict[str, list[str]]) -> Column:
    """(pos, neg, tone, label): a dictionary of positive, negative, neg_positive and neg_negative entries, negated phrases counted for the other side; tone is over the number of tokens."""
    missing = {"positive", "negative", "neg_positive", "neg_negative"} - set(dictionary)
    k = counts(toks, dictionary | {m: [] for m in missing})
    size = F.greatest(F.lit(1), F.size(toks))
    pos, neg = k["positive"] + k["neg_negative"], k["negative"] + k["neg_positive"]
    label = F.when(pos > neg, "trust").when(neg > pos, "distrust").otherwise("non_evaluative")
    return F.struct(pos.alias("pos"), neg.alias("neg"), ((pos - neg) / size).alias("tone"), label.alias("label"))


URL = r"(?i)\b(?:https?://|ftp://|www\.)\S+"
#: A word: letters and digits of any script, joined by apostrophes or hyphens.
WORD = r"[\p{L}\p{N}\p{M}]+(?:['’\-][\p{L}\p{N}\p{M}]+)*"


def plain_tokens(c: Column, numbers: bool = False) -> Column:
    """Lower-case words of a text without addresses, punctuation and symbols; without tokens that have no letter, unless `numbers`."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(c, URL, " ")), F.lit(WORD), F.lit(0))
    return found if numbers else F.filter(found, lambda t: t.rlike(r"\p{L}"))


def entries_of(df: DataFrame, column: str, most: int = 100_000) -> list[str]:
    """A table's entries as a list; refused above `most`, as every task holds the automaton."""
    rows = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} entries: split the dictionary")
    return sorted(rows)

