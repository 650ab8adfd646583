"""Free-typed names mapped to the closest entry of a reference list.

The reference names and their aliases form a trie; each node on the way to several entries keeps them all. A query is
a Levenshtein automaton: its states are stepped along the trie's edges, and a branch is left as soon as its state
can no longer accept. All entries within a distance that depends on the query's length come back; the nearest wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folding import FIGURES, compact, plain

# Words that sellers put before or after a brand; names of the reference may hold them all the same.
BEFORE = "new by brand the genuine original from".split()
AFTER = "ltd limited inc corp co company llc gmbh plc official store shop kenya k electronics brand brands authorised authorized dealer group international intl tm r".split()
#: Entries of the reference list up to which it is sent to every worker.
MAX_REFERENCE = 200_000
CACHE = 100_000  #: names a worker remembers


def allowed_distance(length: int) -> int:
    """Typing errors allowed in a name of ``length`` letters."""
    return 0 if length <= 3 else 1 if length <= 6 else 2 if length <= 12 else 3


class LevenshteinAutomaton:
    """Accepts what is within ``most`` insertions, deletions, substitutions or swaps of neighbours of ``word``.

    A state is the sparse row of reachable (position, errors) pairs together with the row and the letter before it,
    which the swaps need; positions with more than ``most`` errors are left out.
    """

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.most, len(self.word)) + 1)), (), ""

    def step(self, state: tuple, letter: str) -> tuple:
        row, earlier, before = state
        word, most, reached = self.word, self.most, {}

        def reach(i: int, errors: int) -> None:
            if errors <= most and errors < reached.get(i, most + 1):
                reached[i] = errors

        for i, errors in row:
            reach(i, errors + 1)
            if i < len(word):
                reach(i + 1, errors + (word[i] != letter))
        if before:
            for i, errors in earlier:
                if i + 2 <= len(word) and word[i] == letter and word[i + 1] == before:
                    reach(i + 2, errors + 1)
        for i in range(len(word)):
            if i in reached:
                reach(i + 1, reached[i] + 1)
        return tuple(sorted(reached.items())), row, letter

    @staticmethod
    def alive(state: tuple) -> bool:
        return bool(state[0])

    def errors(self, state: tuple) -> int | None:
        """Errors if the state accepts."""
        return next((e for i, e in state[0] if i == len(self.word)), None)


class NameTrie:
    """Entries by folded name; a name may lead to several entries."""

    def __init__(self, names: Iterable[tuple[int, str]]):
        self.root: dict = {}
        self.initials: dict[tuple[str, str], set[int]] = {}
        for entry, name in names:
            if not compact(name):
                continue
            node = self.root
            for letter in compact(name):
                node = node.setdefault(letter, {})
            node.setdefault("", set()).add(entry)
            first, _, rest = plain(name).partition(" ")
            if rest:
                self.initials.setdefault((first[0], compact(rest)), set()).add(entry)

    def exact(self, word: str) -> set[int]:
        node = self._at(word)
        return node.get("", set()) if node else set()

    def _at(self, word: str) -> dict | None:
        node = self.root
        for letter in word:
            node = node.get(letter)
            if node is None:
                return None
        return node

    def beginning(self, word: str) -> set[int]:
        """Entries whose name begins with ``word``."""
        found, stack = set(), [n for n in [self._at(word)] if n]
        while stack:
            for letter, node in stack.pop().items():
                if letter:
                    stack.append(node)
                else:
                    found |= node
        return found

    def within(self, word: str, most: int) -> dict[int, int]:
        """Errors by entry, for all entries within ``most`` errors of ``word``."""
        automaton, found = LevenshteinAutomaton(word, most), {}
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            if "" in node and (errors := automaton.errors(state)) is not None:
                for entry in node[""]:
                    found[entry] = min(errors, found.get(entry, most))
            for letter, below in node.items():
                if letter and automaton.alive(stepped := automaton.step(state, letter)):
                    stack.append((below, stepped))
        return found


def _readings(word: str) -> list[str]:
    """The word with figures read as the letters they stand for: as typed first, at most 32 readings."""
    found = [""]
    for c in word:
        options = FIGURES.get(c, c)
        found = [f + o for f in found for o in options][:32]
    return list(dict.fromkeys([word, *found]))


def _spans(tokens: list[str]) -> Iterator[list[str]]:
    """The tokens without selling words at either end, then without a series and code after the name."""
    start, end = 0, len(tokens)
    yield tokens
    while start < end - 1 and tokens[start] in BEFORE:
        start += 1
    while end > start + 1 and tokens[end - 1] in AFTER:
        end -= 1
    if (start, end) != (0, len(tokens)):
        yield tokens[start:end]
    inner = tokens[start:end]
    if len(inner) > 1 and re.fullmatch(r"(?=.*\d)[a-z0-9]{2,}", inner[-1]):
        yield inner[:-1]
        if len(inner) > 2:
            yield inner[:-2]


def match_name(trie: NameTrie, name: str) -> int:
    """The entry meant by ``name``, or 0.

    Exact folded names go first, with figures read as letters, then without selling words, then without a model after
    them; then an initial before the last words; then the nearest entries within the allowed distance, of which the
    one with fewest errors counts. Last, four or more letters that begin the names of one entry only. Several entries
    equally near: the one that shares the first letter, then the smallest number.
    """
    text = plain(name)
    tokens = re.findall(r"[^\W_]+(?:[@$€|!.'-][^\W_]+)*", text)
    spans = [s for s in _spans([t.strip(".-'") for t in tokens]) if s]
    spans += [s[1:] + s[:1] for s in spans[:2] if len(s) == 2]  # words in the other order
    forms = list(dict.fromkeys("".join(c for c in "".join(s) if c.isalnum() or c in FIGURES) for s in spans))
    for form in forms:
        for reading in _readings(form):
            if found := trie.exact(reading):
                return min(found)
    if short := re.match(r"^\W*([^\W\d_])\.\s*(\w.*)$", text):
        found = trie.initials.get((short[1], compact(short[2])), set())
        if len(found) == 1:
            return min(found)
    ranked = []
    for form in forms:
        for reading in _readings(form):
            letters = "".join(c for c in reading if c.isalnum())
            near = trie.within(letters, allowed_distance(len(letters)))
            ranked += [(errors, entry) for entry, errors in near.items()]
        if ranked:
            return min(ranked)[1]
    for form in forms[:2]:
        found = trie.beginning(form) if len(form) >= 4 else set()
        if len(found) == 1:
            return min(found)
    return 0


def reference_names(reference: DataFrame) -> list[tuple[int, str]]:
    """(brand_id, name) of every canonical name and alias; the list's size is checked before it is collected."""
    rows = reference.select("brand_id", "brand_name", "also_sold_as").limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"more than {MAX_REFERENCE} reference entries; match against parts of the list and keep the nearest")
    return [(r[0], n.strip()) for r in rows for n in [r[1] or "", *(r[2] or "").split(";")] if n and n.strip()]


@lru_cache(maxsize=2)
def _trie(names: tuple[tuple[int, str], ...]) -> NameTrie:
    return NameTrie(names)


@lru_cache(maxsize=CACHE)
def _remembered(names: tuple[tuple[int, str], ...], name: str) -> int:
    return match_name(_trie(names), name)


def matcher(names: list[tuple[int, str]]):
    """A pandas UDF from a name to its entry or 0; each worker builds the trie once and remembers names."""
    fixed = tuple(names)

    @F.pandas_udf("long")
    def entry_of(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        found = [_remembered(fixed, v) for v in distinct]
        return pd.Series([found[c] if c >= 0 else 0 for c in codes], index=values.index)

    return entry_of


def mapped_names(df: DataFrame, name: str, reference: DataFrame, entry: str = "brand_id") -> DataFrame:
    """``df`` with a BIGINT column ``entry``: the reference entry of the column ``name``, 0 if none is meant.

    Works row by row without a shuffle, so a name held by a third of the rows is no hot key. Null, empty and blank names
    and names without a letter or digit map to 0; rows are kept as they are, repeated ones too. An empty reference maps
    everything to 0.
    """
    return df.withColumn(entry, matcher(reference_names(reference))(F.col(name)))


def has_sign(name: Column) -> Column:
    """Whether the name holds a letter or digit."""
    return name.rlike(r"[\p{L}\p{N}]")
