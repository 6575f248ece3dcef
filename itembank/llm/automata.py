"""Levenshtein automata of a lexicon's terms, intersected with its trie; deterministic states are made as words need them."""

from __future__ import annotations

import numpy as np

from itembank.llm import words

#: Marks that count as letters between two letters, as in id*ot or l0$er.
MASKS = "*@$!"
#: A finding's code: this times the edits, plus the term.
STRIDE = 1 << 24
NONE = 1 << 30
#: Code points that can be letters: planes 0 to 3.
_TOP = 0x40000
#: Distinct words and entries of states that an automaton remembers; both memories are emptied when full. Longer words (letters) are walked each time.
CACHE_WORDS, CACHE_ENTRIES, CACHE_LETTERS = 400_000, 4_000_000, 256
#: More edits than any term allows.
_FAR = np.uint8(100)


def edits_allowed(term: str) -> int:
    return 2 if len(term) >= 8 else 1 if len(term) >= 4 else 0


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 between words, 1 a letter or digit, 2 a mask; and its small letter."""
    kind, low = np.zeros(_TOP, dtype=np.uint8), np.arange(_TOP, dtype=np.int64)
    for cp in range(_TOP):
        c = chr(cp)
        if c.isalnum():
            kind[cp] = 1
            if len(small := c.lower()) == 1:
                low[cp] = ord(small)
    kind[[ord(c) for c in MASKS]] = 2
    return kind, low


_tables: list[np.ndarray] = []


def _code_tables() -> list[np.ndarray]:
    if not _tables:
        kind, low = _code_points()
        _tables.extend((kind, low, words.mix64((low + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    return _tables


class Automaton:
    """The trie's nodes as arrays, and the deterministic states met so far.

    A state holds for each trie node the fewest edits that lead there, and for each node of which the last two letters were read
    in the other order and the second is still to come, the same. Edits are insertions, deletions, substitutions and swaps of
    neighbours. A state is made when a word first leads to it, by a few operations over all nodes.
    """

    def __init__(self, terms: list[str]) -> None:
        children: list[dict[str, int]] = [{}]
        parent, letter, whole, inner = [0], [""], [-1], [-1]
        for t in range(len(terms) - 1, -1, -1):  # of equal terms the first stays
            node = 0
            for c in terms[t].rstrip("*"):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    parent.append(node)
                    letter.append(c)
                    whole.append(-1)
                    inner.append(-1)
                node = children[node][c]
            whole[node] = t
            if terms[t].endswith("*"):
                inner[node] = t
        own = [edits_allowed(terms[t].rstrip("*")) if t >= 0 else -1 for t in whole]
        most = list(own)
        for node in range(len(children) - 1, 0, -1):  # children come after their parents
            most[parent[node]] = max(most[parent[node]], most[node])
        self.letters = {c: k + 1 for k, c in enumerate(sorted({*letter} - {""}))}
        self.parent = np.array(parent)
        self.letter = np.array([self.letters.get(c, 0) for c in letter])
        self.above = self.letter[self.parent]
        self.most, self.own = np.array(most, dtype=np.int16), np.array(own, dtype=np.int16)
        self.whole, self.inner = np.array(whole), np.array(inner)
        self._forget_states()
        self._forget_words()

    def _forget_states(self) -> None:
        self.index: dict[bytes, int] = {}
        self.sets: list[tuple[np.ndarray, ...]] = []
        self.next: list[dict[int, int]] = []
        self.ends: list[tuple[int, int]] = []
        self.entries = 0
        n = len(self.parent)
        self._state(np.full(n, _FAR), np.full(n, _FAR))  # 0 is dead
        start = np.full(n, _FAR)
        start[0] = 0
        self._state(self._skipped(start), np.full(n, _FAR))

    def _forget_words(self) -> None:
        self.seen, self.codes = words.Seen(), np.zeros(0, dtype=np.int64)

    def _skipped(self, edits: np.ndarray) -> np.ndarray:
        """With skipped letters of terms."""
        root = edits[0]
        for _ in range(2):
            edits = np.minimum(edits, edits[self.parent] + np.uint8(1))
        edits[0] = root
        return edits

    def _state(self, edits: np.ndarray, waits: np.ndarray) -> int:
        a, b = np.flatnonzero(edits <= self.most), np.flatnonzero(waits <= self.most)
        entry = a, edits[a], b, waits[b]
        key = b"|".join(x.tobytes() for x in entry)
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(entry)
            self.next.append({})
            self.entries += len(a) + len(b) + 50
            done = a[(edits[a] <= self.own[a]) & (self.whole[a] >= 0)]
            code = edits[done].astype(np.int64) * STRIDE
            stem = self.inner[done] >= 0
            self.ends.append((int((code + self.whole[done]).min(initial=NONE)), int((code + self.inner[done])[stem].min(initial=NONE))))
        return self.index[key]

    def _step(self, state: int, letter: int) -> int:
        a, ea, b, eb = self.sets[state]
        edits, waits = np.full(len(self.parent), _FAR), np.full(len(self.parent), _FAR)
        edits[a], waits[b] = ea, eb
        one = np.uint8(1)
        from_parent = edits[self.parent]
        from_parent[0] = _FAR
        to = np.minimum(edits + one, from_parent + (self.letter != letter))
        to = np.minimum(to, np.where(self.above == letter, waits, _FAR))
        swapped = np.where((self.letter == letter) & (self.above != letter) & (self.above > 0), from_parent[self.parent] + one, _FAR)
        return self._state(self._skipped(to), swapped)

    def code(self, word: list[int]) -> int:
        """What a word (its letters' numbers, 0 for those that no term has) is accepted as: STRIDE * edits + term, the fewest edits first, or NONE."""
        if self.entries > CACHE_ENTRIES:
            self._forget_states()
        state, best = 1, NONE
        for letter in word:
            to = self.next[state].get(letter)
            if to is None:
                to = self.next[state][letter] = self._step(state, letter)
            state = to
            if not state:
                return best
            if (inner := self.ends[state][1]) < best:
                best = inner
        return min(best, self.ends[state][0])


def build(terms: list[str]) -> Automaton:
    """terms: words, or stems that end with * and may be followed by anything."""
    return Automaton(terms)


def find(auto: Automaton, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and what it is accepted as: STRIDE * edits + term, the fewest edits first, or NONE. Distinct words are walked once."""
    kinds, low, values = _code_tables()
    cp = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), _TOP - 1)
    kind = kinds[cp]
    inside = kind == 1
    if len(cp) > 2:
        inside[1:-1] |= (kind[1:-1] == 2) & inside[:-2] & inside[2:]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(auto.codes) > CACHE_WORDS:
        auto._forget_words()
    hashes = words.word_hashes(cp, starts, ends, values)
    short = ends - starts <= CACHE_LETTERS
    number = np.where(short, auto.seen.find(hashes), -1)
    new, long = np.flatnonzero((number < 0) & short), np.flatnonzero(~short)
    distinct, first, of = np.unique(hashes[new], return_index=True, return_inverse=True)
    known = len(auto.codes)
    get = auto.letters.get
    codes = [auto.code([get(chr(c), 0) for c in low[cp[starts[i] : ends[i]]].tolist()]) for i in [*new[first].tolist(), *long.tolist()]]
    auto.codes = np.concatenate((auto.codes, np.array(codes[: len(first)], dtype=np.int64)))
    auto.seen.add(distinct, known)
    number[new], number[long] = known + of, 0
    best = auto.codes[number] if len(auto.codes) else np.zeros(len(starts), dtype=np.int64)
    best[long] = codes[len(first) :]
    return starts, ends, best
