"""A generalised suffix automaton over token sequences, and matching statistics."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """All runs of tokens of several sequences, as states.

    A state stands for runs that end at the same places; ``length`` is its longest run
    and ``link`` the state of the longest shorter run with more ends.  ``ends`` of a state
    are (sequence, place of the run's last token), for states of ``least`` tokens or more.
    """

    def __init__(self, sequences: Sequence[Sequence[Hashable]], least: int = 1):
        self.ids: dict[Hashable, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.ids.setdefault(t, len(self.ids)) for t in s] for s in sequences]
        for tokens in coded:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        found: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, tokens in enumerate(coded):
            at = 0
            for place, t in enumerate(tokens):
                at = self.next[at][t]
                found[at].append((k, place))
        for state in sorted(range(1, len(self.next)), key=lambda x: -self.length[x]):
            if self.length[self.link[state]] >= least:
                found[self.link[state]] += found[state]
        self.ends = [tuple(sorted(x)) for x in found]

    def _state(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(onward)
        return len(self.next) - 1

    def _split(self, before: int, token: int) -> int:
        """The state of the run ``before`` + ``token`` alone, parted from longer ones."""
        whole = self.next[before][token]
        if self.length[whole] == self.length[before] + 1:
            return whole
        part = self._state(self.length[before] + 1, self.link[whole], dict(self.next[whole]))
        self.link[whole] = part
        while before >= 0 and self.next[before].get(token) == whole:
            self.next[before][token] = part
            before = self.link[before]
        return part

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # another sequence holds this run already
            return self._split(last, token)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, token)
        return new

    def state_of(self, tokens: Iterable[Hashable]) -> int:
        at = 0
        for t in tokens:
            at = self.next[at][self.ids[t]]
        return at

    def chain(self, state: int) -> Iterator[int]:
        """The state and those of its shorter suffixes, without the empty run."""
        while state > 0:
            yield state
            state = self.link[state]

    def statistics(self, tokens: Iterable[Hashable]) -> Iterator[tuple[int, int]]:
        """State and length of the longest known run that ends at each token."""
        state = length = 0
        onward, link, longest = self.next, self.link, self.length
        for t in map(self.ids.get, tokens):
            if t is None:
                state = length = 0
            else:
                while t not in onward[state]:
                    state = link[state]
                    length = longest[state]
                state = onward[state][t]
                length += 1
            yield state, length
