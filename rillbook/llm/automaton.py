"""A byte-level BPE vocabulary as a deterministic transducer, compiled where texts lead.

A state is what the next bytes of a piece can depend on: every start of a token that may still be under
way, with its node in the trie of tokens, the last token before it, and how many tokens fewer than now
were out there. A transition reads one byte and gives the last token of the longer prefix and how many
tokens are out in addition (none or fewer where a longer token takes the place of several).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: States kept; beyond them compilation starts anew. Results do not depend on it.
MOST_STATES = 100_000


class State(dict):
    """byte -> (state, tokens in addition, last token)."""

    __slots__ = ("entries", "owner")

    def __init__(self, owner: PrefixAutomaton, entries: tuple):
        super().__init__()
        self.owner, self.entries = owner, entries

    def __missing__(self, byte: int) -> tuple[State, int, int]:
        step = self[byte] = self.owner.step(self.entries, byte)
        return step


class PrefixAutomaton:
    """``tokens``: (number, bytes) of every token that merging its own bytes gives.

    ``together(left, right)`` tells whether merging leaves the border between two tokens alone.
    """

    def __init__(self, tokens: Iterable[tuple[int, bytes]], together: Callable[[int, int], bool]):
        self.together = together
        self.children: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for number, data in tokens:
            node = 0
            for byte in data:
                key = node << 8 | byte
                nearest = self.children.get(key)
                if nearest is None:
                    nearest = self.children[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nearest
            self.token[node] = number
        self.known: dict[tuple, State] = {}
        self.pairs: dict[int, bool] = {}
        self.start = State(self, ((0, -1, 0),))

    def step(self, entries: tuple, byte: int) -> tuple[State, int, int]:
        children, tokens, inner, pairs = self.children, self.token, self.inner, self.pairs
        live, found, more = [], -1, 0
        for node, last, behind in entries:
            node = children.get(node << 8 | byte)
            if node is None:
                continue
            if found < 0 and (token := tokens[node]) >= 0:
                # Exactly one token can be the last one of a prefix.
                if last < 0:
                    found, more = token, behind + 1
                else:
                    key = last << 32 | token
                    if (fits := pairs.get(key)) is None:
                        if len(pairs) > 300_000:
                            pairs.clear()
                        fits = pairs[key] = self.together(last, token)
                    if fits:
                        found, more = token, behind + 1
            if inner[node]:
                live.append((node, last, behind))
        if found < 0:
            raise ValueError("no token ends here")
        after = (*((node, last, behind - more) for node, last, behind in live), (0, found, 0))
        state = self.known.get(after)
        if state is None:
            if len(self.known) >= MOST_STATES:
                self.known.clear()
                self.start = State(self, ((0, -1, 0),))
            state = self.known[after] = State(self, after)
        return state, more, found

    def count(self, data: bytes) -> int:
        """Tokens of one piece: the sum of what its transitions add."""
        state, out = self.start, 0
        for byte in data:
            state, more, _ = state[byte]
            out += more
        return out
