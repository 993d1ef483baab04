"""Finite-state form of byte-pair encoding.

A pair-merging tokenizer is turned into a deterministic transducer.  A state is
the *pending* text: what has been read since the last token boundary that no
continuation can move.  An edge carries what becomes certain when one more
symbol is read.  States and edges are made when first needed and then reused,
so the hot loop is one dictionary lookup for each symbol.

Two facts make this exact:

* if a position is a token boundary of a text, the text left of it and the
  text right of it are tokenized independently of each other;
* the token that will cover the end of what has been read starts at a position
  from which the rest is the beginning of some vocabulary entry.

A third makes it cheap: a sequence of tokens is the tokenization of its text
when every two neighbours are that of theirs.

So the boundaries shared by the tokenizations of all prefixes ending at such
starting positions are final, and everything up to the last one is emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


#: The rank of a pair that is not merged.
NEVER = 1 << 60


def merge_pairs(symbols: Iterable[str], pair_rank: Callable[[str, str], int]) -> list[str]:
    """Merge the best-ranked (then leftmost) neighbours until none can be merged; NEVER: not merged."""
    parts = list(symbols)
    ranks = list(map(pair_rank, parts, parts[1:]))
    while ranks:
        best = min(ranks)
        if best == NEVER:
            break
        at = ranks.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        if at:
            ranks[at - 1] = pair_rank(parts[at - 1], parts[at])
        if at < len(ranks):
            ranks[at] = pair_rank(parts[at], parts[at + 1])
    return parts


def sufficient_lookahead(merges: Iterable[tuple[str, str]]) -> int:
    """How many symbols past a boundary settle it, for a ranked merge list.

    Take two continuations of one text and apply the merges rank by rank.  The
    first place where the two runs differ can move left only when one run
    merges (u, v) where the other run has a different symbol starting where v
    starts.  After that the runs differ from the start of u, with u (or a
    longer symbol that begins with u) on one side.  The next such merge
    (u', v') needs a v' whose leftmost parts include u, and a worse rank.  The
    longest chain of these steps, counted in symbols, bounds how far the
    difference travels.
    """
    left_part: dict[str, str] = {}
    reach: dict[str, int] = {}
    longest = 1
    for u, v in merges:
        best, spine = 0, v
        while spine:
            best = max(best, reach.get(spine, 0))
            spine = left_part.get(spine, "")
        here = max(len(u) + len(v), len(u) + best if best else 0)
        left_part.setdefault(u + v, u)
        reach[u] = max(reach.get(u, 0), here)
        longest = max(longest, here)
    return longest


class State(dict):
    """Edges by symbol: (next state, what is emitted)."""

    __slots__ = ("alive", "last", "machine", "pending", "tail")

    def __missing__(self, symbol: str):
        edge = self[symbol] = self.machine.edge(self, symbol)
        return edge


class Transducer:
    """Lazily built deterministic transducer of a pair-merging vocabulary.

    ``emit`` turns a list of tokens into the annotation of an edge (their
    number, their ids, ...).  At most ``max_states`` states are kept; beyond
    that the table starts anew, so memory does not grow with the input.  A
    pending text of more than ``lookahead`` symbols is an error.
    """

    def __init__(self, tokens: Iterable[str], pair_rank, emit, max_states: int = 250_000, lookahead: int | None = None):
        self.pair_rank, self.emit, self.max_states, self.lookahead = pair_rank, emit, max_states, lookahead
        self.tokens = set(tokens)
        self.apart: dict[tuple[str, str], bool] = {}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self._renew()

    def _renew(self) -> None:
        self.states: dict[str, State] = {}
        self.start = self._state("", [0], [0])

    def _state(self, pending: str, last: list[int], alive: list[int]) -> State:
        st = self.states.get(pending)
        if st is None:
            st = State()
            st.machine, st.pending, st.last, st.alive = self, pending, last, alive
            st.tail = self.emit(self._path(pending, last, len(pending)))
            self.states[pending] = st
        return st

    @staticmethod
    def _path(text: str, last: list[int], end: int) -> list[str]:
        tokens = []
        while end:
            tokens.append(text[last[end] : end])
            end = last[end]
        return tokens[::-1]

    def edge(self, st: State, symbol: str):
        if len(self.states) > self.max_states:
            self._renew()
        text = st.pending + symbol
        n = len(text)
        alive = [p for p in st.alive if text[p:] in self.prefixes]
        last = [*st.last, next((p for p in alive if self._ends(text, p, st.last)), n - 1)]
        alive.append(n)
        cut = alive[0]
        for p in alive[1:]:  # the last boundary that all of them share
            while p != cut:
                if p > cut:
                    p = last[p]
                else:
                    cut = last[cut]
        out = self.emit(self._path(text, last, cut))
        if self.lookahead is not None and n - cut > self.lookahead:
            raise RuntimeError("pending text goes over the merge list's lookahead")
        rest = [max(0, x - cut) for x in last[cut:]]
        rest[0] = 0
        return self._state(text[cut:], rest, [p - cut for p in alive]), out

    def _ends(self, text: str, p: int, last: list[int]) -> bool:
        """Whether the tokenization of text ends with the token text[p:]: it and the token before it stay apart."""
        token = text[p:]
        if token not in self.tokens:
            return False
        before = text[last[p] : p]
        found = self.apart.get((before, token))
        if found is None:
            if len(self.apart) > self.max_states:
                self.apart.clear()
            found = self.apart[before, token] = merge_pairs(before + token, self.pair_rank) == ([before, token] if before else [token])
        return found

    def state_of(self, pending: str) -> State:
        """The state that has just this pending text."""
        st = self.states.get(pending)
        if st is None:
            st = self.start
            for symbol in pending:
                st = st[symbol][0]
        return st
