"""A BPE merge list compiled into a deterministic automaton over tokens.

The automaton starts as one state with a loop for every byte: it reads any spelling of any bytes.
Merge number r of (a, b) is then put in as a gadget. What `a` leads to is split: `a` now leads to a
copy that lacks the arc b, and a new arc ab goes from wherever `a` may be read to where b led. After
the last merge, each byte string has just one path left, and the labels on it are its tokens.

A copy differs from its original in the one arc it lost, so what `a` leads to is kept as the list of
gadgets that split it, {lost arc: r}. A token ab leads to where b led when it was made: to the
gadgets of b that came before r. The state after a token is thus the chain of its right ends, each
with the merge that closed its list, and all states together take one entry for each merge. Whether
a state has an arc t follows in the same way from the left ends of t: each was made at a state only
where its own left part could still be read when its merge was put in.
"""

from __future__ import annotations

import functools

from meterloom.llm.bpe_text import byte_bpe

#: Stands for the state before any token: it has every arc.
START = -1
_ROWS_KEPT = 300_000


class MergeAutomaton:
    def __init__(self, path: str):
        self.bpe = byte_bpe(path)
        ids, labels, size = self.bpe.ids, self.bpe.labels, self.bpe.size
        never = len(self.bpe.merges)
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.gadgets: list[dict[int, int]] = [{} for _ in range(size)]
        for rank, (a, b) in enumerate(self.bpe.merges):
            token = ids[labels[a] + labels[b]]
            self.gadgets[a][b] = rank
            self.left[token], self.right[token], self.made[token] = a, b, rank
        self._never = never
        self.lengths = [len(label) for label in labels]
        self._clear()
        self._left_ends: list[tuple | None] = [None] * size

    def _clear(self) -> None:
        self._held: list[tuple] = []
        self._numbers: dict[tuple, int] = {}
        self._table: dict[int, int] = {}
        self._row((b"", (START,)))

    def left_ends(self, token: int) -> tuple:
        """(part, merge that closed it) of a token, its left part, that one's left part and so on."""
        if (found := self._left_ends[token]) is None:
            ends, part, closed = [], token, self._never
            while part >= 0:
                ends.append((part, closed))
                closed, part = self.made[part], self.left[part]
            found = self._left_ends[token] = tuple(ends)
        return found

    def has_arc(self, state: int, token: int) -> bool:
        """Whether token may be read after the token that names the state."""
        ends, closed = self.left_ends(token), self._never
        while state >= 0:
            if lost := self.gadgets[state]:
                for part, above in ends:
                    rank = lost.get(part)
                    if rank is not None and rank < closed and rank <= above:
                        return False
            closed, state = self.made[state], self.right[state]
        return True

    def _row(self, held: tuple) -> int:
        if (found := self._numbers.get(held)) is None:
            found = self._numbers[held] = len(self._held)
            self._held.append(held)
        return found

    def _fill(self, row: int, byte: int) -> int:
        """A cell of the table: the row after it, and the one arc that may end at this byte. A row
        holds the longest end of the word that begins some token, and the last arc of each prefix
        from there on: later arcs depend on no more."""
        end, last = self._held[row]
        end += bytes((byte,))
        for at in range(len(last)):
            token = self.bpe.ids.get(end[at:])
            if token is not None and self.has_arc(last[at], token):
                break
        else:
            raise ValueError("a byte without a token")
        last, keep = (*last, token), 0
        while keep < len(end) and end[keep:] not in self.bpe.beginnings:
            keep += 1
        found = self._table[row << 8 | byte] = self._row((end[keep:], last[keep:])) * self.bpe.size + token
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word. Each prefix of the word has one path,
        too, so it is enough to look up the last arc of each, then to go back along them."""
        get, size, row, last = self._table.get, self.bpe.size, 0, []
        for byte in word:
            if (cell := get(row << 8 | byte)) is None:
                cell = self._fill(row, byte)
            row, arc = divmod(cell, size)
            last.append(arc)
        if len(self._held) > _ROWS_KEPT:
            self._clear()
        found, end, length = [], len(word), self.lengths
        while end:
            found.append(arc := last[end - 1])
            end -= length[arc]
        found.reverse()
        return found

    def encode_chunk(self, chunk: str) -> list[int]:
        found: list[int] = []
        for word in self.bpe.words(chunk):
            found += [word] if isinstance(word, int) else self.encode(word)
        return found

    def decode(self, ids: list[int]) -> bytes:
        """What the arcs spell."""
        return b"".join(map(self.bpe.labels.__getitem__, ids))


@functools.cache
def merge_automaton(path: str) -> MergeAutomaton:
    return MergeAutomaton(path)
