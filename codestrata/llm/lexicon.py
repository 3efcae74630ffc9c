"""A minimal acyclic transducer from words to id sequences, stored for memory mapping.

Words are added in byte order; states with equal futures are shared as soon as their last word is done. Every arc
carries a number, and the numbers along a word's path add up to the place of its ids in the output table.
"""

from __future__ import annotations

import mmap
import struct
from array import array

_HEAD = struct.Struct("<5Q")


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The bytes of the transducer for `entries`; equal entries give equal bytes."""
    words = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states along the previous word

    def settle(depth: int, word: bytes) -> None:
        """Shares or registers the states of the previous word below `depth`."""
        for k in range(len(path) - 1, depth, -1):
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][word[k - 1]] = register.setdefault(key, state)

    last = b""
    for word in words:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        settle(common, last)
        for b in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0, last)

    order, number, reach = [0], {0: 0}, {}
    for state in order:  # grows while it is walked
        for t in arcs[state].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)

    def count(state: int) -> int:
        """Words that end in or below `state`; no deeper than the longest word."""
        if state not in reach:
            reach[state] = final[state] + sum(count(t) for t in arcs[state].values())
        return reach[state]

    first, ends = array("I"), array("B")
    label, target, skip = array("B"), array("I"), array("I")
    for state in order:
        first.append(len(label))
        ends.append(final[state])
        before = int(final[state])
        for b in sorted(arcs[state]):
            t = arcs[state][b]
            label.append(b)
            target.append(number[t])
            skip.append(before)
            before += count(t)
    first.append(len(label))
    place, ids = array("I", [0]), array("I")
    for word in words:
        ids.extend(entries[word])
        place.append(len(ids))
    head = _HEAD.pack(len(order), len(label), len(words), len(ids), 0)
    return head + b"".join(a.tobytes() for a in (first, target, skip, place, ids, ends, label))


class Lexicon:
    """A compiled lexicon, mapped from a file (or read from bytes)."""

    def __init__(self, path: str | None = None, data: bytes | None = None):
        if path is not None:
            with open(path, "rb") as file:
                data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(data)
        states, n_arcs, n_words, n_ids, _ = _HEAD.unpack(view[: _HEAD.size])
        at = _HEAD.size
        parts = []
        for count, kind, width in ((states + 1, "I", 4), (n_arcs, "I", 4), (n_arcs, "I", 4), (n_words + 1, "I", 4), (n_ids, "I", 4), (states, "B", 1), (n_arcs, "B", 1)):
            parts.append(view[at : at + count * width].cast(kind))
            at += count * width
        self.first, self.target, self.skip, self.place, self.ids, self.ends, self.label = parts

    def get(self, word: bytes) -> tuple[int, ...] | None:
        """The ids of `word`; None if the lexicon hasn't got it."""
        state = number = 0
        first, label, target, skip = self.first, self.label, self.target, self.skip
        for b in word:
            for arc in range(first[state], first[state + 1]):
                if label[arc] >= b:
                    break
            else:
                return None
            if label[arc] != b:
                return None
            number += skip[arc]
            state = target[arc]
        if not self.ends[state]:
            return None
        return tuple(self.ids[self.place[number] : self.place[number + 1]])
