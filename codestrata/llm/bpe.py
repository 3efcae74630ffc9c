"""Byte-level byte-pair encoding with the ranks of a public tokenizer's file."""

from __future__ import annotations

import base64
import heapq
import os

import regex

TOKENIZER_FOLDER = "/opt/tokenizers"
# fixed value: the pattern that parts a text into words, as published with the tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed value: Unicode White_Space
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
#: A chunk is a run of non-blanks with one space before it, or blanks; no word of PATTERN crosses a chunk's edge.
CHUNK = rf" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"


class Merges:
    """Ranks of byte strings, and the exact encoding of chunks by them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(PATTERN).findall

    def word(self, piece: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged, the leftmost first, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        stop = after[:]  # part i is piece[i:stop[i]]; a merged part has stop 0
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not stop[i] or j >= n or stop[j] != end:
                continue
            stop[i], stop[j] = end, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : stop[k]])) is not None:
                    heapq.heappush(heap, (r, i, stop[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return [ranks[piece[i : stop[i]]] for i in range(n) if stop[i]]

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk."""
        return [i for w in self.split(text) for i in self.word(w.encode("utf-8"))]


def load(name: str, folder: str | None = None) -> Merges:
    """The tokenizer `name` (byte_bpe_50k or byte_bpe_multi_50k) of the tokenizers' folder."""
    return Merges(os.path.join(folder or TOKENIZER_FOLDER, f"{name}.tiktoken"))
