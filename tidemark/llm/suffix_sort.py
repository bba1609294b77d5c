"""Deep-shallow sorting of suffixes.

Shallow: multikey quicksort whose characters are words of eight bytes, down to ``shallow`` bytes;
only groups of equal keys go on to the next word.  Deep: the suffixes of a group that is still
equal go into a blind trie, which keeps branching places alone; a new suffix is led to some leaf by
the bytes at those places, compared once with that leaf, and hung where they part.
"""

from __future__ import annotations

import numpy as np


class Node:
    """A branching place and the children by the byte there."""
    __slots__ = ("at", "kids")

    def __init__(self, at: int, kids: dict) -> None:
        self.at, self.kids = at, kids


class BlindTrie:
    """Strings of one length; a leaf is a string and the members equal to it."""

    def __init__(self) -> None:
        self.root = None

    def add(self, text: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (text, [member])
            return
        while type(node) is Node:
            kid = node.kids.get(text[node.at])
            node = next(iter(node.kids.values())) if kid is None else kid
        if node[0] == text:
            node[1].append(member)
            return
        differ = int.from_bytes(node[0]) ^ int.from_bytes(text)
        at = len(text) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while type(node) is Node and node.at < at:
            above, node = node, node.kids[text[node.at]]
        if type(node) is Node and node.at == at:
            node.kids[text[at]] = (text, [member])
            return
        other = node
        while type(other) is Node:
            other = next(iter(other.kids.values()))
        split = Node(at, {other[0][at]: node, text[at]: (text, [member])})
        if above is None:
            self.root = split
        else:
            above.kids[text[above.at]] = split

    def groups(self) -> list[list[int]]:
        """Members of equal strings, in the order of the strings."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node) is Node:
                stack += [node.kids[c] for c in sorted(node.kids, reverse=True)]
            else:
                out.append(node[1])
        return out


def sort_suffixes(blob: np.ndarray, starts: np.ndarray, length: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``length`` bytes (all inside ``blob``), and the number of each one's class.

    Classes of equal strings are numbered in order; members of a class keep their order.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shallow = min(shallow, length // 8 * 8)
    words = np.lib.stride_tricks.sliding_window_view(blob, 8) if len(blob) >= 8 else None
    order = np.arange(n)
    new = np.zeros(n, bool)
    new[0] = True
    live = np.arange(n)  # places of the order that lie in groups of several
    for depth in range(0, shallow, 8):
        key = words[starts[order[live]] + depth].view(">u8").ravel().astype(np.uint64)
        group = np.cumsum(new[live])
        by = np.lexsort((key, group))
        order[live] = order[live][by]
        key = key[by]
        new[live[1:]] |= key[1:] != key[:-1]
        ends = np.append(new[1:], True)
        live = np.flatnonzero(~(new & ends))
        if not len(live):
            break
    if len(live) and shallow < length:
        heads = np.flatnonzero(new[live])
        raw = blob.tobytes()
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(live)).tolist()):
            first = live[a]
            members = order[first:first + b - a].tolist()
            trie = BlindTrie()
            for m, p in zip(members, starts[members].tolist()):
                trie.add(raw[p + shallow:p + length], m)
            at = first
            for same in trie.groups():
                order[at:at + len(same)] = same
                new[at] = True
                at += len(same)
    return order, np.cumsum(new) - 1
