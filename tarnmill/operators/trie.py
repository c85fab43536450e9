"""A compact trie over byte strings, walked for many words at once.

The trie is a double array: the child of node ``s`` by byte ``b`` is slot ``base[s] + b`` if
``owner`` of that slot is ``s``. It is built level by level, so a walk takes one step per
byte for all starts of all words of a batch together; starts without a child drop out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

class Trie:
    """Byte strings with values 0, 1, 2, ... in the order given."""

    def __init__(self, base: np.ndarray, owner: np.ndarray, value: np.ndarray):
        self.base, self.owner, self.value = base, owner, value

    @classmethod
    def of(cls, pieces: Sequence[bytes]) -> Trie:
        """The trie of distinct, non-empty byte strings."""
        order = sorted(range(len(pieces)), key=pieces.__getitem__)
        texts = [pieces[k] for k in order]
        number = np.array(order, np.int32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        heads = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        # (slot, owner) of all nodes, (node, base) of those with children, (node, value) of those that end a text
        slots, bases, values = [], [], []
        # slots from here on are free, and so are the holes before it
        free, holes = 257, np.zeros(0, np.int64)
        open_, node, depth = np.arange(len(texts)), np.zeros(len(texts), np.int64), 0
        while len(open_):
            byte = data[heads[open_] + depth].astype(np.int64)
            # texts are sorted, so those below one child are neighbours
            first = np.append(True, (node[1:] != node[:-1]) | (byte[1:] != byte[:-1]))
            parent, label = node[first], byte[first]
            begins = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            ends = np.append(begins[1:], len(parent))
            # children of one node lie as far apart as their bytes; nodes with one child fill the holes between
            several = ends - begins > 1
            low = label[begins]
            width = np.where(several, label[ends - 1] - low + 1, 0)
            place = free + np.cumsum(width) - width
            filled = np.zeros(int(width.sum()), bool)
            slot = np.repeat(place - low, ends - begins) + label
            filled[slot[np.repeat(several, ends - begins)] - free] = True
            holes = np.append(holes, free + np.flatnonzero(~filled))
            free += len(filled)
            lone = int(np.count_nonzero(~several))
            spare = np.append(holes[:lone], np.arange(free, free + max(0, lone - len(holes))))
            free, holes = free + max(0, lone - len(holes)), holes[lone:]
            slot[begins[~several]] = spare
            slots.append((slot, parent))
            bases.append((parent[begins], slot[begins] - low))
            node = slot[np.cumsum(first) - 1]
            depth += 1
            done = sizes[open_] == depth
            values.append((node[done], number[open_[done]]))
            open_, node = open_[~done], node[~done]
        # a step may look 255 slots beyond the last child
        base, owner, value = np.zeros(free + 256, np.int32), np.full(free + 256, -1, np.int32), np.full(free + 256, -1, np.int32)
        for table, rows in ((owner, slots), (base, bases), (value, values)):
            for at, what in rows:
                table[at] = what
        return cls(base, owner, value)

    def matches(self, data: np.ndarray, limits: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, value) of every piece inside ``data``.

        A match begins at any byte and ends at ``limits`` of that byte at most; it comes in
        rising order of its length, then of its start, or with its start in the ``order`` given.
        """
        at = np.arange(len(data)) if order is None else order
        node = np.zeros(len(at), np.int32)
        starts, ends, values = [], [], []
        depth = 0
        while len(at):
            here = at + depth
            inside = here < limits[at]
            at, node, here = at[inside], node[inside], here[inside]
            slot = self.base[node] + data[here]
            child = self.owner[slot] == node
            at, node = at[child], slot[child]
            depth += 1
            found = self.value[node]
            hit = found >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            values.append(found[hit])
        if not starts:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(values)
