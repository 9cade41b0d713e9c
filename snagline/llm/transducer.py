"""A sorted vocabulary as a minimal acyclic transducer: words in, their places in the order out."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Bytes of a word: ASCII letters (A-Z as a-z) and every byte of a character beyond ASCII. Others are 0.
FOLD = np.zeros(256, dtype=np.uint8)
FOLD[ord("a") : ord("z") + 1] = FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)
#: The same for bytes.translate, with blanks between words.
FOLD_TABLE = bytes(int(b) or 32 for b in FOLD)


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """Accepts exactly the words it was built from and adds up, edge by edge, the number of words before each.

    States with equal futures are one state. It travels as flat arrays of edges; the
    first use lays them out in a hash table that is two thirds full at most.
    """

    def __init__(self, words: Iterable[bytes]):
        """`words` in ascending byte order, without repeats; states merge as soon as no later word can pass them."""
        states: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # per letter of the last word: final, edges
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                state = states.setdefault((final, *edges), len(states))
                path[-1][1].append((last[len(path) - 1], state))

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        close(0)
        self.root = states.setdefault((path[0][0], *path[0][1]), len(states))
        accepted = np.zeros(len(states), dtype=np.int32)  # words from each state on; states come after those they lead to
        edges = []
        for at, (final, *out) in enumerate(states):
            before = int(final)
            for byte, to in out:
                edges.append((at << 8 | byte, to, before))
                before += int(accepted[to])
            accepted[at] = before
        self.size = int(accepted[self.root])
        self.final = np.fromiter((s[0] for s in states), dtype=bool, count=len(states))
        self.edges = tuple(np.array(c, dtype=t) for c, t in zip(zip(*edges) if edges else ((), (), ()), (np.int64, np.int32, np.int32)))
        self._table = None

    def _laid_out(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Edge number per slot (-1: free), and the shift that takes a spread key to its first slot."""
        if self._table is None:
            keys = self.edges[0]
            bits = max(1, int(len(keys) * 3 // 2).bit_length())
            shift, slots = np.uint64(64 - bits), np.full(1 << bits, -1, dtype=np.int32)
            slot = ((keys.astype(np.uint64) * _SPREAD) >> shift).astype(np.int64)
            todo = np.arange(len(keys), dtype=np.int32)
            while len(todo):
                free = slots[slot] < 0
                slots[slot[free]] = todo[free]  # of those that want one slot the last gets it
                left = slots[slot] != todo
                todo, slot = todo[left], (slot[left] + 1) & ((1 << bits) - 1)
            self._table = slots, shift
        return self._table

    def _edge(self, key: np.ndarray) -> np.ndarray:
        """Number of each edge (state << 8 | byte), -1 for none."""
        slots, shift = self._laid_out()
        keys = self.edges[0]
        if not len(keys):
            return np.full(len(key), -1, dtype=np.int32)
        slot = ((key.astype(np.uint64) * _SPREAD) >> shift).astype(np.int64)
        out = slots[slot]
        todo = np.flatnonzero((out >= 0) & (keys[out] != key))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(slots) - 1)
            found = out[todo] = slots[slot[todo]]
            todo = todo[(found >= 0) & (keys[found] != key[todo])]
        return out

    def places(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Place in the order of every word data[start : start + length], -1 for those not accepted.

        All words take a step at a time; those in a dead end leave.
        """
        _, leads, before = self.edges
        out = np.full(len(start), -1, dtype=np.int64)
        alive = np.arange(len(start))
        state, place, step = np.full(len(start), self.root, dtype=np.int64), np.zeros(len(start), dtype=np.int64), 0
        at, left = start, length
        while len(alive):
            ended = left == step
            if ended.any():
                hit = ended & self.final[state]
                out[alive[hit]] = place[hit]
                on = ~ended
                alive, state, place, at, left = alive[on], state[on], place[on], at[on], left[on]
            edge = self._edge(state << 8 | data[at + step])
            on = edge >= 0
            edge = edge[on]
            alive, place, at, left = alive[on], place[on] + before[edge], at[on], left[on]
            state = leads[edge].astype(np.int64)
            step += 1
        return out

    def __getstate__(self):
        return self.__dict__ | {"_table": None}


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts, and start, length and text number of every word in them."""
    data = FOLD[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
    inside = np.concatenate([[False], data > 0])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turn[::2], turn[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return data, start, end - start, np.searchsorted(ends, start, side="right")
