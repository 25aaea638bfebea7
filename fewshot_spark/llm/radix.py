"""Adaptive radix tree over byte keys of whole fixed-width ids, with sums over its subtrees.

A node holds a compressed path and its children by next byte, in one of four layouts that it grows
through: 4 and 16 sorted bytes beside the children, 48 children behind a table of 256 slots, or
256 children. Ids are ``WIDTH`` bytes; only depths that are whole ids (turns) are nodes of the
conversation trie, all other branches are inside an id. Keys come sorted, a bounded number at a
time. What the first or the last key of such a batch passes through may go on in a neighbouring
batch: these nodes are open, all others are closed and final.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Sorted:
    """Up to ``room`` children beside their sorted bytes (room 4, then 16)."""

    __slots__ = ("room", "keys", "kids")

    def __init__(self, room: int, keys: bytearray, kids: list):
        self.room, self.keys, self.kids = room, keys, kids

    def find(self, byte: int):
        at = bisect_left(self.keys, byte)
        return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, kid):
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = kid
        elif len(self.keys) < self.room:
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)
        else:
            return (Sorted(16, self.keys, self.kids) if self.room == 4 else Indexed(self)).put(byte, kid)
        return self

    def ordered(self) -> list:
        return self.kids


class Indexed:
    """Up to 48 children behind a table from byte to slot."""

    __slots__ = ("slots", "kids")

    def __init__(self, small: Sorted):
        self.slots, self.kids = bytearray(256), list(small.kids)
        for slot, byte in enumerate(small.keys):
            self.slots[byte] = slot + 1

    def find(self, byte: int):
        slot = self.slots[byte]
        return self.kids[slot - 1] if slot else None

    def put(self, byte: int, kid):
        slot = self.slots[byte]
        if slot:
            self.kids[slot - 1] = kid
        elif len(self.kids) < 48:
            self.kids.append(kid)
            self.slots[byte] = len(self.kids)
        else:
            return Direct(self).put(byte, kid)
        return self

    def ordered(self) -> list:
        return [self.kids[slot - 1] for slot in self.slots if slot]


class Direct:
    """One place for each byte."""

    __slots__ = ("kids",)

    def __init__(self, small: Indexed):
        self.kids = [small.find(byte) for byte in range(256)]

    def find(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def ordered(self) -> list:
        return [kid for kid in self.kids if kid is not None]


class Node:
    """``path`` leads here from the parent (its first byte is the branch). ``end``: what ends
    here, ``(members, lowest, sha256)``. ``key`` and ``lens`` are those of one key below."""

    __slots__ = ("path", "kids", "end", "key", "lens", "n", "low", "tops", "leaves", "saved", "open", "sends", "under", "base", "up")

    def __init__(self, path: bytes, end, key: bytes, lens):
        self.path, self.kids, self.end, self.key, self.lens = path, None, end, key, lens

    def adopt(self, kid: Node) -> None:
        self.kids = (self.kids or Sorted(4, bytearray(), [])).put(kid.path[0], kid)

    def children(self) -> list:
        return self.kids.ordered() if self.kids else []


class Tree:
    def __init__(self):
        self.root = Node(b"", None, b"", ())
        self.first = self.last = None
        self.size = self.held = 0

    def insert(self, key: bytes, lens, end) -> None:
        """Add a key (each once) with what ends at it."""
        if self.first is None:
            self.first = key
        self.last = key
        self.size, self.held = self.size + 1, self.held + len(key)
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.find(key[at]) if node.kids else None
            if kid is None:
                node.adopt(Node(key[at:], end, key, lens))
                return
            if not key.startswith(kid.path, at):
                same = shared_length(kid.path, key[at : at + len(kid.path)])
                upper = Node(kid.path[:same], None, kid.key, kid.lens)
                kid.path = kid.path[same:]
                upper.adopt(kid)
                node.adopt(upper)
                kid = upper
            node, at = kid, at + len(kid.path)
        node.end = end

    def order(self) -> list[tuple[Node, int, bool, bool]]:
        """Nodes before their children: ``(node, byte depth above its path, on the first key's
        path, on the last key's path)``."""
        out, todo = [], [(self.root, 0, True, True)]
        while todo:
            here = todo.pop()
            out.append(here)
            node, above, first, last = here
            kids = node.children()
            below = above + len(node.path)
            for k in range(len(kids) - 1, -1, -1):
                todo.append((kids[k], below, first and k == 0 and node.end is None, last and k == len(kids) - 1))
        return out

    def depths(self, node: Node, above: int) -> range:
        """Turn depths on a node's own path; the root has depth 0."""
        return range(0, 1) if node is self.root else range(above // WIDTH + 1, (above + len(node.path)) // WIDTH + 1)

    def rows(self) -> tuple[list, list, list]:
        """``(closed, first, last)``.

        ``closed``: final nodes ``(lowest, depth, parent's lowest, parent's digest where the parent
        is open, members, children, leaves, saved, ends, id)``. ``first``: the open nodes of the
        first key's path from the root, ``last``: those of the last key's path that are not on the
        first's, ``(depth, digest, length, members, lowest, children, leaves, saved, ends, id)``,
        each with the sums of what ends at it and of what is closed below it."""
        order = self.order()
        for node, above, first, last in reversed(order):
            node.n, node.low = node.end[:2] if node.end else (0, None)
            node.tops = node.leaves = node.saved = 0
            for kid in node.children():
                if kid.sends:
                    node.n, node.tops = node.n + kid.n, node.tops + kid.tops
                    node.leaves, node.saved = node.leaves + kid.leaves, node.saved + kid.saved
                    if node.low is None or (kid.low is not None and kid.low < node.low):
                        node.low = kid.low
            own = self.depths(node, above)
            node.open, node.sends, node.under, node.base = first or last, not ((first or last) and own), node.tops, node.saved
            if own and not node.open:
                node.tops, node.leaves = 1, node.leaves or 1
                node.saved += (node.n - 1) * sum(node.lens[d - 1] for d in own)
        return self._emit(order)

    def _emit(self, order) -> tuple[list, list, list]:
        closed, paths = [], ([], [])
        self.root.up = (None, None, hashlib.md5())
        for node, above, first, _ in order:
            low, digest, running = node.up
            own = self.depths(node, above)
            if node.open:
                for d in own:
                    if d:
                        running = running.copy()
                        running.update(node.key[(d - 1) * WIDTH : d * WIDTH])
                    sums = (node.n, node.low, node.tops, node.leaves, node.saved) if d == own[-1] else (0, None, 0, 0, 0)
                    ends = node.end[2] if node.end and d == own[-1] else None
                    digest = running.digest()
                    paths[not first].append((d, digest, node.lens[d - 1] if d else 0, *sums, ends, node.key[max(0, d - 1) * WIDTH : d * WIDTH]))
            else:
                saved, children, ends, found = node.base, node.under, node.end[2] if node.end else NO_ENDS, []
                for d in reversed(own):
                    saved += (node.n - 1) * node.lens[d - 1]
                    up = (low, digest) if d == own[0] else (node.low, None)
                    found.append((node.low, d, *up, node.n, children, node.leaves, saved, ends, node.key[(d - 1) * WIDTH : d * WIDTH]))
                    children, ends = 1, NO_ENDS
                closed += reversed(found)
                if own:
                    low, digest = node.low, None
            for kid in node.children():
                kid.up = (low, digest, running)
        return closed, *paths


class Merger:
    """Adds up the open nodes of batches in key order; a node is final once a path leaves it."""

    def __init__(self):
        self.path: list[dict] = []

    def take(self, first: list, last: list) -> list[tuple]:
        """The next batch's open nodes; what they close: ``(digest, parent's digest, lowest, depth,
        members, children, leaves, saved, ends, id)``."""
        same = 0
        while same < min(len(self.path), len(first)) and self.path[same]["digest"] == first[same][1]:
            same += 1
        done = self.leave(same)
        self._add(first)
        if last:
            done += self.leave(last[0][0])
            self._add(last)
        return done

    def _add(self, nodes: list) -> None:
        for depth, digest, length, n, low, children, leaves, saved, ends, own in nodes:
            if depth == len(self.path):
                self.path.append({"digest": digest, "length": length, "n": 0, "low": None, "children": 0, "leaves": 0, "saved": 0, "ends": NO_ENDS, "id": own})
            here = self.path[depth]
            self._count(here, n, low, children, leaves, saved)
            here["ends"] = ends or here["ends"]

    @staticmethod
    def _count(here: dict, n: int, low, children: int, leaves: int, saved: int) -> None:
        for key, x in (("n", n), ("children", children), ("leaves", leaves), ("saved", saved)):
            here[key] += x
        if low is not None and (here["low"] is None or low < here["low"]):
            here["low"] = low

    def leave(self, depth: int) -> list[tuple]:
        """Close the path's nodes from ``depth`` on."""
        done = []
        while len(self.path) > depth:
            here = self.path.pop()
            up = self.path[-1] if self.path else None
            here["leaves"] = here["leaves"] or 1
            here["saved"] += (here["n"] - 1) * here["length"]
            if up:
                self._count(up, here["n"], here["low"], 1, here["leaves"], here["saved"])
            done.append(
                (here["digest"], up and up["digest"], here["low"], len(self.path), here["n"], here["children"], here["leaves"], here["saved"], here["ends"], here["id"])
            )
        return done
