"""An adaptive radix tree over byte strings: four node layouts, path compression, sums below each node.

A node holds the bytes that all keys below it share from its place on, so a run without branches is one
node. Children are found by their next byte, in a layout that grows with their number: up to 4 or 16 sorted
bytes with a child each, an index of 256 bytes into up to 48 children, or 256 places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

_LISTED, _INDEXED, _NONE = 16, 48, 255


class Node:
    __slots__ = ("prefix", "keys", "index", "children", "row", "a", "b", "least")

    def __init__(self, prefix: bytes, row: int):
        self.prefix, self.row = prefix, row  # row: number of some key below
        #: 4 and 16: `keys` are the sorted bytes; 48: `index` gives the place; 256: place and byte are one.
        self.keys: bytearray | None = bytearray()
        self.index: bytearray | None = None
        self.children: list[Node | None] = []
        #: Sums and least value of the keys that end here; after `total` of those below, too.
        self.a, self.b, self.least = 0, 0, None

    def layout(self) -> int:
        if self.keys is not None:
            return 4 if len(self.keys) <= 4 else 16
        return 48 if self.index is not None else 256

    def child(self, byte: int) -> Node | None:
        keys = self.keys
        if keys is not None:
            at = bisect_left(keys, byte)
            return self.children[at] if at < len(keys) and keys[at] == byte else None
        if self.index is not None:
            at = self.index[byte]
            return None if at == _NONE else self.children[at]
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add or replace a child; a full layout becomes the next one."""
        keys = self.keys
        if keys is not None:
            at = bisect_left(keys, byte)
            if at < len(keys) and keys[at] == byte:
                self.children[at] = node
                return
            if len(keys) < _LISTED:
                keys.insert(at, byte)
                self.children.insert(at, node)
                return
            self.index = bytearray([_NONE]) * 256
            for place, key in enumerate(keys):
                self.index[key] = place
            self.keys = None
        if self.index is not None:
            at = self.index[byte]
            if at != _NONE:
                self.children[at] = node
                return
            if len(self.children) < _INDEXED:
                self.index[byte] = len(self.children)
                self.children.append(node)
                return
            wide: list[Node | None] = [None] * 256
            for key, place in enumerate(self.index):
                if place != _NONE:
                    wide[key] = self.children[place]
            self.children, self.index = wide, None
        self.children[byte] = node

    def branches(self) -> Iterator[tuple[int, Node]]:
        """(byte, child) in ascending order of the byte."""
        if self.keys is not None:
            yield from zip(self.keys, self.children, strict=True)
        elif self.index is not None:
            for byte, at in enumerate(self.index):
                if at != _NONE:
                    yield byte, self.children[at]
        else:
            for byte, node in enumerate(self.children):
                if node is not None:
                    yield byte, node


def shared(a: bytes, b: bytes) -> int:
    """Number of leading bytes that two strings have in common."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    def __init__(self):
        self.root: Node | None = None

    def add(self, key: bytes, row: int, a: int, b: int, least: int) -> None:
        """Insert a key, or add to the sums of an equal one."""
        node, at, above, byte = self.root, 0, None, 0
        while node is not None:
            size = len(node.prefix)
            if key[at : at + size] != node.prefix:
                same = shared(node.prefix, key[at : at + size])
                upper = Node(node.prefix[:same], node.row)
                upper.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                self._hang(above, byte, upper)
                node, size = upper, same
            at += size
            if at == len(key):
                break
            above, byte = node, key[at]
            node, at = node.child(byte), at + 1
        if node is None:
            node = Node(key[at:], row)
            self._hang(above, byte, node)
        node.a += a
        node.b += b
        node.least = least if node.least is None else min(node.least, least)

    def _hang(self, above: Node | None, byte: int, node: Node) -> None:
        if above is None:
            self.root = node
        else:
            above.put(byte, node)

    def total(self) -> list[tuple[Node, int, int]]:
        """Nodes in key order as (node, place of its parent in the list or -1, byte that leads to it or -1).

        Sums and least values become those of all keys below each node.
        """
        order: list[tuple[Node, int, int]] = []
        stack = [(self.root, -1, -1)] if self.root else []
        while stack:
            node, parent, byte = stack.pop()
            place = len(order)
            order.append((node, parent, byte))
            stack.extend((child, place, b) for b, child in reversed(list(node.branches())))
        for node, parent, _ in reversed(order):
            if parent >= 0:
                above = order[parent][0]
                above.a += node.a
                above.b += node.b
                above.least = node.least if above.least is None else min(above.least, node.least)
        return order
