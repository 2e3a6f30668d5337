"""Adaptive radix tree over byte strings, for keys made of units of one width.

A node holds the bytes that all keys below share (path compression) and one child for each next
byte, in one of four layouts that grow with the number of children: 4 and 16 sorted bytes next to
their children, 48 children behind an index of 256 bytes, and 256 places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any


class Node:
    """``path``: shared bytes; ``value``: what ends here, None if no key does; ``layout``: 4, 16, 48 or 256."""

    __slots__ = ("path", "value", "layout", "signs", "children")

    def __init__(self, path: bytes, value: Any = None):
        self.path, self.value = path, value
        self.layout, self.signs, self.children = 4, bytearray(), []

    def child(self, sign: int) -> Node | None:
        if self.layout <= 16:
            at = bisect_left(self.signs, sign)
            return self.children[at] if at < len(self.signs) and self.signs[at] == sign else None
        if self.layout == 48:
            at = self.signs[sign]
            return self.children[at - 1] if at else None
        return self.children[sign]

    def put(self, sign: int, node: Node) -> None:
        """Set the child of a byte; the layout grows when it is full."""
        if self.layout <= 16:
            at = bisect_left(self.signs, sign)
            if at < len(self.signs) and self.signs[at] == sign:
                self.children[at] = node
                return
            if len(self.signs) == self.layout:
                self._grow()
                self.put(sign, node)
                return
            self.signs.insert(at, sign)
            self.children.insert(at, node)
        elif self.layout == 48:
            if at := self.signs[sign]:
                self.children[at - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.signs[sign] = len(self.children)
            else:
                self._grow()
                self.put(sign, node)
        else:
            self.children[sign] = node

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for at, sign in enumerate(self.signs):
                index[sign] = at + 1
            self.layout, self.signs = 48, index
        else:
            self.layout, self.children = 256, [self.children[at - 1] if at else None for at in self.signs]
            self.signs = bytearray()

    def items(self) -> Iterator[Node]:
        """The children in the order of their bytes."""
        if self.layout == 48:
            return (self.children[at - 1] for at in self.signs if at)
        return (c for c in self.children if c is not None)


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Number of leading bytes that ``a`` and ``b[at:]`` have in common."""
    n = min(len(a), len(b) - at)
    own, other = a[:n], b[at : at + n]
    if own == other:
        return n
    differ = int.from_bytes(own, "big") ^ int.from_bytes(other, "big")
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    """``insert`` gives the value of a key, made by ``new`` when the key is first seen."""

    def __init__(self, new):
        self.root, self.new, self.size = Node(b""), new, 0

    def insert(self, key: bytes) -> Any:
        above, node, at = None, self.root, 0
        while True:
            path = node.path
            if path and not key.startswith(path, at):
                node, at = self._split(above, node, key, at), at
                path = node.path
            at += len(path)
            if at == len(key):
                if node.value is None:
                    node.value = self.new()
                    self.size += 1
                return node.value
            following = node.child(key[at])
            if following is None:
                leaf = Node(key[at:], self.new())
                node.put(key[at], leaf)
                self.size += 1
                return leaf.value
            above, node = node, following

    def _split(self, above: Node, node: Node, key: bytes, at: int) -> Node:
        """A new node in place of ``node`` with the bytes that its path and the key share."""
        n = _shared(node.path, key, at)
        upper = Node(node.path[:n])
        above.put(node.path[0], upper)
        node.path = node.path[n:]
        upper.put(node.path[0], node)
        return upper
