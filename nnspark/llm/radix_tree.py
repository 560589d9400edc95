"""An adaptive radix tree over byte keys: node layouts that grow with their children, and compressed paths.

This is the task-level helper of ``prefix_trie``; it holds the keys of one range.
"""

from __future__ import annotations

from bisect import bisect_left


class Sorted:
    """Up to ``room`` children: their bytes in order, and the children beside them."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def find(self, byte: int):
        i = bisect_left(self.bytes, byte)
        return self.nodes[i] if i < len(self.bytes) and self.bytes[i] == byte else None

    def put(self, byte: int, node):
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.nodes[i] = node
            return self
        if len(self.nodes) == self.room:
            grown = Sorted(16) if self.room == 4 else Indexed()
            for b, child in self.items():
                grown.put(b, child)
            return grown.put(byte, node)
        self.bytes.insert(i, byte)
        self.nodes.insert(i, node)
        return self

    def items(self):
        return zip(self.bytes, self.nodes)


class Indexed:
    """Up to 48 children behind a table of 256 places."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def find(self, byte: int):
        i = self.index[byte]
        return self.nodes[i - 1] if i else None

    def put(self, byte: int, node):
        i = self.index[byte]
        if i:
            self.nodes[i - 1] = node
            return self
        if len(self.nodes) == 48:
            grown = Full()
            for b, child in self.items():
                grown.put(b, child)
            return grown.put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def items(self):
        return ((b, self.nodes[i - 1]) for b, i in enumerate(self.index) if i)


class Full:
    """A place for each of the 256 bytes."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def find(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def items(self):
        return ((b, node) for b, node in enumerate(self.nodes) if node is not None)


class Node:
    """The bytes of a compressed path, the children after it, and the value of the key that ends here."""

    __slots__ = ("path", "children", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.children, self.value = path, None, value

    def attach(self, byte: int, child: Node) -> None:
        self.children = (self.children or Sorted(4)).put(byte, child)


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Put ``value`` (not None) under ``key``; an earlier value of the key is replaced."""
        node, at = self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                self._split(node, key, at)
                path = node.path
            at += len(path)
            if at == len(key):
                node.value = value
                return
            child = node.children.find(key[at]) if node.children is not None else None
            if child is None:
                node.attach(key[at], Node(key[at + 1:], value))
                return
            node, at = child, at + 1

    @staticmethod
    def _split(node: Node, key: bytes, at: int) -> None:
        """Cut the node's path where ``key`` leaves it; what was below hangs on the byte after the cut."""
        path, same = node.path, 0
        for a, b in zip(path, key[at:at + len(path)]):
            if a != b:
                break
            same += 1
        below = Node(path[same + 1:], node.value)
        below.children = node.children
        node.path, node.children, node.value = path[:same], None, None
        node.attach(path[same], below)

    def find(self, key: bytes):
        node, at = self.root, 0
        while key.startswith(node.path, at):
            at += len(node.path)
            if at == len(key):
                return node.value
            child = node.children.find(key[at]) if node.children is not None else None
            if child is None:
                return None
            node, at = child, at + 1
        return None

    def aligned(self, width: int):
        """(parent's number or -1, depth in units, value or None) of every place whose byte depth is a multiple of ``width``.

        Places are numbered as they come, parents before children; a place inside a compressed path counts too.
        """
        stack, number = [(self.root, 0, -1)], 0
        while stack:
            node, start, parent = stack.pop()
            end = start + len(node.path)
            # byte depths start..end belong to this node; its own start follows the branching byte above it
            for depth in range(-(-start // width), end // width + 1):
                last = depth * width == end
                yield parent, depth, node.value if last else None
                parent, number = number, number + 1
            if node.children is not None:
                below = [(child, end + 1, parent) for _, child in node.children.items()]
                stack.extend(reversed(below))
