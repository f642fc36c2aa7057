"""Deep-shallow sorting of byte strings, with the length of the common prefix of neighbours.

Multikey quicksort orders strings by their first bytes. Groups that are still equal at the shallow depth go to a blind
trie: it is searched by branching bytes alone, and one comparison with a stored string places the new one.
"""

from __future__ import annotations


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    different = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (different.bit_length() + 7) // 8


class _Node:
    """An inner node branches at ``depth``; a leaf holds equal strings."""

    __slots__ = ("children", "depth", "ids")

    def __init__(self, depth: int, ids: list[int] | None = None):
        self.depth, self.ids, self.children = depth, ids, {}


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def _leaf_below(node: _Node) -> _Node:
    while node.ids is None:
        node = next(iter(node.children.values()))
    return node


def blind_trie(strings: list[bytes], ids: list[int]) -> tuple[list[int], list[int]]:
    """The sorted order of some strings and each one's common prefix with the one before it (0 for the first)."""
    root = _Node(len(strings[ids[0]]), [ids[0]])
    for i in ids[1:]:
        s, node = strings[i], root
        while node.ids is None:
            child = node.children.get(_byte(s, node.depth))
            node = child if child is not None else _leaf_below(node)
        other = strings[node.ids[0]]
        if other == s:
            node.ids.append(i)
            continue
        shared = common_prefix(s, other)
        parent, node = None, root
        while node.ids is None and node.depth < shared:
            parent, node = node, node.children[_byte(s, node.depth)]
        if node.ids is None and node.depth == shared:
            node.children[_byte(s, shared)] = _Node(len(s), [i])
            continue
        split = _Node(shared)
        split.children = {_byte(other, shared): node, _byte(s, shared): _Node(len(s), [i])}
        if parent is None:
            root = split
        else:
            parent.children[_byte(s, parent.depth)] = split
    order, prefix, todo = [], [], [(root, 0)]
    while todo:
        node, before = todo.pop()
        if node.ids is not None:
            order += node.ids
            prefix += [before] + [len(strings[node.ids[0]])] * (len(node.ids) - 1)
        else:
            keys = sorted(node.children)
            todo += [(node.children[k], before if k == keys[0] else node.depth) for k in reversed(keys)]
    return order, prefix


def deep_shallow_sort(strings: list[bytes], shallow: int = 16) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and the common prefix of each with the one before it (0 for the first)."""
    order, prefix = [], []
    todo = [(list(range(len(strings))), 0, 0)]  # ids, depth they share, common prefix with what stands before
    while todo:
        ids, depth, before = todo.pop()
        if len(ids) == 1:
            order.append(ids[0])
            prefix.append(before)
        elif depth >= shallow:
            sorted_ids, inner = blind_trie(strings, ids)
            order += sorted_ids
            prefix += [before, *inner[1:]]
        elif ids:
            pivot = _byte(strings[ids[len(ids) // 2]], depth)
            less, equal, more = [], [], []
            for i in ids:
                b = _byte(strings[i], depth)
                (less if b < pivot else more if b > pivot else equal).append(i)
            parts = [(less, depth)] if less else []
            parts.append((equal, depth + 1 if pivot >= 0 else shallow))
            parts += [(more, depth)] if more else []
            todo += [(p, d, before if k == 0 else depth) for k, (p, d) in reversed(list(enumerate(parts)))]
    return order, prefix
