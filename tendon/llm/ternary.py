"""A ternary search tree over sequences of turn ids, and the sums of the prefix trie that it holds."""

from __future__ import annotations


class TernaryTree:
    """One node per distinct prefix. The children of a prefix are a binary tree of their symbols (`low`, `high`); `down` leads to the first child tree.

    Columns instead of objects; node 0 is the root, the empty prefix. Nothing recurses, so a sequence may be as long as memory allows.
    """

    def __init__(self):
        self.symbol, self.low, self.high, self.down = [None], [0], [0], [0]
        self.words, self.ending, self.least, self.digest = [0], [0], [None], [None]

    @classmethod
    def of(cls, sequences: list) -> TernaryTree:
        """A tree of sorted, distinct (ids, words, n, least, digest). Medians go in first, so the trees of children are balanced."""
        tree, todo = cls(), [(0, len(sequences))]
        while todo:
            lo, hi = todo.pop()
            if lo < hi:
                mid = (lo + hi) // 2
                tree.insert(*sequences[mid])
                todo += [(mid + 1, hi), (lo, mid)]
        return tree

    def _new(self, symbol: int, words: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, 0), (self.high, 0), (self.down, 0), (self.words, words), (self.ending, 0), (self.least, None), (self.digest, None)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, ids: list[int], words: list[int], n: int, least: int, digest: str) -> None:
        node = 0
        for s, w in zip(ids, words, strict=True):
            at = self.down[node]
            if not at:
                at = self.down[node] = self._new(s, w)
            while self.symbol[at] != s:
                side = self.low if s < self.symbol[at] else self.high
                if not side[at]:
                    side[at] = self._new(s, w)
                at = side[at]
            node = at
        self.ending[node], self.least[node], self.digest[node] = n, least, digest

    def preorder(self) -> list[tuple[int, int, int]]:
        """(node, parent's place in this list, depth), parents first."""
        out, todo = [(0, -1, 0)], [(self.down[0], 0, 1)]
        while todo:
            at, parent, depth = todo.pop()
            if not at:
                continue
            todo += [(self.high[at], parent, depth), (self.low[at], parent, depth)]
            out.append((at, parent, depth))
            todo.append((self.down[at], len(out) - 1, depth + 1))
        return out

    def path(self, ids: list[int]) -> list[int]:
        """Nodes of all prefixes of `ids`, the root first."""
        nodes = [0]
        for s in ids:
            at = self.down[nodes[-1]]
            while self.symbol[at] != s:
                at = self.low[at] if s < self.symbol[at] else self.high[at]
            nodes.append(at)
        return nodes

    def sums(self, shared: dict[int, str]) -> list[dict]:
        """One dict per prefix: key, up, depth, n, least, children, leaves, saved, words, digest, parent's least.

        `shared` names the prefixes that other shards hold too. Their children that are shared are left out of children, leaves and saved, as
        another shard counts them again; a shared one is not a leaf before all shards are merged. `key` is the name of a shared prefix, `up` that of a shared parent.
        """
        order = self.preorder()
        size = len(order)
        n, least = [self.ending[x] for x, *_ in order], [self.least[x] for x, *_ in order]
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for i in range(size - 1, 0, -1):
            x, p, _ = order[i]
            n[p] += n[i]
            if least[p] is None or least[i] < least[p]:
                least[p] = least[i]
            if x in shared:
                continue
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * self.words[x]
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
        return [{"key": shared.get(x), "up": shared.get(order[p][0]) if i else None, "depth": depth, "n": n[i], "least": least[i], "children": children[i], "leaves": leaves[i],
                 "saved": saved[i], "words": self.words[x], "digest": self.digest[x], "above": least[p] if i else None} for i, (x, p, depth) in enumerate(order)]
