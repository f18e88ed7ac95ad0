"""The path-template tree of one host, in memory: wildcards from the root down, then branches from the leaves up."""

from __future__ import annotations

import math

import pandas as pd


class Node:
    """Counts (rows, labelled, bad) of all paths through a node and of those that end there, whose numbers are in `paths`."""

    __slots__ = ("n", "labelled", "bad", "own", "paths", "children")

    def __init__(self) -> None:
        self.n = self.labelled = self.bad = 0
        self.own = (0, 0)
        self.paths: list[int] = []
        self.children: dict[str, Node] = {}


def differs(bad: int, labelled: int, all_bad: int, all_labelled: int, z: float) -> bool:
    """Whether the labelled purity of a part differs from that of the rest of the whole, by z standard errors."""
    rest = all_labelled - labelled
    if not labelled or not rest:
        return False
    pooled = all_bad / all_labelled
    error = math.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / rest))
    return abs(bad / labelled - (all_bad - bad) / rest) > z * error


def _merged(into: Node, other: Node) -> None:
    """Adds another tree to a tree; the other one isn't used any more."""
    todo = [(into, other)]
    while todo:
        a, b = todo.pop()
        a.n, a.labelled, a.bad = a.n + b.n, a.labelled + b.labelled, a.bad + b.bad
        a.own = a.own[0] + b.own[0], a.own[1] + b.own[1]
        a.paths += b.paths
        for name, child in b.children.items():
            if name in a.children:
                todo.append((a.children[name], child))
            else:
                a.children[name] = child


def _peculiar(light: dict[str, Node], z: float) -> set[str]:
    """Those of light siblings that, or below which some path, differs from the same path below all of them.

    A path that no other labelled sibling has isn't followed further: nothing below it can differ.
    """
    found = set()
    todo = [[(c, node) for c, node in light.items() if node.labelled]]
    while todo:
        same = todo.pop()
        if len(same) < 2:
            continue
        labelled, bad = sum(node.labelled for _, node in same), sum(node.bad for _, node in same)
        found.update(c for c, node in same if differs(node.bad, node.labelled, bad, labelled, z))
        deeper: dict[str, list[tuple[str, Node]]] = {}
        for c, node in same:
            for name, child in node.children.items():
                if child.labelled:
                    deeper.setdefault(name, []).append((c, child))
        todo += deeper.values()
    return found


def _generalise(root: Node, most_children: int, heavy: float, z: float) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.children) > most_children:
            total = sum(c.n for c in node.children.values())
            light = {name: c for name, c in node.children.items() if c.n < heavy * total}
            wild = light.keys() - _peculiar(light, z)
            if wild:
                star = Node()
                for name in wild:
                    _merged(star, node.children.pop(name))
                if "*" in node.children:
                    _merged(node.children["*"], star)
                else:
                    node.children["*"] = star
        todo += node.children.values()


class Placed:
    """The nodes of a tree, parents first, and their names on demand: a path is put together only where it is asked for."""

    def __init__(self, root: Node):
        self.nodes, self.parents, self.names = [root], [-1], [""]
        for i, node in enumerate(self.nodes):  # grows meanwhile
            for name, child in node.children.items():
                self.nodes.append(child)
                self.parents.append(i)
                self.names.append(name)

    def path(self, i: int) -> str:
        found = []
        while i > 0:
            found.append(self.names[i])
            i = self.parents[i]
        return "".join(f"/{name}" for name in reversed(found))


def _branches(tree: Placed, z: float) -> dict[int, tuple[int, bool]]:
    """The branch of each node that paths end at, by its number: a node, and whether what is merged below it is meant.

    What of a node's children isn't apart is merged, as (..., node, *), and goes on to the node's own siblings.
    """
    branch: dict[int, tuple[int, bool]] = {}
    parts: dict[int, dict[tuple[int, bool], tuple[int, int, list[int]]]] = {}  # of a node's children: labelled, bad, ends
    for i in range(len(tree.nodes) - 1, -1, -1):
        node, own = tree.nodes[i], parts.pop(i, {})
        labelled, bad = sum(p[0] for p in own.values()), sum(p[1] for p in own.values())
        left: list[int] = []
        n_left = bad_left = 0
        for of, (n, x, ends) in own.items():
            if differs(x, n, bad, labelled, z):
                branch.update(dict.fromkeys(ends, of))
            else:
                left += ends
                n_left += n
                bad_left += x
        if i == 0:
            branch.update(dict.fromkeys(left, (0, True)))
            break
        siblings = parts.setdefault(tree.parents[i], {})
        if node.paths:
            siblings[i, False] = (*node.own, [i])
        if left:
            siblings[i, True] = n_left, bad_left, left
    return branch


def grown_tree(rows: pd.DataFrame, most_children: int = 32, heavy: float = 0.05, z: float = 2.0) -> pd.DataFrame:
    """host, segs, template, branch, labelled, bad of a host's paths: host, segs, n, labelled, bad."""
    root = Node()
    for i, (segs, n, labelled, bad) in enumerate(zip(rows["segs"], rows["n"], rows["labelled"], rows["bad"])):
        node = root
        for name in segs:
            node = node.children.setdefault(name, Node())
            node.n, node.labelled, node.bad = node.n + n, node.labelled + labelled, node.bad + bad
        node.paths.append(i)
        node.own = node.own[0] + labelled, node.own[1] + bad
    _generalise(root, most_children, heavy, z)
    tree = Placed(root)
    template_of, branch_of = [""] * len(rows), [""] * len(rows)
    for at, (of, below) in _branches(tree, z).items():
        template, branch = tree.path(at), tree.path(of) + ("/*" if below else "")
        for i in tree.nodes[at].paths:
            template_of[i], branch_of[i] = template, branch
    return pd.DataFrame({"host": rows["host"], "segs": rows["segs"], "template": template_of, "branch": branch_of, "labelled": rows["labelled"], "bad": rows["bad"]})
