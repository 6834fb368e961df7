"""Decision trees of a fitted MLlib model as plain values."""

from __future__ import annotations

from typing import NamedTuple, Union


class Fork(NamedTuple):
    """Values up to ``threshold`` go left."""

    feature: int
    threshold: float
    left: Union[Fork, float]
    right: Union[Fork, float]


def _plain(node) -> Fork | float:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return Fork(split.featureIndex(), float(split.threshold()), _plain(node.leftChild()), _plain(node.rightChild()))


def plain_trees(model) -> list[tuple[float, Fork | float]]:
    """(weight, tree) of each tree of a boosted or random forest model."""
    return [(float(w), _plain(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]


def value(tree: Fork | float, row) -> float:
    while isinstance(tree, Fork):
        tree = tree.left if row[tree.feature] <= tree.threshold else tree.right
    return tree


def paths(tree: Fork | float, so_far=()):
    """All conjunctions from the root to a fork or leaf, as tuples of
    (feature, is at most, threshold)."""
    if so_far:
        yield so_far
    if isinstance(tree, Fork):
        yield from paths(tree.left, (*so_far, (tree.feature, True, tree.threshold)))
        yield from paths(tree.right, (*so_far, (tree.feature, False, tree.threshold)))
