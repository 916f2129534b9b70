"""Names of features, matchers and datasets, and what they stand for."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self, kind: str):
        self.kind = kind
        self.known: dict[str, object] = {}

    def add(self, name: str, what: object) -> object:
        if name in self.known and self.known[name] is not what:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self.known[name] = what
        return what

    def register(self, name: str) -> Callable:
        return lambda what: self.add(name, what)

    def get(self, name: str) -> object:
        if name not in self.known:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]

    def names(self) -> list[str]:
        return sorted(self.known)


FEATURES, MATCHERS, DATASETS = Registry("feature"), Registry("matcher"), Registry("dataset")

#: Similarity of each matcher. The classifiers' scores are cosine as well: parity of scores is what counts.
for _name, _kind in {"nn_cosine": "cosine", "nn_l2": "l2", "nn_chi2": "chi2", "svm_linear": "cosine", "svm_rbf": "cosine", "knn3": "cosine"}.items():
    MATCHERS.add(_name, _kind)
