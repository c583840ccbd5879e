"""Leaked passages of which up to a quarter is altered; every alignment of an item is checked."""

import pytest

from dyadlens.llm import leakage
from test_kernels import ITEM, OTHERS

W = ITEM.split()
A = "the elderly harbour clerk balanced a gilded weathervane on one knee and kept the borrowed handset glowing with"


def altered(words, *at):
    return " ".join("xqz" if i in at else w for i, w in enumerate(words))


def found(doc):
    return [r[1] for r in leakage._kernel({"doc_id": [1], "text": [doc]}, ((1, ITEM), (2, OTHERS[0]), (3, OTHERS[1])), 12)]


@pytest.mark.parametrize(
    ("doc", "hit"),
    [
        (altered(A.split()[:12], 4, 8), True), (altered(A.split()[:12], 3, 7, 8), True),
        (altered(W[8:28], 3, 7, 11, 14, 17), True), (altered(W[8:28], 3, 5, 7, 9, 11, 14, 17), False),
        (altered(A.split()[:11], 4, 8), False),
        (altered(W[8:33], 3, 4, 8, 9, 13, 14, 18, 19) + ". " + " ".join("zq" + str(i) for i in range(40)) + ". " + " ".join(A.split()[:12]), True),
    ],
)
def test_altered_passages(doc, hit):
    assert found(doc) == ([1] if hit else [])
