"""Product quantisation of vectors: centres, codebooks of the parts of residuals, and distances by table look-up."""

from __future__ import annotations

import numpy as np


def nearest_rows(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of ``c`` for each row, a few rows at a time."""
    half, step = (c * c).sum(1) / 2, max(1, (1 << 22) // len(c))
    return np.concatenate([(half - x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, int)])


def lloyd(x: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after a few rounds on a sample; empty ones stay."""
    for _ in range(rounds):
        at = nearest_rows(x, c)
        n, sums = np.bincount(at, minlength=len(c)), np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def parts_of(dims: int, most: int) -> list[slice]:
    """``dims`` cut into at most ``most`` runs of nearly equal length."""
    cuts = np.linspace(0, dims, min(most, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def codebooks(left: np.ndarray, parts: list[slice], words: int, rounds: int = 4) -> list[np.ndarray]:
    """Up to ``words`` codewords for each part of the residuals."""
    out = []
    for part in parts:
        distinct = np.unique(left[:, part], axis=0)
        start = distinct[np.random.RandomState(0).permutation(len(distinct))[:words]]
        out.append(lloyd(left[:, part], start, rounds) if len(start) else np.zeros((1, part.stop - part.start)))
    return out


def encoded(left: np.ndarray, parts: list[slice], books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, parts)`` codes of residuals, and the length of what they lose."""
    codes, lost = np.zeros((len(left), len(parts)), np.uint8), np.zeros(len(left))
    for m, (part, book) in enumerate(zip(parts, books, strict=True)):
        at = nearest_rows(left[:, part], book)
        codes[:, m] = at
        lost += ((left[:, part] - book[at]) ** 2).sum(1)
    return codes, np.sqrt(lost)


def looked_up(left: np.ndarray, codes: np.ndarray, parts: list[slice], books: list[np.ndarray]) -> np.ndarray:
    """Squared distances from residuals of queries to coded rows of the same list."""
    total = np.zeros((len(left), len(codes)))
    for m, (part, book) in enumerate(zip(parts, books, strict=True)):
        own = left[:, part]
        tables = (own * own).sum(1)[:, None] - 2 * own @ book.T + (book * book).sum(1)
        total += tables[:, codes[:, m]]
    return np.maximum(total, 0)
