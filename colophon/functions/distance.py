"""Distance between a title and a file name (H5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_distance(title: Column, name: Column, mode: str = "levenshtein") -> Column:
    """Edit distance. ``mode="compat"`` gives the reference's own numbers."""
    if mode == "levenshtein":
        return F.levenshtein(title, name)
    if mode == "compat":
        return _compat_distance(title, name)
    raise ValueError(f"unknown distance mode: {mode}")


def _compat_distance(title: Column, name: Column) -> Column:
    """The reference's recurrence on UTF-8 bytes.

    It leaves out the last byte of both strings, and from the second row on the
    row above and the current row are the same array, so the diagonal neighbour
    is the freshly written left neighbour.
    """
    m, n = F.octet_length(title), F.octet_length(name)
    title_hex, name_hex = F.hex(F.encode(title, "UTF-8")), F.hex(F.encode(name, "UTF-8"))

    def byte(hexed, i):
        return F.substr(hexed, i * 2 + 1, F.lit(2))

    def next_row(row, i):
        def append(cells, j):
            left = F.element_at(cells, -1)
            diagonal = F.when(i == 0, F.get(row, j - 1)).otherwise(left)
            differs = F.when(byte(title_hex, i) == byte(name_hex, j - 1), 0).otherwise(1)
            cell = F.least(F.get(row, j) + 1, left + 1, diagonal + differs)
            return F.concat(cells, F.array(cell))

        return F.aggregate(F.sequence(F.lit(1), n - 1), F.array(i + 1), append)

    rows = F.aggregate(
        F.sequence(F.lit(0), m - 2), F.sequence(F.lit(0), n - 1), next_row
    )
    return (
        F.when(m < 2, n - 1)
        .when(n == 1, m - 1)
        .otherwise(F.element_at(rows, -1))
    )
