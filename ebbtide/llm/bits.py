"""A bit table of hashes, by which tasks leave out what an exact join would drop anyway.

Its size is bounded whatever it is made of. When it fills up it lets more through; results
never depend on it.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame, functions as F

#: 64 bits for each hash, and at most 2 ** MOST_BITS: 8 MB.
LEAST_BITS, MOST_BITS = 16, 26


def bit_table(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of leading bits of a hash that address the table, and the table.

    ``hashes`` has a column ``hash``; its values are spread evenly over 64 bits.
    """
    n = hashes.count()
    bits = min(max(LEAST_BITS, int(64 * n).bit_length()), MOST_BITS)
    cells = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("place")).selectExpr(
        "shiftrightunsigned(place, 6) AS cell", "shiftleft(1L, CAST(place & 63 AS INT)) AS bit")
    table = np.zeros(1 << max(0, bits - 6), dtype=np.int64)
    # At most one row for every 64 bits of the table.
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    table[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return bits, table.view(np.uint64)


def in_table(hashes: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - bits)
    word = table[(place >> np.uint64(6)).astype(np.int64)]
    return (word >> (place & np.uint64(63))) & np.uint64(1) == 1
