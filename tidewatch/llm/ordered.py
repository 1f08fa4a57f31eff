"""Numbering and neighbours of rows in the order of their ids, without a window over the whole table.

Ids are dealt to ranges of about equal numbers of rows, whose bounds are quantiles of a sample of the ids, as in a range
partitioning. An id with more rows than a range is cut further by a hash of the rows' texts. There are so many ranges
that each holds a few hundred rows, but never more than MAX_RANGES, which bounds the sample and every table with one row
a range.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RANGES = 50_000
#: Sampled ids a range, and the distance between the numbers of ranges, which leaves room for the parts of one id.
SAMPLED, APART = 8, 1 << 20


@dataclass(frozen=True)
class Ranges:
    """splits: rising lower bounds of all ranges but the first; parts: into how many an id is cut, if into more than one."""

    splits: list[int]
    parts: dict[int, int] = field(default_factory=dict)

    def of(self, column: str, hashed: str | None = None) -> Column:
        """The range of an id; -1 for null. Ranges rise with the ids, and within one id with the uniform hash in `hashed`."""
        x = f"cast({column} as bigint)"
        if not self.splits:
            return F.expr(f"if({column} IS NULL, -1L, 0L)")
        bounds = f"cast(split('{','.join(map(str, self.splits))}', ',') as array<bigint>)"  # folded into one constant
        steps = ", ".join(str(1 << b) for b in reversed(range(len(self.splits).bit_length())))
        found = f"aggregate(array({steps}), 0, (at, step) -> if(get({bounds}, at + step - 1) <= {x}, at + step, at))"
        part = "0L"
        if hashed and self.parts:
            cut = "CASE " + " ".join(f"WHEN {x} = {i} THEN {n}" for i, n in self.parts.items()) + " ELSE 1 END"
            part = f"cast(floor(({hashed} / 18446744073709551616D + 0.5D) * {cut}) as bigint)"
        return F.expr(f"if({column} IS NULL, -1L, {found} * {APART}L + {part})")


def id_ranges(df: DataFrame, column: str = "doc_id", rows: int = 512) -> Ranges:
    """Ranges of about `rows` rows each, from the count and a sample of the ids of at most SAMPLED * MAX_RANGES or so."""
    ids = df.select(F.col(column).cast("long").alias("id")).filter("id IS NOT NULL")
    n = ids.count()
    ranges = min(MAX_RANGES, -(-n // rows))
    if ranges <= 1:
        return Ranges([])
    share = SAMPLED * ranges / n
    some = sorted(r["id"] for r in (ids if share > 0.5 else ids.sample(share, 17)).toLocalIterator())
    bounds = Counter(some[len(some) * i // ranges] for i in range(1, ranges)) if some else {}
    return Ranges(sorted(bounds), {i: c + 1 for i, c in bounds.items() if c > 1})
