"""One-to-one assignment by tiers of shared keys.

Candidates are not paired up. In each tier, from strongest to weakest, the
still unassigned rows of both sides that share the tier's key are numbered in a
fixed order and rows with the same number are joined. Cost is linear in the
rows and each row is used at most once, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.operators.scan import ordered_scan, position
from redliner.operators.validate import union_all
from redliner.session import durable, growing


@dataclass(frozen=True)
class Tier:
    name: str
    keys: tuple[str, ...]


def tiered_assignment(
    left: DataFrame,
    right: DataFrame,
    tiers: Sequence[Tier],
    left_id: str,
    right_id: str,
    chunk_width: int = 5_000_000,
) -> DataFrame:
    """Assignments (left_id, right_id, tier). Rows with a null in a tier's key skip that tier.

    Ids are integers and give the order inside a key. Each round is written to
    the shared folder, and the next one reads what that left over, not the
    sides again.
    """
    columns = sorted({k for tier in tiers for k in tier.keys})
    rest = {row_id: side.select(row_id, *columns) for row_id, side in ((left_id, left), (right_id, right))}
    taken = []
    for number, tier in enumerate(tiers, 1):
        keys = list(tier.keys)

        def numbered(row_id: str) -> DataFrame:
            rows = ordered_scan(rest[row_id].dropna(subset=keys), keys, [F.col(row_id)], F.floor(F.col(row_id) / chunk_width), {"__n": position()})
            return rows.select(*keys, "__n", row_id, *[F.col(c).alias(f"__{row_id}_{c}") for c in columns if c not in keys])

        both = durable(growing(numbered(left_id)).join(numbered(right_id), [*keys, "__n"], "full_outer"))
        paired = F.col(left_id).isNotNull() & F.col(right_id).isNotNull()
        taken.append(both.filter(paired).select(left_id, right_id, F.lit(tier.name).alias("tier"), F.lit(number).alias("tier_no")))
        for row_id in rest:
            alone = both.filter(~paired & F.col(row_id).isNotNull()).select(row_id, *[c if c in keys else F.col(f"__{row_id}_{c}").alias(c) for c in columns])
            skipped = rest[row_id].filter(reduce(or_, [F.col(k).isNull() for k in keys]))
            rest[row_id] = alone.unionByName(skipped)
    return union_all(taken)
