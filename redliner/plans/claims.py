"""Facts asserted by several documents: resolution, sources and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.operators.scan import paged

# The claim types.
CLAIM_TYPES = [
    "occupancy_class", "construction_type", "conditioned_area", "climate_zone", "sprinklered", "r_value_wall",
    "r_value_roof", "r_value_floor", "u_factor_window", "stories", "fire_hazard_zone", "flood_zone", "code_cycle",
]
KEYS = ["project_id", "claim_type"]


def claim_support(assertions: DataFrame) -> DataFrame:
    """Per project, type and value: summed confidence, number of sources and the first source.

    ``assertions``: project_id, claim_type, value, entity_id, document_id,
    confidence. Sums are decimal, so the order of addition does not matter.
    """
    return assertions.filter(F.col("value").isNotNull()).groupBy(*KEYS, "value").agg(
        F.sum(F.col("confidence").cast("decimal(9,6)")).alias("support"),
        F.count(F.lit(1)).alias("n_sources"),
        F.min("entity_id").alias("first_entity"),
    )


def resolve_claims(assertions: DataFrame) -> DataFrame:
    """The value with the largest summed confidence, ties to the smallest value.

    Confidence is the winner's share of the total.
    """
    support = claim_support(assertions)
    top = support.groupBy(*KEYS).agg(
        F.min_by(F.struct("value", "support", "first_entity"), F.struct(-F.col("support"), F.col("value"))).alias("w"),
        F.sum("support").alias("total"),
        F.sum("n_sources").alias("n_sources"),
        F.count(F.lit(1)).alias("n_values"),
    )
    share = F.try_divide(F.col("w.support").cast("double"), F.col("total").cast("double"))
    return top.select(
        *KEYS, F.col("w.value").alias("resolved_value"), share.alias("confidence"), "n_sources", "n_values",
        F.col("w.first_entity").alias("resolved_entity"),
    )


def claim_conflicts(assertions: DataFrame, claims: DataFrame) -> DataFrame:
    """One conflict per source that contradicts the resolved value.

    The partner is the first source of the resolved value, so conflicts grow
    with the sources and not with their pairs; every dissenting source is named.
    """
    contested = claims.filter(F.col("n_values") > 1).select(*KEYS, "resolved_value", "resolved_entity")
    both = assertions.filter(F.col("value").isNotNull()).join(contested, KEYS).filter(F.col("value") != F.col("resolved_value"))
    own_first = F.col("entity_id") < F.col("resolved_entity")
    a_value = F.when(own_first, F.col("value")).otherwise(F.col("resolved_value"))
    b_value = F.when(own_first, F.col("resolved_value")).otherwise(F.col("value"))
    return both.select(
        *KEYS,
        F.least("entity_id", "resolved_entity").alias("entity_id_a"),
        F.greatest("entity_id", "resolved_entity").alias("entity_id_b"),
        F.concat(a_value, F.lit(" <> "), b_value).alias("delta"),
    )


def claim_sources(assertions: DataFrame, page_size: int = 500) -> DataFrame:
    """Sources nested per claim in pages of bounded size."""
    # sources have no numeric order of their own: a hash of the id spreads a large claim over chunks
    bucket = F.pmod(F.xxhash64("entity_id"), F.lit(64))
    return paged(
        assertions.withColumn("__b", bucket), KEYS, [F.col("__b"), F.col("entity_id")], F.col("__b"),
        F.struct("entity_id", "document_id", "value"), page_size, "sources",
    )


def source_counts(assertions: DataFrame) -> DataFrame:
    """Distinct documents behind each claim, exact and approximate."""
    return assertions.groupBy(*KEYS).agg(
        F.countDistinct("document_id").alias("documents"), F.approx_count_distinct("document_id").alias("documents_approx")
    )


def value_disagreements(assertions: DataFrame, left_source: str, right_source: str) -> DataFrame:
    """Claims whose values differ between two kinds of sources, such as plans and the energy report."""
    def side(kind: str, name: str) -> DataFrame:
        own = resolve_claims(assertions.filter(F.col("source_kind") == kind))
        return own.select(*KEYS, F.col("resolved_value").alias(f"{name}_value"), F.col("resolved_entity").alias(f"{name}_entity"))

    both = side(left_source, "left").join(side(right_source, "right"), KEYS)
    return both.filter(F.col("left_value") != F.col("right_value"))
