"""Jurisdiction packs, checklists and fixtures from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AMENDMENT = "struct<base_section_id:string,operation:string,amendment_text:string,effective_date:date,superseded_by:string>"
POLICY = "struct<title:string,body_text:string,source_url:string,applies_to_sections:array<string>>"
PACK = (
    "pack_id string, jurisdiction string, version string, effective_date date, superseded_by string, "
    f"amendments array<{AMENDMENT}>, agency_policies array<{POLICY}>, "
    "submittal_checklists array<struct<question:string,citation:string>>, "
    "drafter_examples array<struct<discipline:string,finding:string,comment:string>>"
)
OPERATIONS = ["replace", "append", "override", "insert_before", "insert_after"]
REQUIRED = ["pack_id", "jurisdiction", "version", "effective_date", "amendments"]


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACK).option("multiLine", True).json(path)


def pack_problems() -> Column:
    """Names of the failed pack checks."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    bad_operation = F.exists(
        F.coalesce("amendments", F.array().cast(f"array<{AMENDMENT}>")),
        lambda a: ~F.coalesce(a["operation"].isin(OPERATIONS), F.lit(False)),
    )
    return F.array_compact(F.array(*missing, F.when(bad_operation, F.lit("bad operation"))))


def split_valid(packs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid packs and a quarantine with the reasons."""
    checked = packs.withColumn("problems", pack_problems())
    return checked.filter(F.size("problems") == 0).drop("problems"), checked.filter(F.size("problems") > 0)


def pack_amendments(packs: DataFrame) -> DataFrame:
    """Amendments in declared order; a pack without any keeps one empty row."""
    rows = packs.select("pack_id", "jurisdiction", "version", F.posexplode_outer("amendments").alias("ordinal", "a"))
    return rows.select("pack_id", "jurisdiction", "version", "ordinal", "a.*")


def pack_policies(packs: DataFrame) -> DataFrame:
    rows = packs.select("pack_id", "jurisdiction", F.posexplode("agency_policies").alias("ordinal", "p"))
    return rows.select("pack_id", "jurisdiction", "ordinal", "p.*")


def pack_checklists(packs: DataFrame) -> DataFrame:
    rows = packs.select("pack_id", "jurisdiction", F.posexplode("submittal_checklists").alias("ordinal", "q"))
    return rows.select("pack_id", "jurisdiction", "ordinal", "q.*")


def pack_readiness(packs: DataFrame, sections: DataFrame, min_examples: int = 20) -> DataFrame:
    """Promotion checks per pack: examples, policy sources, linked amendments."""
    linked = (
        pack_amendments(packs)
        .filter(F.col("base_section_id").isNotNull())
        .join(
            sections.select(F.col("canonical_id").alias("base_section_id"), F.lit(True).alias("known")).distinct(),
            "base_section_id", "left",
        )
        .groupBy("pack_id")
        .agg(F.count_if(F.col("known").isNull()).alias("unlinked_amendments"))
    )
    own = packs.select(
        "pack_id",
        F.coalesce(F.size("drafter_examples"), F.lit(0)).alias("examples"),
        F.coalesce(F.size(F.filter("agency_policies", lambda p: p["source_url"].isNull())), F.lit(0)).alias("unsourced_policies"),
    )
    joined = own.join(linked, "pack_id", "left").fillna(0, ["unlinked_amendments"])
    ready = (F.col("examples") >= min_examples) & (F.col("unsourced_policies") == 0) & (F.col("unlinked_amendments") == 0)
    return joined.withColumn("ready", ready)


def read_checklist(spark: SparkSession, path: str) -> DataFrame:
    """Curated or uploaded checklist: question, structured query and source citation."""
    return spark.read.schema("checklist_id string, question string, citation string").json(path)


def read_fixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Expected authority comments and expected findings of a fixture folder."""
    comments = spark.read.schema(
        "project_id string, review_round int, comment_number int, discipline string, comment_text string, "
        "citation_text string, sheet_reference string, typography string"
    ).option("multiLine", True).json(f"{folder}/expected-letter.parsed.json")
    findings = spark.read.schema(
        "project_id string, rule_id string, discipline string, severity string, sheet_id string, draft_comment_text string"
    ).option("multiLine", True).json(f"{folder}/expected-output.json")
    return comments, findings
