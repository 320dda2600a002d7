"""Domain frames derived row by row from the shared tables, and the same views in SQL.

customer -> projects, orders -> submittals and documents, lineitem -> sheets and entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.catalog.base import Tables
from redliner.functions.text import sheet_key

STREETS = ["Dennis Ln", "Bonita Lane", "Oak St", "Mission Blvd", "Hill Rd", "Park Ave"]


def pick(values: list[str], index) -> F.Column:
    """One literal per row, chosen by a non-negative integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[({index}) % {len(values)} + 1]"


def projects(t: Tables) -> DataFrame:
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("jurisdiction")
    )
    k = F.col("c_custkey")
    return t.customer.join(place, "c_nationkey").select(
        k.alias("project_id"),
        F.col("c_nationkey").alias("tenant_id"),
        "jurisdiction",
        F.concat((k % 8000 + 1000).cast("string"), F.lit(" "), pick(STREETS, k), F.lit(", Santa Rosa, CA")).alias("address"),
        F.format_string("B%02d-%04d", (k % 7 + 19).cast("int"), (k % 10000).cast("int")).alias("permit_number"),
        F.format_string("%03d-%03d", (k % 900).cast("int"), (k % 89).cast("int")).alias("apn"),
        F.col("c_name").alias("name"),
    )


SQL_PROJECTS = f"""
  SELECT c_custkey AS project_id, c_nationkey AS tenant_id, r_name AS jurisdiction,
         (c_custkey % 8000 + 1000)::VARCHAR || ' ' || {sql_pick(STREETS, 'c_custkey')} || ', Santa Rosa, CA' AS address,
         printf('B%02d-%04d', c_custkey % 7 + 19, c_custkey % 10000) AS permit_number,
         printf('%03d-%03d', c_custkey % 900, c_custkey % 89) AS apn, c_name AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def submittals(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("submittal_id"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderdate").alias("received_at"),
        F.when(F.col("o_orderstatus") == "O", "initial")
        .when(F.col("o_orderstatus") == "P", "resubmittal")
        .otherwise("deferred")
        .alias("kind"),
    )


SQL_SUBMITTALS = """
  SELECT o_orderkey AS submittal_id, o_custkey AS project_id, o_orderdate AS received_at,
         CASE o_orderstatus WHEN 'O' THEN 'initial' WHEN 'P' THEN 'resubmittal' ELSE 'deferred' END AS kind
  FROM orders"""


def documents(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("submittal_id")
    )


SQL_DOCUMENTS = "SELECT o_orderkey AS document_id, o_orderkey AS submittal_id FROM orders"


def sheets(t: Tables) -> DataFrame:
    """One row per page; a page listed twice counts once."""
    return (
        t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"))
        .distinct()
        .withColumn("sheet_id", sheet_key(F.col("document_id"), F.col("page")))
    )


SQL_SHEETS = """
  SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS page,
         printf('%d:p%03d', l_orderkey, l_linenumber) AS sheet_id
  FROM lineitem"""


def entities(t: Tables) -> DataFrame:
    """lineitem rows as extracted entities with a JSON payload."""
    li = F.col
    entity_id = F.concat_ws("-", li("l_orderkey"), li("l_linenumber"), li("l_partkey"), li("l_suppkey"))
    street = pick(STREETS, li("l_partkey"))
    address = F.concat((li("l_suppkey") % 8000 + 1000).cast("string"), F.lit(" "), street)
    payload = F.to_json(
        F.struct(
            F.struct(
                F.when(li("l_linenumber") != 7, address).alias("value"),
                (F.lit(1) - li("l_discount").cast("decimal(4,2)")).alias("confidence"),
            ).alias("project_address"),
            F.struct(F.when(li("l_linenumber") % 3 != 0, F.concat(F.lit("A-1."), li("l_linenumber").cast("string"))).alias("value")).alias(
                "sheet_identifier_raw"
            ),
            (li("l_tax") > 0.06).alias("address_mismatch"),
        )
    )
    return t.busy("lineitem").select(
        entity_id.alias("entity_id"),
        li("l_orderkey").alias("document_id"),
        li("l_linenumber").alias("page"),
        sheet_key(li("l_orderkey"), li("l_linenumber")).alias("sheet_id"),
        F.when(li("l_returnflag") == "R", "door").when(li("l_returnflag") == "A", "window").otherwise("title_block").alias("type"),
        payload.alias("payload"),
        li("l_shipdate").alias("created_at"),
        (F.lit(1) - li("l_discount").cast("decimal(4,2)")).cast("double").alias("confidence"),
        F.when(li("l_linestatus") == "F", "1.4.0").otherwise("1.3.0").alias("extractor_version"),
    )


SQL_ENTITIES = f"""
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS entity_id,
         l_orderkey AS document_id, l_linenumber AS page,
         printf('%d:p%03d', l_orderkey, l_linenumber) AS sheet_id,
         CASE l_returnflag WHEN 'R' THEN 'door' WHEN 'A' THEN 'window' ELSE 'title_block' END AS type,
         CASE WHEN l_linenumber <> 7 THEN (l_suppkey % 8000 + 1000)::VARCHAR || ' ' || {sql_pick(STREETS, 'l_partkey')} END AS address,
         CASE WHEN l_linenumber % 3 <> 0 THEN 'A-1.' || l_linenumber END AS sheet_raw,
         l_tax > 0.06 AS address_mismatch,
         l_shipdate AS created_at, (1 - l_discount::DECIMAL(4,2))::DOUBLE AS confidence,
         CASE l_linestatus WHEN 'F' THEN '1.4.0' ELSE '1.3.0' END AS extractor_version
  FROM lineitem"""
