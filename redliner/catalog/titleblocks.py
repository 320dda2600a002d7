"""Title-block, address and extractor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.access import parsed_entities
from redliner.catalog.base import Tables, query
from redliner.functions import geometry as g
from redliner.functions import review as r
from redliner.functions import text as x
from redliner.plans import extraction


def title_pages(t: Tables):
    """Plan pages written from orders: labelled spans in the title block, noise outside of it."""
    k = F.col("o_orderkey")
    w = F.when(k % 3 != 0, 2592.0).otherwise(612.0)
    h = F.when(k % 3 != 0, 1728.0).otherwise(792.0)
    left = F.when(k % 3 != 0, 1600.0).otherwise(10.0)
    top = F.when(k % 3 != 0, 100.0).otherwise(530.0)
    number = (k % 8000 + 1000).cast("string")
    serial = F.lpad((k % 10000).cast("string"), 4, "0")
    permit = F.when(k % 4 == 0, F.concat(F.lit("Permit No: B25-"), serial)).when(
        k % 4 == 1, F.concat(F.lit("Permit no. B25-"), serial)
    ).when(k % 4 == 2, F.concat(F.lit("Ref B25-"), serial)).otherwise("General notes")
    lines = [
        F.concat(F.lit("Project Name: House "), k.cast("string")),
        F.when(k % 5 != 4, F.concat(F.lit("PROJECT ADDRESS: "), number, F.lit(" "), a.pick(a.STREETS, k), F.lit(", Santa Rosa, CA"))).otherwise("No site"),
        F.concat(F.lit("APN: 022-211-"), F.lpad((k % 1000).cast("string"), 3, "0")),
        permit,
        F.concat(F.lit("A-1."), (k % 9 + 1).cast("string")),
        F.lit("Sheet Title: Floor Plan"),
        F.lit("x"),
    ]
    spans = [
        F.struct(F.lit(i).alias("ord"), F.lit(0).alias("block_type"), line.alias("text"), g.box(left, top + 12 * i, left + 200, top + 12 * i + 10).alias("bbox"))
        for i, line in enumerate(lines)
    ]
    noise = [
        F.struct(F.lit(90 + i).alias("ord"), F.lit(i).alias("block_type"), F.lit("Address: 9 Wrong Way").alias("text"), b.alias("bbox"))
        for i, b in enumerate([g.box(0.0, 0.0, 50.0, 10.0), g.box(left, top + 200, left + 50, top + 210)])
    ]
    other_number = (F.when(k % 10 == 0, k + 1).otherwise(k) % 8000 + 1000).cast("string")
    other_street = a.pick(a.STREETS, F.when(k % 15 == 0, k + 1).otherwise(k))
    answer = F.concat(
        F.when(k % 3 == 0, "```json\n").otherwise(""),
        F.lit('{"project_address": {"value": "'), number, F.lit(" "), a.pick(a.STREETS, F.when(k % 4 == 0, k).otherwise(k + 2)),
        F.lit(', santa rosa, ca", "bbox_frac": [0.25, 0.5, 0.5, 0.75]}, "designer_of_record": {"value": "Ann Bo", "bbox_frac": [1]}'),
        F.when(k % 7 == 0, "").otherwise("}"), F.when(k % 3 == 0, "\n```").otherwise(""),
    )
    pages = t.busy("orders", "o_orderkey").select(
        k.alias("document_id"), F.lit(1).alias("page"), w.alias("width"), h.alias("height"),
        F.array(*spans, *noise).alias("spans"),
        F.when(k % 6 == 0, "Licensed  Architect").otherwise("none").alias("full_text"),
        F.array(F.struct((k % 400).cast("int").alias("w"), (k % 400 + 5).cast("int").alias("h"))).alias("images"),
        F.concat(other_number, F.lit(" "), other_street, F.lit(", Santa Rosa, CA")).alias("canonical_address"),
    )
    responses = t.busy("orders", "o_orderkey").filter(k % 2 == 0).select(k.alias("document_id"), F.lit(1).alias("page"), answer.alias("response_json"))
    return pages, responses


PICK_K = a.sql_pick(a.STREETS, "k")
SQL_TITLES = f"""WITH o AS (SELECT o_orderkey AS k FROM orders),
s AS (SELECT k, (k % 3 <> 0) AS land, (k % 8000 + 1000)::VARCHAR AS num, lpad((k % 10000)::VARCHAR, 4, '0') AS serial, {PICK_K} AS street,
  k % 2 = 0 AND k % 7 <> 0 AS vis, {a.sql_pick(a.STREETS, '(CASE WHEN k % 4 = 0 THEN k ELSE k + 2 END)')} AS vstreet,
  ((CASE WHEN k % 10 = 0 THEN k + 1 ELSE k END) % 8000 + 1000)::VARCHAR AS cnum, {a.sql_pick(a.STREETS, '(CASE WHEN k % 15 = 0 THEN k + 1 ELSE k END)')} AS cstreet FROM o),
t AS (SELECT *, CASE WHEN k % 5 <> 4 THEN num || ' ' || street || ', Santa Rosa, CA' END AS taddr,
  CASE WHEN vis THEN num || ' ' || vstreet || ', santa rosa, ca' END AS vaddr,
  'PROJECT ADDRESS: ' || num || ' ' || street || ', Santa Rosa, CA' AS addrline FROM s),
u AS (SELECT *, coalesce(taddr, vaddr) AS addr,
  CASE WHEN taddr IS NOT NULL AND vaddr IS NOT NULL THEN
    CASE WHEN len(list_intersect(list_distinct(string_split(lower(taddr), ' ')), list_distinct(string_split(lower(vaddr), ' '))))::DOUBLE
      / len(list_distinct(list_concat(string_split(lower(taddr), ' '), string_split(lower(vaddr), ' ')))) >= 0.7 THEN 0.95 ELSE 0.40 END
    WHEN coalesce(taddr, vaddr) IS NOT NULL THEN 0.70 ELSE 0.0 END AS aconf FROM t),
w AS (SELECT *, CASE WHEN aconf IN (0.95, 0.40) THEN 'merged' WHEN taddr IS NULL AND vaddr IS NOT NULL THEN 'vision' ELSE 'text' END AS atrack,
  CASE k % 4 WHEN 0 THEN 'B25-' || serial WHEN 1 THEN 'no' WHEN 2 THEN 'B25-' || serial END AS permit FROM u),
n AS (SELECT *, 4 + (addr IS NOT NULL)::INT + (permit IS NOT NULL)::INT AS nf FROM w)
"""


@query("A4 H1 H2 H3 H4 H5 H6 H7 H8 H10 H11 H15 H16 J1 J4 K1 D4 D5", SQL_TITLES + """
SELECT k AS document_id, 'House ' || k AS project_name, addr AS address, aconf::DOUBLE AS address_confidence, atrack AS address_track,
  '022-211-' || lpad((k % 1000)::VARCHAR, 3, '0') AS apn, CASE WHEN permit = 'no' AND k % 5 = 4 THEN 'No' ELSE permit END AS permit_number,
  'A-1.' || (k % 9 + 1) AS sheet_raw, 'Floor Plan' AS sheet_title,
  CASE WHEN vis THEN 'Ann Bo' END AS designer,
  (k % 6 = 0 OR (k % 400 > 50 AND k % 400 < 300)) AS stamp_present,
  coalesce(addr IS NOT NULL AND (NOT regexp_matches(addr, '\\b' || cnum || '\\b') OR
     NOT list_has_any(string_split(lower(regexp_replace(cstreet, ' [A-Za-z]+$', '')), ' '), string_split(regexp_replace(lower(addr), '[^a-z0-9]+', ' ', 'g'), ' '))), false) AS address_mismatch,
  round((0.7 * 4 + aconf + CASE WHEN permit IS NOT NULL THEN 0.7 ELSE 0 END) / nf, 6) AS confidence,
  round(CASE WHEN taddr IS NOT NULL THEN CASE WHEN land THEN 1600 ELSE 10 END WHEN addr IS NULL THEN 0
     WHEN land THEN 2073.6 + 0.5 * 518.4 ELSE 153 END, 3)::DOUBLE AS address_x1,
  round(CASE WHEN taddr IS NOT NULL THEN CASE WHEN land THEN 122 ELSE 552 END WHEN addr IS NULL THEN 0
     WHEN land THEN 0.75 * 1728 ELSE 514.8 + 0.75 * 277.2 END, 3)::DOUBLE AS address_y2
FROM n""")
def title_block_extraction(t: Tables):
    pages, responses = title_pages(t)
    e = extraction.extract_title_blocks(pages, responses)
    return e.select(
        "document_id", F.col("project_name.value").alias("project_name"), F.col("project_address.value").alias("address"),
        F.col("project_address.confidence").alias("address_confidence"), F.col("project_address.source_track").alias("address_track"),
        F.col("apn.value").alias("apn"), F.col("permit_number.value").alias("permit_number"),
        F.col("sheet_identifier_raw.value").alias("sheet_raw"), F.col("sheet_title.value").alias("sheet_title"),
        F.col("designer_of_record.value").alias("designer"), "stamp_present", "address_mismatch",
        F.round("confidence", 6).alias("confidence"),
        F.round(F.col("project_address.bbox")[0], 3).alias("address_x1"), F.round(F.col("project_address.bbox")[3], 3).alias("address_y2"),
    )


@query("A4 H3 H5 J1", """WITH s AS (SELECT o_orderkey AS k FROM orders)
SELECT k % 20 AS bucket, count(*) AS pages, count(*) FILTER (WHERE k % 5 <> 4) AS with_address, count(*) FILTER (WHERE k % 4 <> 3) AS with_permit FROM s GROUP BY 1""")
def title_block_text_only(t: Tables):
    pages, _ = title_pages(t)
    e = extraction.extract_title_blocks(pages, None)
    return e.groupBy((F.col("document_id") % 20).alias("bucket")).agg(
        F.count(F.lit(1)).alias("pages"), F.count("project_address.value").alias("with_address"),
        F.count("permit_number.value").alias("with_permit"),
    )


@query("H9 G5", """WITH x AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(string_split_regex(lower(a.text), '\\s+'), lambda w: w <> '')) AS sa,
  list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda w: w <> '')) AS sb
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(sa) = 0 AND len(sb) = 0 THEN 1.0 WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0
  ELSE len(list_intersect(sa, sb))::DOUBLE / len(list_distinct(list_concat(sa, sb))) END, 6) AS jaccard FROM x""")
def token_jaccard(t: Tables):
    c = t.conversations
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return c.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(x.token_jaccard(F.col("text"), F.col("next_text")), 6).alias("jaccard")
    )


@query("H12 H13 H14 H15", f"""WITH a AS ({a.SQL_PROJECTS}), b AS (SELECT project_id, address,
  CASE project_id % 6 WHEN 0 THEN upper(replace(address, ' Ln', ' Lane')) WHEN 1 THEN (project_id % 8000 + 1001)::VARCHAR || ' Bonita Lane'
  WHEN 2 THEN 'Site ' || address WHEN 3 THEN replace(address, 'Mission', 'Vine') WHEN 4 THEN NULL ELSE address || ' 95403' END AS found FROM a)
SELECT project_id, split_part(address, ' ', 1) AS house_number, lower(split_part(address, ' ', 2)) AS street,
  project_id % 6 IN (1, 3) AS differs FROM b""")
def address_mismatch(t: Tables):
    k, address = F.col("project_id"), F.col("address")
    found = (
        F.when(k % 6 == 0, F.upper(F.replace(address, F.lit(" Ln"), F.lit(" Lane"))))
        .when(k % 6 == 1, F.concat((k % 8000 + 1001).cast("string"), F.lit(" Bonita Lane")))
        .when(k % 6 == 2, F.concat(F.lit("Site "), address))
        .when(k % 6 == 3, F.replace(address, F.lit("Mission"), F.lit("Vine")))
        .when(k % 6 == 5, F.concat(address, F.lit(" 95403")))
    )
    return a.projects(t).select(
        "project_id", x.house_number(address).alias("house_number"), x.street_name(address).alias("street"),
        x.address_differs(found, address).alias("differs"),
    )


@query("D4 D5 H32 B17", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity, l_linenumber, l_quantity + 10, l_linenumber + 5.0] AS b1,
   CASE WHEN l_linenumber % 2 = 0 THEN [0.0, 0.0, 0.0, 0.0] ELSE [l_quantity - 5, 2.0, l_quantity + 1, 3.0] END AS b2,
   [l_discount, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE 0.7 END, l_tax] AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber % 2 = 0 THEN b1[1] ELSE least(b1[1], b2[1]) END AS x1, CASE WHEN l_linenumber % 2 = 0 THEN b1[2] ELSE least(b1[2], b2[2]) END AS y1,
  CASE WHEN l_linenumber % 2 = 0 THEN b1[3] ELSE greatest(b1[3], b2[3]) END AS x2, CASE WHEN l_linenumber % 2 = 0 THEN b1[4] ELSE greatest(b1[4], b2[4]) END AS y2,
  round(coalesce(list_avg(list_filter(c, lambda v: v > 0)), 0.0), 6) AS confidence, (b2[3] - b2[1] > 1 OR b2[4] - b2[2] > 1) AS locatable FROM b""")
def entity_confidence_bbox(t: Tables):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    b1 = g.box(q, n, q + 10, n + 5)
    b2 = F.when(F.col("l_linenumber") % 2 == 0, g.zero_box()).otherwise(g.box(q - 5, 2.0, q + 1, 3.0))
    conf = F.array("l_discount", F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(0.7), "l_tax")
    rows = t.lineitem.withColumn("b2", b2).withColumn("u", g.boxes_union(F.array(b1, F.col("b2"))))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col("u")[i].alias(c) for i, c in enumerate(["x1", "y1", "x2", "y2"])],
        F.round(g.mean_nonzero(conf), 6).alias("confidence"), g.is_locatable(F.col("b2")).alias("locatable"),
    )


@query("H24 H25 K5", """WITH s AS (SELECT p_partkey, (['A-1.1', 'a1.2', 'S-2', 'X-1.0', 'E-1.0'])[p_partkey % 5 + 1] AS raw,
  (['FLOOR PLAN', 'Site Plan', 'Door Schedule', 'Wall Section', 'Cover', 'Lobby'])[p_partkey % 6 + 1] AS title FROM part)
SELECT p_partkey, (['A', 'A', 'S', NULL, 'E'])[p_partkey % 5 + 1] AS discipline_letter, (['1.1', '1.2', '2', NULL, '1.0'])[p_partkey % 5 + 1] AS sheet_number,
  (['A-1.1', 'A-1.2', 'S-2', NULL, 'E-1.0'])[p_partkey % 5 + 1] AS canonical_id,
  (['floor_plan', 'site_plan', 'schedule', 'section', 'cover', NULL])[p_partkey % 6 + 1] AS sheet_type FROM s""")
def sheet_identity(t: Tables):
    p = F.col("p_partkey")
    blocks = t.part.select(
        "p_partkey", a.pick(["A-1.1", "a1.2", "S-2", "X-1.0", "E-1.0"], p).alias("sheet_raw"),
        a.pick(["FLOOR PLAN", "Site Plan", "Door Schedule", "Wall Section", "Cover", "Lobby"], p).alias("sheet_title"))
    return extraction.sheet_identity(blocks).drop("sheet_raw", "sheet_title")


@query("C26 K8 M23", f"""WITH e AS ({a.SQL_ENTITIES}), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, type, extractor_version ORDER BY created_at DESC, entity_id DESC) AS rn FROM e) WHERE rn = 1),
o AS (SELECT * FROM n WHERE extractor_version = '1.3.0'), w AS (SELECT * FROM n WHERE extractor_version = '1.4.0')
SELECT coalesce(o.sheet_id, w.sheet_id) AS sheet_id, coalesce(o.type, w.type) AS type, o.address AS old_value, w.address AS new_value,
  CASE WHEN o.sheet_id IS NULL THEN 'added' WHEN w.sheet_id IS NULL THEN 'removed' WHEN o.address IS NOT DISTINCT FROM w.address THEN 'same' ELSE 'changed' END AS status
FROM o FULL OUTER JOIN w ON o.sheet_id = w.sheet_id AND o.type = w.type""")
def extraction_diff(t: Tables):
    e = parsed_entities(t)
    return extraction.extraction_diff(
        e.filter(F.col("extractor_version") == "1.3.0"), e.filter(F.col("extractor_version") == "1.4.0"), ["sheet_id", "type"], "address"
    )


@query("B16 H18 H19", """SELECT conv_id, turn, CASE WHEN c < 0.7 THEN 'claude-opus-4-5' ELSE 'claude-sonnet-4-5' END AS model, (n % 4 = 1 AND c < 0.6) AS disagree
FROM (SELECT conv_id, turn, length(text) AS n, (length(text) % 100) / 100.0 AS c FROM conversations)""")
def model_routing(t: Tables):
    n = F.length("text")
    conf = (n % 100) / 100
    differ = r.tracks_disagree(F.lit("merged"), F.lit("a"), F.when(n % 4 == 1, "b").otherwise("a"), conf)
    return t.conversations.select(
        "conv_id", "turn", r.model_for(r.escalation_role(conf, F.lit(None).cast("string"))).alias("model"), differ.alias("disagree")
    )
