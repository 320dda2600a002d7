"""Intake and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from redliner.catalog import adapters as a
from redliner.catalog.base import Tables, query
from redliner.functions import text as x
from redliner.operators.validate import union_all
from redliner.sources import documents as docs
from redliner.sources import packs, parsing

SQL_LINES = """SELECT doc_id, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"""


@query("A1 A2 C6", """WITH h AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents),
k AS (SELECT DISTINCT content_hash FROM h WHERE source = 'src0'),
n AS (SELECT content_hash, min(doc_id) AS kept_id, count(*) AS copies FROM h WHERE source <> 'src0' GROUP BY 1)
SELECT n.*, (k.content_hash IS NOT NULL) AS skipped FROM n LEFT JOIN k USING (content_hash)""")
def dedupe_documents(t: Tables):
    hashed = t.documents.select("doc_id", "source", x.content_hash(F.col("text")).alias("content_hash"))
    return docs.dedupe_ledger(
        hashed.filter(F.col("source") != "src0"), hashed.filter(F.col("source") == "src0"), "doc_id"
    )


@query("A1 A2", """SELECT sha256(html) AS content_hash, min(page_id) AS kept_id, count(*) AS copies, false AS skipped FROM pages GROUP BY 1""")
def dedupe_pages(t: Tables):
    hashed = t.pages.select("page_id", x.content_hash(F.col("html")).alias("content_hash"))
    return docs.dedupe_ledger(hashed, None, "page_id")


@query("A3 C6", """WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS n FROM orders),
s AS (SELECT o_orderkey, unnest(generate_series(1, n)) AS page FROM d WHERE n > 0)
SELECT o_orderkey AS document_id, page, printf('%d:p%03d', o_orderkey, page) AS sheet_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 2592.0 ELSE 612.0 END AS page_width_pts, 1728.0 AS page_height_pts
FROM s WHERE printf('%d:p%03d', o_orderkey, page) NOT IN (SELECT printf('%d:p%03d', l_orderkey, l_linenumber) FROM lineitem)""")
def build_sheets(t: Tables):
    width = F.when(F.col("o_orderkey") % 2 == 0, 2592.0).otherwise(612.0)
    pages = F.array_repeat(F.struct(width.alias("width"), F.lit(1728.0).alias("height")), (F.col("o_orderkey") % 4).cast("int"))
    return docs.build_sheets(t.orders.select(F.col("o_orderkey").alias("document_id"), pages.alias("pages")), a.sheets(t))


@query("A5 C6", """WITH k AS (SELECT DISTINCT o_custkey % 1000 AS permit, o_orderpriority AS jurisdiction FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
n AS (SELECT o_custkey % 1000 AS permit, o_orderpriority AS jurisdiction, min(o_orderdate) AS first_seen FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2)
SELECT permit, jurisdiction, strftime(first_seen, '%Y-%m-%d') AS first_seen,
       sha256('project' || chr(31) || permit || chr(31) || jurisdiction) AS project_id
FROM n ANTI JOIN k USING (permit, jurisdiction)""")
def ensure_projects(t: Tables):
    cutoff = F.lit("1996-01-01").cast("timestamp")
    key = [(F.col("o_custkey") % 1000).alias("permit"), F.col("o_orderpriority").alias("jurisdiction")]
    old = t.orders.filter(F.col("o_orderdate") < cutoff).select(*key).distinct().withColumn("project_id", F.lit(None).cast("string"))
    new = t.orders.filter(F.col("o_orderdate") >= cutoff).select(*key, F.col("o_orderdate").alias("first_seen"))
    made = docs.ensure_dim(new, old, ["permit", "jurisdiction"], "project", "project_id")
    return made.filter(F.col("project_id").isNotNull()).select(
        "permit", "jurisdiction", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "project_id"
    )


@query("A6 A7 G1", f"""WITH e AS ({a.SQL_ENTITIES}), o AS (SELECT DISTINCT document_id, page, extractor_version FROM e WHERE created_at < TIMESTAMP '1998-01-01'),
n AS (SELECT DISTINCT document_id, page, extractor_version FROM e WHERE created_at >= TIMESTAMP '1998-01-01')
SELECT extractor_version, count(*) AS entities FROM (SELECT * FROM o UNION SELECT * FROM n) GROUP BY 1""")
def rerun_extractor(t: Tables):
    e = a.entities(t).select("document_id", "page", "extractor_version", "created_at")
    cutoff = F.lit("1998-01-01").cast("timestamp")
    old = e.filter(F.col("created_at") < cutoff).drop("created_at").distinct()
    new = e.filter(F.col("created_at") >= cutoff).drop("created_at").distinct()
    both = docs.rerun_entities(old, new, ["document_id", "page", "extractor_version"])
    return both.groupBy("extractor_version").agg(F.count(F.lit(1)).alias("entities"))


@query("A17 H17 H34", """SELECT page_id, 's3://raw/' || md5(url) || '/' || page_id || '.html' AS uri,
 'http://store:9000/raw/' || md5(url) || '/' || page_id || '.html' AS url,
 '/api/assets/' || md5(url) || '/' || page_id || '.html' AS proxy,
 substr(sha256(page_id::VARCHAR), 1, 12) AS public_id, substr(sha256(url || html), 1, 16) AS prompt_hash FROM pages""")
def asset_uris(t: Tables):
    key = F.concat(F.md5("url"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    uri = x.object_uri(F.lit("raw"), key)
    return t.pages.select(
        "page_id", uri.alias("uri"), x.public_url(F.lit("http://store:9000/"), F.lit("raw"), key).alias("url"),
        x.proxy_path(uri).alias("proxy"), x.public_id(F.col("page_id")).alias("public_id"),
        x.prompt_hash(F.col("url"), F.col("html")).alias("prompt_hash"),
    )


@query("A10 L15", """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line FROM d),
m AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 1 THEN (line_no % 7 + 1) || '.' || line_no || ' ' || line ELSE line END AS line FROM l),
c AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[0-9]+(\\.[0-9]+)+\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS chunk_no FROM m)
SELECT doc_id, chunk_no, regexp_extract(arg_min(line, line_no), '^([0-9]+(?:\\.[0-9]+)+)\\s', 1) AS section_number,
       length(trim(string_agg(line, chr(10) ORDER BY line_no), chr(10) || chr(9) || ' ')) AS n_chars FROM c GROUP BY 1, 2""")
def code_text_chunks(t: Tables):
    numbered = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(
            (i + 1) % 3 == 1, F.concat(((i + 1) % 7 + 1).cast("string"), F.lit("."), (i + 1).cast("string"), F.lit(" "), line)
        ).otherwise(line),
    )
    code = t.documents.select("doc_id", F.array_join(numbered, "\n").alias("text"))
    return parsing.chunk_code_text(code, "doc_id", "text").select(
        "doc_id", "chunk_no", "section_number", F.length("body_text").alias("n_chars")
    )


@query("A20", """WITH t AS (SELECT doc_id, lower((['Title 24 CF1R report', 'Code analysis narrative', 'Sheet index and floor plan', 'Plan check comments', 'Deferred submittal', 'Checklist', 'Cut sheet'])[doc_id % 7 + 1] || ' ' || text) AS s FROM documents),
n AS (SELECT doc_id, [len(regexp_extract_all(s, 'floor plan|elevation|sheet index|title block')), len(regexp_extract_all(s, 'title 24|cf1r|mf1r|certificate of compliance')),
  len(regexp_extract_all(s, 'plan check|plan review comments|response slot')), len(regexp_extract_all(s, 'narrative|code analysis|basis of design')),
  len(regexp_extract_all(s, 'checklist|does every|question')), len(regexp_extract_all(s, 'deferred submittal|sprinkler|solar'))] AS h FROM t)
SELECT doc_id, CASE WHEN list_max(h) = 0 THEN 'supporting_doc' ELSE
 (['plan_set','title24_report','plan_check_letter','narrative','question_checklist','deferred_submittal'])[list_position(h, list_max(h))] END AS doc_type FROM n""")
def classify_documents(t: Tables):
    lead = a.pick(
        ["Title 24 CF1R report", "Code analysis narrative", "Sheet index and floor plan", "Plan check comments",
         "Deferred submittal", "Checklist", "Cut sheet"], F.col("doc_id"))
    return t.busy("documents", "doc_id", "text").select("doc_id", parsing.classify_document(F.concat(lead, F.lit(" "), F.col("text"))).alias("doc_type"))


@query("A21 E15", f"""WITH l AS ({SQL_LINES}), h AS (SELECT *, regexp_matches(line, '^[^ ]+( [^ ]+)?\\.$') AS is_heading FROM l),
c AS (SELECT *, last_value(CASE WHEN is_heading THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading FROM h)
SELECT doc_id, line_no, is_heading, heading, length(line) AS n_chars FROM c""")
def narrative_segments(t: Tables):
    lines = parsing.lines_of(t.documents, "doc_id", "text")
    return parsing.with_heading(lines, "doc_id", "line_no", "line", r"^[^ ]+( [^ ]+)?\.$").select(
        "doc_id", "line_no", "is_heading", "heading", F.length("line").alias("n_chars")
    )


SQL_LETTER = f"""WITH l AS ({SQL_LINES}),
f AS (SELECT doc_id, line_no, CASE WHEN line_no % 10 = 1 THEN (['ARCHITECTURAL', 'ENERGY', 'FIRE', 'STRUCTURAL'])[(line_no // 10) % 4 + 1]
   WHEN line_no % 3 = 0 THEN line_no || '. ' || line || ' CBC §' || (line_no % 12 + 1) || '.2' ELSE line END AS line,
   (['italic', 'bold', 'underlined'])[line_no % 3 + 1] AS style FROM l),
m AS (SELECT *, CASE line WHEN 'ARCHITECTURAL' THEN 'architectural' WHEN 'ENERGY' THEN 'energy' WHEN 'FIRE' THEN 'fire_life_safety' WHEN 'STRUCTURAL' THEN 'structural' END AS sec,
   CASE WHEN line_no % 10 <> 1 AND line_no % 3 = 0 AND regexp_matches(line, '^[0-9]+\\. +[^ ]') THEN line_no END AS num FROM f),
c AS (SELECT *, last_value(sec IGNORE NULLS) OVER w AS discipline, last_value(num IGNORE NULLS) OVER w AS comment_number,
   sum(CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END) OVER w AS comment_seq FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
k AS (SELECT * FROM c WHERE sec IS NULL AND comment_seq > 0)"""


def _letter(t: Tables):
    n = F.col("line_no")
    line = (
        F.when(n % 10 == 1, a.pick(["ARCHITECTURAL", "ENERGY", "FIRE", "STRUCTURAL"], F.floor(n / 10)))
        .when(n % 3 == 0, F.concat(n.cast("string"), F.lit(". "), F.col("line"), F.lit(" CBC §"), (n % 12 + 1).cast("string"), F.lit(".2")))
        .otherwise(F.col("line"))
    )
    return parsing.lines_of(t.busy("documents", "doc_id", "text"), "doc_id", "text").select(
        "doc_id", "line_no", line.alias("line"), a.pick(["italic", "bold", "underlined"], n).alias("style")
    )


@query("A22 E15 H29 J6 C18", SQL_LETTER + """
SELECT doc_id, comment_seq, comment_number, arg_min(discipline, line_no) AS discipline,
       'CBC-' || (comment_number % 12 + 1) || '.2' AS citation, arg_min(style, line_no) AS typography,
       count(*) AS n_lines, sum(length(line)) AS n_chars FROM k GROUP BY 1, 2, 3""")
def review_letter_comments(t: Tables):
    return parsing.parse_review_letter(_letter(t), "doc_id")


@query("A22", SQL_LETTER + """
SELECT doc_id, comment_seq, 1 AS part, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM k GROUP BY 1, 2""")
def review_letter_texts(t: Tables):
    texts = parsing.letter_comment_texts(_letter(t), "doc_id")
    return texts.select("doc_id", "comment_seq", "part", F.md5("comment_text").alias("text_md5"))


@query("A23", """WITH p AS (SELECT p_partkey, (['wall','roof','window','hvac','dhw'])[p_partkey % 5 + 1] AS kind, p_size, p_partkey % 40 AS r FROM part)
SELECT p_partkey, CASE kind WHEN 'hvac' THEN 't24_hvac_row' WHEN 'dhw' THEN 't24_dhw_row' ELSE 't24_envelope_row' END AS type, kind AS name,
  NULL::VARCHAR AS value, p_size::DOUBLE AS area, (p_size % 10) / 10.0::DOUBLE AS u_factor, r::DOUBLE AS r_value FROM p
UNION ALL SELECT p_partkey, 't24_header', 'climate zone', (p_partkey % 16 + 1)::VARCHAR, NULL, NULL, NULL FROM part""")
def compliance_form_rows(t: Tables):
    kind = a.pick(["wall", "roof", "window", "hvac", "dhw"], F.col("p_partkey"))
    table_row = F.concat_ws(" | ", kind, F.col("p_size"), (F.col("p_size") % 10) / 10, (F.col("p_partkey") % 40))
    header = F.concat(F.lit("Climate Zone: "), (F.col("p_partkey") % 16 + 1).cast("string"))
    lines = t.part.select("p_partkey", F.explode(F.array(table_row, header, F.lit("Page 1"))).alias("line"))
    return parsing.parse_form_rows(lines)


@query("A24", """SELECT p_partkey, p_brand AS tag, p_type AS kind, p_size::VARCHAR AS width, CASE WHEN p_size % 2 = 0 THEN p_name END AS rating FROM part""")
def schedule_rows(t: Tables):
    cells = F.array(
        F.struct(F.lit("tag").alias("column"), F.col("p_brand").alias("text")),
        F.struct(F.lit("kind").alias("column"), F.col("p_type").alias("text")),
        F.struct(F.lit("width").alias("column"), F.col("p_size").cast("string").alias("text")),
        F.struct(F.lit("rating").alias("column"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("text")),
    )
    return parsing.parse_schedule(t.part.select("p_partkey", F.inline(cells)), ["p_partkey"], ["tag", "kind", "width", "rating"])


@query("A25 H21 L14", """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 30 + 1 AS k FROM lineitem)
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS note_id, 1 AS citation_no, 'CBC §' || k || '.2.1' AS citation, 'CBC-' || k || '.2.1' AS canonical_id FROM n
UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 2, 'Table ' || k || '.4', 'CBC-TBL-' || k || '.4' FROM n
UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 3, '§11B-' || k || '.2', 'CBC-11B-' || k || '.2' FROM n
UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 4, '§150.' || k || '(f)', 'CEnC-150.' || k || '-f' FROM n
UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 5, '§R' || k || '.2.1', 'CRC-R' || k || '.2.1' FROM n""")
def code_note_citations(t: Tables):
    k = (F.col("l_partkey") % 30 + 1).cast("string")
    note = F.concat(
        F.lit("Provide guard per CBC §"), k, F.lit(".2.1 and Table "), k, F.lit(".4; see §11B-"), k, F.lit(".2, §150."), k,
        F.lit("(f) and §R"), k, F.lit(".2.1 for the rest."),
    )
    note_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return parsing.code_notes(t.busy("lineitem").select(note_id.alias("note_id"), note.alias("note")), "note_id", "note")


@query("A25", """SELECT o_orderkey, 'R-' || (o_custkey % 3 + 1) || '.1' AS occupancy_class, CASE WHEN o_custkey % 2 = 0 THEN 'VB' ELSE 'IIIA' END AS construction_type,
 CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'no' END AS sprinklered, CASE WHEN o_custkey % 5 <> 0 THEN (2013 + 3 * (o_custkey % 5))::VARCHAR END AS code_cycle FROM orders""")
def narrative_claims(t: Tables):
    c = F.col("o_custkey")
    said = F.concat_ws(
        " ",
        F.concat(F.lit("Occupancy group r-"), (c % 3 + 1).cast("string"), F.lit(".1,")),
        F.concat(F.lit("Type "), F.when(c % 2 == 0, "vb").otherwise("iiia"), F.lit(" construction,")),
        F.when(F.col("o_orderstatus") == "O", "with sprinklers.").when(F.col("o_orderstatus") == "F", "non-sprinklered."),
        F.when(c % 5 != 0, F.concat(F.lit("Under the "), (2013 + 3 * (c % 5)).cast("string"), F.lit(" California code."))),
    )
    fields = parsing.claim_fields(F.col("said"))
    return t.orders.select("o_orderkey", said.alias("said")).select("o_orderkey", *[v.alias(k) for k, v in fields.items()])


@query("A26 A12", """SELECT p_partkey, (['bedroom','door','stair'])[p_partkey % 3 + 1] AS target, p_partkey % 2 = 0 AS only_new,
 (['net clear opening','clear width','height'])[p_partkey % 3 + 1] AS measure, CASE WHEN p_partkey % 4 < 2 THEN '>=' ELSE '<=' END AS comparison,
 p_size::DOUBLE AS threshold, 'inches' AS unit, 'CRC-R' || p_size || '.1' AS section FROM part""")
def checklist_questions(t: Tables):
    p = F.col("p_partkey")
    question = F.concat(
        F.lit("Does every "), F.when(p % 2 == 0, "new ").otherwise(""), a.pick(["bedroom", "door", "stair"], p), F.lit(" have a "),
        a.pick(["net clear opening", "clear width", "height"], p), F.lit(" of "),
        F.when(p % 4 < 2, "at least ").otherwise("no more than "), F.col("p_size").cast("string"), F.lit(" inches per §R"),
        F.col("p_size").cast("string"), F.lit(".1?"),
    )
    return t.part.select("p_partkey", question.alias("q")).select(
        "p_partkey", *[v.alias(k) for k, v in parsing.parse_question(F.col("q")).items()]
    )


@query("A11", """WITH a AS (SELECT p_partkey, unnest([0, 1]) AS ordinal FROM part WHERE p_size % 10 <> 0)
SELECT 'pack-' || p_partkey AS pack_id, ordinal, CASE ordinal WHEN 0 THEN 'replace' ELSE 'append' END AS operation, 'text ' || p_partkey AS amendment_text, false AS quarantined FROM a
UNION ALL SELECT 'pack-' || p_partkey, NULL, NULL, NULL, true FROM part WHERE p_size % 10 = 0""")
def pack_loading(t: Tables):
    p = F.col("p_partkey").cast("string")

    def amendment(op: str):
        return F.struct(
            F.concat(F.lit("CBC-"), p).alias("base_section_id"), F.lit(op).alias("operation"),
            F.concat(F.lit("text "), p).alias("amendment_text"), F.lit("2024-01-01").alias("effective_date"),
        )

    raw = F.to_json(
        F.struct(
            F.concat(F.lit("pack-"), p).alias("pack_id"), F.lit("santa_rosa").alias("jurisdiction"),
            F.when(F.col("p_size") % 10 != 0, "1.0").alias("version"), F.lit("2024-01-01").alias("effective_date"),
            F.array(amendment("replace"), amendment("append")).alias("amendments"),
        )
    )
    loaded = t.part.select(F.from_json(raw, packs.PACK).alias("p")).select("p.*")
    valid, quarantine = packs.split_valid(loaded)
    return union_all([
        packs.pack_amendments(valid).select("pack_id", "ordinal", "operation", "amendment_text", F.lit(False).alias("quarantined")),
        quarantine.select("pack_id", F.lit(True).alias("quarantined")),
    ])


@query("A16", """SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 96 MONTH <= TIMESTAMP '2006-01-01' THEN 'hard' ELSE 'soft' END AS stage
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate + INTERVAL 84 MONTH <= TIMESTAMP '2006-01-01'""")
def retention_due(t: Tables):
    projects = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")).alias("closed_at")
    )
    return docs.retention_due(projects, F.lit("2006-01-01").cast("date")).select("o_orderkey", "stage")


@query("A15", f"""WITH p AS ({a.SQL_PROJECTS}) SELECT p.jurisdiction, year(o_orderdate) AS year, count(*) AS projects, min(p.project_id) AS first_project, strftime(max(o_orderdate), '%Y-%m-%d') AS last_closed
FROM orders JOIN p ON p.project_id = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def cold_index(t: Tables):
    closed = t.orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("closed_at"))
    index = docs.cold_index(closed.join(a.projects(t).select("project_id", "jurisdiction"), "project_id"))
    return index.withColumn("last_closed", F.date_format("last_closed", "yyyy-MM-dd"))
