"""Import, duplicate and manifest queries."""

from pyspark.sql import functions as F

from passbook.operators import dedup as dd
from passbook.operators import quality as ql
from passbook.plans import imports as im
from passbook.plans.registry import register
from passbook.plans.testdata import categories, ledger, merchants, oracle, spread, statement_ledger, statement_oracle, table
from passbook.sources import manifest as mf

# A statement import: of the rows of the ledger on whole units, those of a card are stored
# already and all others come in, in id order.
STORED = "source_type IN ('credit_card_pdf', 'bank_pdf')"

BLOCKS_SQL = f"""
side AS (SELECT *, CAST(transaction_date AS DATE) AS day, {STORED} AS is_stored,
    CASE WHEN external_id <> '' THEN coalesce(nullif(ltrim(external_id, '0'), ''), '0') END AS e,
    upper(regexp_replace(original_description, '\\s+', '', 'g')) AS d FROM ledger),
edge AS (
  SELECT n.id AS later, o.id AS earlier, o.is_stored FROM side n JOIN side o
    ON n.day = o.day AND n.amount = o.amount AND n.transaction_type = o.transaction_type
    AND NOT n.is_stored AND (o.is_stored OR o.id < n.id)
    AND CASE WHEN n.e IS NOT NULL AND o.e IS NOT NULL THEN n.e = o.e ELSE n.d = o.d
      OR (length(n.d) > 10 AND length(o.d) > 10 AND (contains(n.d, o.d) OR contains(o.d, n.d))) END),
live(step, id, st) AS (
  SELECT 0, id, CASE WHEN id IN (SELECT later FROM edge WHERE is_stored) THEN 2 ELSE 0 END FROM side WHERE NOT is_stored
  UNION ALL
  SELECT * FROM (
    SELECT s.step + 1, s.id, CASE WHEN s.st <> 0 THEN s.st WHEN bool_or(k.st = 1) THEN 2
      WHEN count(*) FILTER (k.st = 0) = 0 THEN 1 ELSE 0 END
    FROM live s LEFT JOIN edge x ON x.later = s.id AND NOT x.is_stored LEFT JOIN live k ON k.id = x.earlier
    GROUP BY s.step, s.id, s.st) WHERE (SELECT count(*) FROM live WHERE st = 0) > 0),
final AS (SELECT id, st FROM live WHERE step = (SELECT max(step) FROM live))"""


def _sides(spark, sf_dir):
    rows = ledger(spark, sf_dir, whole_units=True)
    return rows.filter(STORED), rows.filter(f"NOT {STORED}").withColumn("seq", F.col("id"))


@register(
    "dedup_candidates",
    oracle(
        "SELECT later AS seq, min(earlier) AS stored_id FROM edge WHERE is_stored GROUP BY 1",
        whole_units=True,
        more=BLOCKS_SQL,
    ),
)
def dedup_candidates(spark, sf_dir):
    return dd.dedup_candidates(*_sides(spark, sf_dir))


@register(
    "fuzzy_dedup",
    oracle(
        "SELECT id AS seq, CASE st WHEN 1 THEN 'new' ELSE 'duplicate' END AS status FROM final",
        whole_units=True,
        more=BLOCKS_SQL,
    ),
)
def fuzzy_dedup(spark, sf_dir):
    return dd.fuzzy_dedup(*_sides(spark, sf_dir), "bank_pdf").select("seq", "status")


# The csv import changes stored rows while rows are taken in order, so its SQL twin walks
# through every block row by row, with the candidates of the block as a list.
WALK_SQL = f"""
side AS (SELECT *, CAST(transaction_date AS DATE) AS day, {STORED} AS is_stored,
    CASE WHEN external_id <> '' THEN coalesce(nullif(ltrim(external_id, '0'), ''), '0') END AS e,
    upper(regexp_replace(original_description, '\\s+', '', 'g')) AS d FROM ledger),
blocks AS (
  SELECT day, amount, transaction_type,
    coalesce(list({{'e': e, 'd': d, 'kind': 'stored', 'id': id, 'up': TRUE}} ORDER BY id) FILTER (is_stored), []) AS known,
    list({{'e': e, 'd': d, 'id': id}} ORDER BY id) FILTER (NOT is_stored) AS fresh
  FROM side GROUP BY ALL HAVING count(*) FILTER (NOT is_stored) > 0),
walk(i, fresh, cands, hit, seq) AS (
  SELECT 0, fresh, known, CAST(NULL AS STRUCT(e VARCHAR, d VARCHAR, kind VARCHAR, id BIGINT, up BOOLEAN)), CAST(NULL AS BIGINT) FROM blocks
  UNION ALL
  SELECT i + 1, fresh, CASE WHEN place = 0 THEN list_append(cands, {{'e': cur.e, 'd': cur.d, 'kind': 'staged', 'id': cur.id, 'up': FALSE}})
      WHEN cands[place].up THEN list_concat(list_concat(cands[1:place - 1],
        [{{'e': coalesce(cur.e, cands[place].e), 'd': cur.d, 'kind': cands[place].kind, 'id': cands[place].id, 'up': FALSE}}]), cands[place + 1:])
      ELSE cands END, CASE WHEN place > 0 THEN cands[place] END, cur.id
  FROM (SELECT *, fresh[i + 1] AS cur, coalesce(list_position(list_transform(cands, lambda c:
      CASE WHEN c.e IS NOT NULL AND fresh[i + 1].e IS NOT NULL THEN c.e = fresh[i + 1].e ELSE c.d = fresh[i + 1].d
        OR (length(c.d) > 10 AND length(fresh[i + 1].d) > 10 AND (contains(c.d, fresh[i + 1].d) OR contains(fresh[i + 1].d, c.d))) END), TRUE), 0) AS place
    FROM walk WHERE i < len(fresh))),
decisions AS (SELECT seq, CASE WHEN hit IS NULL THEN 'new' ELSE 'duplicate' END AS status, hit.kind AS matched_kind, hit.id AS matched_id,
    coalesce(hit.up, FALSE) AS upgrades FROM walk WHERE i > 0)"""


@register(
    "source_upgrade",
    oracle(
        """SELECT matched_id AS id, original_description, trim(regexp_replace(original_description, '\\s+', ' ', 'g')) AS cleaned_description,
      'bank_csv' AS source_type, nullif(external_id, '') AS external_id, sha256(strftime(transaction_date, '%Y-%m-%d') || '|'
      || CAST(amount AS VARCHAR) || '|' || trim(regexp_replace(original_description, '\\s+', ' ', 'g'))[1:50] || '|' || transaction_type) AS dedup_hash
    FROM decisions JOIN ledger ON ledger.id = seq WHERE upgrades""",
        whole_units=True,
        more=WALK_SQL,
    ),
)
def source_upgrade(spark, sf_dir):
    stored, incoming = _sides(spark, sf_dir)
    return dd.source_upgrades(dd.fuzzy_dedup(stored, incoming, "bank_csv"), incoming)


@register("candidate_union", oracle("SELECT * FROM decisions", whole_units=True, more=WALK_SQL))
def candidate_union(spark, sf_dir):
    stored, incoming = _sides(spark, sf_dir)
    return dd.fuzzy_dedup(stored, incoming, "bank_csv")


@register(
    "import_statement",
    oracle(
        """SELECT s.id AS seq, 'bank_pdf' AS source_type, trim(regexp_replace(original_description, '\\s+', ' ', 'g')) AS cleaned_description,
      sha256(strftime(transaction_date, '%Y-%m-%d') || '|' || CAST(amount AS VARCHAR) || '|'
      || trim(regexp_replace(original_description, '\\s+', ' ', 'g'))[1:50] || '|' || transaction_type) AS dedup_hash, external_id
    FROM side s JOIN final f ON f.id = s.id AND f.st = 1""",
        whole_units=True,
        more=BLOCKS_SQL,
    ),
)
def import_statement(spark, sf_dir):
    added, _ = im.import_statement(*_sides(spark, sf_dir), "bank_pdf", {"bank": "acme", "product": "savings"})
    return added.select("seq", "source_type", "cleaned_description", "dedup_hash", "external_id")


@register(
    "unified_ledger",
    oracle(
        """SELECT source_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, count(currency) AS with_currency FROM (
      SELECT source_type, amount, currency FROM ledger
      UNION ALL SELECT 'manual', CAST(l_extendedprice AS DECIMAL(12,2)), NULL FROM lineitem) GROUP BY 1"""
    ),
)
def unified_ledger(spark, sf_dir):
    rows = im.unified_ledger(
        ledger(spark, sf_dir), statement_ledger(spark, sf_dir).withColumn("source_type", F.lit("manual"))
    )
    return rows.groupBy("source_type").agg(
        F.count("*").alias("n"),
        F.sum("amount").cast("double").alias("total"),
        F.count("currency").alias("with_currency"),
    )


FILES_SQL = """
files AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 5 = 0 THEN ' (1)' ELSE '' END || '.txt' AS filename,
    sha256(text) AS file_hash, doc_id, CAST(strlen(text) AS BIGINT) AS file_size, doc_id % 3 = 0 AS is_known FROM documents)"""


def _files(spark, sf_dir):
    """Every document as a file: its bytes are the UTF-8 text."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(
        F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, " (1)").otherwise(""), F.lit(".txt")
    )
    return docs.select(
        "doc_id",
        name.alias("filename"),
        F.sha2("text", 256).alias("file_hash"),
        F.octet_length("text").cast("long").alias("file_size"),
    )


@register("file_manifest", f"WITH {FILES_SQL} SELECT filename, file_hash, file_size FROM files")
def file_manifest(spark, sf_dir):
    return _files(spark, sf_dir).select("filename", "file_hash", "file_size")


@register(
    "manifest_merge",
    f"""WITH {FILES_SQL},
    old AS (SELECT file_hash, min(filename) AS filename FROM files WHERE is_known GROUP BY 1),
    new AS (SELECT file_hash, min(filename) AS filename FROM files WHERE NOT is_known GROUP BY 1)
    SELECT coalesce(o.file_hash, n.file_hash) AS file_hash, coalesce(o.filename, n.filename) AS filename,
      CASE WHEN n.file_hash IS NOT NULL THEN 'new' ELSE 'old' END AS profile, coalesce(o.filename, NULL) AS first_seen
    FROM old o FULL JOIN new n ON o.file_hash = n.file_hash""",
)
def manifest_merge(spark, sf_dir):
    files = _files(spark, sf_dir)

    def manifest(rows, profile, key):
        one = rows.groupBy("file_hash").agg(
            F.min("filename").alias("filename"), F.min("file_size").alias("file_size"), F.count("*").alias("record_count")
        )
        pairs = [F.lit("profile"), F.lit(profile), F.lit(key), F.col("filename")]
        return one.withColumn("metadata", F.create_map(*pairs))

    merged = mf.merge_manifest(
        manifest(files.filter("doc_id % 3 = 0"), "old", "first_seen"),
        manifest(files.filter("doc_id % 3 <> 0"), "new", "last_seen"),
    )
    return merged.select(
        "file_hash", "filename", F.col("metadata")["profile"].alias("profile"), F.col("metadata")["first_seen"].alias("first_seen")
    )


@register(
    "known_file",
    f"""WITH {FILES_SQL} SELECT filename, file_hash IN (SELECT file_hash FROM files WHERE is_known) AS is_known
    FROM files WHERE NOT is_known""",
)
def known_file(spark, sf_dir):
    files = _files(spark, sf_dir)
    manifest, incoming = files.filter("doc_id % 3 = 0"), files.filter("doc_id % 3 <> 0")
    known = mf.known_files(incoming, manifest).select("filename", F.lit(True).alias("is_known"))
    return known.unionByName(mf.new_files(incoming, manifest).select("filename", F.lit(False).alias("is_known")))


@register(
    "file_union_dedupe",
    f"WITH {FILES_SQL} SELECT filename FROM files WHERE NOT contains(filename, ' (1)')",
)
def file_union_dedupe(spark, sf_dir):
    return mf.without_copies(_files(spark, sf_dir)).select("filename")


@register(
    "pii_scan",
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
    hits AS (SELECT doc_id, line_no, line, unnest([
      CASE WHEN regexp_matches(line, '\b\d{4}[\s-]\d{4}[\s-]\d{4}\b') THEN 'Aadhaar number (NNNN NNNN NNNN)' END,
      CASE WHEN regexp_matches(line, '\b[A-Z]{5}\d{4}[A-Z]\b') THEN 'PAN card number' END,
      CASE WHEN regexp_matches(line, '(?:\+91[\s-]?|\b0)[6-9]\d{9}\b') THEN 'Indian phone number' END,
      CASE WHEN len(list_filter(regexp_extract_all(line, '(?i)(?:password|passwd|pwd|secret|api_key)\s*=\s*[''"]([a-zA-Z0-9@#$%^&*!]{4,})[''"]', 1),
        lambda v: NOT regexp_matches(v, '(?i)^(test|changeme|example|dummy|fake|placeholder)|^secret$'))) > 0
        THEN 'Possible hardcoded password (use env vars instead)' END,
      CASE WHEN len(list_filter(regexp_extract_all(line, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b'),
        lambda v: NOT regexp_matches(v, '@(example\.com|example\.org|anthropic\.com|users\.noreply\.github\.com)\b'))) > 0
        THEN 'Email address (use @example.com for tests)' END]) AS label FROM lines)
    SELECT doc_id, line_no, label, trim(line)[1:120] AS excerpt FROM hits WHERE label IS NOT NULL""",
)
def pii_scan(spark, sf_dir):
    return ql.pii_scan(spread(table(spark, sf_dir, "documents")))


@register(
    "referential_checks",
    oracle(
        """SELECT 'merchant' AS reference, count(*) AS n FROM ledger WHERE merchant_id NOT IN (SELECT id FROM merchants)
    UNION ALL SELECT 'category', count(*) FROM ledger WHERE category_id NOT IN (SELECT id FROM categories)
    UNION ALL SELECT 'reconciled_with', count(*) FROM ledger WHERE reconciled_with_id NOT IN (SELECT id FROM ledger)
    UNION ALL SELECT 'category_name', count(*) FROM (SELECT name, parent_id FROM categories GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'unknown_value', count(*) FROM ledger WHERE source_type NOT IN ('splitwise', 'bank_csv', 'bank_pdf', 'credit_card_pdf', 'manual')
      OR transaction_type NOT IN ('expense', 'income', 'transfer', 'payment')
    UNION ALL SELECT 'transaction_id', count(*) FROM (SELECT id FROM ledger GROUP BY ALL HAVING count(*) > 1)"""
    ),
)
def referential_checks(spark, sf_dir):
    rows, cats = ledger(spark, sf_dir), categories(spark, sf_dir)
    checks = {
        "merchant": ql.orphans(rows, "merchant_id", merchants(spark, sf_dir)),
        "category": ql.orphans(rows, "category_id", cats),
        "reconciled_with": ql.orphans(rows, "reconciled_with_id", rows),
        "category_name": ql.repeated(cats, "name", "parent_id"),
        "unknown_value": ql.unknown_values(rows),
        "transaction_id": ql.repeated(rows, "id"),
    }
    out = None
    for name, bad in checks.items():
        part = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("reference"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "repeated_keys",
    statement_oracle("SELECT id, count(*) AS n FROM ledger GROUP BY 1 HAVING count(*) > 1"),
)
def repeated_keys(spark, sf_dir):
    return ql.repeated(statement_ledger(spark, sf_dir), "id")
