"""Documents linked by the similarity of their three-word shingles."""

from passbook.llm.common import table
from passbook.llm.ngram_join import PERCENT, similar_documents
from passbook.plans.registry import register

SQL = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
  s AS (
    SELECT DISTINCT doc_id, shingle FROM (
      SELECT doc_id, unnest(CASE WHEN len(words) BETWEEN 1 AND 2 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle FROM d)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
  links AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * n_both >= {PERCENT} * (x.n + y.n - n_both)),
  reached AS (
    SELECT DISTINCT doc_id, doc_id AS other FROM documents
    UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other),
  least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""


@register("op12_ngram_join", SQL)
def op12_ngram_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))
