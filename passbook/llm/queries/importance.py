"""Documents drawn towards the benchmark."""

from passbook.llm.common import table
from passbook.llm.importance import BUCKETS, MIN_WORDS, SEED, resample
from passbook.llm.queries.crc import CRC32, CRC32_TABLE
from passbook.plans.registry import register

PERCENT = 10

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+')"""

SQL = f"""
WITH {CRC32_TABLE},
  d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
  dw AS (SELECT r, unnest(words) AS w FROM d),
  bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
  b AS (SELECT w, {CRC32.format(text="w")} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
  raw AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (w) GROUP BY bucket),
  aim AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (w) GROUP BY bucket),
  gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS}))))::BIGINT AS g
    FROM raw FULL JOIN aim USING (bucket)),
  weights AS (SELECT r, sum(g)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN gain USING (bucket) GROUP BY r),
  scored AS (
    SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
        / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (r)),
  ranked AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n
    FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)"""


@register("op11_importance_resampling", SQL)
def op11_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), PERCENT)
