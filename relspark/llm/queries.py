"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.decontaminate import contamination
from relspark.llm.exact_dedup import exact_dedup
from relspark.llm.line_dedup import dedup_lines
from relspark.llm.mixing import mix_sources
from relspark.llm.ngram_join import ngram_join
from relspark.llm.quality import score_quality, train
from relspark.llm.secret_scan import ACCESS, ASSIGN, BLANK, ENDPOINT, HEX, ID, MIN_ACCESS, MIN_ASSIGN, WEAK, joined_spans, scan_secrets
from relspark.llm.sharding import compact_into_shards
from relspark.llm.substring_dedup import dedup_substrings
from relspark.llm.url_filter import filter_urls


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages", "page_id", "url"))


def op3_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compact_into_shards(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "shard", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.concat("assign", "access", "hex")
    order = ["assign", "access", "hex", "id", "weak", "bare", "endpoint"]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in order[:3]),
        F.sha2(joined_spans(base, order), 256).alias("base_sha256"),
        joined_spans(F.concat(base, F.col("linked")), order).alias("spans"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return score_quality(docs, train(docs, _read(spark, sf_dir, "labels")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"), copy_col="copy")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_read(spark, sf_dir, "documents", "doc_id", "text"), extend=True, min_words=20, max_words=20, cut_every=3)
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_line_dedup, op2_url_filter, op3_size_tiered_compaction, op4_decontaminate, op5_secret_scan,
        op6_quality, op7_source_mix, op8_ngram_join, op9_exact_dedup, op10_substring_dedup,
    )
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = rf"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
frequent AS (
  SELECT k, max(doc_id) AS keep_id FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.i, l.line, coalesce(f.keep_id <> l.doc_id, false) AS gone FROM lines l LEFT JOIN frequent f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP2 = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(split_part(rest, '/', 1), '{_UPPER}', '{_LOWER}') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM cut),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS place
  FROM split s LEFT JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""

_OP7 = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS all_size, sum(sqrt(size)) AS all_w FROM sizes),
rates AS (
  SELECT source, CASE WHEN size > 0 AND all_w > 0 THEN 1.0::DOUBLE * sqrt(size) / all_w * all_size / size ELSE 1.0::DOUBLE END AS rate FROM sizes, totals),
parted AS (SELECT source, rate, greatest(ceil(rate / 64)::INT, 1) AS parts FROM rates),
steps AS (
  SELECT source, parts, n, sum(exp(-rate / parts + n * ln(rate / parts) - lgamma(n + 1))) OVER (PARTITION BY source ORDER BY n) AS below
  FROM parted, range(0, 200) t(n)),
draws AS (
  SELECT d.doc_id, d.text, d.source, p.rate,
         ('0x' || substr(md5('count-42:' || d.doc_id || ':' || md5(coalesce(d.text, '')) || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source, range(1, 2) t(i)),
counted AS (
  SELECT d.doc_id, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.below <= d.u) AS n FROM draws d)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.copy::INT AS copy
FROM documents d JOIN counted c USING (doc_id), range(0, 200) t(copy) WHERE t.copy < c.n
"""

_OP9 = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS digest, length(coalesce(text, '')) AS n FROM documents),
best AS (
  SELECT doc_id, digest, first_value(doc_id) OVER (PARTITION BY digest ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size
  FROM keyed)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM best
"""

_OP4 = rf"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM item_words WHERE len(w) > 0))),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.n, d.i, m.item_id FROM doc_windows d JOIN item_windows m ON d.n = m.n AND d.g = m.g),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""

_OP8 = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, w, least(3, len(w)) AS k FROM doc_words WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 90 * (s.n + t.n - count(*))),
reach(x, y) AS (SELECT DISTINCT x, x FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM doc_words d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS root FROM reach GROUP BY x) c USING (doc_id)
"""


def _op5_sql(reach: int = 200) -> str:
    """Spans by the same marks, then the links as joins of spans."""

    def spans(kind: str, pattern: str, keep: str = "true") -> str:
        p = pattern.replace("'", "''")
        return f"""
  SELECT doc_id, '{kind}' AS kind, CASE WHEN i = 0 THEN 0 ELSE list_sum(list_transform(p[1:i], lambda y: length(y))) END AS s, length(p[i + 1]) AS n, p[i + 1] AS m
  FROM (SELECT doc_id, p, unnest(range(1, len(p), 2)) AS i
        FROM (SELECT doc_id, string_split(regexp_replace(t, '({p})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM texts)) WHERE {keep.format(p=p)}"""

    assign = spans("assign", ASSIGN, f"length(regexp_extract(p[i + 1], '{{p}}', 2)) >= {MIN_ASSIGN}")
    access = spans("access", ACCESS, f"length(p[i + 1]) >= {MIN_ACCESS}")
    rest = [spans(k, p) for k, p in (("hex", HEX), ("id", ID), ("weak", WEAK), ("endpoint", ENDPOINT), ("break", BLANK))]
    near = f"a.doc_id = b.doc_id AND a.scope = b.scope AND a.s - {reach} <= b.e AND b.s - {reach} <= a.e"
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
found AS ({" UNION ALL ".join([assign, access, *rest])}),
spans AS (SELECT doc_id, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM found),
placed AS (
  SELECT a.doc_id, a.kind, a.s, a.e, (SELECT count(*) FROM spans b WHERE b.doc_id = a.doc_id AND b.kind = 'break' AND b.s < a.s) AS scope
  FROM spans a WHERE a.kind <> 'break' AND NOT (a.kind = 'weak' AND EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.kind = 'assign' AND b.s < a.e AND a.s < b.e))),
names AS (SELECT * FROM placed WHERE kind IN ('id', 'access')),
keys AS (SELECT * FROM placed WHERE kind IN ('weak', 'assign')),
linked_names AS (SELECT * FROM names a WHERE EXISTS (SELECT 1 FROM keys b WHERE {near})),
linked_keys AS (SELECT * FROM keys a WHERE EXISTS (SELECT 1 FROM names b WHERE {near})),
linked_places AS (SELECT * FROM placed a WHERE kind = 'endpoint' AND EXISTS (SELECT 1 FROM linked_keys b WHERE {near})),
reported AS (
  SELECT doc_id, kind, s, e FROM spans WHERE kind IN ('assign', 'access', 'hex')
  UNION ALL SELECT doc_id, kind, s, e FROM linked_names WHERE kind = 'id'
  UNION ALL SELECT doc_id, kind, s, e FROM linked_keys WHERE kind = 'weak'
  UNION ALL SELECT doc_id, kind, s, e FROM linked_places),
ordered AS (
  SELECT doc_id, kind, s, list_position(['assign', 'access', 'hex', 'id', 'weak', 'endpoint'], kind) AS k, kind || ':' || s || ':' || e AS line FROM reported)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(line, ',' ORDER BY s, k) FILTER (WHERE k <= 3), '')) AS base_sha256, coalesce(string_agg(line, ',' ORDER BY s, k), '') AS spans
FROM documents d LEFT JOIN ordered o ON o.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": _OP1, "op2_url_filter": _OP2, "op4_decontaminate": _OP4, "op5_secret_scan": _op5_sql(), "op7_source_mix": _OP7,
        "op8_ngram_join": _OP8, "op9_exact_dedup": _OP9,
    }
