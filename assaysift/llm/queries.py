"""Registered queries of this package and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaysift.llm import ann, bpe, decontaminate, fim, html, licenses, lines, minhash, quality, resample, topk, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link documents whose 5-word shingle sets have a similarity of 0.85 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 85, 100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop lines of 40 code points or more that 5 documents or more hold."""
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"), 40, 5)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256")
    )


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encode whole texts and decode their ids."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip_digests(spark, bpe.encode(_table(spark, sf_dir, "documents"), path), path)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find licence phrases and, with edits, licence notices."""
    return licenses.summary(licenses.scan(_table(spark, sf_dir, "documents")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List documents that hold a benchmark item, as it is or edited."""
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search every twentieth vector among all vectors."""
    vectors = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), topk.integer_vector(F.col("embedding")).alias("v")
    )
    return topk.top_k(vectors.filter(F.col("id") % 20 == 0), vectors, 20)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the article of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's address."""
    return urls.judge(_table(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit an archive of all pages against a replica in which a few records are damaged or lost.

    The replica is derived from the pages: records whose address has a digest beginning with 00 have their first character
    replaced, those with 01 are lost.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    start = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 2)
    damaged = F.when((start == "00") & (F.ascii("html") < 128), F.overlay("html", F.lit("#"), 1)).otherwise(F.col("html"))
    lost = pages.filter(start == "01").select(F.col("page_id").alias("record")).distinct()
    replica = warc.catalogue(pages, damaged).join(lost, "record", "left_anti")
    out = warc.audit(warc.catalogue(pages), replica)
    return out.select(F.col("record").alias("page_id"), F.col("file").alias("warc_file"), "offset", "length", "status")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the quality of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rearrange whole texts for filling in the middle, and restore them."""
    return fim.restore(fim.transform(_table(spark, sf_dir, "documents")), keep_text=False)


def op12_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search every twentieth vector among all vectors, by an index."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ann.search(ann.build_index(vectors, 20), vectors.filter(F.col("id") % 20 == 0))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw documents towards the word runs of the benchmark."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Return one callable per operator of this package."""
    every = (
        op1_minhash_near_dedup,
        op2_line_dedup,
        op3_bpe,
        op4_license_scan,
        op5_decontaminate,
        op6_exact_top_k,
        op7_main_text,
        op8_url_filter,
        op9_warc_fixity,
        op10_quality,
        op11_fill_in_middle,
        op12_stable_projection_ann,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i+4])) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
class AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, max(n) AS n FROM sized WHERE n > 0 GROUP BY list_sort(s)),
member AS (SELECT d.doc_id, c.rep FROM sized d JOIN class c ON c.n = d.n AND c.s = list_sort(d.s)),
grams AS (SELECT rep, n, hash(g) AS g FROM (SELECT rep, n, unnest(s) AS g FROM class)),
often AS (SELECT g, count(*) AS df FROM grams GROUP BY g),
ranked AS (
  SELECT rep, n, g, df, row_number() OVER (PARTITION BY rep ORDER BY df, g) AS r FROM grams JOIN often USING (g)),
pref AS (SELECT rep, n, g FROM ranked WHERE df > 1 AND r <= n - ceil(0.85 * n) + 1),
cand AS (
  SELECT DISTINCT a.rep AS x, b.rep AS y FROM pref a JOIN pref b ON a.g = b.g AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
both_ AS (
  SELECT x, y, count(*) AS i FROM cand JOIN grams p ON p.rep = x JOIN grams q ON q.rep = y AND q.g = p.g GROUP BY x, y),
link AS (
  SELECT x, y FROM both_ JOIN class a ON a.rep = x JOIN class b ON b.rep = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
edge AS (SELECT x AS a, y AS b FROM link UNION SELECT y, x FROM link),
reach AS (SELECT DISTINCT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, coalesce(c.c, m.rep, d.doc_id) AS component_id,
       coalesce(c.c, m.rep, d.doc_id) = d.doc_id AS kept
FROM sized d LEFT JOIN member m ON m.doc_id = d.doc_id LEFT JOIN comp c ON c.rep = m.rep
"""

OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, (c.k IS NOT NULL AND doc_id <> keeper) AS gone FROM keyed LEFT JOIN common c USING (k))
SELECT doc_id, count(*) AS n_lines, sum(CAST(gone AS INTEGER))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP6_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(url, ''))[1:2] AS d, CAST(floor(page_id / 2048) AS BIGINT) AS warc_file, html,
    octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) ||
      'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') ||
      chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) ||
      chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))) AS length
  FROM pages),
o AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY warc_file ORDER BY page_id) - length AS BIGINT) AS "offset" FROM p)
SELECT page_id, warc_file, "offset", length, CASE d WHEN '00' THEN 'changed' ELSE 'missing' END AS status
FROM o WHERE d = '01' OR (d = '00' AND html IS NOT NULL AND html <> '' AND html[1:1] <> '#' AND ascii(html) < 128)
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, x, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS g FROM d),
p AS (
  SELECT doc_id, x, t, len(t) AS n, g[1] % (len(t) + 1) AS a, g[2] % (len(t) + 1) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR g[3] % 100 >= 50 THEN 'plain'
      WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT doc_id, x, n, form, array_to_string(t[1:least(a, b)], '') AS pre, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS mid,
    array_to_string(t[greatest(a, b) + 1:], '') AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM c
"""


def oracle_sql() -> dict[str, str]:
    """Return reference SQL where SQL can express a query."""
    return {
        "op1_minhash_near_dedup": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op6_exact_top_k": OP6_SQL,
        "op9_warc_fixity": OP9_SQL,
        "op11_fill_in_middle": OP11_SQL,
    }
