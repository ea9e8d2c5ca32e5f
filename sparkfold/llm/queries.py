"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_search import top_k
from .graph_search import nearest
from .html_text import extract
from .licenses import TEMPLATES, scan
from .mixing import mix
from .near_dedup import near_duplicate_classes
from .packing import pack
from .pii import digests, find_pii
from .quality import classify
from .substrings import remove_repeats


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")



def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _licenses_sql() -> str:
    values = ", ".join(f"({i}, '{label}', {len(set(t.lower().split()))}, {sorted(set(t.lower().split()))})" for i, (t, label) in enumerate(TEMPLATES.items()))
    longest = max(len(t.split()) for t in TEMPLATES)
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    ascii_lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, hash(text) AS h, {ascii_lower.format("coalesce(text, '')")} AS text FROM documents),
w AS (SELECT doc_id, h, text, regexp_extract_all(text, {word}) AS w FROM d),
p AS (SELECT doc_id, h, text, len(w) AS n_words,
        list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc,
        list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl,
        list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS res FROM w),
t AS (SELECT * FROM (VALUES {values}) v(template, label, m, words)),
l AS (SELECT k, i, w, len(w) AS n, sum(len(w)) OVER u AS upto, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER u AS blanks
      FROM (SELECT (doc_id, h) AS k, generate_subscripts(lines, 1) AS i, regexp_extract_all(unnest(lines), {word}) AS w FROM (SELECT DISTINCT doc_id, h, string_split(text, chr(10)) AS lines FROM d))
      WINDOW u AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT DISTINCT x.k[1] AS doc_id, x.k[2] AS h, list_sort(list_distinct(flatten(list(y.w)))) AS bw
      FROM l x JOIN l y ON x.k = y.k AND y.i BETWEEN x.i AND x.i + {longest} AND y.blanks = x.blanks AND y.upto - y.n - x.upto < {longest}
      WHERE x.n > 0 GROUP BY x.k, x.i),
c AS (SELECT doc_id, h, label, len(list_intersect(bw, words)) / m AS containment FROM b, t WHERE len(list_intersect(bw, words)) >= ceil(0.9 * m - 1e-9)),
k AS (SELECT doc_id, h, list(DISTINCT label) AS more, max(containment) AS top FROM c GROUP BY doc_id, h),
x AS (SELECT p.*, list_concat(CASE WHEN len(cc) > 0 THEN ['cc-by'] ELSE [] END, CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END, CASE WHEN len(res) > 0 THEN ['reserved'] ELSE [] END) AS base, more, top
      FROM p LEFT JOIN k ON p.doc_id IS NOT DISTINCT FROM k.doc_id AND p.h = k.h)
SELECT doc_id, n_words, CAST(len(cc) + len(gpl) + len(res) AS BIGINT) AS n_base,
       list_min(list_concat(cc, gpl, res)) - 1 AS first_word, list_max(list_concat(cc, gpl, res)) - 1 AS last_word,
       array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
       CAST(CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(top, 0.0) END AS DOUBLE) AS score
FROM x"""


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False))


QUERIES = {"op1_packing": op1_packing, "op2_near_dedup": op2_near_dedup, "op3_licenses": op3_licenses, "op4_repeats": op4_repeats, "op5_neighbours": op5_neighbours, "op6_html_text": op6_html_text, "op7_mixing": op7_mixing, "op8_quality": op8_quality, "op9_top_k": op9_top_k, "op10_pii": op10_pii}
ORACLES: dict[str, str] = {
    "op3_licenses": _licenses_sql(),
    "op9_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
""",
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM sized),
b AS (SELECT total, max(x) AS block FROM n, (VALUES (1), (2), (4), (8), (16), (32), (64)) t(x) WHERE x = 1 OR total >= 4096 * x GROUP BY total),
o AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM sized GROUP BY source),
w AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM o),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER (ORDER BY cap / weight, ord ROWS UNBOUNDED PRECEDING) - cap))
                / sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, ord, least(cap, max(lev) OVER () * weight) AS target FROM l),
e AS (SELECT *, CAST(round(sum(target) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * 4294967296) AS BIGINT) AS hi FROM t WHERE target > 0),
s AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY ord), 0) AS lo FROM e),
p AS (SELECT CAST((CAST(i AS HUGEINT) * 2654435769) % 4294967296 AS BIGINT) AS point FROM b, unnest(range(1, CAST(ceil(total / block) AS BIGINT) + 1)) r(i)),
c AS (SELECT ord, count(*) AS slots FROM s JOIN p ON point >= lo AND point < hi GROUP BY ord),
d AS (SELECT z.doc_id, z.size, t.source_size, t.target, t.ord, sum(z.size) OVER (PARTITION BY z.source ORDER BY h, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) - z.size AS start
      FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(start + size, coalesce(slots, 0) * block) - start)
  + greatest(0, least(start + source_size + size, coalesce(slots, 0) * block) - start - source_size)
  + greatest(0, least(start + 2 * source_size + size, coalesce(slots, 0) * block) - start - 2 * source_size) AS BIGINT) AS taken
FROM d CROSS JOIN b LEFT JOIN c ON c.ord = d.ord
""",
}
