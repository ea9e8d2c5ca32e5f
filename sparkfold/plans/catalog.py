"""The registered queries of the reduction engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import delta, lz4, patch, unlz4
from ..functions.scalars import as_bytes, byte_sum, container_name, decrypt, encrypt, fingerprint, keyed_token, name_hash, sketch_positions
from ..functions.superfeatures import super_feature
from ..operators import containers, dedup, metrics, similarity
from ..operators.chunking import SMALL, ChunkSpec, cdc_chunks, fixed_chunks
from ..runtime import keep, load, shared_folder
from ..sources.streams import mutated, numbered, synthetic_payload, text_stream, trace, trace_line
from ..streaming.ingest import chunk_stream, ingest_streams, run_to_end, unique_chunks
from .reports import chunk_log
from .store import POLICIES, Options, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIZE = 512
#: Sizes of content-defined chunks that short texts have several of.
TINY = ChunkSpec(16, 32, 64)
KEY = b"0123456789abcdef"
#: The chunks of documents: doc_id, source, seq, off, c (bytes), fp.
CHUNKS = f"""ch AS (SELECT doc_id, source, o // {SIZE} AS seq, o AS off, encode(text)[o + 1 : o + {SIZE}] AS c, sha256(encode(text)[o + 1 : o + {SIZE}]) AS fp
  FROM documents, unnest(range(0, octet_length(encode(text)), {SIZE})) t(o))"""


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stream(load(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, doc_id, seq, offset, fp, chunk_size of all documents in chunks of SIZE bytes, without payload."""
    rows = fixed_chunks(streams(spark, sf_dir), "payload", SIZE, ("source", "doc_id"))
    return rows.select("source", "doc_id", "seq", "offset", fingerprint(F.col("chunk")).alias("fp"), F.length("chunk").cast("long").alias("chunk_size"))


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY doc_id")
def fixed_chunk_count(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@query(f"WITH {CHUNKS} SELECT CAST(octet_length(c) AS BIGINT) AS chunk_size, count(*) AS n_chunks FROM ch GROUP BY ALL")
def fixed_chunk_sizes(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("chunk_size").agg(F.count("*").alias("n_chunks"))


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(off AS BIGINT) AS off, CAST(octet_length(c) AS BIGINT) AS chunk_size, fp FROM ch")
def chunk_fingerprints(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "seq", F.col("offset").alias("off"), "chunk_size", "fp")


@query("SELECT doc_id, sha1(encode(text)) AS by_sha1, md5(encode(text)) AS by_md5 FROM documents")
def other_digests(spark, sf_dir):
    return streams(spark, sf_dir).select("doc_id", fingerprint(F.col("payload"), "sha1").alias("by_sha1"), fingerprint(F.col("payload"), "md5").alias("by_md5"))


_RATIO = f"""WITH {CHUNKS}, d AS (SELECT {{key}} fp, count(*) AS n, any_value(octet_length(c)) AS one FROM ch GROUP BY ALL)
SELECT {{key}} CAST(sum(n) AS BIGINT) AS logical_chunks, count(*) AS unique_chunks, CAST(sum(n * one) AS BIGINT) AS logical_bytes, CAST(sum(one) AS BIGINT) AS unique_bytes,
  CAST(sum(n * one) AS DOUBLE) / CAST(sum(one) AS DOUBLE) AS dedup_ratio FROM d GROUP BY ALL"""


@query(_RATIO.format(key="source,"))
def exact_dedup_ratio_by_source(spark, sf_dir):
    return metrics.dedup_ratio(chunks(spark, sf_dir), ("source",))


@query(_RATIO.format(key=""))
def exact_dedup_overall(spark, sf_dir):
    return metrics.dedup_ratio(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT fp, doc_id, CAST(seq AS BIGINT) AS seq FROM ch QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id, seq) = 1")
def first_occurrence_chunks(spark, sf_dir):
    return dedup.first_occurrences(chunks(spark, sf_dir).select("fp", "doc_id", "seq"), ("doc_id", "seq"))


_PLACED = f"{CHUNKS}, pl AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, seq) - 1 AS place FROM ch)"


@query(
    f"""WITH {_PLACED}, r AS (SELECT source, place // 128 AS batch, row_number() OVER (PARTITION BY source, place // 128, fp ORDER BY place) > 1 AS repeated FROM pl)
SELECT source, CAST(batch AS BIGINT) AS batch, count(*) AS n, CAST(sum(CASE WHEN repeated THEN 1 ELSE 0 END) AS BIGINT) AS repeats FROM r GROUP BY ALL"""
)
def batch_local_duplicates(spark, sf_dir):
    placed = numbered(chunks(spark, sf_dir), "source", ("doc_id", "seq"))
    marked = dedup.batch_flags(placed, ("source",), "place")
    return marked.groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum(F.col("repeated").cast("long")).alias("repeats"))


@query(f"WITH {CHUNKS} SELECT fp, count(*) AS freq FROM ch GROUP BY fp")
def chunk_frequency(spark, sf_dir):
    return dedup.frequencies(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT fp, count(*) AS freq FROM ch GROUP BY fp ORDER BY freq DESC, fp LIMIT 100")
def top_k_chunks(spark, sf_dir):
    return dedup.top_k(chunks(spark, sf_dir), 100)


@query(f"WITH {CHUNKS} SELECT fp, count(*) AS freq, true AS bounded FROM ch GROUP BY fp")
def cms_upper_bound(spark, sf_dir):
    return dedup.sketch_estimates(chunks(spark, sf_dir)).select("fp", "freq", (F.col("estimate") >= F.col("freq")).alias("bounded"))


_WORD = "CAST(('0x' || substr(fp, {3}, 2) || substr(fp, {2}, 2) || substr(fp, {1}, 2) || substr(fp, {0}, 2)) AS BIGINT) % 262144"


@query(f"WITH {CHUNKS} SELECT DISTINCT fp, " + ", ".join(_WORD.format(*[i * 8 + 2 * b + 1 for b in range(4)]) + f" AS p{i}" for i in range(4)) + " FROM ch")
def cms_positions(spark, sf_dir):
    at = sketch_positions(F.col("fp"))
    return chunks(spark, sf_dir).select("fp").distinct().select("fp", *[at[i].alias(f"p{i}") for i in range(4)])


_CELLS = ", ".join(f"({i}, {_WORD.format(*[i * 8 + 2 * b + 1 for b in range(4)]).replace('262144', '64')})" for i in range(4))


@query(
    f"""WITH {CHUNKS}, x AS (SELECT doc_id, seq, fp, i, p, count(*) OVER (PARTITION BY i, p ORDER BY doc_id, seq ROWS UNBOUNDED PRECEDING) AS cell FROM ch, LATERAL (VALUES {_CELLS}) t(i, p))
SELECT doc_id, CAST(seq AS BIGINT) AS seq, min(cell) AS estimate FROM x GROUP BY ALL"""
)
def cms_running_estimates(spark, sf_dir):
    return dedup.running_estimates(chunks(spark, sf_dir), ("doc_id", "seq"), width=64).select("doc_id", "seq", "estimate")


@query(f"WITH {CHUNKS}, u AS (SELECT fp, min(doc_id) AS doc_id FROM ch GROUP BY fp) SELECT * FROM u WHERE NOT starts_with(fp, 'a1')")
def delta_candidates(spark, sf_dir):
    fresh = dedup.first_occurrences(chunks(spark, sf_dir).select("fp", "doc_id", "seq"), ("doc_id", "seq"))
    return similarity.may_be_delta(fresh, "a1").select("fp", "doc_id")


@query(f"WITH {CHUNKS} SELECT source, fp, count(*) AS n, fp IN (SELECT fp FROM ch WHERE source = 'src0') AS duplicate FROM ch GROUP BY source, fp")
def probe_with_hot_chunks(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    stored = rows.filter("source = 'src0'")
    return dedup.probe(rows, stored, dedup.top_k(rows, 1000)).groupBy("source", "fp").agg(F.count("*").alias("n"), F.max("duplicate").alias("duplicate"))


@query(f"WITH {CHUNKS} SELECT DISTINCT a.source, a.fp FROM ch a ANTI JOIN ch b ON a.fp = b.fp AND b.source = 'src0' WHERE a.source = 'src1'")
def new_chunks_vs_other_source(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("source", "fp").distinct()
    return dedup.new_chunks(rows.filter("source = 'src1'"), rows.filter("source = 'src0'")).select("source", "fp")


@query(f"WITH {CHUNKS} SELECT fp, CAST(count(DISTINCT source) AS BIGINT) AS n_sources FROM ch GROUP BY fp HAVING count(DISTINCT source) > 1")
def shared_chunks_between_sources(spark, sf_dir):
    pairs = chunks(spark, sf_dir).select("fp", "source").distinct()
    return pairs.groupBy("fp").agg(F.count("source").alias("n_sources")).filter("n_sources > 1")


@query(f"WITH {CHUNKS} (SELECT fp FROM ch WHERE source = 'src0') INTERSECT (SELECT fp FROM ch WHERE source <> 'src0')")
def chunks_known_elsewhere(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("fp", "source")
    return dedup.known_chunks(rows.filter("source = 'src0'").select("fp").distinct(), rows.filter("source <> 'src0'"))


_RUNNING = f"""{CHUNKS}, f AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY source, doc_id, seq) = 1 AS fresh FROM ch),
per AS (SELECT source AS backup, CAST(sum(octet_length(c)) AS BIGINT) AS logical_bytes, CAST(sum(CASE WHEN fresh THEN octet_length(c) ELSE 0 END) AS BIGINT) AS stored_bytes FROM f GROUP BY source)"""


@query(
    f"""WITH {_RUNNING} SELECT *, CAST(sum(logical_bytes) OVER w AS BIGINT) AS logical_total, CAST(sum(stored_bytes) OVER w AS BIGINT) AS stored_total,
CAST(sum(logical_bytes) OVER w AS DOUBLE) / CAST(sum(stored_bytes) OVER w AS DOUBLE) AS reduction FROM per WINDOW w AS (ORDER BY backup ROWS UNBOUNDED PRECEDING)"""
)
def cumulative_reduction_ratio(spark, sf_dir):
    return metrics.running_reduction(per_source(spark, sf_dir))


def per_source(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    first = dedup.first_occurrences(rows, ("source", "doc_id", "seq")).groupBy("source").agg(F.sum("chunk_size").alias("stored_bytes"))
    seen = rows.groupBy("source").agg(F.sum("chunk_size").alias("logical_bytes"))
    return seen.join(first, "source", "left").select(F.col("source").alias("backup"), "logical_bytes", F.coalesce("stored_bytes", F.lit(0)).cast("long").alias("stored_bytes"))


@query(f"WITH {_RUNNING} SELECT backup, CAST(avg(logical_bytes) OVER (ORDER BY backup ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS mean_bytes FROM per")
def running_average_bytes(spark, sf_dir):
    return metrics.running_mean(per_source(spark, sf_dir), "logical_bytes", "backup", "mean_bytes").select("backup", "mean_bytes")


@query(f"WITH {_RUNNING} SELECT max_by(stored_bytes, backup) AS stored_bytes FROM per")
def last_row_report(spark, sf_dir):
    return metrics.last_value(per_source(spark, sf_dir), "stored_bytes", "backup")


@query(f"WITH {_RUNNING} SELECT avg(logical_bytes) AS mean_logical, max_by(logical_bytes, backup) AS last_logical FROM per")
def column_mean_report(spark, sf_dir):
    return per_source(spark, sf_dir).agg(F.avg("logical_bytes").alias("mean_logical"), F.max_by("logical_bytes", "backup").alias("last_logical"))


_SWEEP = " UNION ALL ".join(
    f"SELECT {s} AS size, CAST(sum(n * one) AS DOUBLE) / CAST(sum(one) AS DOUBLE) AS ratio FROM (SELECT count(*) AS n, any_value(octet_length(encode(text)[o + 1 : o + {s}])) AS one FROM documents, unnest(range(0, octet_length(encode(text)), {s})) t(o) GROUP BY sha256(encode(text)[o + 1 : o + {s}]))"
    for s in (256, 512, 1024, 4096)
)


@query(_SWEEP)
def chunk_size_sweep(spark, sf_dir):
    sizes = []
    for size in (256, 512, 1024, 4096):
        rows = fixed_chunks(streams(spark, sf_dir), "payload", size).select(fingerprint(F.col("chunk")).alias("fp"), F.length("chunk").cast("long").alias("chunk_size"))
        sizes.append(metrics.dedup_ratio(rows).select(F.lit(size).alias("size"), F.col("dedup_ratio").alias("ratio")))
    out = sizes[0]
    for df in sizes[1:]:
        out = out.unionByName(df)
    return out


@query(f"WITH {CHUNKS} SELECT 0 AS orphans, count(*) AS entries FROM ch")
def recipe_integrity(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    stored = dedup.first_occurrences(rows.select("fp", "doc_id", "seq"), ("doc_id", "seq"))
    marked = dedup.probe(rows, stored)
    return marked.agg(F.sum((~F.col("duplicate")).cast("int")).cast("int").alias("orphans"), F.count("*").alias("entries"))


@query(f"WITH {CHUNKS}, d AS (SELECT count(DISTINCT fp) AS n, sum(octet_length(c)) AS b FROM ch) SELECT CAST(n * 80 AS BIGINT) AS fp_bytes, CAST(n * 80 * 100 AS DOUBLE) / CAST(b AS DOUBLE) AS fp_percent FROM d")
def fp_index_size_overhead(spark, sf_dir):
    total = metrics.dedup_ratio(chunks(spark, sf_dir))
    zero = F.lit(0)
    size = metrics.index_bytes(F.col("unique_chunks"), zero, zero, zero)["fp_bytes"]
    return total.select(size.alias("fp_bytes"), (size * 100 / F.col("logical_bytes")).alias("fp_percent"))


_FRESH = f"{CHUNKS}, u AS (SELECT fp, source, doc_id, seq, octet_length(c) AS n FROM ch QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id, seq) = 1)"


@query(
    f"""WITH {_FRESH}, r AS (SELECT source, n, CAST(floor((sum(n) OVER (PARTITION BY source ORDER BY doc_id, seq ROWS UNBOUNDED PRECEDING) - n) / 65536) AS BIGINT) AS container FROM u)
SELECT source, container, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS bytes FROM r GROUP BY ALL"""
)
def container_packing_running_sum(spark, sf_dir):
    fresh = dedup.first_occurrences(chunks(spark, sf_dir), ("doc_id", "seq"))
    packed = containers.pack_approximately(fresh, ("doc_id", "seq"), "chunk_size", ("source",), 65536)
    return packed.groupBy("source", "container").agg(F.count("*").alias("n_chunks"), F.sum("chunk_size").alias("bytes"))


@query(f"WITH {_FRESH} SELECT source, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS bytes, true AS fits FROM u GROUP BY source")
def container_packing_exact(spark, sf_dir):
    fresh = dedup.first_occurrences(chunks(spark, sf_dir), ("doc_id", "seq"))
    packed = containers.pack_exactly(fresh, ("doc_id", "seq"), "chunk_size", ("source",), 65536)
    record = F.col("chunk_size") + containers.ADDRESS + containers.DIGESTS + containers.VECTOR
    filled = packed.groupBy("source", "container").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("b"), F.max(F.col("offset") + record).alias("top"))
    return filled.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.sum("b").alias("bytes"), (F.max("top") <= 65536 + containers.ADDRESS).alias("fits"))


_PACKED = """WITH RECURSIVE {fresh}, s AS MATERIALIZED (SELECT source, {kind} AS is_delta, fp, n + {record} AS n, row_number() OVER (PARTITION BY source, {kind} ORDER BY doc_id, seq) AS k FROM u),
r AS (SELECT source, is_delta, k, fp, 0 AS container, 0 AS off, n AS used FROM s WHERE k = 1 UNION ALL
  SELECT s.source, s.is_delta, s.k, s.fp, CASE WHEN r.used + s.n >= 65536 THEN r.container + 1 ELSE r.container END, CASE WHEN r.used + s.n >= 65536 THEN 0 ELSE r.used END, CASE WHEN r.used + s.n >= 65536 THEN s.n ELSE r.used + s.n END
  FROM r JOIN s ON s.source = r.source AND s.is_delta = r.is_delta AND s.k = r.k + 1)
SELECT source, is_delta, fp, CAST(container AS BIGINT) AS container, CAST(off AS BIGINT) AS off FROM r"""


def _assigned(spark, sf_dir, is_delta, record: int) -> DataFrame:
    fresh = dedup.first_occurrences(chunks(spark, sf_dir), ("doc_id", "seq")).withColumn("is_delta", is_delta)
    packed = containers.pack_exactly(fresh, ("doc_id", "seq"), "chunk_size", ("source", "is_delta"), 65536, record)
    return packed.select("source", "is_delta", "fp", "container", F.col("offset").alias("off"))


@query(_PACKED.format(fresh=_FRESH, kind="(fp < '6')", record=288))
def container_assignment(spark, sf_dir):
    """Chunks in containers of bases and of deltas; the first digit of the fingerprint stands for the kind."""
    return _assigned(spark, sf_dir, F.col("fp") < "6", containers.RECORD)


@query(_PACKED.format(fresh=_FRESH, kind="false", record=16))
def container_assignment_without_header(spark, sf_dir):
    return _assigned(spark, sf_dir, F.lit(False), containers.PLAIN_RECORD)


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(seq AS BIGINT) AS seq, {" || ':' || ".join(f'substr(fp, {2 * i + 1}, 2)' for i in range(6))} || chr(9) || octet_length(c) AS line, octet_length(c) AS size FROM ch")
def trace_writer(spark, sf_dir):
    lines = chunks(spark, sf_dir).select("doc_id", "seq", trace_line(F.col("fp"), F.col("chunk_size")).alias("value"))
    return trace(lines).select("doc_id", "seq", F.col("value").alias("line"), "size")


@query(
    f"""WITH {_PLACED}, p AS (SELECT source, place // 128 AS batch, fp, octet_length(c) AS n FROM pl),
s AS (SELECT source, sum(n) - sum(CASE WHEN first THEN n ELSE 0 END) AS saved, count(DISTINCT batch) AS calls, count(DISTINCT substr(fp, 1, 1)) AS containers FROM (SELECT *, row_number() OVER (PARTITION BY source, fp) = 1 AS first FROM p) GROUP BY source)
SELECT source, CAST(saved AS DOUBLE) / (calls + containers) / 1024 AS kib_per_call FROM s"""
)
def saved_per_call(spark, sf_dir):
    placed = _in_containers(spark, sf_dir)
    sums = placed.groupBy("source").agg(F.sum("chunk_size").alias("logical"), F.count_distinct("batch").alias("calls"), F.count_distinct("container").alias("containers"))
    unique = placed.groupBy("source", "fp").agg(F.first("chunk_size").alias("n")).groupBy("source").agg(F.sum("n").alias("unique"))
    saved = (F.col("logical") - F.col("unique")).cast("double")
    return sums.join(unique, "source").select("source", metrics.saved_per_call(saved, F.col("calls"), F.col("containers")).alias("kib_per_call"))


_THRESHOLDS = (0.0, 0.01, 0.03, 0.1)


@query(
    f"""WITH {_PLACED}, b AS (SELECT count(*) AS n, count(DISTINCT substr(fp, 1, 1)) AS k FROM pl GROUP BY source, place // 128)
SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS batches, CAST(sum(CASE WHEN k > floor(n * CAST(t AS DOUBLE)) THEN 1 ELSE 0 END) AS BIGINT) AS deferred FROM b, (VALUES (0.0), (0.01), (0.03), (0.1)) v(t) GROUP BY t"""
)
def threshold_sweep(spark, sf_dir):
    counted = similarity.batch_locality(_in_containers(spark, sf_dir), ("source",), "container").select("n", "containers")
    swept = counted.withColumn("threshold", F.explode(F.array(*map(F.lit, _THRESHOLDS))))
    late = F.col("containers") > F.floor(F.col("n") * F.col("threshold"))
    return swept.groupBy("threshold").agg(F.count("*").alias("batches"), F.sum(late.cast("long")).alias("deferred"))


@query("SELECT sha256(encode(text)) AS fp, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def document_exact_duplicates(spark, sf_dir):
    rows = streams(spark, sf_dir).select("doc_id", fingerprint(F.col("payload")).alias("fp"))
    return rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("SELECT page_id, sha256(encode(html)) AS fp, CAST(octet_length(encode(html)) AS INTEGER) AS n_bytes FROM pages")
def page_fingerprints(spark, sf_dir):
    html = as_bytes(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", fingerprint(html).alias("fp"), F.length(html).alias("n_bytes"))


@query("SELECT user_id, count(*) AS freq FROM events GROUP BY user_id ORDER BY freq DESC, user_id LIMIT 50")
def event_heavy_users(spark, sf_dir):
    return dedup.top_k(load(spark, sf_dir, "events").select("user_id"), 50, "user_id")


_RECORD = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus)"


@query(f"SELECT count(*) AS logical_chunks, count(DISTINCT sha256({_RECORD})) AS unique_chunks FROM lineitem")
def lineitem_record_dedup(spark, sf_dir):
    record = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")])
    rows = load(spark, sf_dir, "lineitem").select(fingerprint(as_bytes(record)).alias("fp"), F.length(record).cast("long").alias("chunk_size"))
    return metrics.dedup_ratio(rows).select("logical_chunks", "unique_chunks")


@query(
    """WITH b AS (SELECT lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents),
c AS (SELECT lang, byte, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT lang, sum(n) AS t, count(*) AS d FROM c GROUP BY lang)
SELECT lang, CAST(any_value(t) AS BIGINT) AS n_bytes, any_value(d) AS distinct_bytes, round(-sum(n / t * ln(n / t)) / ln(any_value(d)), 9) AS entropy FROM c JOIN s USING (lang) GROUP BY lang"""
)
def byte_entropy_by_lang(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("lang", as_bytes(F.col("text")).alias("payload"))
    return metrics.byte_entropy(rows, "payload", ("lang",)).withColumn("entropy", F.round("entropy", 9))


@query("SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), 0) % 4294967296 AS BIGINT) AS bytes_total FROM documents")
def byte_sums_of_documents(spark, sf_dir):
    return streams(spark, sf_dir).select("doc_id", byte_sum(F.col("payload")).alias("bytes_total"))


_WHOLE = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(encode(text)) AS fp FROM documents"


def joined(parts: DataFrame, chunk: str = "chunk", keys: tuple = ("doc_id",), order: str = "seq") -> DataFrame:
    """keys, n_bytes, fp of the chunks put together in order."""
    whole = parts.groupBy(*keys).agg(F.expr(f"listagg({chunk}, X'') WITHIN GROUP (ORDER BY {order})").alias("_data"))
    return whole.select(*keys, F.length("_data").cast("long").alias("n_bytes"), fingerprint(F.col("_data")).alias("fp"))


@query(f"{_WHOLE} WHERE octet_length(encode(text)) > 0")
def cdc_roundtrip(spark, sf_dir):
    return joined(cdc_chunks(streams(spark, sf_dir).select("doc_id", "payload"), "payload", SMALL, ("doc_id",)))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS within FROM documents WHERE octet_length(encode(text)) > 0")
def cdc_bounds(spark, sf_dir):
    rows = cdc_chunks(streams(spark, sf_dir).select("doc_id", "payload"), "payload", SMALL, ("doc_id",)).withColumn("n", F.length("chunk").cast("long"))
    sums = rows.groupBy("doc_id").agg(F.sum("n").alias("n_bytes"), F.max("n").alias("most"), F.max("seq").alias("last"), F.min(F.struct(-F.col("seq"), "n")).alias("end"), F.collect_list("n").alias("all"))
    short = F.size(F.filter("all", lambda n: n < SMALL.least))
    return sums.select("doc_id", "n_bytes", ((F.col("most") <= SMALL.most) & (short <= (F.col("end.n") < SMALL.least).cast("int"))).alias("within"))


@query("SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents WHERE octet_length(encode(text)) > 0")
def cdc_default_sizes(spark, sf_dir):
    rows = cdc_chunks(streams(spark, sf_dir).select("doc_id", "payload"), "payload", ChunkSpec(), ("doc_id",))
    return rows.agg(F.count_distinct("doc_id").alias("documents"), F.sum(F.length("chunk")).alias("n_bytes"))


@query(f"{_WHOLE}")
def lz4_roundtrip(spark, sf_dir):
    rows = streams(spark, sf_dir).select("doc_id", F.length("payload").alias("n"), lz4(F.col("payload")).alias("z"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_bytes"), fingerprint(unlz4(F.col("z"), F.col("n"))).alias("fp"))


_GEAR = "(SELECT list(CAST('0x' || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2) AS BIGINT) >> 1 ORDER BY i) FROM (SELECT i, sha256('sparkfold:' || i) AS s FROM range(256) t(i)))"


@query(
    f"""WITH RECURSIVE g AS MATERIALIZED (SELECT {_GEAR} AS gear),
d AS MATERIALIZED (SELECT item_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: gear[CAST('0x' || x AS INTEGER) + 1]) AS v, octet_length(encode(text)) AS n FROM benchmark, g),
r AS (SELECT item_id, 0 AS start, {{least}} AS pos, v[{{least}} + 1] AS h FROM d WHERE n > {{least}} UNION ALL
  SELECT r.item_id, CASE WHEN cut THEN pos + 1 ELSE start END, CASE WHEN cut THEN pos + 1 + {{least}} ELSE pos + 1 END, CASE WHEN cut THEN v[pos + {{least}} + 2] ELSE (h >> 1) + v[pos + 2] END
  FROM (SELECT *, (h & {{loose}}) = 0 OR pos + 1 - start = {{most}} AS cut FROM r) r JOIN d USING (item_id) WHERE CASE WHEN cut THEN pos + 1 + {{least}} ELSE pos + 1 END < n),
e AS (SELECT item_id, pos + 1 AS cut_end FROM r WHERE (h & {{loose}}) = 0 OR pos + 1 - start = {{most}} UNION SELECT item_id, n FROM d WHERE n > 0)
SELECT item_id, CAST(cut_end AS BIGINT) AS cut_end FROM e""".format(least=TINY.least, most=TINY.most, loose=TINY.masks[1])
)
def cdc_cut_points(spark, sf_dir):
    rows = load(spark, sf_dir, "benchmark").select("item_id", as_bytes(F.col("text")).alias("payload"))
    return cdc_chunks(rows, "payload", TINY, ("item_id",)).select("item_id", (F.col("offset") + F.length("chunk")).cast("long").alias("cut_end"))


@query("SELECT count(*) AS documents, true AS no_longer FROM documents")
def lz4_never_longer(spark, sf_dir):
    rows = streams(spark, sf_dir).select(F.length("payload").alias("n"), F.length(lz4(F.col("payload"))).alias("z"))
    return rows.agg(F.count("*").alias("documents"), F.min(F.col("z") <= F.col("n")).alias("no_longer"))


@query(_WHOLE)
def aes_gcm_roundtrip(spark, sf_dir):
    rows = streams(spark, sf_dir).select("doc_id", decrypt(encrypt(F.col("payload"), KEY), KEY).alias("p"))
    return rows.select("doc_id", F.length("p").cast("long").alias("n_bytes"), fingerprint(F.col("p")).alias("fp"))


@query(_WHOLE)
def aes_cbc_roundtrip(spark, sf_dir):
    rows = streams(spark, sf_dir).select("doc_id", decrypt(encrypt(F.col("payload"), KEY, "CBC"), KEY, "CBC").alias("p"))
    return rows.select("doc_id", F.length("p").cast("long").alias("n_bytes"), fingerprint(F.col("p")).alias("fp"))


@query(f"WITH {CHUNKS} SELECT count(DISTINCT fp) AS fingerprints, count(DISTINCT sha256('secret' || fp)) AS tokens FROM ch")
def keyed_index_tokens(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("fp", keyed_token(F.col("fp"), "secret").alias("token"))
    return rows.agg(F.count_distinct("fp").alias("fingerprints"), F.count_distinct("token").alias("tokens"))


@query("SELECT page_id, sha256(url || CAST(page_id % 5 AS VARCHAR)) AS name FROM pages")
def backup_names(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", name_hash(F.col("url"), F.col("page_id") % 5).alias("name"))


_BASE36 = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((o_orderkey // {36**i}) % 36 AS INTEGER) + 1, 1)" for i in range(6, -1, -1))


@query(f"SELECT o_orderkey, {_BASE36} AS name FROM orders")
def base36_names(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", container_name(F.col("o_orderkey")).alias("name"))


@query("SELECT doc_id, [sha256(repeat(chr(0), 32)), sha256(repeat(chr(0), 32)), sha256(repeat(chr(0), 32))] AS sf FROM documents WHERE octet_length(encode(text)) <= 564")
def tiny_chunk_superfeature(spark, sf_dir):
    return streams(spark, sf_dir).filter(F.length("payload") <= 564).select("doc_id", super_feature(F.col("payload")).alias("sf"))


@query("SELECT sha256(encode(text)) AS fp, count(*) AS copies, CAST(1 AS BIGINT) AS features FROM documents GROUP BY 1")
def superfeatures_of_exact_copies(spark, sf_dir):
    rows = streams(spark, sf_dir).select(fingerprint(F.col("payload")).alias("fp"), super_feature(F.col("payload")).alias("sf"))
    return rows.groupBy("fp").agg(F.count("*").alias("copies"), F.count_distinct("sf").alias("features"))


def _similar(spark, sf_dir):
    """All documents as chunks, and the base that the earliest like one is to each; short ones, which all look alike, get none."""
    rows = streams(spark, sf_dir)
    rows = keep(rows.select("source", "doc_id", fingerprint(F.col("payload")).alias("fp"), F.length("payload").alias("chunk_size"), super_feature(F.col("payload")).alias("sf"), "payload"), "similar")
    bases = rows.filter("chunk_size > 564").withColumn("insert_seq", F.col("doc_id"))
    asked = rows.select("fp", "sf", "chunk_size").dropDuplicates(["fp"])
    return rows, similarity.choose_base(asked, similarity.index_owners(similarity.feature_index(bases)), least_bytes=565)


@query()
def similar_base_candidates(spark, sf_dir):
    return _similar(spark, sf_dir)[1]


@query("SELECT 0 AS failures")
def delta_roundtrip(spark, sf_dir):
    rows, hits = _similar(spark, sf_dir)
    payloads = rows.select("fp", "payload").dropDuplicates(["fp"])
    both = hits.join(payloads, "fp").join(payloads.withColumnsRenamed({"fp": "base_fp", "payload": "base"}), "base_fp")
    both = both.withColumn("back", patch(delta(F.col("payload"), F.col("base")), F.col("base")))
    return both.agg(F.coalesce(F.sum((fingerprint(F.col("back")) != F.col("fp")).cast("int")), F.lit(0)).cast("int").alias("failures"))


@query(_WHOLE.replace("FROM documents", "FROM documents WHERE octet_length(encode(text)) > 0"))
def delta_of_mutated_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(mutated(docs, 1).withColumnRenamed("text", "later"), "doc_id").select("doc_id", as_bytes(F.col("text")).alias("t"), as_bytes(F.col("later")).alias("b")).filter("length(t) > 0")
    back = rows.select("doc_id", patch(delta(F.col("t"), F.col("b")), F.col("b")).alias("p"))
    return back.select("doc_id", F.length("p").cast("long").alias("n_bytes"), fingerprint(F.col("p")).alias("fp"))


#: Features that SQL can give as well: of each document one per slot.
_FEATURED = """f AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS fp, n_chars AS chunk_size, doc_id % 7 * 1000000 + doc_id AS insert_seq, doc_id % 3 = 0 AS base,
  [md5(lang || (n_chars % 97)), md5(source || (n_chars % 13)), md5(CAST(n_chars % 31 AS VARCHAR))] AS sf FROM documents),
i AS (SELECT doc_id, fp, chunk_size, insert_seq, base, CAST(s AS INTEGER) AS slot, sf[s + 1] AS feature FROM f, range(3) t(s)),
o AS (SELECT slot, feature, arg_min(fp, (insert_seq, fp)) AS base_fp FROM i WHERE base GROUP BY ALL),
h AS (SELECT i.fp, i.slot, o.base_fp FROM i JOIN o USING (slot, feature) WHERE NOT base AND chunk_size >= 300 QUALIFY row_number() OVER (PARTITION BY i.fp ORDER BY i.slot) = 1)"""


def _featured(spark, sf_dir) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    docs = load(spark, sf_dir, "documents").withColumns({f"n{m}": (F.col("n_chars") % m).cast("string") for m in (97, 13, 31)})
    sf = F.array(F.md5(F.concat("lang", "n97")), F.md5(F.concat("source", "n13")), F.md5(F.col("n31")))
    return docs.select("doc_id", F.sha2(text("doc_id"), 256).alias("fp"), F.col("n_chars").alias("chunk_size"), (F.col("doc_id") % 7 * 1000000 + F.col("doc_id")).alias("insert_seq"), (F.col("doc_id") % 3 == 0).alias("base"), sf.alias("sf"))


@query(f"WITH {_FEATURED} SELECT * FROM h")
def base_choice_by_slots(spark, sf_dir):
    rows = _featured(spark, sf_dir)
    owners = similarity.index_owners(similarity.feature_index(rows.filter("base")))
    return similarity.choose_base(rows.filter("not base"), owners, least_bytes=300)


@query(f"WITH {_FEATURED} SELECT (SELECT count(*) FROM f) * 80 AS fp_bytes, (SELECT count(*) FROM o) * 64 AS sf_bytes, (SELECT count(*) + count(DISTINCT base_fp) FROM h) * 32 AS delta_bytes")
def index_sizes(spark, sf_dir):
    rows = _featured(spark, sf_dir)
    index = similarity.feature_index(rows.filter("base"))
    hits = similarity.choose_base(rows.filter("not base"), similarity.index_owners(index), least_bytes=300)
    counts = [rows.agg(F.count_distinct("fp").alias("n")), index.agg(F.count_distinct("slot", "feature").alias("m")), hits.agg(F.count_distinct("base_fp").alias("k"), F.count("*").alias("e"))]
    one = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    return one.select(*[c.alias(k) for k, c in metrics.index_bytes(F.col("n"), F.col("m"), F.col("k"), F.col("e")).items()])


@query(
    f"""WITH {_FEATURED}, p AS (SELECT a.fp AS old_fp, b.fp AS new_fp FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 6 = 0),
ends AS (SELECT old_fp AS fp FROM p UNION SELECT new_fp FROM p), gone AS (SELECT DISTINCT slot, feature FROM i JOIN ends USING (fp))
SELECT slot, feature, fp AS base_fp, insert_seq AS base_order FROM i ANTI JOIN gone USING (slot, feature) WHERE base
UNION ALL SELECT slot, feature, i.fp, insert_seq FROM i WHERE fp IN (SELECT new_fp FROM p)"""
)
def index_after_swap(spark, sf_dir):
    rows = _featured(spark, sf_dir)
    later = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fp").alias("new_fp"))
    pairs = rows.filter("doc_id % 6 = 0").select("doc_id", F.col("fp").alias("old_fp")).join(later, "doc_id").select("old_fp", "new_fp")
    digests = rows.select("fp", "insert_seq", F.posexplode("sf").alias("slot", "feature"))
    return similarity.swap_owners(similarity.feature_index(rows.filter("base")), pairs, digests)


_BATCHES = f"""{_PLACED}, x AS (SELECT source, place // 128 AS batch, c, substr(fp, 1, 1) AS container FROM pl)"""


@query(f"WITH {_BATCHES} SELECT source, CAST(batch AS BIGINT) AS batch, count(*) AS n, count(DISTINCT container) AS containers, count(DISTINCT container) > floor(count(*) * 0.03) AS deferred FROM x GROUP BY ALL")
def batch_locality_decision(spark, sf_dir):
    return similarity.batch_locality(_in_containers(spark, sf_dir), ("source",), "container")


@query(f"WITH {_BATCHES}, y AS (SELECT source, batch, count(*) OVER (PARTITION BY source, batch, container) > 3 AS affine FROM x) SELECT source, CAST(batch AS BIGINT) AS batch, CAST(sum(CASE WHEN affine THEN 1 ELSE 0 END) AS BIGINT) AS affine FROM y GROUP BY ALL")
def affinity_decision(spark, sf_dir):
    marked = similarity.with_affinity(_in_containers(spark, sf_dir), ("source",), "container")
    return marked.groupBy("source", "batch").agg(F.sum(F.col("affine").cast("long")).alias("affine"))


def _in_containers(spark, sf_dir):
    """Chunks in batches of 128; the first digit of the fingerprint stands for the base's container."""
    placed = numbered(chunks(spark, sf_dir), "source", ("doc_id", "seq"))
    return placed.withColumn("batch", F.floor(F.col("place") / dedup.BATCH)).withColumn("container", F.substring("fp", 1, 1))


@query(
    """WITH p AS (SELECT l_partkey AS o, l_orderkey * 8 + l_linenumber AS w FROM lineitem),
l AS (SELECT o, max(w) AS w, count(*) AS n FROM p GROUP BY o),
s AS (SELECT CAST(o AS VARCHAR) AS old_fp, 'n' || w AS new_fp, n FROM l UNION SELECT 'n' || p.w, 'n' || l.w, 0 FROM p JOIN l USING (o) WHERE p.w <> l.w)
SELECT old_fp, new_fp, CAST(n AS BIGINT) AS n FROM s"""
)
def pending_pairs_revised(spark, sf_dir):
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("old_fp"), F.concat(F.lit("n"), seq.cast("string")).alias("new_fp"), seq.alias("batch_seq"), F.lit(0).cast("long").alias("pair_seq"))
    return similarity.latest_bases(rows).select("old_fp", "new_fp", "n")


_ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


@query(
    """WITH p AS (SELECT l_partkey AS o, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS saved FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, CAST(o AS VARCHAR)) AS rank FROM p), t AS (SELECT CAST(sum(saved) AS BIGINT) * 2 AS total FROM p),
l AS (SELECT *, total - (sum(saved) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) - saved) AS rest FROM r, t)
SELECT CAST(a AS DOUBLE) AS alpha, count(*) AS pairs, CAST(sum(saved) AS BIGINT) AS saved FROM l, (VALUES (0.0), (0.3), (0.5), (0.7), (1.0)) v(a) WHERE rest > CAST(a AS DOUBLE) * total GROUP BY a"""
)
def alpha_sweep(spark, sf_dir):
    """How many pairs an offline pass works on, by the share of the bytes at which it stops."""
    pairs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("old_fp")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("saved"))
    ranked = keep(similarity.rank_pairs(pairs.withColumn("new_fp", F.lit("new"))), "ranked")
    total = 2 * (ranked.agg(F.sum("saved")).first()[0] or 0)
    out = None
    for alpha in _ALPHAS:
        one = similarity.greedy_share(ranked, total, alpha).agg(F.count("*").alias("pairs"), F.sum("saved").alias("saved")).select(F.lit(alpha).alias("alpha"), "pairs", "saved")
        out = one if out is None else out.unionByName(one)
    return out.filter("pairs > 0")


@query(
    """WITH p AS (SELECT l_partkey AS o, l_orderkey * 8 + l_linenumber AS w FROM lineitem), l AS (SELECT o, max(w) AS w, count(*) AS n FROM p GROUP BY o),
s AS (SELECT CAST(o AS VARCHAR) AS old_fp, 'n' || w AS new_fp, n FROM l UNION SELECT 'n' || p.w, 'n' || l.w, 0 FROM p JOIN l USING (o) WHERE p.w <> l.w)
SELECT old_fp, new_fp, CAST(row_number() OVER (ORDER BY n DESC, old_fp, new_fp) AS INTEGER) AS rank FROM s"""
)
def pending_pairs_ranked(spark, sf_dir):
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("old_fp"), F.concat(F.lit("n"), seq.cast("string")).alias("new_fp"), seq.alias("batch_seq"), F.lit(0).cast("long").alias("pair_seq"))
    return similarity.rank_pairs(similarity.latest_bases(rows)).select("old_fp", "new_fp", "rank")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS container_id, CAST(sum(l_quantity) AS BIGINT) AS dead FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey")
def dead_bytes_per_container(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("container_id"), F.col("l_quantity").cast("long").alias("length"))
    return containers.dead_bytes(rows)


@query(
    f"""WITH {_FRESH}, r AS (SELECT source, n, sum(n) OVER w - n AS off, row_number() OVER w AS k FROM u WINDOW w AS (PARTITION BY source ORDER BY doc_id, seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT source AS container_id, n, sum(n) OVER (PARTITION BY source ORDER BY off ROWS UNBOUNDED PRECEDING) - n AS off FROM r WHERE k % 3 <> 0)
SELECT container_id, count(*) AS records, CAST(sum(n) AS BIGINT) AS bytes, CAST(max(off + n) AS BIGINT) AS top FROM k GROUP BY container_id"""
)
def compacted_containers(spark, sf_dir):
    fresh = dedup.first_occurrences(chunks(spark, sf_dir), ("doc_id", "seq"))
    order = Window.partitionBy("source").orderBy("doc_id", "seq")
    rows = fresh.select(F.col("source").alias("container_id"), F.col("chunk_size").alias("length"), (F.sum("chunk_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chunk_size")).alias("offset"), F.row_number().over(order).alias("k"))
    rows = keep(rows, "records")
    live = containers.compact(rows.drop("k"), rows.filter("k % 3 = 0"))
    return live.groupBy("container_id").agg(F.count("*").alias("records"), F.sum("length").alias("bytes"), F.max(F.col("offset") + F.col("length")).alias("top"))


@query("SELECT count(*) AS containers, CAST(sum(l) AS BIGINT) AS bytes, true AS fits FROM (SELECT source, sum(octet_length(encode(text))) AS l FROM documents GROUP BY source)")
def merged_containers(spark, sf_dir):
    sizes = streams(spark, sf_dir).groupBy(F.col("source").alias("container_id")).agg(F.sum(F.length("payload")).alias("bytes"))
    sizes = keep(sizes, "sizes")
    capacity = 3 * (sizes.agg(F.max("bytes")).first()[0] or 1)
    into = containers.merge_pairs(sizes, capacity).join(sizes, "container_id").groupBy("merged_into").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return into.agg(F.sum("n").alias("containers"), F.sum("b").alias("bytes"), (F.max("b") < capacity).alias("fits"))


_MERGED = """WITH RECURSIVE z AS MATERIALIZED (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS name, CAST(sum(o_totalprice) AS BIGINT) AS bytes FROM orders GROUP BY 1),
s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY name) AS k, (SELECT max(bytes) FROM z) AS cap FROM z),
r AS (SELECT k, name, name AS open, bytes AS held, name AS merged_into FROM s WHERE k = 1 UNION ALL
  SELECT s.k, s.name, CASE WHEN r.open IS NOT NULL AND r.held + s.bytes < s.cap - 1 THEN NULL ELSE s.name END, s.bytes, CASE WHEN r.open IS NOT NULL AND r.held + s.bytes < s.cap - 1 THEN r.open ELSE s.name END FROM r JOIN s ON s.k = r.k + 1)
SELECT name AS container_id, merged_into FROM r"""


@query(_MERGED)
def merged_pairs(spark, sf_dir):
    name = F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
    sizes = keep(load(spark, sf_dir, "orders").groupBy(name.alias("container_id")).agg(F.sum("o_totalprice").cast("long").alias("bytes")), "sizes")
    return containers.merge_pairs(sizes, sizes.agg(F.max("bytes")).first()[0] or 1)


@query(
    """SELECT event_id, lpad(lower(to_hex(event_id % 251)), 2, '0') || lpad(lower(to_hex(event_id % 241)), 2, '0') || '0a0b0c0d' AS prefix, least(user_id * 37 + 64, 16384) AS size FROM events"""
)
def trace_lines(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    hex_ = lambda m: F.lower(F.hex(F.col("event_id") % m))
    line = F.concat(hex_(251), F.lit(":"), hex_(241), F.lit(":0a:0b:0c:0d\t"), (F.col("user_id") * 37 + 64).cast("string"))
    return trace(e.select("event_id", line.alias("value")), "fsl").select("event_id", "prefix", "size")


@query("SELECT DISTINCT lpad(lower(to_hex(user_id % 251)), 2, '0') || '01020304' AS prefix, CAST(user_id % 4096 + 100 AS BIGINT) AS size, true AS right_size, true AS starts FROM events")
def synthetic_trace_chunks(spark, sf_dir):
    u = load(spark, sf_dir, "events").select("user_id").distinct()
    rows = trace(u.select(F.concat(F.lower(F.hex(F.col("user_id") % 251)), F.lit(":01:02:03:04 "), (F.col("user_id") % 4096 + 100).cast("string")).alias("value")), "ubc")
    made = rows.withColumn("chunk", synthetic_payload(F.col("prefix"), F.col("size")))
    return made.select("prefix", "size", (F.length("chunk") == F.col("size")).alias("right_size"), (F.lower(F.hex(F.substring("chunk", 1, 5))) == F.col("prefix")).alias("starts")).distinct()


# stores


def _ingest(store: Store, name: str, docs: DataFrame) -> DataFrame:
    """Adds a backup of the documents (doc_id, text), each in chunks of 16 KiB; returns their numbering."""
    data = docs.select(F.lit(name).alias("backup_id"), "doc_id", as_bytes(F.coalesce("text", F.lit(""))).alias("payload"))
    parts = keep(numbered(fixed_chunks(data, "payload", 16384, ("backup_id", "doc_id")), "backup_id", ("doc_id", "seq")), "backup")
    store.ingest(name, parts.select(F.col("place").alias("seq"), "chunk"))
    return parts.select("backup_id", F.col("place").alias("seq"), "doc_id")


def _store(spark, policy: str, backups: list[DataFrame], least: int = 0, key: bytes | None = None) -> tuple[Store, list[DataFrame]]:
    """A new store with the backups (doc_id, text); also their numbering."""
    store = Store(spark, shared_folder(spark, "store"), Options(policy=policy, least_similar_bytes=least, key=key))
    return store, [_ingest(store, f"b{i}", docs) for i, docs in enumerate(backups)]


def _restored(store: Store, places: list[DataFrame]) -> DataFrame:
    where = places[0]
    for df in places[1:]:
        where = where.unionByName(df)
    return joined(store.restore().join(where, ["backup_id", "seq"]), keys=("backup_id", "doc_id"))


_HALVES = "SELECT 'b' || (doc_id % 2) AS backup_id, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(encode(text)) AS fp FROM documents WHERE octet_length(encode(text)) > 0"


def _restore_query(policy: str):
    def run(spark, sf_dir):
        docs = load(spark, sf_dir, "documents").select("doc_id", "text")
        return _restored(*_store(spark, policy, [docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")]))

    run.__name__ = f"restore_{policy}"
    query(_HALVES)(run)


for _policy in tuple(POLICIES):
    _restore_query(_policy)

_BIG = "c AS (SELECT doc_id, doc_id % 2 AS half, encode(text)[o + 1 : o + 16384] AS c, sha256(encode(text)[o + 1 : o + 16384]) AS fp FROM documents, unnest(range(0, octet_length(encode(text)), 16384)) t(o))"


def _halves(spark, sf_dir, policy: str = "dedup_only", key: bytes | None = None):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return _store(spark, policy, [docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")], key=key)


@query(_HALVES)
def restore_with_encrypted_recipes(spark, sf_dir):
    store, places = _halves(spark, sf_dir, "inline", KEY)
    if store.table("recipes").join(store.table("chunks").select("fp"), "fp", "left_semi").limit(1).count():
        raise ValueError("a recipe shows fingerprints")
    return _restored(store, places)


@query(
    f"""WITH {_BIG}, u AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY half) = 1 AS fresh FROM c),
p AS (SELECT half, count(*) AS l, sum(CASE WHEN fresh THEN 1 ELSE 0 END) AS u, sum(octet_length(c)) AS lb, sum(CASE WHEN fresh THEN octet_length(c) ELSE 0 END) AS ub FROM u GROUP BY half)
SELECT 'b' || half AS backup_id, CAST(sum(l) OVER w AS BIGINT) AS logical_chunks, CAST(sum(u) OVER w AS BIGINT) AS unique_chunks, CAST(sum(u) OVER w AS BIGINT) AS base_chunks, CAST(0 AS BIGINT) AS delta_chunks,
  CAST(sum(lb) OVER w AS BIGINT) AS logical_bytes, CAST(sum(ub) OVER w AS BIGINT) AS unique_bytes, CAST(sum(ub) OVER w AS BIGINT) AS stored_or_saved FROM p WINDOW w AS (ORDER BY half ROWS UNBOUNDED PRECEDING)"""
)
def store_chunk_log(spark, sf_dir):
    log = chunk_log(_halves(spark, sf_dir)[0])
    names = ("backup_id", "logical_chunks", "unique_chunks", "base_chunks", "delta_chunks", "logical_bytes", "unique_bytes")
    return log.select(*names, (F.col("base_bytes") + F.col("delta_bytes") + F.col("lz4_saved") + F.col("delta_saved")).alias("stored_or_saved"))


@query(f"WITH {_BIG}, x AS (SELECT i, p FROM c, LATERAL (VALUES {_CELLS.replace('% 64', '% 262144')}) t(i, p)) SELECT i AS sketch_row, CAST(p AS BIGINT) AS position, count(*) AS cell FROM x GROUP BY ALL")
def store_sketch(spark, sf_dir):
    """The sketch as a later session reads it, remembered after each of two backups."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    store, _ = _store(spark, "dedup_only", [docs.filter("doc_id % 2 = 0")])
    store.remember()
    _ingest(store, "b1", docs.filter("doc_id % 2 = 1"))
    store.remember()
    return Store(spark, store.path).sketch()


_EDIT = "CASE WHEN doc_id % 3 = {0} THEN substr(text, 1, CAST(floor(length(text) * 0.5) AS BIGINT)) || ' passage {0} of ' || doc_id || '. ' || substr(text, CAST(floor(length(text) * 0.5) AS BIGINT) + 1) ELSE text END"


def _versions(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null and text <> ''")
    return _store(spark, "adaptive", [docs, mutated(docs, 1), mutated(mutated(docs, 1), 2)], least=565)


@query(
    f"""WITH v0 AS (SELECT doc_id, text FROM documents WHERE text <> ''), v1 AS (SELECT doc_id, {_EDIT.format(1)} AS text FROM v0), v2 AS (SELECT doc_id, {_EDIT.format(2)} AS text FROM v1),
a AS (SELECT 'b0' AS backup_id, * FROM v0 UNION ALL SELECT 'b1', * FROM v1 UNION ALL SELECT 'b2', * FROM v2)
SELECT backup_id, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(encode(text)) AS fp FROM a"""
)
def offline_pass_preserves_content(spark, sf_dir):
    store, places = _versions(spark, sf_dir)
    store.optimize()
    return _restored(store, places)


@query("SELECT * FROM (VALUES ('orphans', 0::BIGINT), ('repeated fingerprints', 0::BIGINT), ('deltas of deltas', 0::BIGINT), ('larger after the pass', 0::BIGINT), ('bytes unaccounted for', 0::BIGINT)) t(invariant, violations)")
def store_invariants(spark, sf_dir):
    store, _ = _versions(spark, sf_dir)
    m = store.table("metrics").agg(F.sum(F.abs(F.col("unique_bytes") - F.col("base_bytes") - F.col("delta_bytes") - F.col("lz4_saved") - F.col("delta_saved")))).first()[0]
    store.optimize()
    c = store.table("chunks")
    deltas = c.filter("is_delta")
    log = store.table("passes").filter("stored_after > stored_before").count()
    rows = [("orphans", store.orphans().count()), ("repeated fingerprints", c.count() - c.select("fp").distinct().count()), ("deltas of deltas", deltas.join(deltas.select(F.col("fp").alias("base_fp")), "base_fp").count()), ("larger after the pass", log), ("bytes unaccounted for", m or 0)]
    return spark.createDataFrame(rows, "invariant string, violations long")


@query()
def store_reduction_over_versions(spark, sf_dir):
    return _versions(spark, sf_dir)[0].reduction()


@query(f"WITH {CHUNKS} SELECT CAST(octet_length(c) AS INTEGER) AS chunk_size, count(DISTINCT fp) AS unique_chunks FROM ch GROUP BY 1")
def stream_ingest_equals_batch(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    schema = load(spark, sf_dir, "documents").schema.simpleString()[7:-1].replace(":", " ")
    found = run_to_end(unique_chunks(chunk_stream(spark, path, schema, size=SIZE)), shared_folder(spark, "stream"), shared_folder(spark, "offsets"))
    return found.groupBy("chunk_size").agg(F.count("*").alias("unique_chunks"))


@query(f"WITH {CHUNKS} SELECT 'c' || (doc_id % 2) AS client, count(*) AS entries, count(DISTINCT fp) AS unique_chunks, CAST(sum(octet_length(c)) AS BIGINT) AS logical_bytes FROM ch GROUP BY 1")
def clients_stream_ingest(spark, sf_dir):
    """Two clients' streams, each a query of its own, into one store."""
    schema = load(spark, sf_dir, "documents").schema.simpleString()[7:-1].replace(":", " ")
    whole = lambda: chunk_stream(spark, f"{sf_dir}/documents.parquet", schema, size=SIZE)
    streams_ = {f"c{i}": whole().filter(F.col("doc_id") % 2 == i) for i in (0, 1)}
    path = shared_folder(spark, "clients")
    ingest_streams(streams_, path, shared_folder(spark, "offsets"), Options(policy="dedup_only"))
    store = Store(spark, path)
    sizes = store.table("chunks").select("fp", "logical_len")
    rows = store.recipes().join(sizes, "fp").withColumn("client", F.split("backup_id", "/")[0])
    return rows.groupBy("client").agg(F.count("*").alias("entries"), F.count_distinct("fp").alias("unique_chunks"), F.sum("logical_len").alias("logical_bytes"))
