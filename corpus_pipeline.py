"""A corpus pipeline: quality filter, near-dedup, redaction of personal data, source mix, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that
stay, with the columns of docs. The last returns packed pieces. ``run`` writes each stage's result to
the shared scratch folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import materialize, ship_code, table
from sparkfold.llm.mixing import WORDS, mix
from sparkfold.llm.near_dedup import FEW_IDS, near_duplicate_classes
from sparkfold.llm.packing import pack
from sparkfold.llm.pii import find_pii, redact
from sparkfold.llm.quality import fit, score
from sparkfold.llm.queries import default_tokenizer

#: Documents that score below this are rejected.
QUALITY = 0.7


def _folded(docs: DataFrame, *, named: tuple = ("doc_id", "text")) -> DataFrame:
    """doc_id, text and, in one column, all the others: names that an operator uses itself can't clash."""
    return docs.select(*named, F.struct(*[c for c in docs.columns if c not in named]).alias("_rest"))


def _unfolded(docs: DataFrame, columns: list[str], named: tuple = ("doc_id", "text")) -> DataFrame:
    """The columns again, n_chars brought up to date."""
    out = docs.select(*[F.col(c) if c in named else F.col("_rest")[c].alias(c) for c in columns])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least QUALITY; it is fitted on this table's labels.

    A null or empty text scores by the bias alone and goes or stays by that; long texts count whole; repeated
    rows, ties and rows without a doc_id are judged each by their text; an empty table gives no rows."""
    weights = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(_folded(docs), weights).filter(F.col("score") >= QUALITY)
    return scored.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate class. Rows without a doc_id that are in no
    other row's class stay."""
    classes = materialize(near_duplicate_classes(docs))
    ids = materialize(classes.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("_stays"), F.count("*").alias("_rows")))
    gone, named = ids.filter("not _stays").select("doc_id"), docs.filter("doc_id is not null")
    if gone.limit(FEW_IDS + 1).count() <= FEW_IDS:  # a bounded number of ids goes to the texts, more meet them in a shuffle
        out = named.join(F.broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
    else:
        out = named.join(ids.filter("_stays").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if ids.filter("_stays and _rows > 1").limit(1).count():  # repeated rows
        out = out.dropDuplicates(["doc_id", "text"])
    if classes.filter("doc_id is null and class_id is null").limit(1).count():
        out = out.unionByName(docs.filter("doc_id is null").dropDuplicates(["text"]))
    return out


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind. Null and empty texts stay as they are,
    texts of any length are searched whole, repeated rows are redacted alike, an empty table stays empty."""
    return _unfolded(redact(find_pii(_folded(docs))), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it is taken whole, and its beginning up to the last taken word where it
    is taken in part. A null or empty text has no words and is never taken; a null source is a source of
    its own; rows equal in doc_id and text are taken together; an empty table gives no rows."""
    key = F.xxhash64("text").alias("_key")
    taken = mix(docs.select("doc_id", "source", "text", key), keep=("_key",)).filter("taken > 0").groupBy("doc_id", "_key").agg(F.sum("taken").alias("_taken"), F.first("size").alias("_size"), F.count("*").alias("_rows"))
    taken = materialize(taken).withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
    keyed = _folded(docs).select("*", key)
    if taken.filter("_rows > 1").limit(1).count():  # repeated rows are taken together
        keyed = keyed.dropDuplicates(["doc_id", "_key"])
    joined = keyed.join(taken, (keyed["_key"] == taken["_k"]) & keyed["doc_id"].eqNullSafe(taken["_id"]))
    turns = joined.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size")))))
    rest = F.col("_taken") - (F.col("_turn") - 1) * F.col("_size")
    words, apart = F.regexp_extract_all("text", F.lit(WORDS), 0), F.split("text", WORDS, -1)
    taken_words = F.zip_with(F.slice(apart, F.lit(1), rest.cast("int")), F.slice(words, F.lit(1), rest.cast("int")), lambda a, w: F.concat(a, w))
    first = F.array_join(taken_words, "")
    cut = turns.withColumn("text", F.when(rest >= F.col("_size"), F.col("text")).otherwise(first))
    return _unfolded(cut, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their token ids; see the packing operator for null, empty and long texts,
    repeated rows and ties. An empty table gives no rows."""
    return pack(docs, default_tokenizer(), capacity=4096, end_id=2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
