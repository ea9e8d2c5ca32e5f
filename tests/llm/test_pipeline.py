import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(240):
        text = prose(90, i)
        if i % 8 == 0:
            text = text.upper().replace(" ", "!! ")
        if i % 10 == 3:
            text += f" write to me{i}@example.com"
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(i % 8 != 0), 0))
    rows += [(1000 + i, rows[i][1], "en", "s0", 1) for i in range(1, 40)]
    rows += [(2000 + i, rows[i][1] + " and one more", "en", None, 1) for i in range(1, 40)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
    good = {r.doc_id for r in seen["quality"].collect()}
    assert not any(i % 8 == 0 and i < 240 for i in good) and {i for i in range(240) if i % 8} <= good
    kept = {r.doc_id for r in seen["near_dedup"].collect()}
    assert kept <= good and not any(1000 <= i < 3000 and (i % 1000) in good for i in kept) and {i for i in range(240) if i % 8} <= kept
    texts = {r.doc_id: r for r in seen["pii"].collect()}
    assert texts.keys() == kept and not any("@" in (r.text or "") for r in texts.values()) and all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r.text) for r in texts.values())
    mixed = seen["mixing"].collect()
    assert abs(sum(words(r.text) for r in mixed) - total) < 0.05 * total
    times = Counter()
    for r in mixed:
        times[r.doc_id] += words(r.text)
        assert texts[r.doc_id].text.startswith(r.text[:20])
    assert all(n <= 3 * words(texts[i].text) for i, n in times.items())


def test_run_returns_packed_pieces_of_the_mix(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    fill = defaultdict(int)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 4096 and len(pieces) > 100


def test_extra_columns_and_odd_rows(spark, folder, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.collect()
    near = corpus_pipeline.near_dedup(spark, odd_docs, folder).collect()
    ids = Counter(r.doc_id for r in near)
    assert ids[0] == 1 and ids[1] == ids[2] == 0 and ids[5] == 1 and ids[3] == ids[4] == 1
    empty = odd_docs.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
