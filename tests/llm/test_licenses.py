import re

from sparkfold.llm.licenses import PHRASES, TEMPLATES, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(text, threshold=0.9):
    w = words(text)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, top = {label for _, label in hits}, 1.0 if hits else 0.0
    lines = [words(x) for x in (text or "").split("\n")]
    for i, line in enumerate(lines):
        have, n, j = set(line), 0, i + 1
        while line and j < len(lines) and lines[j] and n < max(len(t.split()) for t in TEMPLATES):  # the lines after it, to the longest template's words
            have |= set(lines[j])
            n += len(lines[j])
            j += 1
        for t, label in TEMPLATES.items():
            need = set(t.lower().split())
            share = len(have & need) / len(need)
            if share >= threshold - 1e-9:
                labels.add(label)
                top = max(top, share)
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), sorted({label for _, label in hits}), sorted(labels), top


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved. ALL RIGHTS-RESERVED!",
    "cc by cc by\ncc\nby ccby cc,by",
    "Released\nunder the MIT License.",
    "Released under the MIT License.",
    "under the terms: LICENSED, under (the) apache\tlicense; version 2.0, or later, with more words than the template has",
    "Permission is hereby granted free of charge to any person obtaining a copy of the software",
    "licence general public  license generalpublic license",
    "é all rights reserved ß 東京 all rights reserved",
    "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated files */",
    "before\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that\n",
    "This program is free software; you can redistribute it\nand/or modify it under the terms of the GNU\nGeneral Public\nLicense\n",
    "Released under\n\nthe MIT License",
    "Released under\n" + "one two three " * 8 + "\nthe MIT License",
    "Released under\n" + "one two three " * 7 + "\nthe MIT License",
    "Released\n" * 400 + "under the mit\nlicense",
    "",
    None,
    " \n\n ",
    "all rights reserved " * 3000,
    "word " * 50_000 + "cc by",
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(7, "cc by"), (7, "cc by"), (None, "cc by")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base, r.labels, r.score) for r in scan(df).collect()), key=str)
    want = sorted(((i, *brute(t)) for i, t in list(enumerate(TEXTS)) + [(7, "cc by"), (7, "cc by"), (None, "cc by")]), key=str)
    assert got == want


def test_odd_documents(spark, odd_docs):
    rows = scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.labels == [] and r.score == 0 for r in rows)
    assert scan(odd_docs.limit(0)).count() == 0


def test_wrapped_notices_are_found_whole(spark):
    rows = scan(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t and "\n" in t], "doc_id long, text string")).collect()
    by = {r.doc_id: r.labels for r in rows}
    start = next(i for i, t in enumerate(TEXTS) if t.startswith("/*"))
    assert [by[start + k] for k in range(6)] == [["mit"], ["bsd"], ["gpl", "gpl-notice"], [], [], ["mit"]]


def test_blocks_are_cut_once_and_not_in_a_filter_of_the_scan(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    plan = scan(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().optimizedPlan()
    filters, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        filters += [node.condition().sql()] if node.nodeName() == "Filter" else []
    assert any("arrays_overlap" in f for f in filters)
    assert not any("aggregate(" in f or "transform(" in f for f in filters)
