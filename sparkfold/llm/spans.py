"""Places of regular expressions in texts, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 256


def _running(steps: Column) -> Column:
    """Running sums of an array of longs, in chunks so that long arrays take no quadratic time."""
    n_chunks = F.ceil(F.size(steps) / F.lit(STEP)).cast("int")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    chunks = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda k: F.slice(steps, k * STEP + 1, F.lit(STEP)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
    bases = F.transform(F.sequence(F.lit(1), n_chunks), lambda k: F.aggregate(F.slice(sums, F.lit(1), k - 1), zero, lambda a, x: a + x))

    def inside(chunk: Column, base: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
        return F.aggregate(chunk, F.struct(base.alias("at"), none.alias("out")), step, lambda a: a["out"])

    return F.flatten(F.zip_with(chunks, bases, inside))


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]], context: int = 24) -> DataFrame:
    """Adds for each name an array of its pattern's leftmost non-overlapping matches, null if none.

    patterns: name to (Java regular expression that matches no empty string, cheap test that must hold).
    An element has start and end (code points, end exclusive), found, before (up to ``context``
    characters since the match before) and after (one character). Each step is a projection of its
    own, so that a regular expression runs once for its matches and, where there are any, once for
    the text between them.
    """
    names = list(patterns)
    some = {n: F.size(f"_f_{n}") > 0 for n in names}
    df = df.withColumns({f"_f_{n}": F.when(may, F.regexp_extract_all(F.col(text), F.lit(p), 0)) for n, (p, may) in patterns.items()})
    df = df.withColumns({f"_b_{n}": F.when(some[n], F.split(F.col(text), patterns[n][0], -1)) for n in names})
    df = df.withColumns({f"_s_{n}": F.when(some[n], F.zip_with(F.slice(f"_b_{n}", 1, F.size(f"_f_{n}")), f"_f_{n}", lambda b, f: F.length(b).cast("long") + F.length(f))) for n in names})
    df = df.withColumns({f"_e_{n}": F.when(some[n], _running(F.col(f"_s_{n}"))) for n in names})

    def rows(n: str) -> Column:
        size = F.size(f"_f_{n}")
        parts = F.arrays_zip(F.col(f"_f_{n}").alias("found"), F.col(f"_e_{n}").alias("end"), F.slice(f"_b_{n}", 1, size).alias("before"), F.slice(f"_b_{n}", 2, size).alias("after"))
        return F.when(
            some[n],
            F.transform(
                parts,
                lambda x: F.struct((x["end"] - F.length(x["found"])).alias("start"), x["end"].alias("end"), x["found"].alias("found"), F.right(x["before"], F.lit(context)).alias("before"), F.left(x["after"], F.lit(1)).alias("after")),
            ),
        )

    df = df.withColumns({n: rows(n) for n in names})
    return df.drop(*[f"_{x}_{n}" for x in "fbse" for n in names])
