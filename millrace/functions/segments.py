"""Pieces of texts with their places, counted in code points: lines, sentences, blocks, quotes."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
LONGEST, LEAST = 1200, 400
BOUNDARY = re.compile(r"\n+|(?<=[.!?;])[ \t]+")


@pandas_udf(T.ArrayType(T.IntegerType()))
def line_starts(s: pd.Series) -> pd.Series:
    return s.map(lambda t: list(accumulate((len(x) + 1 for x in t.split("\n")[:-1]), initial=0)), na_action="ignore")


def located_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, start, line): every line with the place where it begins."""
    both = F.arrays_zip(F.split(F.col(text), "\n", -1).alias("line"), line_starts(F.col(text)).alias("start"))
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(both).alias("line_no", "z")).select(key, "line_no", "z.start", "z.line")


def cut(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A stretch in parts of LONGEST at most, cut after a blank if there is one beyond LEAST."""
    out = []
    while b - a > LONGEST:
        at = max(text.rfind(" ", a + LEAST, a + LONGEST), text.rfind("\t", a + LEAST, a + LONGEST))
        at = at + 1 if at >= a + LEAST else a + LONGEST
        out.append((a, at))
        a = at
    return [*out, (a, b)] if b > a else out


def block_spans(text: str | None) -> list[tuple[int, int]]:
    """Sentences and lines as blocks that together are the text; a blank stretch belongs to the block after it, at the end to the last one."""
    text = text or ""
    ends = [m.end() for m in BOUNDARY.finditer(text)]
    out: list[tuple[int, int]] = []
    a = 0
    for b in [*ends, len(text)]:
        if b > a and text[a:b].strip():
            out += cut(text, a, b)
            a = b
    if out and a < len(text):
        out[-1] = (out[-1][0], len(text))
    return out


@pandas_udf(SPAN)
def blocks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"start": a, "end": b} for a, b in block_spans(x)])


def located_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_id, start, end, block): a loss-less partition of each text."""
    rows = df.select(key, F.col(text).alias("__t"), F.posexplode(blocks(F.col(text))).alias("n", "s"))
    block = F.substring(F.col("__t"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select(key, F.format_string("J%04d", F.col("n") + 1).alias("block_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), block.alias("block"))


def cleaned(blocks: DataFrame, key: str, removed: DataFrame, restored: DataFrame) -> DataFrame:
    """(key, text): the blocks that aren't removed, or are restored, put together; a text that would be empty stays whole."""
    drop = removed.select(key, "block_id").join(restored.select(key, "block_id"), [key, "block_id"], "left_anti").withColumn("__gone", F.lit(True))
    held = blocks.join(drop, [key, "block_id"], "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "block", F.coalesce("__gone", F.lit(False)).alias("gone")))).alias("b"))
    join = lambda xs: F.array_join(F.transform(xs, lambda x: x["block"]), "")
    kept = join(F.filter("b", lambda x: ~x["gone"]))
    return held.select(key, F.when(F.trim(kept) != "", kept).otherwise(join(F.col("b"))).alias("text"))


@pandas_udf(SPAN)
def occurrences(text: pd.Series, quote: pd.Series) -> pd.Series:
    """All places of a quote, overlapping ones too; none for an empty or missing quote."""

    def one(t, q):
        out, at = [], t.find(q) if t and q else -1
        while at >= 0:
            out.append({"start": at, "end": at + len(q)})
            at = t.find(q, at + 1)
        return out

    return pd.Series([one(t, q) for t, q in zip(text, quote)])


def concept_key(text: Column) -> Column:
    """Slug of a criterion's first twelve normal words and a digest of them all."""
    t = F.lower(text)
    for pattern, by in ((r"\b(?:required|preferred) verification item\s*:\s*", ""), (r"\bproperty\s*(?:&|and)\s*casualty\b|\bp\s*&\s*c\b", "property casualty"), (r"\bcustomer relationship management\b", "crm"), (r"\bbachelor(?:'s|’s)?\b", "bachelor"), (r"\b(?:is|required|preferred|must have|minimum of|at least)\b", " "), ("[^a-z0-9]+", " ")):
        t = F.regexp_replace(t, pattern, by)
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    slug = F.coalesce(F.nullif(F.array_join(F.slice(F.split(t, " "), 1, 12), "-"), F.lit("")), F.lit("unknown-criterion"))
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(t, 256), 1, 10))
