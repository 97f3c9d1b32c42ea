"""Quotes in texts: all places of many quotes at once, and the integrity of answers that cite them.

sources: job_id, source, field, text   (field is null for the text itself)
evidence: job_id, pos, evidence_id, quote, source, field, occurrences array<struct<start int, end int>> in code points
answers: job_id, pos, question, answer, evidence array<string>
rules: question, pos, answer, least, most, total, sources array<string>, fields array<string>
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.tables import dealt, kept

#: Quotes are looked for in blocks of about so many bytes, each with an automaton that a task builds once.
BLOCK_BYTES = 1 << 20
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
#: The longest quote and the most that all quotes of a vector may have, in code points; sources and fields in their order.
QUOTE_MOST, VECTOR_MOST = 320, 160_000
SOURCES, FIELDS = ("original_jd", "trusted_metadata"), ("company", "title", "location")


def automaton(quotes: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for q in quotes:
        made.add_word(q, q)
    made.make_automaton()
    return made


def find_all(texts: DataFrame, quotes: DataFrame, key: str, text: str, quote_key: str = "quote_id", quote: str = "quote", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, quote_key, start, end): every place of every quote in every text, overlapping ones too, in code points.

    Each text is read once for a block of quotes, by an automaton over all of the block; quotes go to the tasks a block at a time, dealt by hash, so
    that what is sent is bounded however many there are. Empty and null quotes and null texts are found nowhere; quotes that repeat are each found.
    """
    some = quotes.where(F.col(quote) != "").select(F.col(quote_key).alias("__q"), F.col(quote).alias("__quote"))
    total = some.agg(F.sum(F.octet_length("__quote"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    schema = T.StructType([texts.schema[key], quotes.schema[quote_key], *SPAN.fields]) if key != quote_key else None
    if schema is None:
        raise ValueError("texts and quotes need keys of different names")
    sent = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__text"))
    parts = []
    for b in range(n_blocks):
        ids: dict[str, list] = {}
        for r in some.where(F.pmod(F.xxhash64("__quote"), F.lit(n_blocks)) == b).collect():
            ids.setdefault(r["__quote"], []).append(r["__q"])
        if ids:
            parts.append(sent.mapInArrow(finder(texts.sparkSession.sparkContext.broadcast(ids), schema), schema))
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], schema)


def finder(shared, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        found = automaton(list(ids))
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            types = to_arrow_schema(schema).types

            def out():
                made = [pa.array(c, t) for c, t in zip(rows, types)]
                for c in rows:
                    c.clear()
                return pa.RecordBatch.from_arrays(made, names=schema.names)

            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for last, q in found.iter(t):
                    for i in ids[q]:
                        for c, v in zip(rows, (k, i, last + 1 - len(q), last + 1)):
                            c.append(v)
                    if len(rows[0]) >= 50_000:
                        yield out()
            if rows[0]:
                yield out()

    return run


@pandas_udf(T.ArrayType(T.ArrayType(SPAN)))
def places(text: pd.Series, quotes: pd.Series) -> pd.Series:
    """For each of a text's own quotes all its places, by one pass over the text."""

    def one(t, wanted):
        held = {q: [] for q in wanted if q}
        if t and held:
            for last, q in automaton(list(held)).iter(t):
                held[q].append({"start": last + 1 - len(q), "end": last + 1})
        return [held.get(q, []) for q in wanted]

    return pd.Series([one(t, list(q)) for t, q in zip(text, quotes)])


def located(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds actual, all places of each quote in its own source, and there, whether that source exists."""
    at = ["job_id", "source", "__field"]
    keyed = evidence.withColumn("__field", F.coalesce("field", F.lit("")))
    texts = sources.where(F.col("text").isNotNull()).select("job_id", "source", F.coalesce("field", F.lit("")).alias("__field"), F.col("text").alias("__text"))
    wanted = keyed.groupBy(*at).agg(F.collect_set(F.coalesce("quote", F.lit(""))).alias("__quotes")).join(texts, at)
    found = wanted.select(*at, F.explode(F.arrays_zip(F.col("__quotes").alias("quote"), places("__text", "__quotes").alias("actual"))).alias("z")).select(*at, F.col("z.quote").alias("__quote"), "z.actual")
    met = keyed.withColumn("__quote", F.coalesce("quote", F.lit(""))).join(found, [*at, "__quote"], "left")
    return met.withColumn("there", F.col("actual").isNotNull()).drop("__field", "__quote")


def rank(values: tuple[str, ...], c: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)), F.lit(99))


def vector_faults(evidence: DataFrame, answers: DataFrame, sources: DataFrame, rules: DataFrame) -> DataFrame:
    """(job_id, subject, kind): what is wrong with vectors of answers and the evidence that they cite; subject is an evidence id, a question, or `vector`.

    Evidence: `repeated_id`, `source` (none, or a field where none or one is due), `quote_too_long`, `not_found`, `occurrences` (not every exact place, in
    order), `catalog_order`, `unreferenced`. Answers: `membership` (missing or not asked), `answer_order`, `cardinality`, `unknown_evidence`,
    `unauthorized_source`, `unauthorized_field`, `citation_order`, `combined_length`. Vector: `total_length`. A null quote counts as empty and is not found.
    """
    fault = lambda df, kind, subject: df.select("job_id", subject.alias("subject"), F.lit(kind).alias("kind"))

    def faults(df, subject, **broken):
        """All kinds of a table's faults in one pass."""
        kinds = F.array_compact(F.array(*[F.when(when, F.lit(kind)) for kind, when in broken.items()]))
        return df.select("job_id", subject.alias("subject"), F.explode(kinds).alias("kind"))

    own, asked = F.col("evidence_id"), F.col("question")
    e, answers = located(evidence, sources), kept(dealt(answers, "job_id"), "answers")
    told = F.array_sort(F.array_distinct(F.coalesce("occurrences", F.array().cast("array<struct<start:int,end:int>>"))))
    placed = (F.col("source") == "original_jd") == F.col("field").isNull()
    start = F.when(F.col("source") == "original_jd", F.get(told, F.lit(0))["start"])
    end = F.when(F.col("source") == "original_jd", F.get(told, F.lit(0))["end"])
    field = F.when(F.col("source") != "original_jd", rank(FIELDS, F.col("field")))
    proper = Window.partitionBy("job_id").orderBy(rank(SOURCES, F.col("source")), start, end, field, "quote", "evidence_id", "pos")
    stood = e.withColumn("due", F.row_number().over(proper)).withColumn("is", F.row_number().over(Window.partitionBy("job_id").orderBy("pos")))
    stood = stood.withColumn("n", F.count("*").over(Window.partitionBy("job_id", "evidence_id"))).withColumn("told", told)
    e = stood = kept(stood, "evidence")  # texts are searched once for all that follows
    none, told = F.size("actual") == 0, F.col("told")
    out = [
        faults(
            stood, own, repeated_id=F.col("n") > 1, source=~placed | ~F.col("there"), quote_too_long=F.length("quote") > QUOTE_MOST, not_found=F.col("there") & none,
            occurrences=F.col("there") & ~none & (told != F.col("actual")), catalog_order=F.col("due") != F.col("is"),
        ),
        fault(e.groupBy("job_id").agg(F.sum(F.length("quote")).alias("n")).where(F.col("n") > VECTOR_MOST), "total_length", F.lit("vector")),
    ]
    cited = answers.select("job_id", "question", "answer", F.posexplode("evidence").alias("at", "evidence_id"))
    out.append(fault(e.join(cited.select("job_id", "evidence_id").distinct(), ["job_id", "evidence_id"], "left_anti").select("job_id", "evidence_id").distinct(), "unreferenced", own))

    order = rules.groupBy("question").agg(F.min("pos").alias("due"))
    jobs = sources.select("job_id").distinct()
    missing = jobs.crossJoin(F.broadcast(order)).join(answers.select("job_id", "question"), ["job_id", "question"], "left_anti")
    extra = answers.join(order, "question", "left_anti")
    known = answers.join(F.broadcast(order), "question")
    turn = known.withColumn("is", F.row_number().over(Window.partitionBy("job_id").orderBy("pos"))).withColumn("due", F.row_number().over(Window.partitionBy("job_id").orderBy("due", "pos")))
    ruled = answers.drop("pos").join(F.broadcast(rules.drop("pos")), ["question", "answer"])
    n = F.size("evidence")
    out += [fault(missing, "membership", asked), fault(extra, "membership", asked), fault(turn.where("due <> is"), "answer_order", asked), fault(ruled.where((n < F.col("least")) | (n > F.col("most"))), "cardinality", asked)]

    first = stood.groupBy("job_id", "evidence_id").agg(F.min_by(F.struct("source", "field", F.length("quote").alias("length"), F.col("is").alias("place")), "pos").alias("e"))
    met = cited.join(first, ["job_id", "evidence_id"], "left").join(F.broadcast(rules.select("question", "answer", "total", F.col("sources").alias("may"), "fields")), ["question", "answer"], "left")
    met = met.withColumn("before", F.lag("e.place").over(Window.partitionBy("job_id", "question").orderBy("at"))).withColumn("n", F.sum("e.length").over(Window.partitionBy("job_id", "question", "total")))
    allowed = F.array_contains("may", F.col("e.source"))
    field_allowed = F.coalesce(F.array_contains("fields", F.col("e.field")), F.lit(False))
    out.append(
        faults(
            met, asked, unknown_evidence=F.col("e").isNull(), unauthorized_source=~allowed, unauthorized_field=allowed & (F.col("e.source") == "trusted_metadata") & ~field_allowed,
            citation_order=F.col("e.place") <= F.col("before"), combined_length=F.col("n") > F.col("total"),
        )
    )
    return reduce(DataFrame.unionByName, out).distinct()
