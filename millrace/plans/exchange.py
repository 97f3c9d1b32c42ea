"""Documents that are exchanged: their schemas, bounded exports and what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.json_schema import violations
from millrace.operators import exports
from millrace.plans.registry import query
from millrace.tables import dealt, shared_path, table

#: What an event's message must look like.
MESSAGE = {
    "$defs": {"tag": {"type": "string", "minLength": 2, "maxLength": 8, "pattern": "^[a-z]+$"}},
    "type": "object",
    "required": ["id", "type", "value"],
    "additionalProperties": False,
    "maxProperties": 8,
    "properties": {
        "id": {"type": "integer", "minimum": 100, "maximum": 9000},
        "type": {"enum": ["click", "view", "error", "purchase"]},
        "value": {"anyOf": [{"type": "number", "minimum": 0}, {"type": "null"}]},
        "tags": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/tag"}},
        "kind": {"const": "event"},
        "pair": {"type": "array", "prefixItems": [{"type": "integer"}, {"type": "string"}], "items": False},
        "user": {"oneOf": [{"type": "integer", "maximum": 50}, {"type": "integer", "minimum": 40}]},
        "key": {"type": "string", "format": "uuid"},
        "props": {"allOf": [{"type": "object", "minProperties": 1}, {"additionalProperties": {"type": "integer", "maximum": 90}}]},
    },
}
#: An event's message as text, in SQL that both engines read alike. Each fault has its own share of the events.
MESSAGE_SQL = """concat('{"id":', CASE WHEN event_id % 31 = 0 THEN concat('"', event_id, '"') ELSE concat('', event_id) END, CASE WHEN event_id % 29 = 0 THEN '' ELSE concat(',"type":"', event_type, '"') END,
',"value":', CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '-1' WHEN 2 THEN '"3"' WHEN 3 THEN '2.5' ELSE '7' END,
',"tags":', CASE event_id % 11 WHEN 0 THEN '[]' WHEN 1 THEN '["ab","cd","ef","gh"]' WHEN 2 THEN '["ab","ab"]' WHEN 3 THEN '["a"]' WHEN 4 THEN '["abcdefghi"]' WHEN 5 THEN '["aB","x1"]' WHEN 6 THEN '{}' ELSE concat('["', event_type, '"]') END,
',"kind":', CASE WHEN event_id % 13 = 0 THEN '"row"' ELSE '"event"' END, ',"pair":', CASE event_id % 17 WHEN 0 THEN '[1,2]' WHEN 1 THEN '[1,"a",null]' WHEN 2 THEN '["b"]' ELSE '[1,"a"]' END,
',"user":', user_id, CASE WHEN event_id % 19 = 0 THEN ',"key":"123e4567-e89b-12d3-a456-42661417400"' WHEN event_id % 19 = 1 THEN ',"key":"123e4567-e89b-12d3-a456-426614174000"' ELSE '' END,
CASE WHEN event_id % 23 = 0 THEN ',"props":{}' WHEN event_id % 23 < 9 THEN concat(',"props":', props) ELSE '' END, CASE WHEN event_id % 37 = 0 THEN ',"more":1' ELSE '' END, CASE WHEN event_id % 41 = 0 THEN '' ELSE '}' END)"""


@query(f"""WITH m AS (SELECT event_id AS id, CASE WHEN json_valid(m) THEN m::JSON END AS j FROM (SELECT event_id, {MESSAGE_SQL} AS m FROM events)),
t AS (SELECT id, i, json_extract_string(j, '$.tags[' || i || ']') AS tag FROM m, range(4) r(i) WHERE json_type(j, '$.tags') = 'ARRAY' AND i < json_array_length(j, '$.tags')),
p AS (SELECT id, k, json_extract(j, '$.props.' || k) AS v FROM (SELECT id, j, unnest(json_keys(j, '$.props')) AS k FROM m)),
k AS (SELECT id, j, unnest(json_keys(j)) AS k FROM m)
SELECT id, '$' AS path, 'json' AS rule FROM m WHERE j IS NULL
UNION ALL SELECT id, '$.' || r, 'required' FROM m, unnest(['id', 'type', 'value']) x(r) WHERE j IS NOT NULL AND NOT json_exists(j, '$.' || r)
UNION ALL SELECT id, '$.' || k, 'additionalProperties' FROM k WHERE k NOT IN ('id', 'type', 'value', 'tags', 'kind', 'pair', 'user', 'key', 'props')
UNION ALL SELECT id, '$', 'maxProperties' FROM m WHERE len(json_keys(j)) > 8
UNION ALL SELECT id, '$.id', 'type' FROM m WHERE json_type(j, '$.id') NOT IN ('UBIGINT', 'BIGINT')
UNION ALL SELECT id, '$.id', 'minimum' FROM m WHERE json_type(j, '$.id') = 'UBIGINT' AND (j->>'$.id')::BIGINT < 100
UNION ALL SELECT id, '$.id', 'maximum' FROM m WHERE json_type(j, '$.id') = 'UBIGINT' AND (j->>'$.id')::BIGINT > 9000
UNION ALL SELECT id, '$.type', 'enum' FROM m WHERE j->>'$.type' NOT IN ('click', 'view', 'error', 'purchase')
UNION ALL SELECT id, '$.value', 'anyOf' FROM m WHERE CASE json_type(j, '$.value') WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN true ELSE (j->>'$.value')::DOUBLE < 0 END
UNION ALL SELECT id, '$.tags', 'type' FROM m WHERE json_type(j, '$.tags') <> 'ARRAY'
UNION ALL SELECT id, '$.tags', 'minItems' FROM m WHERE json_type(j, '$.tags') = 'ARRAY' AND json_array_length(j, '$.tags') < 1
UNION ALL SELECT id, '$.tags', 'maxItems' FROM m WHERE json_type(j, '$.tags') = 'ARRAY' AND json_array_length(j, '$.tags') > 3
UNION ALL SELECT id, '$.tags', 'uniqueItems' FROM t GROUP BY id HAVING count(DISTINCT tag) < count(*)
UNION ALL SELECT id, '$.tags[' || i || ']', 'minLength' FROM t WHERE length(tag) < 2
UNION ALL SELECT id, '$.tags[' || i || ']', 'maxLength' FROM t WHERE length(tag) > 8
UNION ALL SELECT id, '$.tags[' || i || ']', 'pattern' FROM t WHERE NOT regexp_matches(tag, '^[a-z]+$')
UNION ALL SELECT id, '$.kind', 'const' FROM m WHERE j->>'$.kind' <> 'event'
UNION ALL SELECT id, '$.pair[0]', 'type' FROM m WHERE json_type(j, '$.pair[0]') <> 'UBIGINT'
UNION ALL SELECT id, '$.pair[1]', 'type' FROM m WHERE json_type(j, '$.pair[1]') <> 'VARCHAR'
UNION ALL SELECT id, '$.pair', 'items' FROM m WHERE json_array_length(j, '$.pair') > 2
UNION ALL SELECT id, '$.user', 'oneOf' FROM m WHERE (j->>'$.user')::BIGINT BETWEEN 40 AND 50
UNION ALL SELECT id, '$.key', 'format' FROM m WHERE NOT regexp_matches(j->>'$.key', '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-8][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$')
UNION ALL SELECT id, '$.props', 'minProperties' FROM m WHERE len(json_keys(j, '$.props')) < 1
UNION ALL SELECT id, '$.props.' || k, 'maximum' FROM p WHERE v::BIGINT > 90""")
def message_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, some with faults: each rule of the schema that one breaks, and where."""
    m = dealt(table(spark, sf_dir, "events")).select(F.col("event_id").alias("id"), F.expr(MESSAGE_SQL).alias("m"))
    return m.select("id", F.explode(violations(F.col("m"), MESSAGE)).alias("v")).select("id", "v.path", "v.rule")


PAYLOAD_SQL = """concat('{"id":', doc_id, ',"hash":"', CASE WHEN doc_id % 50 = 7 THEN repeat('x', 1500) WHEN doc_id % 50 < 30 THEN '' ELSE repeat('y', CAST(doc_id % 50 * 9 AS INT)) END, '","lang":"', lang, '"}')"""
#: Small bounds, so that both are met.
ITEMS, BYTES = 7, 2000


def export_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PAYLOAD_SQL).alias("payload"))


@query(f"""WITH p AS (SELECT doc_id, {PAYLOAD_SQL} AS payload FROM documents), n AS (SELECT *, strlen(payload) + 1 AS n, strlen(payload) + 1 > {BYTES // 2} AS big FROM p),
o AS (SELECT *, coalesce(sum(n) OVER w, 0) // {BYTES // 2} AS bucket, coalesce(sum(big::INT) OVER w, 0) AS bigs FROM n WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY bigs, big, bucket ORDER BY doc_id) - 1 AS i FROM o)
SELECT printf('%08d-%d-%08d-%05d', bigs::BIGINT, big::INT, bucket::BIGINT, i // {ITEMS}) AS file, count(*) AS n_items, sum(n)::BIGINT AS bytes, sha256(string_agg(concat(i % {ITEMS}, ':', doc_id, ':', sha256(payload)), chr(10) ORDER BY i)) AS manifest_hash FROM r GROUP BY 1""")
def export_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into small files by running sums, with each file's manifest."""
    return exports.manifests(exports.pack(export_items(spark, sf_dir), "doc_id", "payload", ITEMS, BYTES))


@query("""SELECT CAST(doc_id AS VARCHAR) AS key, unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'missing' END, CASE WHEN doc_id % 11 = 1 THEN 'hash' END, CASE WHEN doc_id % 11 = 2 THEN 'order' END, CASE WHEN doc_id % 11 = 3 THEN 'repeated' END, CASE WHEN doc_id % 11 = 4 THEN 'version' END], lambda x: x IS NOT NULL)) AS fault FROM documents
UNION ALL SELECT concat('x', doc_id), 'extra' FROM documents WHERE doc_id % 11 = 5""")
def export_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export that is written and read back is sound; results of it that lack members, have others, and were tampered with are told, each by its fault."""
    folder = shared_path(spark, "export")
    exports.write_export(exports.pack(export_items(spark, sf_dir), "doc_id", "payload", ITEMS, BYTES), folder)
    items, manifest = exports.read_export(spark, folder)
    k, same = F.col("key").cast("long") % 11, items.withColumn("policy", F.lit("v1")).where("key % 11 <> 0")
    changed = same.select("file", F.when(k == 2, F.col("ordinal") + 100).otherwise(F.col("ordinal")).alias("ordinal"), "key", F.when(k == 1, F.sha2("key", 256)).otherwise(F.col("input_hash")).alias("input_hash"), F.when(k == 4, F.lit("v0")).otherwise(F.col("policy")).alias("policy"))
    more = changed.where("key % 11 = 3").unionByName(changed.where("key % 11 = 5").withColumn("key", F.concat(F.lit("x"), "key")))
    sound = exports.faults(items, manifest).select("key", "fault")
    return exports.faults(changed.unionByName(more), manifest, {"policy": "v1"}).select("key", "fault").unionByName(sound)
