"""The queries of the data-preparation operators of the core, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, drift, grid, snapdiff
from ..shared import Scratch


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compact(_table(spark, d, "part_files")).repeats


def p1_compacted(spark: SparkSession, d: str) -> DataFrame:
    done = compaction.compact(_table(spark, d, "part_files"))
    return compaction.publish(done, Scratch(spark, "published").path).drop("other")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """What it's all about: of each item, in how many files its records are."""
    done = compaction.compact(_table(spark, d, "part_files"))
    return compaction.layout(compaction.publish(done, Scratch(spark, "published").path))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("origin = 'filled'").select("collection_name", "item_name", "period_no")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(_table(spark, d, "item_readings"), _table(spark, d, "collection_info"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_table(spark, d, "schema_files")).select("collection_name", "item_name", "schema_version", "change_type", "column_name")


def p4_cast_failures(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(_table(spark, d, "schema_files"))[1]


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    table = drift.consistent_table(_table(spark, d, "schema_files"))[0]
    return table.select("collection_name", "item_name", "schema_version", "line_no", "idx_us", *(F.to_json(c).alias(c) for c in ("ints", "floats", "bools", "texts")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = snapdiff.changes(_table(spark, d, "snapshot_rows"), _table(spark, d, "snapshot_list"))
    return found.select("collection_name", "snapshot_name", "item_name", "category", "idx_us", "change_kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_compacted": p1_compacted,
        "p1_files": p1_files,
        "p2_found": p2_found,
        "p2_grid": _grid,
        "p4_found": p4_found,
        "p4_table": p4_table,
        "p4_cast_failures": p4_cast_failures,
        "p5_found": p5_found,
    }


# An instant in microseconds of the column {x}: ISO 8601, extended or basic, UTC where no offset is given.
_INSTANT = r"epoch_us(try_cast(regexp_replace(regexp_replace({x}, '^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})', '\1-\2-\3T\4:\5:\6'), '^(\d{{4}}-\d{{2}}-\d{{2}}[T ][0-9:.]+)$', '\1Z') as timestamptz))"

_P1_RECORDS = rf"""
  lines AS (
    SELECT file_id, collection_name, CASE WHEN item_name LIKE '\_\_%' ESCAPE '\' THEN substr(item_name, 3) ELSE item_name END AS item,
           unnest(string_split(payload, chr(10))) AS line, generate_subscripts(string_split(payload, chr(10)), 1) AS line_no
    FROM part_files WHERE payload IS NOT NULL),
  fields AS (
    SELECT file_id, collection_name, item, line_no, json_extract_string(line, '$.index') AS idx,
           json_extract_string(line, '$.value1') AS v1, json_extract_string(line, '$.value2') AS v2, json_extract_string(line, '$.category') AS category
    FROM lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
  records AS (
    SELECT file_id, CAST(line_no AS INT) AS line_no, collection_name, item,
           CASE WHEN regexp_full_match(idx, '-?\d+') THEN CAST(idx AS BIGINT) * 1000 ELSE {_INSTANT.format(x="idx")} END AS idx_us,
           CAST(v1 AS DOUBLE) AS value1, CAST(v2 AS DOUBLE) AS value2, category
    FROM fields)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": rf"""
WITH {_P1_RECORDS}
SELECT file_id, line_no FROM records
QUALIFY row_number() OVER (PARTITION BY collection_name, item, idx_us, value1, value2, category ORDER BY file_id, line_no) > 1""",
        "p1_compacted": rf"""
WITH {_P1_RECORDS}
SELECT DISTINCT collection_name, item AS item_name, idx_us, value1, value2, category FROM records""",
        "p1_files": rf"""
WITH {_P1_RECORDS}
SELECT collection_name, item AS item_name, CAST(1 AS BIGINT) AS n_files, count(*) AS n_records
FROM (SELECT DISTINCT collection_name, item, idx_us, value1, value2, category FROM records) GROUP BY 1, 2""",
        "p2_found": rf"""
WITH usable AS (
    SELECT r.collection_name, item_name,
           CASE WHEN index_dtype = 'int64' THEN idx_int // (CAST(step_s AS BIGINT) * CASE index_unit WHEN 'ns' THEN 1000000000 WHEN 'ms' THEN 1000 ELSE 1 END)
                WHEN index_dtype = 'object' THEN {_INSTANT.format(x="idx_text")} // (CAST(step_s AS BIGINT) * 1000000)
                ELSE epoch_us(idx_ts) // (CAST(step_s AS BIGINT) * 1000000) END AS p
    FROM item_readings r JOIN collection_info i ON r.collection_name = i.collection_name
    WHERE value1 IS NOT NULL AND NOT isnan(value1)),
  seen AS (SELECT DISTINCT collection_name, item_name, CAST(p AS BIGINT) AS p FROM usable WHERE p IS NOT NULL),
  steps AS (SELECT *, lead(p) OVER (PARTITION BY collection_name, item_name ORDER BY p) AS n FROM seen)
SELECT collection_name, item_name, unnest(range(p + 1, n)) AS period_no FROM steps WHERE n > p + 1""",
        "p4_found": rf"""
WITH v AS (
    SELECT collection_name, item_name, schema_version, schema_file_id, col_names, list_transform(col_dtypes, lambda x: lower(trim(x))) AS dtypes, lower(trim(index_dtype)) AS idx, payload
    FROM schema_files WHERE schema_version IS NOT NULL AND col_names IS NOT NULL AND col_dtypes IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY collection_name, item_name, schema_version ORDER BY schema_file_id) = 1),
  p AS (
    SELECT *, lead(schema_version) OVER w AS nv, lead(schema_file_id) OVER w AS nf, lead(col_names) OVER w AS nn, lead(dtypes) OVER w AS nd, lead(idx) OVER w AS ni
    FROM v WINDOW w AS (PARTITION BY collection_name, item_name ORDER BY schema_version)),
  q AS (
    SELECT *, list_filter(col_names, lambda x: NOT list_contains(nn, x)) AS gone, list_filter(nn, lambda x: NOT list_contains(col_names, x)) AS fresh,
           list_filter(col_names, lambda x: list_contains(nn, x)) AS kept
    FROM p WHERE nv IS NOT NULL),
  fields AS (
    SELECT schema_file_id, col_names, idx, string_split(line, ',') AS f
    FROM (SELECT schema_file_id, col_names, idx, unnest(string_split(replace(payload, chr(13), ''), chr(10))) AS line FROM v) WHERE line <> ''),
  cells AS (
    SELECT schema_file_id, col_names[k] AS name, nullif(f[k + 1], '') AS value,
           CASE WHEN idx = 'int64' AND regexp_full_match(trim(f[1]), '-?\d+') THEN TRY_CAST(f[1] AS BIGINT) // 1000 ELSE {_INSTANT.format(x="f[1]")} END AS us
    FROM (SELECT *, unnest(range(1, len(col_names) + 1)) AS k FROM fields)),
  renames AS (
    SELECT q.schema_file_id, a.name AS old_name, b.name AS new_name
    FROM q JOIN cells a ON a.schema_file_id = q.schema_file_id AND list_contains(q.gone, a.name) AND a.value IS NOT NULL
           JOIN cells b ON b.schema_file_id = q.nf AND list_contains(q.fresh, b.name) AND b.value IS NOT NULL AND a.us = b.us
    GROUP BY ALL HAVING count(*) >= 2 AND bool_and(a.value = b.value OR coalesce(TRY_CAST(a.value AS DOUBLE) = TRY_CAST(b.value AS DOUBLE), false))),
  paired AS (
    SELECT q.*, unnest(kept) AS old_name, unnest(kept) AS new_name FROM q
    UNION ALL SELECT q.*, r.old_name, r.new_name FROM q JOIN renames r USING (schema_file_id)),
  found AS (
    SELECT collection_name, item_name, nv, 'column_renamed' AS t, new_name AS c FROM paired WHERE old_name <> new_name
    UNION SELECT collection_name, item_name, nv, 'type_changed', new_name FROM paired WHERE dtypes[list_position(col_names, old_name)] IS DISTINCT FROM nd[list_position(nn, new_name)]
    UNION SELECT collection_name, item_name, nv, 'column_added', x FROM (SELECT *, unnest(fresh) AS x FROM q) q WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.schema_file_id = q.schema_file_id AND r.new_name = x)
    UNION SELECT collection_name, item_name, nv, 'column_removed', x FROM (SELECT *, unnest(gone) AS x FROM q) q WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.schema_file_id = q.schema_file_id AND r.old_name = x)
    UNION SELECT collection_name, item_name, nv, 'columns_reordered', '' FROM q WHERE kept <> list_filter(nn, lambda x: list_contains(col_names, x))
    UNION SELECT collection_name, item_name, nv, 'index_type_changed', '' FROM q WHERE idx IS DISTINCT FROM ni)
SELECT collection_name, item_name, nv AS schema_version, t AS change_type, c AS column_name FROM found""",
        "p5_found": """
WITH no AS (
    SELECT collection_name, snapshot_name, row_number() OVER w AS k, lead(snapshot_name) OVER w AS later
    FROM snapshot_list WINDOW w AS (PARTITION BY collection_name ORDER BY taken_at)),
  one AS (
    SELECT r.collection_name, n.k, r.snapshot_name, n.later, item_name, category, epoch_us(idx) AS idx_us,
           CASE WHEN NOT isnan(value1) THEN value1 END AS v1, CASE WHEN NOT isnan(value2) THEN value2 END AS v2, remark
    FROM snapshot_rows r JOIN no n ON r.collection_name = n.collection_name AND r.snapshot_name = n.snapshot_name
    QUALIFY row_number() OVER (PARTITION BY r.collection_name, r.snapshot_name, item_name, category, idx ORDER BY row_id) = 1),
  old AS (SELECT * FROM one WHERE later IS NOT NULL), new AS (SELECT * FROM one WHERE k > 1)
SELECT coalesce(b.collection_name, a.collection_name) AS collection_name, coalesce(b.snapshot_name, a.later) AS snapshot_name,
       coalesce(b.item_name, a.item_name) AS item_name, coalesce(b.category, a.category) AS category, coalesce(b.idx_us, a.idx_us) AS idx_us,
       CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM old a FULL JOIN new b ON a.collection_name = b.collection_name AND a.k + 1 = b.k AND a.item_name = b.item_name AND a.category = b.category AND a.idx_us = b.idx_us
WHERE a.k IS NULL OR b.k IS NULL OR (a.v1 IS NULL) <> (b.v1 IS NULL) OR abs(a.v1 - b.v1) > 1e-9
   OR (a.v2 IS NULL) <> (b.v2 IS NULL) OR abs(a.v2 - b.v2) > 1e-9 OR a.remark IS DISTINCT FROM b.remark""",
    }
