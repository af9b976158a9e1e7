"""Files of one item whose fields are added, renamed, removed or change type.

Method: every row is loaded as a map from path (the field's name) to raw
value, so that files of any schema are one table.  Statistics of what raw types
a path's values have are aggregated by file.  The types of an item's table are
derived from those statistics and what the files declare, and the maps are
projected to typed columns; a value that can't be cast is reported with its
place, and is not lost: its text stays beside the null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.neighbours import with_next
from ..functions.normal import instant_us, number
from ..shared import Scratch

ITEM = ["collection_name", "item_name"]
VERSION = [*ITEM, "schema_version"]
#: Versions are looked up by their next one in groups of so many version numbers.
WIDTH = 4096


def _plain(dtype: Column) -> Column:
    """Dtypes that differ only in case or outer blanks are the same."""
    return F.lower(F.trim(dtype, F.lit(" \t\r\n")))


def versions(files: DataFrame) -> DataFrame:
    """One row for each version of an item: of several files with its number, the one with the least
    ``schema_file_id``.  Files without a number or a list of columns are left out."""
    usable = files.where("schema_version is not null and col_names is not null and col_dtypes is not null and item_name is not null and collection_name is not null")
    row = F.struct("schema_file_id", "written_at", "col_names", F.transform("col_dtypes", _plain).alias("dtypes"), _plain(F.col("index_dtype")).alias("index_dtype"))
    return usable.groupBy(*VERSION).agg(F.min_by(row, "schema_file_id").alias("_row")).select(*VERSION, "_row.*")


def path_values(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``schema_file_id, line_no, idx_us, values`` (and what ``wanted`` has for the file), for each row of each
    payload: the map has a text for each of the file's fields, null for an empty one.

    With ``wanted``, only its files are read.  A line with other than one
    field for each column gives what it has, in order.  The index is an
    instant, or null where it can't be read; integers under ``int64`` are
    epoch nanoseconds.
    """
    source = files.select("schema_file_id", "col_names", "index_dtype", "payload")
    source = source if wanted is None else source.join(wanted, "schema_file_id")
    extra = [] if wanted is None else [c for c in wanted.columns if c != "schema_file_id"]
    lines = source.where("col_names is not null").select("schema_file_id", "col_names", "index_dtype", *extra, F.posexplode(F.split("payload", "\r?\n")).alias("_line", "_text")).where("_text != ''")
    split = lines.withColumn("_f", F.split("_text", ",", -1))
    values = F.transform("col_names", lambda name, k: F.struct(name.alias("key"), F.nullif(F.try_element_at("_f", k + 2), F.lit("")).alias("value")))
    index = F.trim(F.col("_f")[0])
    nanos = F.rlike(index, F.lit(r"^-?\d+$")) & (_plain(F.col("index_dtype")) == "int64")
    instant = F.when(nanos, F.call_function("div", index.try_cast("bigint"), F.lit(1000).cast("bigint"))).otherwise(instant_us(index))
    # of repeated names the first one holds
    return split.select("schema_file_id", (F.col("_line") + 1).alias("line_no"), *extra, instant.alias("idx_us"), F.map_from_entries(_first_of_each(values)).alias("values"))


def _first_of_each(entries: Column) -> Column:
    names = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, k: e["key"].isNotNull() & (F.array_position(names, e["key"]) == k + 1))


def raw_type(text: Column) -> Column:
    """The narrowest of int, float, bool, text that a raw value reads as; null for null."""
    t = F.trim(text)
    return (
        F.when(F.rlike(t, F.lit(r"^[+-]?\d{1,18}$")), "int").when(number(text).isNotNull(), "float").when(F.lower(t).isin("true", "false"), "bool").when(text.isNotNull(), "text")
    )


def path_types(rows: DataFrame) -> DataFrame:
    """``schema_file_id, path, n_rows, n_null, n_int, n_float, n_bool, n_text``: the raw types of each path by file."""
    cells = rows.select("schema_file_id", F.explode("values").alias("path", "_v")).select("schema_file_id", "path", raw_type(F.col("_v")).alias("_t"))
    counts = [F.count_if(F.col("_t") == t).alias(f"n_{t}") for t in ("int", "float", "bool", "text")]
    return cells.groupBy("schema_file_id", "path").agg(F.count("*").alias("n_rows"), F.count_if(F.col("_t").isNull()).alias("n_null"), *counts)


def _pairs(known: DataFrame) -> DataFrame:
    """Each version with the next one present."""
    return with_next(known, ITEM, "schema_version", ["schema_file_id", "col_names", "dtypes", "index_dtype"], WIDTH).where("next_schema_version is not null")


def _renames(files: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``collection_name, item_name, schema_version`` (the earlier one), ``old_name, new_name``: gone and new names
    with at least two rows, of the same index instant, that have both values, all of them equal."""
    asked = pairs.where("size(gone) > 0 and size(fresh) > 0")
    pair = [*VERSION, "gone", "fresh"]
    # only files that may hold a rename are read, each as the earlier one, the later one, or both
    sides = asked.select("schema_file_id", F.struct(*pair, F.lit(True).alias("earlier")).alias("_as")).unionByName(asked.select(F.col("next_schema_file_id").alias("schema_file_id"), F.struct(*pair, F.lit(False).alias("earlier")).alias("_as")))
    wanted = sides.groupBy("schema_file_id").agg(F.collect_list("_as").alias("_as"))  # two entries at most
    rows = path_values(files, wanted).where("idx_us is not null").select("idx_us", "values", F.explode("_as").alias("_as")).select("_as.*", "idx_us", "values")
    names = F.when(F.col("earlier"), F.col("gone")).otherwise(F.col("fresh"))
    named = F.filter(F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at("values", n).alias("value"))), lambda s: s["value"].isNotNull())
    # written, so that a payload is read once, not once as the earlier and once as the later side
    held = scratch.write(rows.select(*VERSION, "earlier", "idx_us", named.alias("_named")).where("size(_named) > 0"), "sides")
    old = held.where("earlier").select(*VERSION, "idx_us", F.col("_named").alias("_old"))
    new = held.where("not earlier").select(*VERSION, "idx_us", F.col("_named").alias("_new"))
    both = old.join(new, [*VERSION, "idx_us"]).select(*VERSION, F.explode("_old").alias("_old"), "_new").select(*VERSION, "_old", F.explode("_new").alias("_new"))
    x, y = F.col("_old.value"), F.col("_new.value")
    equal = F.coalesce(number(x) == number(y), F.lit(False)) | (x == y)
    found = both.groupBy(*VERSION, F.col("_old.name").alias("old_name"), F.col("_new.name").alias("new_name")).agg(F.count("*").alias("_n"), F.every(equal).alias("_all"))
    return found.where("_n >= 2 and _all").select(*VERSION, "old_name", "new_name")


def changes(files: DataFrame) -> DataFrame:
    """``collection_name, item_name, schema_version, change_type, column_name``, and ``old_name, old_type,
    new_type`` where they apply, for each change between a version of an item and the next version present.

    Names are told apart by case, dtypes aren't.  If a gone name agrees with
    several new ones, or a new one with several gone ones, each agreement is a
    rename.  Missing numbers are passed over; late and repeated files don't
    count twice.
    """
    scratch = Scratch(files.sparkSession, "drift")
    known = scratch.write(versions(files), "versions")
    names = F.col("col_names")
    pairs = _pairs(known).withColumns({"gone": F.array_except(names, "next_col_names"), "fresh": F.array_except("next_col_names", names)})
    pairs = scratch.write(pairs, "pairs")
    renames = _renames(files, pairs, scratch).groupBy(*VERSION).agg(F.collect_set(F.struct("old_name", "new_name")).alias("renamed"))
    # the sets are no longer than the two lists of names allow
    every = pairs.join(renames, VERSION, "left").withColumn("renamed", F.coalesce("renamed", F.expr("array()")))
    types = lambda n, d, name: F.element_at(F.col(d), F.array_position(F.col(n), name).cast("int"))
    none = F.lit(None).cast("string")

    def change(kind: str, name: Column, old: Column = none, before: Column = none, after: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("change_type"), name.alias("column_name"), old.alias("old_name"), before.alias("old_type"), after.alias("new_type"))

    kept = F.array_intersect(names, F.col("next_col_names"))
    old_names, new_names = F.transform("renamed", lambda r: r["old_name"]), F.transform("renamed", lambda r: r["new_name"])
    same = F.concat(F.transform(kept, lambda n: F.struct(n.alias("old_name"), n.alias("new_name"))), F.col("renamed"))
    typed = F.transform(same, lambda r: change("type_changed", r["new_name"], r["old_name"], types("col_names", "dtypes", r["old_name"]), types("next_col_names", "next_dtypes", r["new_name"])))
    in_next = F.array_intersect(F.col("next_col_names"), names)
    found = F.concat(
        F.transform("renamed", lambda r: change("column_renamed", r["new_name"], r["old_name"], none, none)),
        F.transform(F.array_except("fresh", new_names), lambda n: change("column_added", n, none, none, types("next_col_names", "next_dtypes", n))),
        F.transform(F.array_except("gone", old_names), lambda n: change("column_removed", n, n, types("col_names", "dtypes", n), none)),
        F.filter(typed, lambda c: ~c["old_type"].eqNullSafe(c["new_type"])),
        F.when(kept != in_next, F.array(change("columns_reordered", F.lit("")))).otherwise(F.array()),
        F.when(~F.col("index_dtype").eqNullSafe(F.col("next_index_dtype")), F.array(change("index_type_changed", F.lit(""), none, F.col("index_dtype"), F.col("next_index_dtype")))).otherwise(F.array()),
    )
    each = every.select(*ITEM, F.col("next_schema_version").alias("schema_version"), F.explode(found).alias("_c")).select(*ITEM, "schema_version", "_c.*")
    return each.dropDuplicates([*VERSION, "change_type", "column_name"])


#: What a declared dtype means for the table's columns; a wider one on the right takes in those left of it.
_KINDS = {"bool": "bool", "int8": "int", "int16": "int", "int32": "int", "int64": "int", "float32": "float", "float64": "float"}


def _kind(dtype: Column) -> Column:
    found = F.coalesce(*(F.when(dtype == name, F.lit(kind)) for name, kind in _KINDS.items()))
    return F.coalesce(found, F.lit("text"))


def _final_names(known: DataFrame, renames: DataFrame, scratch: Scratch) -> DataFrame:
    """``schema_file_id, path, final``: the name that each column of each file has in the end, along its renames.

    A name is followed to its next rename at its own or a later version, from
    there to the next one, and so on; every round doubles the steps, so there
    are as many as the logarithm of the longest chain.  Of several agreements
    of one name only one counts, the first by name.
    """
    one = renames.groupBy(*VERSION, "old_name").agg(F.min("new_name").alias("new_name")).groupBy(*VERSION, "new_name").agg(F.min("old_name").alias("old_name"))
    later = with_next(known.select(*VERSION), ITEM, "schema_version", [], WIDTH).select(*VERSION, F.col("next_schema_version").alias("_then"))
    leaves = one.join(later, VERSION).select(*VERSION, F.col("old_name").alias("path"), F.struct("_then", "new_name").alias("_leave"))
    names = known.select(*VERSION, "schema_file_id", F.explode(F.array_distinct("col_names")).alias("path")).where("path is not null")
    marked = names.join(leaves, [*VERSION, "path"], "left")
    onward = Window.partitionBy(*ITEM, "path").orderBy("schema_version").rowsBetween(0, Window.unboundedFollowing)
    step = marked.withColumn("_leave", F.first("_leave", ignorenulls=True).over(onward))
    step = scratch.write(step.select(*VERSION, "schema_file_id", "path", F.col("_leave._then").alias("_then"), F.coalesce("_leave.new_name", "path").alias("final")), "names-0")
    turn = 0
    while not step.where("_then is not null").isEmpty():
        turn += 1
        target = step.select(*ITEM, F.col("schema_version").alias("_then"), F.col("path").alias("final"), F.struct("_then", "final").alias("_on"))
        moved = step.join(target, [*ITEM, "_then", "final"], "left")
        step = scratch.write(moved.select(*VERSION, "schema_file_id", "path", F.col("_on._then").alias("_then"), F.coalesce("_on.final", "final").alias("final")), f"names-{turn}")
    return step.select("schema_file_id", "path", "final")


def consistent_table(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, failures, statistics) of all files, each version once.

    The table has a row for each row of each file: ``collection_name,
    item_name, schema_version, schema_file_id, line_no, idx_us, ints, floats,
    bools, texts``, where each of an item's columns is a key of the one map
    that its type belongs to.  A column's type is that of the item's latest
    version that has it; ints are widened to floats where any file holds
    fractions, and so on to text where most values can't be read.  A column
    that a file lacks is absent from its rows; one that was renamed has the
    name that it has in the end, in the rows of all files (if a file has that
    name too, the earlier column there wins).  ``failures`` lists each value
    that its column's type can't take, with place and raw text; in the table
    it is null.
    """
    scratch = Scratch(files.sparkSession, "drift")
    known = scratch.write(versions(files), "versions")
    listed = F.col("col_names")
    pairs = scratch.write(_pairs(known).withColumns({"gone": F.array_except(listed, "next_col_names"), "fresh": F.array_except("next_col_names", listed)}), "pairs")
    final = _final_names(known, _renames(files, pairs, scratch), scratch)
    # no more entries than a file has columns
    names = final.where("final != path").groupBy("schema_file_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "final"))).alias("_names"))
    wanted = known.select("schema_file_id", "schema_version", *ITEM).join(names, "schema_file_id", "left")
    renamed = F.transform(F.map_entries("values"), lambda e: F.struct(F.coalesce(F.element_at("_names", e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    # written, so that the payloads are read once for the statistics, the table and the failures
    rows = path_values(files, wanted).withColumn("values", F.map_from_entries(_first_of_each(renamed))).drop("_names")
    rows = scratch.write(rows, "rows")
    statistics = scratch.write(path_types(rows), "path_types")
    declared = known.select(*ITEM, "schema_version", "schema_file_id", F.explode(F.arrays_zip("col_names", "dtypes")).alias("_c")).select(*ITEM, "schema_version", "schema_file_id", F.col("_c.col_names").alias("path"), _kind(F.col("_c.dtypes")).alias("kind"))
    declared = declared.join(final, ["schema_file_id", "path"]).drop("path").withColumnRenamed("final", "path")
    found = declared.join(statistics, ["schema_file_id", "path"], "left")
    total = {k: F.sum(F.coalesce(f"n_{k}", F.lit(0))) for k in ("int", "float", "bool", "text")}
    latest = found.groupBy(*ITEM, "path").agg(F.max_by("kind", "schema_version").alias("kind"), *(v.alias(f"n_{k}") for k, v in total.items()))
    unread = F.when(F.col("kind").isin("int", "float"), F.col("n_bool") + F.col("n_text")).when(F.col("kind") == "bool", F.col("n_int") + F.col("n_float") + F.col("n_text")).otherwise(F.lit(0))
    read = F.col("n_int") + F.col("n_float") + F.col("n_bool") + F.col("n_text") - unread
    final = F.when(unread > read, "text").when((F.col("kind") == "int") & (F.col("n_float") > 0), "float").otherwise(F.col("kind"))
    types = latest.groupBy(*ITEM).agg(F.map_from_entries(F.collect_list(F.struct("path", final.alias("kind")))).alias("_types"))

    typed = rows.join(types, ITEM).withColumn("_e", F.map_entries("values"))
    casts = {"ints": ("int", lambda v: F.when(raw_type(v) == "int", F.trim(v).try_cast("bigint"))), "floats": ("float", number), "bools": ("bool", lambda v: F.when(F.lower(F.trim(v)).isin("true", "false"), F.lower(F.trim(v)) == "true")), "texts": ("text", lambda v: v)}
    kind_of = lambda e: F.element_at("_types", e["key"])

    def typed_map(kind: str, cast) -> Column:
        own = F.filter("_e", lambda e: kind_of(e) == kind)
        return F.map_from_entries(F.transform(own, lambda e: F.struct(e["key"], cast(e["value"]).alias("value"))))

    maps = [typed_map(*how).alias(name) for name, how in casts.items()]
    table = typed.select(*ITEM, "schema_version", "schema_file_id", "line_no", "idx_us", *maps)

    cells = typed.select(*ITEM, "schema_version", "schema_file_id", "line_no", "_types", F.explode("_e").alias("_c")).where("_c.value is not null").withColumn("target", F.element_at("_types", F.col("_c.key")))
    fits = F.coalesce(*(F.when(F.col("target") == kind, cast(F.col("_c.value")).isNotNull()) for kind, cast in casts.values()))
    failures = cells.where(~fits).select(*ITEM, "schema_version", "schema_file_id", "line_no", F.col("_c.key").alias("column_name"), "target", F.col("_c.value").alias("raw_value"))
    return table, failures, statistics


def item_table(files: DataFrame, collection_name: str, item_name: str) -> DataFrame:
    """One item's consistent table with a typed column for each of its fields, in the order of their names, after
    ``schema_version, line_no, idx_us``.  A field that's named like one of these gets an underscore before it."""
    own = files.where((F.col("collection_name") == collection_name) & (F.col("item_name") == item_name))
    table = consistent_table(own)[0]
    places = ["schema_version", "line_no", "idx_us"]
    kinds = ("ints", "floats", "bools", "texts")
    keys = table.agg(*(F.array_distinct(F.flatten(F.collect_set(F.map_keys(k)))).alias(k) for k in kinds)).first()
    fields = sorted((name, k) for k in kinds for name in keys[k] or [])
    return table.select(*places, *(F.element_at(k, F.lit(name)).alias(f"_{name}" if name.lower() in places else name) for name, k in fields))
