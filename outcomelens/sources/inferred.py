"""What JSON texts hold, path by path: types seen, rows, one common type, conflicts. One pass, merged by shape, then by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types from narrow to wide; two of ``NUMBERS`` merge to the wider one, any other two to text.
NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE"]
EMPTY, UNREADABLE = "NULL", "UNREADABLE"
ROOT, ELEMENT = "$", "[]"
PLACE = "struct<path:string,parent:string,name:string,value:variant>"


def _kind(value: Column) -> Column:
    """Type of a single value without its parameters."""
    kind = F.substring_index(F.schema_of_variant(value), "(", 1)
    return F.when(kind == "VOID", EMPTY).otherwise(kind)


def _place(path: Column, parent: Column, name: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), parent.alias("parent"), name.alias("name"), value.alias("value"))


def _opened(place: Column) -> Column:
    """A place with its fields if it is an object, its elements if it is an array."""
    return F.struct(
        place["path"].alias("path"), place["parent"].alias("parent"), place["name"].alias("name"), place["value"].alias("value"),
        F.try_variant_get(place["value"], "$", "map<string,variant>").alias("fields"),
        F.try_variant_get(place["value"], "$", "array<variant>").alias("elements"))


def _inside(place: Column) -> Column:
    """Places of the fields or elements of an opened place; none in any other value."""
    path = place["path"]
    fields = F.transform(F.map_entries(place["fields"]), lambda e: _place(F.concat(path, F.lit("."), e["key"]), path, e["key"], e["value"]))
    elements = F.transform(place["elements"], lambda v: _place(F.concat(path, F.lit(ELEMENT)), path, F.lit(ELEMENT), v))
    return F.coalesce(fields, elements, F.array().cast(f"array<{PLACE}>"))


def _typed(place: Column) -> Column:
    kind = F.when(place["fields"].isNotNull(), "OBJECT").when(place["elements"].isNotNull(), "ARRAY").otherwise(
        F.coalesce(_kind(place["value"]), F.lit(EMPTY)))
    return F.struct(place["path"].alias("path"), place["parent"].alias("parent"), place["name"].alias("name"), kind.alias("type"))


#: A key with its colon, or all from a quote on that no other closes (kept); a text without control characters (its last quote is kept); a number of up to
#: 18 digits before and behind its point (the point is kept). What is kept is found after all else: Java keeps it also from a try that failed.
TOKEN = (r'("[^"\x00-\x1f]*+"[ \t\r\n]*+:|"(?![^"\x00-\x1f]*+")[\s\S]++)|"[^"\x00-\x1f]*+(")|'
         r"(?<![0-9.eE+-])-?(?:0|[1-9][0-9]{0,17}+)(?:(?![0-9.eE+-])|(?=\.[0-9]{1,18}+(?![0-9.eE+-]))(\.)[0-9]++)")
#: Stands behind what is left of a token; no readable text holds it. Longer texts are parsed first: a parser may find them too long.
MARK, LONG, NO_JSON = "\x01", 1 << 20, "{"


def json_shape(text: Column) -> Column:
    """A text in which every value is replaced by one of its type, so that records differing in values alone share it: same paths, same types, and
    unreadable if ``text`` is. Numbers of unusual size, which may have another type, stay; so does what is no JSON.

    It is not JSON itself but has marks, which ``shape_text`` resolves.
    """
    plain = ~F.contains(text, F.lit("\\")) & ~F.contains(text, F.lit(MARK)) & (F.octet_length(text) <= LONG)
    # escaped quotes as code points: then every quote begins or ends a text. Which escapes are allowed is left to the parser
    quotes = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    safe = F.when(plain, text).when(F.try_parse_json(text).isNotNull(), quotes).otherwise(NO_JSON)
    return F.regexp_replace(safe, TOKEN, f"$1$2$3{MARK}")


def shape_text(shape: Column) -> Column:
    for left, value in ((f'"{MARK}', '""'), (f".{MARK}", "0.5"), (f":{MARK}", ":"), (MARK, "0")):
        shape = F.replace(shape, F.lit(left), F.lit(value))
    return shape


def json_paths(df: DataFrame, column: str, depth: int = 5) -> DataFrame:
    """(path, parent, name, type, n): rows of JSON text in which a path holds a value of a type; ``$`` is the whole text, ``$.a[].b`` a field of the objects in
    an array. ``parent`` and ``name`` tell a field ``a.b`` from the field ``b`` in ``a``.

    Unreadable texts count under the type ``UNREADABLE`` of ``$``, null texts not at all. A path counts once per row and type. Below ``depth`` levels an
    object or array is only named as such. Rows are merged inside the tasks to distinct shapes, and only a shape is walked; were no two rows of one shape,
    each would be.
    """
    shapes = df.where(F.col(column).isNotNull()).groupBy(json_shape(F.col(column)).alias("_shape")).agg(F.count("*").alias("_n"))
    return walked(shapes.select(shape_text(F.col("_shape")).alias("_text"), "_n"), "_text", "_n", depth)


def walked(texts: DataFrame, column: str, rows_each: str, depth: int) -> DataFrame:
    """``json_paths`` of texts that stand for ``rows_each`` rows each."""
    variant = F.try_parse_json(F.col(column))
    rows = texts.select(rows_each, F.array(_place(F.lit(ROOT), F.lit(""), F.lit(ROOT), variant)).alias("level_0"))
    for i in range(depth + 1):
        rows = rows.withColumn(f"opened_{i}", F.transform(f"level_{i}", _opened))
        if i < depth:
            rows = rows.withColumn(f"level_{i + 1}", F.flatten(F.transform(f"opened_{i}", _inside)))
    held = F.flatten(F.array(*[F.transform(f"opened_{i}", _typed) for i in range(depth + 1)]))
    unreadable = F.transform("level_0", lambda p: F.struct(
        p["path"].alias("path"), p["parent"].alias("parent"), p["name"].alias("name"), F.lit(UNREADABLE).alias("type")))
    seen = F.when(F.col("level_0")[0]["value"].isNull(), unreadable).otherwise(F.array_distinct(held))
    return rows.select(rows_each, F.inline(seen)).groupBy("path", "parent", "name", "type").agg(F.sum(rows_each).alias("n"))


def json_conflicts(paths: DataFrame) -> DataFrame:
    """(path, parent, name, types, merged, conflict, n) of ``json_paths``: the types of a path, the one that can hold them all, whether that had to be text,
    and its occurrences (a row with two types of it counts twice)."""
    types = F.array_sort(F.collect_set(F.when(~F.col("type").isin(EMPTY, UNREADABLE), F.col("type"))))  # a handful of types
    merged = paths.groupBy("path", "parent", "name").agg(types.alias("types"), F.sum(F.when(F.col("type") != UNREADABLE, F.col("n"))).alias("n"))
    numbers = F.size(F.array_except("types", F.array(*[F.lit(t) for t in NUMBERS]))) == 0
    widest = F.coalesce(*[F.when(F.array_contains("types", t), t) for t in reversed(NUMBERS)])
    one = F.when(F.size("types") == 0, EMPTY).when(F.size("types") == 1, F.get("types", F.lit(0)))
    conflict = (F.size("types") > 1) & ~numbers
    return merged.select("path", "parent", "name", "types", F.coalesce(one, F.when(numbers, widest), F.lit("STRING")).alias("merged"), conflict.alias("conflict"),
                         F.coalesce("n", F.lit(0)).alias("n"))


def json_schema(conflicts: DataFrame) -> T.StructType:
    """Schema to read the texts with: only its fields, a row each, reach the driver. What conflicts is read as text, a field that is always null too."""
    inside: dict[str, list] = {}
    for row in conflicts.orderBy("path", "name").collect():
        inside.setdefault(row["parent"], []).append(row)

    def kind(row) -> T.DataType:
        held = inside.get(row["path"], [])
        if row["merged"] == "OBJECT":
            return T.StructType([T.StructField(r["name"], kind(r)) for r in held if r["name"] != ELEMENT])
        if row["merged"] == "ARRAY":
            return T.ArrayType(next((kind(r) for r in held if r["name"] == ELEMENT), T.StringType()))
        return {"BIGINT": T.LongType(), "DECIMAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}.get(
            row["merged"], T.StringType())

    found = next((kind(r) for r in inside.get("", [])), T.StructType())
    return found if isinstance(found, T.StructType) else T.StructType([T.StructField("value", found)])
