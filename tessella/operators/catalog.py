"""Source catalogs: what tables and functions can serve as sources, and how two snapshots differ."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(prev: DataFrame, now: DataFrame) -> DataFrame:
    """(id, action) with action add, update or remove; versions that are null on both sides never update."""
    a = prev.select("id", F.col("version").alias("old"), F.lit(True).alias("was"))
    b = now.select("id", F.col("version").alias("new"), F.lit(True).alias("is"))
    action = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return a.join(b, "id", "full").select("id", action.alias("action")).filter("action is not null")


def geometry_tables(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """A row a geometry column: its table, whether it is indexed, and the other columns as a map of types.

    ``columns`` has schema, table, column, type; ``indexes`` schema, table, column, is_spatial.
    """
    geo = columns.filter(F.col("type").isin("geometry", "geography")).select("schema", "table", F.col("column").alias("geom"), "type").distinct()
    indexed = indexes.groupBy("schema", "table", F.col("column").alias("geom")).agg(F.bool_or("is_spatial").alias("indexed"))
    other = columns.select("schema", "table", F.col("column").alias("prop"), F.ltrim(F.col("type"), F.lit("_")).alias("prop_type"))
    joined = geo.alias("g").join(other.alias("o"), (F.col("g.schema") == F.col("o.schema")) & (F.col("g.table") == F.col("o.table")) & (F.col("g.geom") != F.col("o.prop")), "left")
    props = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("prop").isNotNull(), F.struct("prop", "prop_type"))))).alias("properties")
    out = joined.groupBy("g.schema", "g.table", "geom", "g.type").agg(props)
    return out.join(indexed, ["schema", "table", "geom"], "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def tile_functions(args: DataFrame) -> DataFrame:
    """Functions whose signature serves tiles: (z or zoom, x, y) integers, maybe a JSON fourth, giving bytes.

    ``args`` has function, position, name, type and returns; result columns are the functions' names and
    whether they take parameters.
    """
    listed = F.array_sort(F.collect_list(F.struct("position", "name", "type")))
    grouped = args.groupBy("function", "returns").agg(listed.alias("a"))
    arg = lambda k, f: F.get("a", F.lit(k))[f]
    whole = (arg(0, "type") == "integer") & (arg(1, "type") == "integer") & (arg(2, "type") == "integer")
    named = arg(0, "name").isin("z", "zoom") & (arg(1, "name") == "x") & (arg(2, "name") == "y")
    fourth = (F.size("a") == 3) | ((F.size("a") == 4) & F.coalesce(arg(3, "type").isin("json", "jsonb"), F.lit(False)))
    result = F.col("returns").isin("bytea", "bytea,text")
    return grouped.filter(whole & named & fourth & result).select("function", (F.size("a") == 4).alias("takes_query"))


class IdResolver:
    """Ids for sources: illegal characters become "-", clashes get ".1", ".2"; the same unique name keeps its id."""

    def __init__(self, reserved: set[str] | None = None):
        self.reserved, self.ids = set(reserved or ()), {}

    def resolve(self, name: str, unique: str) -> str:
        clean = re.sub(r"[^A-Za-z0-9_.-]", "-", name) or "_"
        if clean not in self.reserved and self.ids.setdefault(clean, unique) == unique:
            return clean
        k = 1
        while self.ids.setdefault(f"{clean}.{k}", unique) != unique:
            k += 1
        return f"{clean}.{k}"


def clean_id(name: Column) -> Column:
    """A name with the characters that ids may have; others become "-"."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "-")


def quote_identifier(name: Column, mark: str = '"') -> Column:
    """A name in quotes, those within it doubled."""
    return F.concat(F.lit(mark), F.replace(name, F.lit(mark), F.lit(mark * 2)), F.lit(mark))


def quote_relation(name: Column) -> Column:
    """A relation's name, each of its dotted parts quoted."""
    return F.array_join(F.transform(F.split(name, r"\."), lambda part: quote_identifier(part)), ".")


def fill_template(template: str, **values: Column) -> Column:
    """``template`` with each "{name}" replaced by its value; others stay. Values are not looked through again."""
    parts = re.split(r"\{(\w+)\}", template)
    made = [F.lit(p) if k % 2 == 0 else values[p].cast("string") if p in values else F.lit(f"{{{p}}}") for k, p in enumerate(parts)]
    return F.concat(*made)


def hex_128(text: Column) -> Column:
    """16 bytes of 32 hexadecimal digits; null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(text))


def mirror(z: Column, x: Column, y: Column, n: int) -> Column:
    """Which of ``n`` mirrors serves a tile: always the same one."""
    return F.pmod(F.xxhash64(z, x, y), F.lit(n)).cast("int")


def fingerprint(sources: DataFrame, *ignored: str) -> DataFrame:
    """(id, version): a digest over all fields of a source but ``ignored``, whatever their order in the table."""
    fields = sorted(c for c in sources.columns if c not in ("id", *ignored))
    return sources.select("id", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("version"))


def resolve_srid(found: Column, configured: Column, default: Column) -> Column:
    """The reference system of a geometry column: what the table says (0: nothing), else the configuration, else the default.

    Null, so that the source is skipped, where table and configuration disagree or none says anything.
    """
    given = F.when(found != 0, found)
    return F.when(given.isNotNull() & configured.isNotNull() & (given != configured), F.lit(None).cast("int")).otherwise(F.coalesce(given, configured, default))


def id_column(columns: DataFrame, wanted: list[str]) -> DataFrame:
    """(schema, table, id_column): the first of ``wanted`` that a table has as a whole number; an exact name goes before one that differs in case."""
    listed = columns.filter(F.col("type").isin("int2", "int4", "int8", "smallint", "integer", "bigint"))
    names = columns.sparkSession.createDataFrame([(k, n, n.lower()) for k, n in enumerate(wanted)], "rank int, wanted string, low string")
    joined = listed.join(F.broadcast(names), F.lower("column") == F.col("low"))  # as many as wanted
    best = F.min_by("column", F.struct("rank", (F.col("column") != F.col("wanted")).alias("case"), "column"))
    return joined.groupBy("schema", "table").agg(best.alias("id_column"))


def geometry_column(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table, geometry, fault): the geometry column of each table of ``columns`` (table, column, type).

    ``wanted`` (table, column) names one for some tables; that must be there and be a geometry. Others need
    exactly one. A fault is a text, and the geometry null.
    """
    is_geometry = F.coalesce(F.col("type").isin("geometry", "geography"), F.lit(False))
    asked = columns.join(wanted.select("table", F.col("column").alias("asked")), "table", "left")
    found = asked.groupBy("table").agg(
        F.max("asked").alias("asked"),
        F.max(F.col("column") == F.col("asked")).alias("there"),
        F.max((F.col("column") == F.col("asked")) & is_geometry).alias("fits"),
        F.count(F.when(is_geometry, 1)).alias("n"),
        F.min(F.when(is_geometry, F.col("column"))).alias("first"),
    )
    named = F.col("asked").isNotNull()
    fault = (
        F.when(named & ~F.col("there"), "no such column").when(named & ~F.col("fits"), "not a geometry").when(named, None)
        .when(F.col("n") == 0, "no geometry").when(F.col("n") > 1, "several geometries")
    )
    return found.withColumn("fault", fault).select("table", F.when(F.col("fault").isNull(), F.coalesce("asked", "first")).alias("geometry"), "fault")


def aliased(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``names``, output name -> column's name, which may differ in case."""
    return df.select(*[F.col(f"`{find_name(found, df.columns)}`").alias(out) for out, found in names.items()])


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of the two has, each once; columns are taken by name."""
    sides = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(2)))
    return sides.groupBy(*a.columns).agg(F.min("__side").alias("__low"), F.max("__side").alias("__high")).filter("__low = __high").drop("__low", "__high")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each ``key`` once, with the place at which it came first."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def drop_adjacent(rows: DataFrame, part: list[str], order: str, values: list[str]) -> DataFrame:
    """``rows`` but for those whose ``values`` are those of the row before in their part; equal rows further apart stay."""
    window = Window.partitionBy(*part).orderBy(order)
    same = F.lag(F.struct(*values)).over(window).eqNullSafe(F.struct(*values)) & (F.row_number().over(window) > 1)
    return rows.withColumn("__same", same).filter(~F.col("__same")).drop("__same")


def published(snapshot: DataFrame, actions: DataFrame) -> DataFrame:
    """``actions`` with their place in the order of publication: updates, then additions, then removals, each by name, equal names by id."""
    order = F.when(F.col("action") == "update", 0).when(F.col("action") == "add", 1).otherwise(2)
    return actions.join(snapshot.select("id", "name"), "id", "left").select("id", "action", F.struct(order.alias("step"), F.coalesce("name", F.col("id").cast("string")).alias("name"), "id").alias("place"))


def find_name(wanted: str, names: list[str]) -> str:
    """An exact name, or the only one that differs in case alone."""
    if wanted in names:
        return wanted
    close = [n for n in names if n.lower() == wanted.lower()]
    if len(close) != 1:
        raise KeyError(f"{wanted} is not in {names}" if not close else f"{wanted} may be any of {close}")
    return close[0]


def merge_patch(doc: dict, patch) -> dict:
    """JSON merge patch: null takes away, objects merge, anything else replaces. What is no object changes nothing at the top."""
    if not isinstance(patch, dict):
        return doc
    out = dict(doc)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict):
            out[k] = merge_patch(out[k] if isinstance(out.get(k), dict) else {}, v)
        else:
            out[k] = v
    return out


def parse_crs(crs: str | None) -> int:
    """The SRID of "EPSG:n" or "OGC:CRS84"; anything else raises."""
    if not crs:
        raise ValueError("no reference system")
    if crs.upper() == "OGC:CRS84":
        return 4326
    m = re.fullmatch(r"(?:EPSG|epsg):(\d+)", crs)
    if not m or int(m[1]) == 0:
        raise ValueError(f"reference system {crs!r} is not known")
    return int(m[1])


def query_value(value: str):
    """A parameter as JSON where it is, else as text."""
    try:
        return json.loads(value)
    except ValueError:
        return value


class Registry:
    """Function sources: name -> function of (coords, params) that gives z, x, y, tile_data. No row is an empty tile."""

    def __init__(self):
        self.functions: dict = {}

    def register(self, name: str, function) -> None:
        self.functions[name] = function

    def tiles(self, name: str, coords: DataFrame, params: dict[str, str] | None = None) -> DataFrame:
        typed = {k: query_value(v) for k, v in (params or {}).items()}
        made = self.functions[name](coords, typed).select("z", "x", "y", "tile_data")
        return coords.join(made, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("tile_data", F.lit(b"")).alias("tile_data"))
