"""Readers and writers of the tables that studies exchange: results, cells, flows, sums, parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import wkt_to_ring
from ..functions.physics import number
from ..operators.geo import from_web_mercator

_D, _S, _L, _I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


#: Fixed formats: one row for each variant's embedding, and the columns of it that a resumed run must find.
STATS = schema(variant=_S, type=_S, offset_x_m=_D, offset_y_m=_D, angle_deg=_D, translation_angle=_D, translation_distance_m=_I, scale_factor=_D, scale_axis=_S, num_nodes=_I, num_edges=_I, z_mean=_D, z_min=_D, z_max=_D, edge_len_mean=_D, missing_altitude=_I, on_land=_S)
#: Fixed format: a daily file of trips.
TRIPS = schema(origen=_S, destino=_S, distancia=_S, viajes=_D)


def read_results(spark: SparkSession, path: str | Sequence[str], columns: T.StructType, separator: str = ",") -> DataFrame:
    """A table of results with a header. Values that are not of their column's type become null; columns are found by name, so pruning reaches the reader."""
    return spark.read.schema(columns).options(header=True, sep=separator, mode="PERMISSIVE", enforceSchema=False).csv(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return read_results(spark, path, STATS).withColumn("on_land", F.lower("on_land") == "true")


def checked(df: DataFrame, columns: T.StructType) -> DataFrame:
    """df, if it has the columns of a format with their types; a resumed run must not append to another format."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in columns if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return df


def read_polygons(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """A semicolon table with a column geometry of polygons in well-known text; rows without one are left out. ring: the outer ring."""
    return read_results(spark, path, columns, ";").where("geometry is not null").withColumn("ring", wkt_to_ring(F.col("geometry")))


def read_trips(spark: SparkSession, paths: str | Sequence[str], ids: Sequence[str] | DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """origen, destino, viajes over daily pipe-separated files (gzip or not): both ends among ids, some bands of distance left out. Sums before the shuffle."""
    df = read_results(spark, paths, TRIPS, "|")
    if without:
        df = df.where(~F.col("distancia").isin(*without))
    for end in ("origen", "destino"):
        if isinstance(ids, DataFrame):
            df = df.join(ids.select(F.col(ids.columns[0]).alias(end)).distinct(), end, "left_semi")
        else:
            df = df.where(F.col(end).isin(*ids))
    return df.groupBy("origen", "destino").agg(F.sum("viajes").alias("viajes"))


def normalised_cells(df: DataFrame) -> DataFrame:
    """cell, lon_min, lat_min, lon_max, lat_max, cent_lon, cent_lat of cells in any of three layouts: metres of web maps or degrees as x_min..., lon_min..., min_lon.... Numbers beyond degrees are metres."""
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns})
    have = set(df.columns)
    names = next((n for n in (("lon_min", "lat_min", "lon_max", "lat_max"), ("min_lon", "min_lat", "max_lon", "max_lat"), ("x_min", "y_min", "x_max", "y_max")) if set(n) <= have), None)
    if names is None:
        raise ValueError("cells need x_min, y_min, x_max, y_max, or the same as lon and lat")
    a, b, c, d = (F.col(n).cast("double") for n in names)
    metres = F.greatest(F.abs(a), F.abs(c)) > 360
    low, high = from_web_mercator(a, b), from_web_mercator(c, d)
    out = df.select(F.col("cell_id").cast("string").alias("cell"), *(F.when(metres, m).otherwise(x).alias(n) for n, m, x in (("lon_min", low[0], a), ("lat_min", low[1], b), ("lon_max", high[0], c), ("lat_max", high[1], d))), *(F.col(n).cast("double").alias(f"_{n}") if n in have else F.lit(None).cast("double").alias(f"_{n}") for n in ("cent_lon", "cent_lat")))
    centre = lambda n, p, q: F.coalesce(F.col(f"_{n}"), (F.col(p) + F.col(q)) / 2).alias(n)
    return out.select("cell", "lon_min", "lat_min", "lon_max", "lat_max", centre("cent_lon", "lon_min", "lon_max"), centre("cent_lat", "lat_min", "lat_max"))


def flows(df: DataFrame) -> DataFrame:
    """origin, dest, flow of a table whose first three columns are these: text to numbers, null to 0, positive ones kept."""
    o, d, f = df.columns[:3]
    return df.select(F.col(o).cast("string").alias("origin"), F.col(d).cast("string").alias("dest"), F.coalesce(number(F.col(f).cast("string")), F.lit(0.0)).alias("flow")).where("flow > 0")


def summed_flows(*tables: DataFrame) -> DataFrame:
    """Flows of several kinds of days, summed by pair."""
    both = flows(tables[0])
    for t in tables[1:]:
        both = both.unionByName(flows(t))
    return both.groupBy("origin", "dest").agg(F.sum("flow").alias("flow"))


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of one object each (a variant's sums), as one table."""
    return spark.read.json(path)


def long_sums(wide: DataFrame, key: str = "filename") -> DataFrame:
    """key, leg, measure, value from columns <leg>_<measure> (of a{access}_{mode} or road): a study adds modes without a new schema."""
    names = [c for c in wide.columns if "_" in c and c != key]
    kinds = F.regexp_extract("name", r"^(.*)_([A-Za-z]+)$", 1), F.regexp_extract("name", r"^(.*)_([A-Za-z]+)$", 2)
    return wide.select(key, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(key, names, "name", "value").select(key, kinds[0].alias("leg"), kinds[1].alias("measure"), "value")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """mode, parameter, low, central, high from a JSON document {"modes": {mode: {parameter: [low, central, high]}}}."""
    text = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.modes").alias("m"))
    modes = text.select(F.explode(F.from_json("m", "map<string, map<string, string>>")).alias("mode", "p"))
    values = modes.select("mode", F.explode("p").alias("parameter", "v")).withColumn("v", F.from_json("v", "array<double>")).where("size(v) = 3")
    return values.select("mode", "parameter", *(F.col("v")[i].alias(n) for i, n in enumerate(("low", "central", "high"))))


def lat_lon_box(text: Column) -> Column:
    """An array of structs x, y from JSON pairs of latitude and longitude."""
    return F.transform(F.from_json(text, "array<array<double>>"), lambda p: F.struct(p[1].alias("x"), p[0].alias("y")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is at path, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def existing_or(spark: SparkSession, path: str, fallback: str, columns: T.StructType) -> DataFrame:
    """The table at path if it is there, and the other otherwise. A table that is there but cannot be read fails."""
    return read_results(spark, path if exists(spark, path) else fallback, columns)


def flows_of(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """origin, dest, flow of a city's named source of trips in its folder: geolocated (working days and holidays, summed), or mitma, with a suffix for what was left out of it."""
    columns = schema(cell_origin=_S, cell_destination=_S, count=_S)
    if source == "geolocated":
        return summed_flows(*(read_results(spark, f"{folder}/od_{kind}", columns) for kind in ("work", "holiday")))
    if not source.startswith("mitma"):
        raise ValueError(f"no source of trips is called {source}")
    return flows(read_results(spark, f"{folder}/od_weekday{source.removeprefix('mitma')}", columns))


def write_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    """A network as two tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    arcs.write.mode("overwrite").parquet(f"{path}/arcs")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/arcs")


def cell_polygons(cells: DataFrame, to_metric: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """cell, ring, cent_x, cent_y in metres of normalised_cells(): corners by to_metric(lon, lat), and their mean."""
    corners = [("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max")]
    at = [to_metric(F.col(a), F.col(b)) for a, b in corners]
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in at))
    mean = lambda k: F.aggregate(F.transform("ring", lambda p: p[k]), F.lit(0.0), lambda t, v: t + v) / 4.0
    return cells.select("cell", ring.alias("ring")).select("cell", "ring", mean("x").alias("cent_x"), mean("y").alias("cent_y"))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A box as a closed ring, counter-clockwise from its lower left corner."""
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))))


def overwrite_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replaces the partitions that df has rows of and leaves the others: a run that is repeated leaves one copy of its rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_results(df: DataFrame, path: str, separator: str = ",") -> None:
    """A table with a header; Spark's committer shows it whole or not at all."""
    df.write.mode("overwrite").options(header=True, sep=separator).csv(path)


def summary_json(df: DataFrame, group: Sequence[str], order: Column) -> DataFrame:
    """One JSON text for each group: its rows in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("_order"), F.struct(*df.columns).alias("row"))))
    return df.groupBy(*group).agg(F.to_json(F.transform(rows, lambda x: x["row"])).alias("json"))


def _placemark(name: Column, description: Column, geometry: Column) -> Column:
    from ..functions.names import escaped_xml

    return F.concat(F.lit("<Placemark><name>"), escaped_xml(name), F.lit("</name><description>"), escaped_xml(description), F.lit("</description>"), geometry, F.lit("</Placemark>"))


def _coordinates(points: Column) -> Column:
    text = F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return F.concat(F.lit("<coordinates>"), text, F.lit("</coordinates>"))


def kml(name: Column, ring: Column, description: Column) -> Column:
    """A placemark of a ring."""
    return _placemark(name, description, F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing>"), _coordinates(ring), F.lit("</LinearRing></outerBoundaryIs></Polygon>")))


def kml_line(name: Column, points: Column, description: Column) -> Column:
    return _placemark(name, description, F.concat(F.lit("<LineString>"), _coordinates(points), F.lit("</LineString>")))


def kml_point(name: Column, x: Column, y: Column, description: Column) -> Column:
    return _placemark(name, description, F.concat(F.lit("<Point>"), _coordinates(F.array(F.struct(x.alias("x"), y.alias("y")))), F.lit("</Point>")))


def kml_folders(placemarks: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """group and kml: one folder for each group with its placemarks in order."""
    from ..functions.names import escaped_xml

    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")
    return placemarks.groupBy(group).agg(inside.alias("_k")).select(group, F.concat(F.lit("<Folder><name>"), escaped_xml(F.col(group).cast("string")), F.lit("</name>"), "_k", F.lit("</Folder>")).alias("kml"))


def transit_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, lon, lat), ways (id, node, position, tags) and route members (route, member, position, role, tags) of a JSON document of map elements."""
    element = "struct<type:string,id:bigint,lon:double,lat:double,nodes:array<bigint>,tags:map<string,string>,members:array<struct<type:string,ref:bigint,role:string>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<elements:array<{element}>>")["elements"]).alias("e")).select("e.*")
    nodes = e.where("type = 'node'").select("id", "lon", "lat")
    ways = e.where("type = 'way'").select("id", "tags", F.posexplode("nodes").alias("position", "node"))
    members = e.where("type = 'relation'").select(F.col("id").alias("route"), "tags", F.posexplode("members").alias("position", "m")).select("route", "tags", "position", "m.type", F.col("m.ref").alias("member"), "m.role")
    return nodes, ways, members


def on_terrain(tags: Column) -> Column:
    """Whether a way lies on the ground: no tunnel, bridge or other level."""
    off = F.coalesce(tags["tunnel"], F.lit("no")) != "no"
    raised = F.coalesce(tags["bridge"], F.lit("no")) != "no"
    level = F.coalesce(tags["layer"].try_cast("double"), F.lit(0.0))
    return ~(off | raised | (level != 0))
