"""Features as JSON texts: parsing, selections, rounding. feature_files writes and scans large files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem

FEATURE = "struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
_MULTI = {"Point": 0, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def parse(texts: DataFrame) -> DataFrame:
    """(ord, id, properties, kind, coordinates) of each of texts(value, ...), a collection or a single feature, beside its
    other columns; coordinates as JSON text. A byte order mark at a text's start is dropped."""
    rest = [c for c in texts.columns if c != "value"]
    whole = texts.select(*rest, F.regexp_replace(F.col("value"), "^\ufeff", "").alias("v"))
    many = F.from_json(F.get_json_object("v", "$.features"), f"array<{FEATURE}>")
    one = F.array(F.from_json("v", FEATURE))
    rows = whole.select(*rest, F.posexplode(F.coalesce(many, one)).alias("ord", "f"))
    return rows.select(*rest, "ord", "f.id", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """The features of files: a file is one JSON text, as such files are written."""
    return parse(spark.read.text(path, wholetext=True).select("value"))


def boundary(df: DataFrame, code: str) -> DataFrame:
    """The features as they are; reading one with another code, or none that is an area, is an error."""
    good = F.col("kind").isin("Polygon", "MultiPolygon") & F.col("properties")["code"].eqNullSafe(F.lit(code))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("not the boundary of "), F.lit(code), F.lit(": "), F.coalesce("id", F.lit("?")))))
    return df.withColumn("kind", checked)


def polygons(df: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """Adds polys: projected polygons of Polygon and MultiPolygon rows, an empty array for others."""
    ring = "array<array<double>>"
    many = F.when(F.col("kind") == "MultiPolygon", F.from_json("coordinates", f"array<array<{ring}>>")).when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", f"array<{ring}>")))
    projected = F.transform(many, lambda poly: F.transform(poly, lambda r: geom.project_ring(r, origin)))
    return df.withColumn("polys", F.coalesce(projected, F.array().cast(f"array<array<{geom.RING}>>")))


def lines(df: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """Adds lines: projected lines of LineString and MultiLineString rows, an empty array for others."""
    ring = "array<array<double>>"
    many = F.when(F.col("kind") == "MultiLineString", F.from_json("coordinates", f"array<{ring}>")).when(F.col("kind") == "LineString", F.array(F.from_json("coordinates", ring)))
    return df.withColumn("lines", F.coalesce(F.transform(many, lambda r: geom.project_ring(r, origin)), F.array().cast(f"array<{geom.RING}>")))


def whole_geometry(df: DataFrame) -> DataFrame:
    """Features with a geometry that isn't marked as incomplete."""
    return df.where("kind is not null").where(~F.coalesce(F.col("properties")["@tainted"].cast("boolean"), F.lit(False)))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def rounded(value: Column, digits: int = 7) -> Column:
    """Numbers as they are written: rounded, halves up."""
    return jsem.round_to(value, digits)


def feature_counts(df: DataFrame) -> DataFrame:
    """One row: features, buildings, roads, rail, named places, of rows with a map properties."""
    tag = lambda k: jsem.text_or_null(F.col("properties")[k]).isNotNull()
    return df.agg(F.count("*").alias("features"), F.count_if(tag("building")).alias("buildings"), F.count_if(tag("highway")).alias("roads"), F.count_if(F.col("properties")["railway"] == "rail").alias("rail"), F.count_if(tag("place") & tag("name")).alias("places"))


def named_zones(df: DataFrame, commune: str) -> DataFrame:
    """Zones in service, of a commune, with a name and a real geometry (an unknown flag is not enough)."""
    return df.where((F.col("insee") == commune) & (F.col("state") == "En service") & F.col("fictitious").eqNullSafe(False) & jsem.text_or_null("name").isNotNull()).select("id", "name", "nature", "precision")


def of_nature(df: DataFrame, natures: tuple[str, ...]) -> DataFrame:
    """Features of some natures: id, nature, precision."""
    return df.where(F.col("nature").isin(*natures)).select("id", "nature", "precision")


def landmarks(df: DataFrame, commune: str) -> DataFrame:
    """Zones in service with a name or a nature that stands for one; the flag of unreal geometry is carried along."""
    # Names by nature.
    named = {"Caserne de pompiers": "Centre de secours", "Salle de spectacle ou conférence": "Salle polyvalente"}
    name = F.coalesce(jsem.text_or_null("name"), jsem.lookup("nature", named))
    return df.where((F.col("insee") == commune) & (F.col("state") == "En service")).withColumn("name", name).where("name is not null").select("id", "name", "nature", "precision", "fictitious")


_NESTED = {"Point": "array<double>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def rounded_geometry(kind: Column, coordinates: Column, digits: int = 7) -> Column:
    """Coordinates as JSON text with all numbers rounded; null for other kinds of geometry."""

    def deep(x: Column, depth: int) -> Column:
        return F.transform(x, lambda y: deep(y, depth - 1)) if depth else rounded(x, digits)

    out = F.lit(None).cast("string")
    for name, nested in _NESTED.items():
        out = F.when(kind == name, F.to_json(deep(F.from_json(coordinates, nested), nested.count("array")))).otherwise(out)
    return out


def buildings(df: DataFrame) -> DataFrame:
    """Features whose building tag isn't empty."""
    return df.where(jsem.text_or_null(F.col("properties")["building"]).isNotNull())
