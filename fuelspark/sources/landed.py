"""Readers of landed source files. Schemas are declared: identifiers stay text, nothing is inferred."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelspark.functions.lookups import FUELS
from fuelspark.operators.prices import sane_price

PLACE_SCHEMA = "_place_id string, name string, cre_id string, location struct<x:string,y:string>"
PRICE_SCHEMA = "_place_id string, gas_price array<struct<_VALUE:string,_type:string>>"
OSM_SCHEMA = "type string, id string, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
LOCATOR_SCHEMA = "external_id string, name string, lat double, lng double, props map<string,string>"
PLACES_SCHEMA = (
    "place_id string, name string, lat double, lng double, "
    "address_components array<struct<long_name:string,types:array<string>>>"
)
_PRICE = "struct<regular:double,premium:double,diesel:double,gasolina_regular:double,gasolina_premium:double,updatedAt:string,updated_at:string>"
APP_SCHEMA = (
    "id string, master_id string, name string, canonical_name string, brand string, canonical_brand string, "
    "address string, canonical_address string, city string, canonical_municipality string, state string, "
    "canonical_state string, zipCode string, canonical_zip string, lat double, lng double, hasData boolean, "
    f"prices {_PRICE}"
)

# Published field names per canonical field, in order of preference (fixed values)
PLACE_ALIASES = {
    "place_id": ["place_id", "placeid", "id_place", "id"],
    "cre_id": ["cre_id", "creid", "id_estacion", "estacion_id"],
    "nombre": ["nombre", "name", "nombre_estacion", "nom_estab"],
    "razon_social": ["razon_social", "razonsocial", "razon", "legal_name"],
    "marca": ["marca", "brand", "franquicia"],
    "domicilio": ["domicilio", "address", "direccion", "calle"],
    "municipio": ["municipio", "municipality", "ciudad"],
    "estado": ["estado", "state", "entidad"],
    "cp": ["cp", "postal_code", "codigo_postal", "zip"],
}
COORDINATE_ALIASES = {
    "latitud": ["latitud", "lat", "latitude", "y"],
    "longitud": ["longitud", "lon", "lng", "longitude", "x"],
}
PRICE_ID_ALIASES = {"cre_id": ["cre_id", "creid", "id_estacion", "id"], "place_id": ["place_id", "placeid"]}
PRICE_ALIASES = {
    "gasolina_regular": ["gasolina_regular", "regular", "magna", "precio_regular"],
    "gasolina_premium": ["gasolina_premium", "premium", "precio_premium"],
    "diesel": ["diesel", "precio_diesel"],
}
REGISTER_ALIASES = {
    "denue_id": ["id", "clee", "id_estab"],
    "nom_estab": ["nom_estab", "nombre_establecimiento"],
    "raz_social": ["raz_social", "razon_social"],
    "nombre_act": ["nombre_act", "actividad"],
    "per_ocu": ["per_ocu", "per_ocu_label", "personal_ocupado"],
    "telefono": ["telefono", "tel"],
    "correoelec": ["correoelec", "email", "correo"],
    "tipo_vial": ["tipo_vial", "tipo_vialidad"],
    "nom_vial": ["nom_vial", "nombre_vialidad", "calle"],
    "tipo_v_e_1": ["tipo_v_e_1"],
    "nom_v_e_1": ["nom_v_e_1"],
    "numero_ext": ["numero_ext", "num_ext"],
    "letra_ext": ["letra_ext"],
    "tipo_asent": ["tipo_asent", "tipo_asentamiento"],
    "nomb_asent": ["nomb_asent", "nombre_asentamiento", "colonia"],
    "cod_postal": ["cod_postal", "cp"],
    "cve_ent": ["cve_ent", "id_entidad_federativa"],
    "entidad": ["entidad", "estado", "entidad_federativa"],
    "cve_mun": ["cve_mun", "id_municipio"],
    "municipio": ["municipio", "ciudad"],
    "localidad": ["localidad", "nombre_localidad"],
    "latitud": ["latitud", "lat"],
    "longitud": ["longitud", "lon", "lng"],
    "fecha_alta": ["fecha_alta"],
    "codigo_act": ["codigo_act", "scian", "codigo_scian"],
}
# Locator property and the service it stands for (fixed values)
SERVICE_FLAGS = {
    "gasolina_regular": "regular", "gasolina_premium": "premium", "diesel": "diesel",
    "lavado": "car_wash", "tienda": "convenience_store", "abarrotes": "convenience_store",
}
FALSE_VALUES = ["", "0", "false", "False", "N"]


def read_places_xml(spark: SparkSession, path: str) -> DataFrame:
    """Places feed: identifier attribute, children, and the nested location (x is longitude)."""
    rows = spark.read.format("xml").option("rowTag", "place").schema(PLACE_SCHEMA).load(path)
    return rows.select(
        F.col("_place_id").alias("place_id"), "name", "cre_id",
        F.expr("try_cast(location.x as double)").alias("lng"), F.expr("try_cast(location.y as double)").alias("lat"),
    )


def read_prices_xml(spark: SparkSession, path: str) -> DataFrame:
    """Prices feed: one row per place with its fuels, the last value of a fuel wins.

    Elements are ordered by file, block of the file and position in the block.
    """
    rows = spark.read.format("xml").option("rowTag", "place").schema(PRICE_SCHEMA).load(path)
    place_in_file = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("_order", place_in_file)
    fuel = F.lower(F.trim("p._type"))
    long = rows.select("_place_id", "_order", F.posexplode("gas_price").alias("_i", "p")).select(
        F.col("_place_id").alias("place_id"), "_order", "_i", F.when(fuel == "magna", "regular").otherwise(fuel).alias("fuel"),
        F.expr("try_cast(p._VALUE as double)").alias("price"),
    )
    long = long.filter(F.col("fuel").isin(*FUELS) & F.col("place_id").isNotNull())
    return long.groupBy("place_id").agg(*[
        F.max_by(F.when(F.col("fuel") == f, F.col("price")),
                 F.when(F.col("fuel") == f, F.struct("_order", "_i"))).alias(f) for f in FUELS])


def first_given(df: DataFrame, names: list[str]) -> Column:
    """First alias column that is there and not blank; null when none is."""
    lower = {c.lower().strip(): c for c in df.columns}
    found = [F.trim(F.col(f"`{lower[n]}`").cast("string")) for n in names if n in lower]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found]) if found else F.lit(None).cast("string")


def first_number(df: DataFrame, names: list[str]) -> Column:
    """First alias column that is a number, decimal comma allowed."""
    lower = {c.lower().strip(): c for c in df.columns}
    found = [F.replace(F.col(f"`{lower[n]}`").cast("string"), F.lit(","), F.lit(".")).try_cast("double") for n in names if n in lower]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def normalize_places(df: DataFrame) -> DataFrame:
    """Canonical place fields by alias; a coordinate of 0 is no coordinate."""
    texts = [first_given(df, names).alias(k) for k, names in PLACE_ALIASES.items()]
    points = [F.nullif(first_number(df, names), F.lit(0.0)).alias(k) for k, names in COORDINATE_ALIASES.items()]
    return df.select(*texts, *points)


def normalize_prices(df: DataFrame) -> DataFrame:
    """Canonical price fields by alias; prices outside the plausible band become null."""
    ids = [first_given(df, names).alias(k) for k, names in PRICE_ID_ALIASES.items()]
    return df.select(*ids, *[sane_price(first_number(df, names)).alias(k) for k, names in PRICE_ALIASES.items()])


def read_open_map(spark: SparkSession, path: str) -> DataFrame:
    """Open-map export, landed one element per line so that files split: fuel elements with tag fallbacks; ways
    take their centre."""
    e = spark.read.schema(OSM_SCHEMA).json(path).filter(F.col("tags")["amenity"] == "fuel")
    tag = lambda *names: F.coalesce(*[F.nullif(F.col("tags")[n], F.lit("")) for n in names])
    street = tag("addr:street", "addr:housenumber")
    number = tag("addr:housenumber")
    way = F.col("type") == "way"
    return e.filter("id <> ''").select(
        F.col("id").alias("osm_id"), F.col("type").alias("osm_type"), tag("name", "name:es").alias("name"),
        tag("brand", "operator", "network").alias("brand"), tag("operator").alias("operator"),
        tag("ref:MX:CRE", "ref:cre").alias("ref_cre"), F.concat_ws(" ", street, number).alias("_s"),
        tag("addr:suburb", "addr:colony").alias("addr_suburb"),
        tag("addr:city", "addr:municipality", "addr:place").alias("addr_city"),
        tag("addr:state", "addr:province").alias("addr_state"),
        tag("addr:postcode", "postal_code").alias("addr_postcode"),
        F.when(way, F.col("center.lat")).when(F.col("type") == "node", F.col("lat")).alias("lat"),
        F.when(way, F.col("center.lon")).when(F.col("type") == "node", F.col("lon")).alias("lng"), "tags",
    ).withColumn("addr_street", F.nullif("_s", F.lit(""))).drop("_s")


def read_register_csv(spark: SparkSession, path: str, code: str = "46411", encoding: str = "UTF-8") -> DataFrame:
    """Business register: canonical columns by header alias, rows whose activity code starts with ``code``.

    Only the header line is read to learn the column names; a file without the code column is kept whole.
    """
    df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    names = {c.lower().strip() for c in df.columns}
    rows = df.select(*[
        first_given(df, a).alias(k) for k, a in REGISTER_ALIASES.items() if names & set(a)])
    return rows.filter(F.startswith(F.col("codigo_act"), F.lit(code))) if "codigo_act" in rows.columns else rows


def services(props: Column) -> Column:
    """Distinct service labels of the locator flags that are set."""
    labels = []
    for key, label in SERVICE_FLAGS.items():
        value = F.trim(props[key])
        labels.append(F.when(value.isNotNull() & ~value.isin(FALSE_VALUES), F.lit(label)))
    return F.array_distinct(F.array_compact(F.array(*labels)))


def component(components: Column, *types: str) -> Column:
    """Long name of the first address component that has one of the types."""
    def wanted(c):
        hit = F.lit(False)
        for t in types:
            hit = hit | F.array_contains(c["types"], t)
        return hit
    return F.get(F.filter(components, wanted), F.lit(0))["long_name"]


def place_address(df: DataFrame) -> DataFrame:
    c = F.col("address_components")
    return df.withColumns({
        "state": component(c, "administrative_area_level_1"),
        "municipality": component(c, "locality", "administrative_area_level_2"),
        "zip_code": component(c, "postal_code"),
    })


def read_app_json(spark: SparkSession, path: str) -> DataFrame:
    """Exported stations, one per line, under current or older field names; rows without id or position are
    dropped."""
    s = spark.read.schema(APP_SCHEMA).json(path)
    regular = F.coalesce("prices.regular", "prices.gasolina_regular")
    premium = F.coalesce("prices.premium", "prices.gasolina_premium")
    diesel = F.col("prices.diesel")
    some = F.coalesce(regular, premium, diesel).isNotNull()
    rows = s.select(
        F.coalesce("id", "master_id", F.lit("")).alias("id"), F.coalesce("name", "canonical_name", F.lit("")).alias("name"),
        F.coalesce("brand", "canonical_brand", F.lit("OTRO")).alias("brand"),
        F.coalesce("address", "canonical_address", F.lit("")).alias("address"),
        F.coalesce("city", "canonical_municipality", F.lit("")).alias("city"),
        F.coalesce("state", "canonical_state", F.lit("")).alias("state"),
        F.coalesce("zipCode", "canonical_zip", F.lit("")).alias("zip_code"),
        F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lng", F.lit(0.0)).alias("lng"),
        regular.alias("regular"), premium.alias("premium"), diesel.alias("diesel"),
        F.coalesce("prices.updatedAt", "prices.updated_at").alias("updated_at"),
        F.coalesce("hasData", some).alias("has_data"),
    )
    return rows.filter("id <> '' and lat <> 0 and lng <> 0")
