"""Courier dictionaries as data frames.

The fixed values below are the public sample of one courier's delivery area; a
deployment passes its own frames (``read_courier`` reads them from JSON).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Barangay, district, sort code and rider, in dictionary order.
DISTRICTS = [
    ("Muzon", "North", "FEX-BUL-SJDM-MZN1-GY01", "GY01"),
    ("Muzon", "South", "FEX-BUL-SJDM-MZN2-GY02", "GY02"),
    ("Muzon", "Central", "FEX-BUL-SJDM-MZN3-GY03", "GY03"),
    ("Muzon", "Proper", "FEX-BUL-SJDM-MZN4-GY04", "GY04"),
    ("Graceville", "Subdivision", "FEX-BUL-SJDM-GRC1-GY05", "GY05"),
    ("Graceville", "Main", "FEX-BUL-SJDM-GRC2-GY06", "GY06"),
    ("Graceville", "Commercial", "FEX-BUL-SJDM-GRC3-GY07", "GY07"),
    ("Poblacion I", "Central District", "FEX-BUL-SJDM-POB1-GY08", "GY08"),
    ("Poblacion I", "Downtown", "FEX-BUL-SJDM-POB2-GY09", "GY09"),
    ("Poblacion I", "Main", "FEX-BUL-SJDM-POB3-GY10", "GY10"),
    ("Loma de Gato", "Marilao Border", "FEX-BUL-SJDM-LDG1-GY11", "GY11"),
    ("Loma de Gato", "Residential", "FEX-BUL-SJDM-LDG2-GY12", "GY12"),
    ("Loma de Gato", "Main", "FEX-BUL-SJDM-LDG3-GY13", "GY13"),
    ("Bagong Silang (Brgy 176)", "Caloocan Border", "FEX-BUL-SJDM-BS01-GY14", "GY14"),
    ("Bagong Silang (Brgy 176)", "Metro Manila Border", "FEX-BUL-SJDM-BS02-GY15", "GY15"),
    ("Bagong Silang (Brgy 176)", "Main", "FEX-BUL-SJDM-BS03-GY16", "GY16"),
    ("Gaya-Gaya", "Warehouse District", "FEX-BUL-SJDM-GYG1-HUB", "HUB"),
    ("Gaya-Gaya", "Main", "FEX-BUL-SJDM-GYG2-GY17", "GY17"),
    ("Gaya-Gaya", "Central", "FEX-BUL-SJDM-GYG3-GY18", "GY18"),
    ("Sapang Palay", "West", "FEX-BUL-SJDM-SPY1-GY19", "GY19"),
    ("Sapang Palay", "East", "FEX-BUL-SJDM-SPY2-GY20", "GY20"),
    ("Sapang Palay", "Central", "FEX-BUL-SJDM-SPY3-GY21", "GY21"),
    ("Tungko", "Main", "FEX-BUL-SJDM-TKO1-GY22", "GY22"),
    ("Tungko", "Subdivision", "FEX-BUL-SJDM-TKO2-GY23", "GY23"),
]
# Known first names.
FIRST_NAMES = ["John", "Jane", "Michael", "Sarah", "David", "Emma", "Chris", "Lisa", "James", "Maria", "Robert", "Jennifer", "William", "Linda", "Thomas", "Jose", "Ana", "Carlos", "Rosa", "Miguel"]
# Known last names.
LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson", "Santos", "Cruz", "Reyes", "Flores", "Morales"]
# Cities and provinces of the delivery area.
PLACES = ["San Jose del Monte", "Bulacan"]
# Spelling variations -> canonical name.
BARANGAY_VARIATIONS = {"MUZON": "Muzon", "MUZOM": "Muzon", "MUZ0N": "Muzon", "MUZ0M": "Muzon", "GRACEVILLE": "Graceville", "GR4CEVILLE": "Graceville", "GRACEVILE": "Graceville", "GRACVILE": "Graceville"}
# Spelling variations of one barangay's districts -> canonical name.
DISTRICT_VARIATIONS = {"NORTH": "North", "N0RTH": "North", "MORTH": "North", "SOUTH": "South", "S0UTH": "South", "SOUT": "South", "CENTRAL": "Central", "CENTR4L": "Central", "GENTRAL": "Central", "PROPER": "Proper", "PR0PER": "Proper", "PROP3R": "Proper"}
# Literal corrections of the simple reader, in order.
TYPOS = [("DRDER", "ORDER"), ("5", "S"), ("0", "O"), ("1", "I"), ("8", "B"), ("C0DE", "CODE"), ("RT5", "RTS"), ("F3X", "FEX"), ("8UL", "BUL")]
# The label model's corrections, in order.
MODEL_TYPOS = [
    ("0", "O"), ("1", "I"), ("3", "E"), ("4", "A"), ("5", "S"), ("6", "G"), ("7", "T"), ("8", "B"), ("9", "G"),
    ("DRDER", "ORDER"), ("QRDER", "ORDER"), ("0RDER", "ORDER"), ("C0DE", "CODE"), ("G0DE", "CODE"), ("GODE", "CODE"), ("RT5", "RTS"), ("R7S", "RTS"),
    ("S0RT", "SORT"), ("50RT", "SORT"), ("$ORT", "SORT"), ("FE><", "FEX"), ("F3X", "FEX"), ("F£X", "FEX"), ("BUL", "BUL"), ("8UL", "BUL"), ("BUt", "BUL"), ("SJDM", "SJDM"), ("5JDM", "SJDM"), ("SJ0M", "SJDM"),
    ("SUBDIV", "SUBDIVISION"), ("SUB0IV", "SUBDIVISION"), ("EXTENS10N", "EXTENSION"), ("EXT", "EXTENSION"), ("PR0PER", "PROPER"), ("PROP3R", "PROPER"), ("M41N", "MAIN"), ("MA1N", "MAIN"), ("COMMERC1AL", "COMMERCIAL"), ("GOMMERC1AL", "COMMERCIAL"),
]
# Valid return codes and delivery districts of the second courier family.
RETURN_CODES = ["RTS-01", "RTS-02", "RTS-03"]
TH_DISTRICTS = ["Bang Khen", "Bang Kapi", "Pathum Wan", "Pom Prap Sattru Phai", "Phra Nakhon", "Min Buri", "Lat Krabang", "Yan Nawa", "Samphanthawong", "Phaya Thai", "Thon Buri", "Bang Khun Thian"]
# Streets of generated labels.
STREETS = ["Mabini St", "Rizal Ave", "Bonifacio St", "Mabuhay St", "Del Pilar St", "Kalayaan Ave", "Maginhawa St", "Kamuning Rd", "Tandang Sora Ave", "Sto. Domingo St", "Sta. Mesa St", "España Blvd", "Lacson Ave", "Vicente Cruz St", "Carriedo St", "NLEX Service Rd", "Del Monte Ave", "Bulacan Highway", "Main Street"]
# Labels whose parts the keyword score looks for.
KEYWORD_CODES = ["FEX-BUL-SJDM-BS02-GY15", "FEX-BUL-SJDM-MZN3-GY03", "FEX-BUL-SJDM-TKO1-GY22", "FEX-BUL-SJDM-SPY2-GY20", "FEX-BUL-SJDM-GRC3-GY07"]
# Areas without printed sort code -> code, by district where there are several.
AREA_CODES = [("Muzon", "North", "RTS-BUL-SJDM-MZN1-A1"), ("Muzon", "South", "RTS-BUL-SJDM-MZN2-A2"), ("Muzon", "Central", "RTS-BUL-SJDM-MZN3-A3"), ("Tungko", "Main", "RTS-BUL-SJDM-TKM-B1"), ("Tungko", "Subdivision", "RTS-BUL-SJDM-TKM-B2"), ("Sapang Palay", "West", "RTS-BUL-SJDM-SPY1-C1"), ("Sapang Palay", "East", "RTS-BUL-SJDM-SPY2-C2"), ("Santa Maria", None, "RTS-BUL-STM-SMR-D1"), ("Norzagaray", None, "RTS-BUL-NRY-NRY-D2")]


def district_rows() -> list[tuple[int, str, str, str, str]]:
    """(pos, barangay, district, sort code, rider) in order."""
    return [(i, *row) for i, row in enumerate(DISTRICTS)]


def barangay_names() -> list[str]:
    return list(dict.fromkeys(row[0] for row in DISTRICTS))


def districts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(district_rows(), "pos int, barangay string, district string, sort_code string, rider string")


def words(spark: SparkSession, items: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(items)), "pos int, word string")


def barangays(spark: SparkSession) -> DataFrame:
    return words(spark, barangay_names())


def sort_codes(spark: SparkSession) -> DataFrame:
    return words(spark, [r[3] for r in district_rows()])


def riders(spark: SparkSession) -> DataFrame:
    """In alphabetical order, so that the first of several near codes is defined."""
    return words(spark, sorted(r[4] for r in district_rows()))


def names(spark: SparkSession) -> DataFrame:
    return words(spark, FIRST_NAMES).unionByName(words(spark, LAST_NAMES))


def places(spark: SparkSession) -> DataFrame:
    return words(spark, PLACES)


def variations(spark: SparkSession, items: dict[str, str] = BARANGAY_VARIATIONS) -> DataFrame:
    return spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(items.items())], "pos int, variation string, canonical string")


#: The nested dictionary file: names that all couriers share, and for each courier its places, codes and patterns.
COURIERS = """shared struct<firstNames: array<string>, lastNames: array<string>>,
couriers map<string, struct<
  dictionaries: struct<barangays: array<string>, districts: map<string, array<struct<name: string, code: string>>>, cities: array<string>, provinces: array<string>>,
  fieldEnumerations: struct<sortCode: array<string>, riderCodes: array<string>>,
  fieldPatterns: map<string, struct<pattern: string>>>>"""


def courier_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """``courier, dimension, pos, value, parent, code`` of all couriers in one read of nested JSON files.

    Dimensions: barangay, district (of barangay ``parent``, with ``code``), city, province, rider, sort_code,
    name (``parent``: first or last; the same for every courier) and pattern (of field ``parent``).  What a
    courier lacks gives no rows: one has sort codes by list, another by pattern only.
    """
    root = spark.read.schema(COURIERS).json(path, multiLine=True).where("couriers is not null")
    one = root.select("shared", F.explode("couriers").alias("courier", "c"))
    item = lambda kind, value, parent=None, code=None: F.struct(F.lit(kind).alias("dimension"), value.cast("string").alias("value"), (F.lit(None) if parent is None else parent).cast("string").alias("parent"), (F.lit(None) if code is None else code).cast("string").alias("code"))
    plain = lambda kind, values: F.transform(values, lambda x, i: F.struct(i.alias("pos"), item(kind, x).alias("x")))
    named = lambda values, parent: F.transform(values, lambda x, i: F.struct(i.alias("pos"), item("name", x, F.lit(parent)).alias("x")))
    of = F.col("c")
    areas = F.flatten(F.transform(F.map_entries(of["dictionaries"]["districts"]), lambda e: F.transform(e["value"], lambda d, i: F.struct(i.alias("pos"), item("district", d["name"], e["key"], d["code"]).alias("x")))))
    patterns = F.transform(F.filter(F.map_entries(of["fieldPatterns"]), lambda e: e["value"]["pattern"].isNotNull()), lambda e: F.struct(F.lit(0).alias("pos"), item("pattern", e["value"]["pattern"], e["key"]).alias("x")))
    every = [plain("barangay", of["dictionaries"]["barangays"]), areas, plain("city", of["dictionaries"]["cities"]), plain("province", of["dictionaries"]["provinces"]), plain("rider", of["fieldEnumerations"]["riderCodes"]), plain("sort_code", of["fieldEnumerations"]["sortCode"]), named(F.col("shared.firstNames"), "first"), named(F.col("shared.lastNames"), "last"), patterns]
    none = F.array().cast("array<struct<pos:int,x:struct<dimension:string,value:string,parent:string,code:string>>>")
    rows = one.select("courier", F.explode(F.concat(*(F.coalesce(x, none) for x in every))).alias("e"))
    return rows.select("courier", "e.x.dimension", "e.pos", "e.x.value", "e.x.parent", "e.x.code")


#: A label model file: barangays with spellings, each with districts that have spellings, riders and return codes.
MODEL = "name string, variations array<string>, districts array<struct<name: string, code: string, rider: string, rtsCode: string, variations: array<string>>>"


def label_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Areas (``barangay, district, code, rider, sort_code``) and spellings (``kind, barangay, canonical, variation``) of a label model."""
    root = spark.read.schema(MODEL).json(path)
    districts = root.select(F.col("name").alias("barangay"), F.explode("districts").alias("d"))
    areas = districts.select("barangay", F.col("d.name").alias("district"), F.col("d.code").alias("code"), F.col("d.rider").alias("rider"), F.col("d.rtsCode").alias("sort_code"))
    spelled = root.select(F.lit("barangay").alias("kind"), F.col("name").alias("barangay"), F.col("name").alias("canonical"), F.explode("variations").alias("variation"))
    return areas, spelled.unionByName(districts.select(F.lit("district").alias("kind"), "barangay", F.col("d.name").alias("canonical"), F.explode("d.variations").alias("variation")))
