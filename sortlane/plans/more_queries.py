"""Queries of dictionaries, generated labels and line-wise extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import extract, match
from ..sources import dictionaries as dic
from ..sources import files
from ..sources.generator import labels
from ..sources.files import work_folder
from .catalog import query
from .match_queries import _BRGY, _EXPECT, _LCS, _VAR, _values

C = F.col
#: A quantity or weight whose digits stand in a barangay's name ("176") makes its line score as an address line.
_STRAY = "nullif(concat_ws(', ', CASE WHEN quantity IN (1, 6, 7) THEN 'Quantity: ' || quantity END, CASE WHEN weight_g = 176 THEN 'Weight: 176g' END), '')"


@query("src_order_truth", "order_truth", "SELECT tracking_id, order_id, rts_code, rider, buyer_name, address, weight, quantity FROM order_truth")
def _(orders):
    """Orders written as JSON objects of objects, one a line, and read back."""
    folder = work_folder(orders.sparkSession)
    one = F.create_map(F.concat("tracking_id", F.lit(".jpg")), F.struct(*orders.columns))
    orders.select(F.to_json(one).alias("value")).write.text(folder)
    return files.read_orders(orders.sparkSession, folder, by_line=True).select(*orders.columns)


_COURIER = "CASE WHEN n_regionkey % 2 = 0 THEN 'flash-express' ELSE 'shopee-spx' END"
_RIDER = "'GY' || lpad(CAST(s_suppkey % 30 AS STRING), 2, '0')"
_DIMS = f"""WITH n AS (SELECT *, {_COURIER} AS courier FROM nation), shared AS (SELECT DISTINCT c_mktsegment AS value, 'first' AS parent FROM customer UNION SELECT n_name, 'last' FROM nation)
SELECT courier, 'barangay' AS dimension, n_name AS value, NULL AS parent, NULL AS code FROM n
UNION ALL SELECT DISTINCT courier, 'district', c_mktsegment, n_name, upper(substr(c_mktsegment, 1, 3)) || n_nationkey FROM n JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT courier, 'city', 'City of ' || n_name, NULL, NULL FROM n
UNION ALL SELECT DISTINCT courier, 'province', 'Province ' || n_regionkey, NULL, NULL FROM n
UNION ALL SELECT DISTINCT courier, 'rider', {_RIDER.replace("STRING", "VARCHAR")}, NULL, NULL FROM n JOIN supplier ON s_nationkey = n_nationkey
UNION ALL SELECT courier, 'sort_code', 'FEX-' || upper(substr(n_name, 1, 3)) || '-' || n_nationkey, NULL, NULL FROM n WHERE courier = 'flash-express'
UNION ALL SELECT courier, 'name', value, parent, NULL FROM shared, (SELECT DISTINCT courier FROM n)
UNION ALL SELECT DISTINCT courier, 'pattern', CASE courier WHEN 'flash-express' THEN '^FE[0-9]{{10}}$' ELSE '^SPX[0-9]{{9}}$' END, 'trackingNumber', NULL FROM n"""


@query("src_courier_dims", "nation customer supplier", _DIMS)
def _(nation, customer, supplier):
    """A nested dictionary of two couriers, written as one JSON file, and read into its seven dimensions at once."""
    spark, folder = nation.sparkSession, work_folder(nation.sparkSession)
    n = nation.withColumn("courier", F.expr(_COURIER))
    several = lambda c: F.array_sort(F.collect_set(c))
    sort_codes = F.when(C("courier") == "flash-express", F.concat(F.lit("FEX-"), F.upper(F.substring("n_name", 1, 3)), F.lit("-"), C("n_nationkey")))
    places = n.groupBy("courier").agg(several("n_name").alias("barangays"), several(F.concat(F.lit("City of "), "n_name")).alias("cities"), several(F.concat(F.lit("Province "), "n_regionkey")).alias("provinces"), several(sort_codes).alias("codes"))
    areas = n.join(customer, C("c_nationkey") == C("n_nationkey")).groupBy("courier", "n_name").agg(several(F.struct(C("c_mktsegment").alias("name"), F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), C("n_nationkey")).alias("code"))).alias("all"))
    areas = areas.groupBy("courier").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "all"))).alias("districts"))
    riders = n.join(supplier, C("s_nationkey") == C("n_nationkey")).groupBy("courier").agg(several(F.expr(_RIDER)).alias("riders"))
    tracking = F.struct(F.when(C("courier") == "flash-express", "^FE[0-9]{10}$").otherwise("^SPX[0-9]{9}$").alias("pattern"))
    patterns = F.create_map(F.lit("trackingNumber"), tracking, F.lit("weight"), F.struct(F.lit(None).cast("string").alias("pattern")))
    codes = F.when(F.size("codes") > 0, C("codes"))
    one = F.struct(F.struct("barangays", "districts", "cities", "provinces").alias("dictionaries"), F.struct(codes.alias("sortCode"), C("riders").alias("riderCodes")).alias("fieldEnumerations"), patterns.alias("fieldPatterns"))
    couriers = places.join(areas, "courier", "left").join(riders, "courier", "left").agg(F.map_from_entries(F.collect_list(F.struct("courier", one))).alias("couriers"))
    shared = customer.select(C("c_mktsegment").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(nation.select(F.lit(None).cast("string").alias("a"), C("n_name").alias("b"))).agg(F.struct(several("a").alias("firstNames"), several("b").alias("lastNames")).alias("shared"))
    # both are one row
    whole = couriers.withColumn("one", F.lit(1)).join(shared.withColumn("one", F.lit(1)), "one").select(F.to_json(F.struct("shared", "couriers")).alias("value"))
    whole.coalesce(1).write.text(folder)
    return dic.courier_dimensions(spark, folder).select("courier", "dimension", "value", "parent", "code")


_UP, _SEG = "upper(n_name)", "upper(c_mktsegment)"
_MODEL_SQL = f"""WITH d AS (SELECT DISTINCT n_nationkey, n_name, c_mktsegment FROM nation JOIN customer ON c_nationkey = n_nationkey),
s AS (SELECT 'barangay' AS kind, n_name AS barangay, n_name AS canonical, unnest([{_UP}, replace({_UP}, 'I', '1'), replace({_UP}, 'A', '4')]) AS variation FROM (SELECT DISTINCT n_name FROM d)
  UNION SELECT 'district', n_name, c_mktsegment, unnest([{_SEG}, replace({_SEG}, 'O', '0')]) FROM d)
SELECT kind, barangay, canonical, variation, NULL AS rider, NULL AS sort_code FROM s
UNION ALL SELECT 'area', n_name, c_mktsegment, upper(substr(c_mktsegment, 1, 3)), 'GY' || n_nationkey, 'FEX-' || upper(substr(c_mktsegment, 1, 3)) || '-GY' || n_nationkey FROM d"""


@query("src_label_model", "nation customer", _MODEL_SQL)
def _(nation, customer):
    """A label model (a JSON line a barangay), written and read into areas and spellings."""
    folder = work_folder(nation.sparkSession)
    d = nation.join(customer, C("c_nationkey") == C("n_nationkey")).select("n_nationkey", "n_name", "c_mktsegment").distinct()
    code, up, seg = F.upper(F.substring("c_mktsegment", 1, 3)), F.upper("n_name"), F.upper("c_mktsegment")
    rider = F.concat(F.lit("GY"), C("n_nationkey"))
    district = F.struct(C("c_mktsegment").alias("name"), code.alias("code"), rider.alias("rider"), F.concat(F.lit("FEX-"), code, F.lit("-"), rider).alias("rtsCode"), F.array_distinct(F.array(seg, F.replace(seg, F.lit("O"), F.lit("0")))).alias("variations"))
    spellings = F.array_distinct(F.array(up, F.replace(up, F.lit("I"), F.lit("1")), F.replace(up, F.lit("A"), F.lit("4"))))
    files.write_json(d.groupBy("n_name").agg(F.collect_list(district).alias("districts")).select(C("n_name").alias("name"), spellings.alias("variations"), "districts"), folder)
    areas, spelled = dic.label_model(nation.sparkSession, folder)
    none = F.lit(None).cast("string")
    return spelled.select("kind", "barangay", "canonical", "variation", none.alias("rider"), none.alias("sort_code")).unionByName(areas.select(F.lit("area").alias("kind"), "barangay", C("district").alias("canonical"), C("code").alias("variation"), "rider", "sort_code"))


@query("gen_labels_job", "customer", None)
def _(customer):
    return labels(customer, "c_custkey")


_DTEXT = "CASE scan_id % 4 WHEN 0 THEN 'N0RTH' WHEN 1 THEN 'Souht' WHEN 2 THEN 'CENTRAL' ELSE 'x' END"
_DVAR = _values([(i, v, c) for i, (v, c) in enumerate(dic.DISTRICT_VARIATIONS.items())], "d(pos, variation, canonical)")


def _variation(source: str, table: str) -> str:
    return f"(SELECT t, canonical FROM (SELECT t, canonical, pos, 1 - levenshtein(upper(t), variation) / greatest(length(t), length(variation)) AS score FROM (SELECT DISTINCT {source} AS t FROM r), {table}) WHERE score > 0.7 QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, pos) = 1)"


@query("join_address_pair", "places", f"WITH r AS (SELECT scan_id, barangay_text AS b, {_DTEXT} AS d, 'FEX-BUL-SJDM-MZN1-GY01' AS code FROM places) SELECT scan_id, coalesce(x.canonical = barangay, false) AND coalesce(y.canonical = district, false) AS valid, CASE WHEN x.canonical = barangay THEN 0.5 ELSE 0 END + CASE WHEN y.canonical = district THEN 0.5 ELSE 0 END AS confidence FROM r JOIN {_EXPECT} USING (code) LEFT JOIN {_variation('b', _VAR)} x ON x.t = b LEFT JOIN {_variation('d', _DVAR)} y ON y.t = d")
def _(places):
    spark = places.sparkSession
    rows = places.select("scan_id", C("barangay_text").alias("b"), F.expr(_DTEXT).alias("d"), F.lit("FEX-BUL-SJDM-MZN1-GY01").alias("sort_code"))
    rows = match.best_variation(rows, "b", dic.variations(spark)).withColumnRenamed("matched", "mb")
    rows = match.best_variation(rows, "d", dic.variations(spark, dic.DISTRICT_VARIATIONS)).withColumnRenamed("matched", "md")
    rows = rows.join(match.small(dic.districts(spark)), "sort_code")
    b, d = F.coalesce(C("mb") == C("barangay"), F.lit(False)), F.coalesce(C("md") == C("district"), F.lit(False))
    return rows.select("scan_id", (b & d).alias("valid"), (F.when(b, 0.5).otherwise(0.0) + F.when(d, 0.5).otherwise(0.0)).alias("confidence"))


_TH_DISTRICT = "CASE scan_id % 15 WHEN 0 THEN 'bang  khen' WHEN 5 THEN 'Phra Nakon' WHEN 10 THEN 'Nowhere' END"


@query("ext_th_fields", "scans", f"""WITH d AS (SELECT * FROM (VALUES ('bang  khen', 'Bang Khen'), ('Phra Nakon', 'Phra Nakhon')) AS v(t, district))
SELECT scan_id, CASE WHEN scan_id % 5 > 0 THEN 'TH' || substr(tracking_id, 3) END AS tracking_id, CASE WHEN scan_id % 5 > 0 AND scan_id % 6 IN (1, 2, 3) THEN 'RTS-0' || (scan_id % 6) END AS rts_code,
CASE WHEN scan_id % 5 > 0 THEN 'ORD' || lpad(CAST(scan_id % 1000000 AS VARCHAR), 6, '0') END AS order_id, district FROM scans LEFT JOIN d ON t = {_TH_DISTRICT}""")
def _(scans):
    """Labels of the second courier family; some scans hold a district's name alone."""
    label = F.concat_ws("\n", F.concat(F.lit("TH"), F.substring("tracking_id", 3, 10)), F.concat(F.lit("rts-0"), (C("scan_id") % 6).cast("string")), F.concat(F.lit("ord"), F.lpad((C("scan_id") % 1000000).cast("string"), 6, "0")))
    rows = scans.select("scan_id", F.coalesce(F.expr(_TH_DISTRICT), label).alias("text"))
    return extract.th_fields(rows, "scan_id", "text", dic.words(scans.sparkSession, dic.TH_DISTRICTS), dic.RETURN_CODES)


@query("ext_anchor_match", "label_text", None)
def _(t):
    lines = t.select(F.explode(F.split("raw_text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    return lines.select("line", "n", extract.anchor_of("line").alias("anchor")).where("anchor IS NOT NULL")


_RIDER_LINE = r"upper(nullif(regexp_extract(regexp_extract(raw_text, 'Rider: [^\n]*'), '(?i)([A-Z]{1,2}[0-9]{1,2})(?:[^A-Za-z0-9_]|$)', 1), ''))"


@query("ext_anchor_fields_job", "label_text scans", f"SELECT scan_id, order_id, {_RIDER_LINE} AS rider_id, 'FEX-BUL-SJDM-MZN' || (scan_id % 4 + 1) || '-GY0' || (scan_id % 4 + 1) AS sort_code, CASE WHEN weight_g BETWEEN 100 AND 7000 THEN CAST(weight_g AS VARCHAR) END AS weight, CASE WHEN quantity IS NOT NULL THEN CAST(quantity AS VARCHAR) END AS quantity, CASE WHEN scan_id % 3 = 0 THEN 'Carlos Johnson' ELSE 'Thomas Gonzalez' END AS buyer_name, nullif(concat_ws(', ', buyer_address, {_STRAY}), '') AS buyer_address FROM scans JOIN label_text USING (scan_id)")
def _(t, _scans):
    return extract.anchored_fields(t, "scan_id", "raw_text")


@query("ext_name_fallback", "label_text", "SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN 'Carlos Johnson' ELSE 'Thomas Gonzalez' END AS name FROM scans")
def _(t):
    return extract.name_lines(extract.label_lines(t, "scan_id", "raw_text"), "scan_id")


@query("ext_buyer_simple", "label_text", "SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN 'Carlos Johnson' ELSE 'Thomas Gonzalez' END AS name FROM scans")
def _(t):
    header = r"(?i)flash|rts|sort|rider|order|buyer|quantity|weight"
    lines = t.select("scan_id", F.posexplode(F.split("raw_text", "\n")).alias("pos", "line"))
    fits = C("line").rlike(r"^[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*){1,3}$") & ~C("line").rlike(header)
    return lines.where(fits).groupBy("scan_id").agg(F.min_by("line", "pos").alias("name"))


@query("ext_buyer_info", "scans", "SELECT scan_id, 'Carlos Johnson' AS name, CASE WHEN buyer_address IS NULL THEN NULL ELSE 'Lot ' || scan_id || ', Brgy. Muzon' END AS address FROM scans")
def _(scans):
    text = F.concat_ws("\n", F.lit("BUYER"), F.lit("Carlos Johnson PDG"), F.when(C("buyer_address").isNotNull(), F.concat(F.lit("Lot "), C("scan_id").cast("string"), F.lit("\nBrgy. Muzon"))), F.lit("COD"), F.lit("Zip Code 3023"), F.lit("ignored"))
    return extract.buyer_zones(extract.label_lines(scans.select("scan_id", text.alias("t")), "scan_id", "t"), "scan_id")


_KNOWN = _values([(w.lower(), 75) for w in dic.barangay_names()] + [(w.lower(), 85) for w in dic.PLACES], "k(w, least)")


def _windows(pairs: str) -> str:
    """The partial ratio of distinct pairs (x, y): the best window of the shorter text's length."""
    return f"q AS ({pairs}), o AS (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM q), wd AS (SELECT x, y, s AS a, unnest(list_transform(range(1 - length(s), length(l)), lambda i: substr(l, CAST(greatest(i, 0) AS INT) + 1, CAST(least(i + length(s), length(l)) - greatest(i, 0) AS INT)))) AS b FROM o), p AS (SELECT DISTINCT a, b FROM wd), {_LCS}, part AS (SELECT x, y, max(200.0 * n / (length(a) + length(b))) AS s FROM wd JOIN lcs USING (a, b) GROUP BY x, y)"


_TOKENS = r"SELECT scan_id, lower(regexp_replace(unnest(regexp_split_to_array(barangay_text || ' Bulacan 3023', '\s+')), '[^A-Za-z0-9_]', '', 'g')) AS t FROM places"


@query("str_address_score", "places", f"WITH RECURSIVE t AS ({_TOKENS}), {_windows(f'SELECT DISTINCT t AS x, w AS y FROM t, {_KNOWN}')}, h AS (SELECT DISTINCT x FROM part JOIN {_KNOWN} ON w = y WHERE s >= least) SELECT scan_id, round(avg(CASE WHEN x IS NULL THEN 0 ELSE 1 END), 6) AS score FROM t LEFT JOIN h ON x = t GROUP BY scan_id")
def _(places):
    """Share of a line's tokens that come near a barangay (75) or a city or province (85)."""
    spark, lines = places.sparkSession, places.select("scan_id", F.concat("barangay_text", F.lit(" Bulacan 3023")).alias("line"))
    return match.address_score(lines, "scan_id", "line", dic.barangays(spark), dic.places(spark)).withColumn("score", F.round("score", 6))


@query("udf_partial_ratio_job", "places", f"WITH RECURSIVE {_windows(f'SELECT DISTINCT lower(barangay_text) AS x, lower(word) AS y FROM places, {_BRGY}')}, best AS (SELECT x, max(s) AS s FROM part GROUP BY x) SELECT scan_id, round(s, 6) AS s FROM places JOIN best ON x = lower(barangay_text)")
def _(places):
    """The native form serves; the key keeps the inventory's name."""
    pairs = places.select(F.lower("barangay_text").alias("x")).distinct().join(match.small(dic.barangays(places.sparkSession).select(F.lower("word").alias("y"))), F.lit(True))
    return places.select("scan_id", F.lower("barangay_text").alias("x")).join(pairs.withColumn("s", sim.partial_ratio(C("x"), C("y"))).groupBy("x").agg(F.round(F.max("s"), 6).alias("s")), "x").select("scan_id", "s")
