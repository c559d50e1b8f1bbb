"""Queries of text rules and field extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extract, match, store
from ..operators.enrich import enriched
from ..sources import dictionaries as dic
from ..sources import files
from ..sources.files import work_folder
from .catalog import query
from .match_queries import _BARANGAY, _D_TEXT, _EXPECT, _R_TEXT, _RIDERS, _S_TEXT, _SORT, _district
from .match_queries import _first as _first_code
from .more_queries import _STRAY

C = F.col
_FIX = f"translate({{s}}, '{tx.CONFUSED}', '{tx.DIGITS}')"


def _first(pattern: str, group: int = 0, s: str = "raw_text", flags: str = "") -> str:
    return f"nullif(regexp_extract({s}, '{flags}{pattern}', {group}), '')"


@query("str_fix_digits", "documents", f"SELECT doc_id, sha256({_FIX.format(s='text')}) AS fixed FROM documents")
def _(d):
    return d.select("doc_id", F.sha2(tx.fix_digits(C("text")), 256).alias("fixed"))


_T = "CASE scan_id % 4 WHEN 0 THEN tracking_id WHEN 1 THEN replace(tracking_id, '0', 'O') WHEN 2 THEN tracking_id || '1' ELSE 'XX' || tracking_id END"


#: Field values of both couriers with the errors of their kinds: right, letters for digits, too long, strange.
_FIELDS = {
    ("flash", "tracking"): _T,
    ("flash", "order"): "CASE scan_id % 3 WHEN 0 THEN order_id WHEN 1 THEN replace(order_id, '0', 'O') ELSE lower(order_id) END",
    ("flash", "phone"): "CASE WHEN scan_id % 2 = 0 THEN 'FE ' || lpad(CAST(scan_id AS STRING), 12, 'O') ELSE 'FE' || CAST(scan_id AS STRING) END",
    ("spx", "tracking"): "CASE WHEN scan_id % 2 = 0 THEN 'SPX' || lpad(CAST(scan_id AS STRING), 9, '0') ELSE 'SPX' || lpad(CAST(scan_id AS STRING), 9, 'O') END",
    ("spx", "order"): "'SH' || lpad(CAST(scan_id AS STRING), 10, 'A')",
    ("spx", "phone"): "CASE WHEN scan_id % 2 = 0 THEN 'SPX' || lpad(CAST(scan_id AS STRING), 12, '0') ELSE 'SPX' END",
}


def _validated_sql(courier: str, field: str) -> str:
    t, p = f"({_FIELDS[courier, field]})", tx.COURIER_FIELDS[courier][field].strip("^$").replace("\\d", "[0-9]")
    fixed, fits = _FIX.format(s=t), lambda x: f"regexp_full_match({x}, '{p}')"
    return f"SELECT scan_id, '{courier}' AS courier, '{field}' AS field, CASE WHEN NOT {fits(t)} AND {fits(fixed)} THEN {fixed} ELSE {t} END AS value, {fits(t)} OR {fits(fixed)} AS ok FROM scans"


@query("str_validate_fix", "scans", " UNION ALL ".join(_validated_sql(*k) for k in _FIELDS))
def _(scans):
    out = []
    for (courier, field), text in _FIELDS.items():
        out.append(F.struct(F.lit(courier).alias("courier"), F.lit(field).alias("field"), F.expr(text).alias("t")))
    rows = scans.select("scan_id", F.explode(F.array(*out)).alias("x")).select("scan_id", "x.*")
    value = ok = F.lit(None)
    for courier, field in _FIELDS:
        v, o = tx.validated(C("t"), tx.COURIER_FIELDS[courier][field])
        mine = (C("courier") == courier) & (C("field") == field)
        value, ok = F.when(mine, v).otherwise(value), F.when(mine, o).otherwise(ok)
    return rows.select("scan_id", "courier", "field", value.alias("value"), ok.alias("ok"))


def _chain(s: str, pairs=dic.TYPOS) -> str:
    for a, b in pairs:
        s = f"replace({s}, '{a}', '{b}')"
    return s


@query("str_typo_chain", "label_text", f"SELECT scan_id, {_chain('raw_text')} AS fixed, {_chain('raw_text', dic.MODEL_TYPOS)} AS fixed_by_model FROM label_text")
def _(t):
    return t.select("scan_id", tx.typos_fixed(C("raw_text"), dic.TYPOS).alias("fixed"), tx.typos_fixed(C("raw_text"), dic.MODEL_TYPOS).alias("fixed_by_model"))


@query("flt_ocr_lines", "documents", r"WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, trim(unnest(string_split(text, chr(10)))) AS x FROM documents) SELECT d.doc_id, sha256(coalesce(t, '')) AS kept FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM l WHERE length(x) >= 3 AND length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) / length(x) >= 0.5 GROUP BY doc_id) USING (doc_id)")
def _(d):
    return d.select("doc_id", F.sha2(tx.kept_lines(C("text")), 256).alias("kept"))


_P = {k: (p.replace("(?:\\D|$)", "(?:[^0-9]|$)"), g) for k, (p, g) in extract.PATTERNS.items()}
_REGEX = ", ".join(f"trim({_first(p, g, flags='(?i)')}) AS {k}" for k, (p, g) in _P.items() if k not in ("weight", "quantity"))
_WEIGHT = f"TRY_CAST({_first(_P['weight'][0], 1, flags='(?i)')} AS INT)"
_QTY = f"TRY_CAST({_first(_P['quantity'][0], 1, flags='(?i)')} AS INT)"


@query("ext_regex_fields", "label_text", f"SELECT scan_id, {_REGEX}, CASE WHEN {_WEIGHT} BETWEEN 100 AND 7000 THEN {_WEIGHT} END AS weight_g, CASE WHEN {_QTY} BETWEEN 1 AND 14 THEN {_QTY} END AS quantity FROM label_text")
def _(t):
    return t.select("scan_id", *(v.alias(k) for k, v in extract.regex_fields(C("raw_text")).items()))


@query("ext_simple_fields", "label_text", "SELECT scan_id, " + ", ".join(f"{_first(p, g)} AS {k}" for k, (p, g) in extract.SIMPLE.items()) + " FROM label_text")
def _(t):
    return t.select("scan_id", *(v.alias(k) for k, v in extract.pattern_fields(C("raw_text"), extract.SIMPLE).items()))


@query("ext_strict_fields", "label_text", "SELECT scan_id, " + ", ".join(f"{_first(p, g, s='upper(raw_text)')} AS {k}" for k, (p, g) in extract.STRICT.items()) + " FROM label_text")
def _(t):
    return t.select("scan_id", *(v.alias(k) for k, v in extract.strict_fields(C("raw_text")).items()))


@query("ext_generic_rts", "label_text", f"SELECT scan_id, {_first('RTS-[A-Z0-9-]+', s="'RTS-BUL-' || raw_text")} AS code FROM label_text")
def _(t):
    return t.select("scan_id", tx.first_match(F.concat(F.lit("RTS-BUL-"), "raw_text"), "RTS-[A-Z0-9-]+").alias("code"))


#: Every other label has an order id of the second form.
_HEADER = "(CASE WHEN scan_id % 2 = 0 THEN raw_text ELSE replace(raw_text, 'Order ID: FE', 'Order ID: FE12') END)"


@query("ext_header", "label_text", f"SELECT scan_id, replace({_first('(FE[ ]*[0-9]{10})(?:[^0-9]|$)', 1)}, ' ', '') AS tracking_id, coalesce({_first(extract.PATTERNS['order_id'][0], flags='(?i)', s=_HEADER)}, {_first('(FE[0-9]{8}[A-Z][A-Za-z0-9_]+)', 1, flags='(?i)', s=_HEADER)}) AS order_id, {_first(extract.SORT_CODE, flags='(?i)', s=_HEADER)} AS rts_code, {_first(extract.PATTERNS['rider_id'][0], 1, flags='(?i)', s=_HEADER)} AS rider_id FROM label_text")
def _(t):
    t = t.withColumn("raw_text", F.expr(_HEADER))
    return t.select("scan_id", *(v.alias(k) for k, v in extract.header_fields(C("raw_text")).items()))


@query("ext_footer", "label_text", f"SELECT scan_id, TRY_CAST({_first('([0-9]{3,5})[ ]*g', 1, flags='(?i)')} AS INT) AS weight_g, TRY_CAST({_first('quantity:[ ]*([0-9]{1,3})', 1, flags='(?i)')} AS INT) AS quantity FROM label_text")
def _(t):
    return t.select("scan_id", *(v.alias(k) for k, v in extract.footer_fields(C("raw_text")).items()))


@query("ext_regex_fallbacks", "label_text", f"SELECT scan_id, {_first('(FE ?[0-9]{10})(?:[^0-9]|$)', 1, flags='(?i)')} AS tracking_id, upper({_first(extract.PATTERNS['order_id'][0], flags='(?i)')}) AS order_id, CASE WHEN scan_id % 2 = 0 THEN 'given' ELSE {_first(extract.SORT_CODE, flags='(?i)')} END AS rts_code, upper({_first('(?:Rider:|ID:)[ ]*([A-Z]{1,2}[0-9]{1,2})', 1, flags='(?i)')}) AS rider_id, CASE WHEN lower({_first(extract.PATTERNS['payment_type'][0], 1, flags='(?i)')}) = 'cop' THEN 'COD' ELSE {_first(extract.PATTERNS['payment_type'][0], 1, flags='(?i)')} END AS payment_type, {_first('BUYER[ ]*' + chr(10) + '([A-Z][a-z]+ [A-Z][a-z]+)', 1)} AS buyer_name FROM label_text")
def _(t):
    given = {"rts_code": F.when(C("scan_id") % 2 == 0, "given")}
    return t.select("scan_id", *(v.alias(k) for k, v in extract.fallbacks(C("raw_text"), given).items()))


@query("ext_buyer_block", "scans label_text", f"SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN 'Carlos Johnson' ELSE 'Thomas Gonzalez' END AS name, nullif(concat_ws(', ', buyer_address, {_STRAY}), '') AS address FROM scans")
def _(_scans, t):
    return extract.buyer_blocks(extract.label_lines(t, "scan_id", "raw_text"), "scan_id").select("scan_id", C("buyer_name").alias("name"), C("buyer_address").alias("address"))


@query("ext_ph_address", "label_text", "SELECT scan_id, CASE WHEN buyer_address IS NOT NULL THEN buyer_address END AS address FROM scans")
def _(t):
    return extract.addresses(t, "scan_id", "raw_text").select("scan_id", C("buyer_address").alias("address"))


@query("top_longest_brgy_line", "label_text", "WITH l AS (SELECT scan_id, unnest(string_split(raw_text, chr(10))) AS line FROM label_text) SELECT scan_id, arg_max(line, length(line)) AS line FROM l WHERE contains(lower(line), 'brgy') GROUP BY scan_id")
def _(t):
    lines = t.select("scan_id", F.posexplode(F.split("raw_text", "\n")).alias("pos", "line")).where(F.contains(F.lower("line"), F.lit("brgy")))
    return lines.groupBy("scan_id").agg(F.max_by("line", F.struct(F.length("line"), -C("pos"))).alias("line"))


_ADDR = "CASE scan_id % 3 WHEN 0 THEN '## ' || buyer_address || ' ) 1, iy' WHEN 1 THEN buyer_address ELSE ') 12, ~Lot 5  Block 2 iy 3023, x ' END"
#: With a third form that has no four-digit number, for the rule without one.
_UNCODED = "CASE scan_id % 3 WHEN 0 THEN '## ' || buyer_address || ' ) 1, iy' WHEN 1 THEN buyer_address ELSE '~Lot 5  Block 2 ,, ' END"


@query("str_clean_address", "scans", rf"WITH r AS (SELECT scan_id, regexp_replace(trim({_UNCODED}), '^[^\w\s,.-]+', '') AS t FROM scans) SELECT scan_id, CASE WHEN regexp_extract(t, '^(.*\b[0-9]{{4}}\b)', 1) <> '' THEN regexp_extract(t, '^(.*\b[0-9]{{4}}\b)', 1) ELSE regexp_replace(regexp_replace(regexp_replace(t, '[^\w\s,.-]+$', ''), '\s+', ' ', 'g'), '^[ ,.-]+|[ ,.-]+$', '', 'g') END AS address FROM r")
def _(scans):
    return scans.select("scan_id", tx.clean_address(F.expr(_UNCODED)).alias("address"))


_EXTENDED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^[\)\]\}\|]{0,2}\s*[0-9]{1,2}\s*[,\s]+', ''), '^[a-z]\s+', ''), '^[^\w\d]+', ''), '([0-9]{4})([^\w\s].*)?$', '\1'), '\b(mi|iy)\s+([0-9]{4})\b', '\2', 'g'), '\s+', ' ', 'g'))"


@query("str_clean_address_v2", "scans", rf"WITH r AS (SELECT scan_id, {_ADDR} AS t FROM scans) SELECT scan_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^[^\w\d]+', ''), '[^\w\d]+$', ''), '\bmi\s+([0-9]{{4}})\b', '\1', 'g'), '\s+', ' ', 'g')) AS address, {_EXTENDED} AS extended FROM r")
def _(scans):
    return scans.select("scan_id", tx.clean_address_short(F.expr(_ADDR)).alias("address"), tx.clean_address_extended(F.expr(_ADDR)).alias("extended"))


_NM = "CASE scan_id % 5 WHEN 0 THEN 'Carlos Johnson' WHEN 1 THEN 'Al Bo' WHEN 2 THEN 'Maria Clara Reyes' WHEN 3 THEN 'carlos Johnson' ELSE buyer_name END"


@query("str_name_valid", "scans", f"SELECT scan_id, scan_id % 5 IN (0, 2) AS valid FROM scans")  # noqa: F541
def _(scans):
    return scans.select("scan_id", tx.name_valid(F.expr(_NM)).alias("valid"))


@query("str_address_valid", "scans", r"SELECT scan_id, coalesce(length(buyer_address) >= 20 AND regexp_matches(lower(buyer_address), 'brgy|barangay') AND regexp_matches(lower(buyer_address), 'san jose del monte|sjdm') AND regexp_matches(buyer_address, '\b302[0-9]\b') AND NOT regexp_matches(lower(buyer_address), 'district|zip code'), false) AS valid FROM scans")
def _(scans):
    return scans.select("scan_id", tx.address_valid(C("buyer_address")).alias("valid"))


_REQ = {"tracking_id": "tracking_id IS NULL", "buyer_name": "buyer_name IS NULL", "buyer_address": "buyer_address IS NULL"}


@query("flt_label_valid", "scans", "SELECT scan_id, concat_ws('; ', " + ", ".join(f"CASE WHEN {v} THEN 'missing {k}' END" for k, v in _REQ.items()) + ", CASE WHEN NOT regexp_full_match(tracking_id, 'FE[0-9]{10}') THEN 'tracking pattern' END, CASE WHEN weight_g > 5000 THEN 'too heavy' END) AS errors FROM scans")
def _(scans):
    errors = [F.when(C(k).isNull(), f"missing {k}") for k in _REQ] + [F.when(~C("tracking_id").rlike(tx.TRACKING), "tracking pattern"), F.when(C("weight_g") > 5000, "too heavy")]
    return scans.select("scan_id", F.array_join(F.array_compact(F.array(*errors)), "; ").alias("errors"))


@query("agg_zone_merge", "scans", "SELECT scan_id, tracking_id, CASE WHEN scan_id % 2 = 0 THEN 'Carlos Johnson' END AS buyer_name, CASE WHEN coalesce(length(buyer_address) >= 20 AND regexp_matches(buyer_address, '\\b302[0-9]\\b'), false) THEN buyer_address END AS buyer_address, weight_g, quantity, round((confidence + 0.5) / 2, 6) AS confidence FROM scans")
def _(scans):
    none = F.lit(None)
    head = scans.select("scan_id", F.lit("header").alias("zone"), "tracking_id", none.cast("string").alias("buyer_name"), none.cast("string").alias("buyer_address"), none.cast("int").alias("weight_g"), none.cast("int").alias("quantity"), "confidence")
    buyer = scans.select("scan_id", F.lit("buyer").alias("zone"), none.cast("string").alias("tracking_id"), F.when(C("scan_id") % 2 == 0, "Carlos Johnson").otherwise("Al B").alias("buyer_name"), "buyer_address", none.cast("int").alias("weight_g"), none.cast("int").alias("quantity"), F.lit(0.5).alias("confidence"))
    foot = scans.select("scan_id", F.lit("footer").alias("zone"), none.cast("string").alias("tracking_id"), none.cast("string").alias("buyer_name"), none.cast("string").alias("buyer_address"), "weight_g", "quantity", none.cast("double").alias("confidence"))
    return extract.merged_zones(head.unionByName(buyer).unionByName(foot), "scan_id")


_CODE = _first(extract.SIMPLE["rts_code_label"][0], 1)
_CODE2 = _first(extract.SIMPLE["rts_code_pattern"][0], 1)
_FOUND = " + ".join(f"CASE WHEN {_first(*extract.SIMPLE[k])} IS NOT NULL THEN 1 ELSE 0 END" for k in ("tracking_number", "ph_number", "order_id"))


def _points(source: str, columns: str, more: str = "") -> str:
    return f"WITH r AS (SELECT scan_id, {_FOUND} AS n, upper(coalesce({_CODE}, {_CODE2})) AS t FROM {source}), m AS (SELECT t, word FROM (SELECT DISTINCT t FROM r), {_SORT} WHERE levenshtein(t, word) <= 5 QUALIFY row_number() OVER (PARTITION BY t ORDER BY levenshtein(t, word), pos) = 1) SELECT scan_id, {columns}(n + CASE WHEN word IS NULL THEN 0 ELSE 3 END) || '/7' AS confidence, CASE WHEN word IS NULL THEN 'Extraction Failed' ELSE 'RTS Code Corrected, Address Inferred from RTS' END AS status FROM r LEFT JOIN m USING (t){more}"


_B, _D = (_first(extract.STRICT[k][0], extract.STRICT[k][1]) for k in ("barangay", "district"))
_LIKE = "(1 - levenshtein(upper(b), upper(barangay)) / greatest(length(b), length(barangay)) + 1 - levenshtein(upper(d), upper(district)) / greatest(length(d), length(district))) / 2"
_LARGER = f"WITH a AS (SELECT scan_id, {_FOUND} AS n, {_B} AS b, {_D} AS d FROM label_text), c AS ({_points('label_text', 'word, ')}), j AS (SELECT scan_id, n, word, c.confidence, c.status, {_LIKE} AS likeness FROM c JOIN a USING (scan_id) LEFT JOIN {_EXPECT} ON code = word) SELECT scan_id, confidence, status, (n + CASE WHEN word IS NULL THEN 0 WHEN likeness > 0.7 THEN 5 ELSE 3 END) || '/7' AS larger, CASE WHEN word IS NULL THEN 'Extraction Failed' WHEN likeness > 0.7 THEN 'RTS Code Corrected, Address Validated' WHEN likeness IS NOT NULL THEN 'RTS Code Corrected, Address Corrected by RTS' ELSE 'RTS Code Corrected, Address Inferred from RTS' END AS larger_status FROM j"


@query("math_conf7", "label_text", _LARGER)
def _(t):
    """The score of the simple reader, and the larger form that weighs the address too."""
    text = C("raw_text")
    fields = extract.pattern_fields(text, extract.SIMPLE) | {f"x_{k}": tx.first_match(text, *extract.STRICT[k]) for k in ("barangay", "district")}
    rows = t.select("scan_id", *(v.alias(k) for k, v in fields.items())).withColumn("t", F.upper(F.coalesce("rts_code_label", "rts_code_pattern")))
    rows = match.nearest_edit(rows, "t", dic.sort_codes(t.sparkSession), 5)
    known = match.small(dic.districts(t.sparkSession).select(C("sort_code").alias("matched"), C("barangay").alias("e_barangay"), C("district").alias("e_district")))
    rows = rows.join(known, "matched", "left")
    likeness = extract.address_likeness(C("x_barangay"), C("x_district"), C("e_barangay"), C("e_district"))
    (points, status), (larger, told) = (extract.confidence_points({k: C(k) for k in fields}, C("matched"), x) for x in (None, likeness))
    return rows.select("scan_id", points.alias("confidence"), status.alias("status"), larger.alias("larger"), told.alias("larger_status"))


@query("pipe_reconcile_labels", "label_text", _points(f"(SELECT scan_id, {_chain('raw_text')} AS raw_text FROM label_text)", "word AS rts_code, barangay, district, ", f" LEFT JOIN {_EXPECT} ON code = word"))
def _(t):
    """Typo fixes, extraction, code matching, address and score in one plan."""
    fields = extract.pattern_fields(tx.typos_fixed(C("raw_text"), dic.TYPOS), extract.SIMPLE)
    rows = t.select("scan_id", *(v.alias(k) for k, v in fields.items())).withColumn("t", F.upper(F.coalesce("rts_code_label", "rts_code_pattern")))
    rows = match.nearest_edit(rows, "t", dic.sort_codes(t.sparkSession), 5)
    points, status = extract.confidence_points({k: C(k) for k in fields}, C("matched"))
    known = match.small(dic.districts(t.sparkSession).select(C("sort_code").alias("matched"), C("barangay").alias("b"), C("district").alias("d")))
    return rows.join(known, "matched", "left").select("scan_id", C("matched").alias("rts_code"), C("b").alias("barangay"), C("d").alias("district"), points.alias("confidence"), status.alias("status"))


def corrected(rows):
    """Address cleaned, barangay and its district, tracking and phone number, rider and sort code
    corrected, quantity derived, payment normalised; only of the columns that the rows have."""
    spark, has = rows.sparkSession, set(rows.columns)
    fixed = {}
    for column, pattern in (("tracking_id", tx.TRACKING), ("ph_number", tx.PHONE)):
        if column in has:
            value, ok = tx.validated(C(column), pattern)
            fixed[column] = F.when(ok, value).otherwise(C(column))
    rows = rows.withColumns(fixed | {"buyer_address": tx.clean_address(C("buyer_address")), "payment_type": F.when(F.lower("payment_type") == "cop", "COD").otherwise(C("payment_type"))})
    matchers = [(lambda x: match.first_ratio(x, "rider_id", dic.riders(spark)), "rider_id"), (lambda x: match.first_ratio(x, "rts_code", dic.sort_codes(spark)), "rts_code")]
    if {"barangay", "district"} <= has:
        matchers += [(lambda x: match.best_ratio(x, "barangay", dic.barangays(spark)), "barangay"), (lambda x: match.best_ratio(x, "district", dic.districts(spark).withColumnRenamed("district", "word"), keys=("barangay",)), "district")]
    for matched, column in matchers:
        rows = matched(rows).withColumn(column, F.coalesce("matched", column)).drop("matched")
    return rows.withColumn("quantity", F.coalesce("quantity", F.greatest(F.lit(1), F.floor(C("weight_g") / 500).cast("int"))))


def scan_fields(t):
    """Fields of label text by the label patterns, looser ones for gaps, the buyer block, and what
    other lines give where that has none.

    The fields are written once as a narrow table: matching reads them for the distinct
    texts and to join back, and must not extract them again.
    """
    spark, text = t.sparkSession, C("raw_text")
    fields = extract.regex_fields(text)
    loose = extract.fallbacks(text, fields)
    blocks = extract.buyer_blocks(extract.label_lines(t, "scan_id", "raw_text"), "scan_id").withColumnRenamed("buyer_name", "block_name").withColumnRenamed("buyer_address", "block_address")
    rows = t.join(blocks, "scan_id", "left")
    fields = fields | loose | {"buyer_name": C("block_name"), "loose_name": loose["buyer_name"], "buyer_address": F.coalesce("block_address", extract.whole_address(text))}
    rest = F.when(fields["buyer_name"].isNull() | fields["buyer_address"].isNull(), text)
    rows = files.written(rows.select("scan_id", "confidence", "engine", *(v.alias(k) for k, v in fields.items()), rest.alias("rest")), work_folder(spark))
    lines = extract.label_lines(rows.where("rest IS NOT NULL"), "scan_id", "rest")
    near = extract.near_addresses(lines, "scan_id").withColumnRenamed("buyer_address", "near")
    rows = rows.join(near, "scan_id", "left").join(extract.name_lines(lines, "scan_id"), "scan_id", "left")
    return rows.withColumns({"buyer_name": F.coalesce("buyer_name", "name", "loose_name"), "buyer_address": F.coalesce("buyer_address", "near")}).drop("name", "loose_name", "near", "rest")


_PH = "CASE WHEN scan_id % 3 = 0 THEN 'FE ' || lpad(CAST(scan_id AS STRING), 12, 'O') WHEN scan_id % 3 = 1 THEN 'FE ' || lpad(CAST(scan_id AS STRING), 12, '0') ELSE 'none' END"
_NOISY = f"SELECT s.scan_id, {_T} AS tracking_id, {_PH} AS ph_number, {_R_TEXT} AS rider_id, {_S_TEXT} AS rts_code, barangay_text AS barangay, {_D_TEXT} AS district, '##' || buyer_address AS buyer_address, payment_type, weight_g, quantity FROM scans s JOIN places p ON p.scan_id = s.scan_id".replace("scan_id %", "s.scan_id %").replace("CAST(scan_id", "CAST(s.scan_id")
_FIXED = lambda t, p: f"CASE WHEN NOT regexp_full_match({t}, '{p}') AND regexp_full_match({_FIX.format(s=t)}, '{p}') THEN {_FIX.format(s=t)} ELSE {t} END"


@query("pipe_correct_fields", "scans places", f"SELECT n.scan_id, {_FIXED('n.tracking_id', 'FE[0-9]{10}')} AS tracking_id, {_FIXED('n.ph_number', 'FE [0-9]{12}')} AS ph_number, r.code AS rider_id, c.code AS rts_code, b.barangay, d.district, substr(n.buyer_address, 3) AS buyer_address, CASE WHEN payment_type = 'cop' THEN 'COD' ELSE payment_type END AS payment_type, coalesce(quantity, greatest(1, weight_g // 500)) AS quantity FROM ({_NOISY}) n JOIN ({_first_code(_RIDERS, f'SELECT scan_id, {_R_TEXT} AS t FROM scans')}) r USING (scan_id) JOIN ({_first_code(_SORT, f'SELECT scan_id, {_S_TEXT} AS t FROM scans')}) c USING (scan_id) JOIN ({_BARANGAY}) b USING (scan_id) JOIN ({_district(f'SELECT scan_id, barangay AS brgy, {_D_TEXT} AS t FROM ({_BARANGAY})')}) d USING (scan_id)")
def _(scans, places):
    """Every field with an error of its kind, corrected."""
    rows = scans.join(places, "scan_id").select(
        "scan_id", F.expr(_T).alias("tracking_id"), F.expr(_PH).alias("ph_number"), F.expr(_R_TEXT).alias("rider_id"), F.expr(_S_TEXT).alias("rts_code"), C("barangay_text").alias("barangay"),
        F.expr(_D_TEXT).alias("district"), F.concat(F.lit("##"), "buyer_address").alias("buyer_address"), "payment_type", "weight_g", "quantity",
    )
    return corrected(rows).drop("weight_g")


_OWN_STRAY = _STRAY.replace("quantity IN", "s.quantity IN").replace("|| quantity", "|| s.quantity").replace("weight_g =", "s.weight_g =")
_RIDER = _first_code(_RIDERS, f"SELECT scan_id, coalesce({_first(extract.PATTERNS['rider_id'][0], 1, flags='(?i)')}, upper({_first('(?:Rider:|ID:)[ ]*([A-Z]{1,2}[0-9]{1,2})', 1, flags='(?i)')})) AS t FROM label_text")


@query("pipe_scan_record", "label_text order_truth", f"SELECT s.scan_id, s.tracking_id, s.order_id, 'FEX-BUL-SJDM-MZN' || (s.scan_id % 4 + 1) || '-GY0' || (s.scan_id % 4 + 1) AS rts_code, coalesce(r.code, o.rider) AS rider_id, CASE WHEN s.scan_id % 3 = 0 THEN 'Carlos Johnson' ELSE 'Thomas Gonzalez' END AS buyer_name, coalesce(o.address, s.buyer_address, {_OWN_STRAY}) AS buyer_address, coalesce(TRY_CAST(replace(o.weight, 'g', '') AS INT), s.weight_g) AS weight_g, coalesce(TRY_CAST(o.quantity AS INT), s.quantity, greatest(1, s.weight_g // 500)) AS quantity, CASE WHEN s.payment_type = 'cop' THEN 'COD' ELSE s.payment_type END AS payment_type, s.confidence, CASE WHEN o.tracking_id IS NOT NULL THEN false WHEN s.confidence < 0.7 THEN true ELSE coalesce(s.buyer_address, {_OWN_STRAY}) IS NULL END AS needs_review FROM scans s LEFT JOIN order_truth o USING (tracking_id) JOIN ({_RIDER}) r USING (scan_id)")
def _(t, orders):
    """Label text to reviewed record: fields, corrections, order enrichment, review flag."""
    rows = corrected(scan_fields(t))
    names = rows.select("buyer_name").where("buyer_name IS NOT NULL").distinct()
    rows = rows.join(match.name_score(names, "buyer_name", "buyer_name", dic.names(t.sparkSession)), "buyer_name", "left")
    done = enriched(rows, orders, keep_name=C("score") >= 0.8)
    return done.withColumn("needs_review", store.needs_review(C("order_found"))).select("scan_id", "tracking_id", "order_id", "rts_code", "rider_id", "buyer_name", "buyer_address", "weight_g", "quantity", "payment_type", "confidence", "needs_review")
