"""Queries of similarity and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import match
from ..sources import dictionaries as dic
from .catalog import query

C = F.col


def _values(items, names: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, x)) + ")" for x in items) + f") AS {names}"


#: The longest common subsequence by the textbook table, one row a cell, over distinct pairs p(a, b).
_LCS = """cells(a, b, i, line) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM p
  UNION ALL
  SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc,
      CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS INT), 1) THEN line[CAST(j AS INT)] + 1 ELSE greatest(acc[-1], line[CAST(j AS INT) + 1]) END), [0])
  FROM cells WHERE i < length(a)),
lcs AS (SELECT a, b, line[-1] AS n FROM cells WHERE i = length(a))"""
_BRGY = _values([(i, b) for i, b in enumerate(dic.barangay_names())], "d(pos, word)")
_RIDERS = _values(list(enumerate(sorted(r[4] for r in dic.district_rows()))), "d(pos, word)")
_SORT = _values([(r[0], r[3]) for r in dic.district_rows()], "d(pos, word)")
_DIST = _values([r[:3] for r in dic.district_rows()], "d(pos, barangay, district)")
_FIX = f"translate({{s}}, '{tx.CONFUSED}', '{tx.DIGITS}')"


@query("sim_levenshtein", "places", f"SELECT DISTINCT barangay_text, word, levenshtein(barangay_text, word) AS d FROM places, {_BRGY}")
def _(places):
    return places.select("barangay_text").distinct().join(match.small(dic.barangays(places.sparkSession)), F.lit(True)).select("barangay_text", "word", F.levenshtein("barangay_text", "word").alias("d"))


@query("sim_lev_similarity", "places", f"SELECT DISTINCT barangay_text, word, round(1 - levenshtein(barangay_text, word) / greatest(length(barangay_text), length(word)), 6) AS s FROM places, {_BRGY}")
def _(places):
    pairs = places.select("barangay_text").distinct().join(match.small(dic.barangays(places.sparkSession)), F.lit(True))
    return pairs.select("barangay_text", "word", F.round(sim.edit_similarity(C("barangay_text"), C("word")), 6).alias("s"))


@query("sim_ratio", "places", f"WITH RECURSIVE p AS (SELECT DISTINCT lower(barangay_text) AS a, lower(word) AS b FROM places, {_BRGY}), {_LCS} SELECT a, b, round(200.0 * n / (length(a) + length(b)), 6) AS s FROM lcs")
def _(places):
    pairs = places.select(F.lower("barangay_text").alias("a")).distinct().join(match.small(dic.barangays(places.sparkSession).select(F.lower("word").alias("b"))), F.lit(True))
    return pairs.select("a", "b", F.round(sim.ratio(C("a"), C("b")), 6).alias("s"))


@query("sim_partial_ratio", "places", f"WITH RECURSIVE q AS (SELECT DISTINCT lower(barangay_text) AS x, lower(word) AS y FROM places, {_BRGY}), o AS (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM q), w AS (SELECT x, y, s AS a, unnest(list_transform(range(1 - length(s), length(l)), lambda i: substr(l, CAST(greatest(i, 0) AS INT) + 1, CAST(least(i + length(s), length(l)) - greatest(i, 0) AS INT)))) AS b FROM o), p AS (SELECT DISTINCT a, b FROM w), {_LCS} SELECT x, y, round(max(200.0 * n / (length(a) + length(b))), 6) AS s FROM w JOIN lcs USING (a, b) GROUP BY x, y")
def _(places):
    pairs = places.select(F.lower("barangay_text").alias("x")).distinct().join(match.small(dic.barangays(places.sparkSession).select(F.lower("word").alias("y"))), F.lit(True))
    return pairs.select("x", "y", F.round(sim.partial_ratio(C("x"), C("y")), 6).alias("s"))


@query("sim_difflib", "places", None)
def _(places):
    pairs = places.select("barangay_text").distinct().join(match.small(dic.barangays(places.sparkSession)), F.lit(True))
    return pairs.select("barangay_text", "word", F.round(sim.matching_blocks_ratio("barangay_text", "word"), 6).alias("s"))


@query("udf_difflib_ratio_job", "places", None)
def _(places):
    pairs = places.select("barangay_text").distinct().join(match.small(dic.barangays(places.sparkSession)), F.lit(True))
    hits = pairs.where(sim.matching_blocks_ratio(F.lower("barangay_text"), F.lower("word")) >= 0.8)
    first = hits.groupBy("barangay_text").agg(F.min_by("word", "pos").alias("matched"))
    return places.join(first, "barangay_text", "left").select("scan_id", "barangay_text", "matched")


def _best(least: int, extra: str = "") -> str:
    return f"s AS (SELECT t, d.word, d.pos, 200.0 * n / (length(lower(t)) + length(lower(d.word))) AS score FROM x JOIN {_BRGY} ON true JOIN lcs ON a = lower(t) AND b = lower(d.word)), m AS (SELECT t, word FROM s WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, pos) = 1)"


_BARANGAY = f"WITH RECURSIVE x AS (SELECT DISTINCT barangay_text AS t FROM places), p AS (SELECT DISTINCT lower(t) AS a, lower(word) AS b FROM x, {_BRGY}), {_LCS}, {_best(80)} SELECT scan_id, coalesce(word, barangay_text) AS barangay FROM places LEFT JOIN m ON t = barangay_text"


@query("join_fuzzy_barangay", "places", _BARANGAY)
def _(places):
    found = match.best_ratio(places, "barangay_text", dic.barangays(places.sparkSession))
    return found.select("scan_id", F.coalesce("matched", "barangay_text").alias("barangay"))


_D_TEXT = "CASE scan_id % 4 WHEN 0 THEN 'Nort' WHEN 1 THEN 'Souht' WHEN 2 THEN 'Centrai' ELSE 'Subdivison' END"


def _district(source: str) -> str:
    """The best district of its barangay for rows ``scan_id, brgy, t``."""
    return f"WITH RECURSIVE r AS ({source}), p AS (SELECT DISTINCT lower(t) AS a, lower(district) AS b FROM r, {_DIST}), {_LCS}, s AS (SELECT DISTINCT brgy, t, district, pos, 200.0 * n / (length(a) + length(b)) AS score FROM r JOIN {_DIST} ON barangay = brgy JOIN lcs ON a = lower(t) AND b = lower(district)), m AS (SELECT brgy, t, district FROM s WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY brgy, t ORDER BY score DESC, pos) = 1) SELECT scan_id, coalesce(district, t) AS district FROM r LEFT JOIN m USING (brgy, t)"


@query("join_fuzzy_district", "places", _district(f"SELECT scan_id, CASE WHEN scan_id % 2 = 0 THEN 'Muzon' ELSE 'Tungko' END AS brgy, {_D_TEXT} AS t FROM places"))
def _(places):
    rows = places.select("scan_id", F.when(C("scan_id") % 2 == 0, "Muzon").otherwise("Tungko").alias("barangay"), F.expr(_D_TEXT).alias("t"))
    found = match.best_ratio(rows, "t", dic.districts(places.sparkSession).withColumnRenamed("district", "word"), keys=("barangay",))
    return found.select("scan_id", F.coalesce("matched", "t").alias("district"))


def _first(values: str, source: str) -> str:
    clean = "upper(trim(" + _FIX.format(s="t") + "))"
    return f"WITH RECURSIVE r AS ({source}), x AS (SELECT DISTINCT t, {clean} AS c FROM r), p AS (SELECT DISTINCT c AS a, word AS b FROM x, {values}), {_LCS}, s AS (SELECT t, word, pos, c = word AS exact, 200.0 * n / (length(a) + length(b)) AS score FROM x JOIN {values} ON true JOIN lcs ON a = c AND b = word), m AS (SELECT t, word FROM s WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY t ORDER BY exact DESC, pos) = 1) SELECT scan_id, coalesce(word, t) AS code FROM r LEFT JOIN m USING (t)"


_R_TEXT = "CASE scan_id % 5 WHEN 0 THEN translate(rider_id, '01', 'Ol') WHEN 1 THEN lower(rider_id) WHEN 2 THEN rider_id || 'X' ELSE rider_id END"


@query("join_fuzzy_rider", "scans", _first(_RIDERS, f"SELECT scan_id, {_R_TEXT} AS t FROM scans"))
def _(scans):
    rows = scans.select("scan_id", F.expr(_R_TEXT).alias("t"))
    return match.first_ratio(rows, "t", dic.riders(scans.sparkSession)).select("scan_id", F.coalesce("matched", "t").alias("code"))


_S_TEXT = "'FEX-BUL-SJDM-MZN' || CAST(scan_id % 6 AS STRING) || '-GYO' || CAST(scan_id % 5 AS STRING)"


@query("join_fuzzy_sort", "scans", _first(_SORT, f"SELECT scan_id, {_S_TEXT} AS t FROM scans"))
def _(scans):
    rows = scans.select("scan_id", F.expr(_S_TEXT).alias("t"))
    return match.first_ratio(rows, "t", dic.sort_codes(scans.sparkSession)).select("scan_id", F.coalesce("matched", "t").alias("code"))


@query("join_code_best", "scans", f"WITH RECURSIVE r AS (SELECT scan_id, {_S_TEXT} AS t FROM scans), x AS (SELECT DISTINCT t, upper(trim(t)) AS c, upper({_FIX.format(s='upper(trim(t))')}) AS f FROM r), p AS (SELECT DISTINCT f AS a, word AS b FROM x, {_SORT}), {_LCS}, s AS (SELECT t, word, CASE WHEN c = word THEN 2 WHEN f = word THEN 1 ELSE 0 END AS rank, 200.0 * n / (length(a) + length(b)) AS score FROM x JOIN {_SORT} ON true JOIN lcs ON a = f AND b = word), m AS (SELECT t, word FROM s WHERE rank > 0 OR score >= 80 QUALIFY row_number() OVER (PARTITION BY t ORDER BY rank DESC, score DESC, word) = 1) SELECT scan_id, word AS code FROM r LEFT JOIN m USING (t)")
def _(scans):
    rows = scans.select("scan_id", F.expr(_S_TEXT).alias("t"))
    return match.best_code(rows, "t", dic.sort_codes(scans.sparkSession)).select("scan_id", C("matched").alias("code"))


def _edit(most: int, order: str) -> str:
    return f"WITH r AS (SELECT scan_id, {_S_TEXT} AS t FROM scans), x AS (SELECT DISTINCT t FROM r), s AS (SELECT t, word, pos, levenshtein(upper(trim(t)), word) AS d FROM x, {_SORT}), m AS (SELECT t, word FROM s WHERE d <= {most} QUALIFY row_number() OVER (PARTITION BY t ORDER BY {order}) = 1) SELECT scan_id, word AS code FROM r LEFT JOIN m USING (t)"


@query("join_rts_lev5", "scans", _edit(5, "d, pos"))
def _(scans):
    rows = scans.select("scan_id", F.expr(_S_TEXT).alias("t"))
    return match.nearest_edit(rows, "t", dic.sort_codes(scans.sparkSession), 5).select("scan_id", C("matched").alias("code"))


@query("join_rts_lev8", "scans", _edit(8, "d > 0, d > 2, CASE WHEN d > 2 THEN d ELSE 0 END, pos"))
def _(scans):
    rows = scans.select("scan_id", F.expr(_S_TEXT).alias("t"))
    return match.nearest_edit(rows, "t", dic.sort_codes(scans.sparkSession), 8, stop=2).select("scan_id", C("matched").alias("code"))


_VAR = _values([(i, v, c) for i, (v, c) in enumerate(dic.BARANGAY_VARIATIONS.items())], "d(pos, variation, canonical)")


@query("join_variation_match", "places", f"WITH x AS (SELECT DISTINCT barangay_text AS t, upper(trim(barangay_text)) AS c FROM places), s AS (SELECT t, canonical, pos, 1 - levenshtein(c, variation) / greatest(length(c), length(variation)) AS score FROM x, {_VAR}), m AS (SELECT t, canonical FROM s WHERE score > 0.7 QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, pos) = 1) SELECT scan_id, canonical FROM places LEFT JOIN m ON t = barangay_text")
def _(places):
    return match.best_variation(places, "barangay_text", dic.variations(places.sparkSession)).select("scan_id", C("matched").alias("canonical"))


@query("join_rts_address", "scans", f"WITH r AS (SELECT scan_id, 'FEX-BUL-SJDM-MZN' || (scan_id % 6) || '-GY0' || (scan_id % 6) AS code FROM scans), d AS (SELECT * FROM {_values([r[1:4] for r in dic.district_rows()], 'v(barangay, district, code)')}) SELECT scan_id, barangay, district FROM r LEFT JOIN d USING (code)")
def _(scans):
    n = (C("scan_id") % 6).cast("string")
    rows = scans.select("scan_id", F.concat(F.lit("FEX-BUL-SJDM-MZN"), n, F.lit("-GY0"), n).alias("sort_code"))
    return rows.join(match.small(dic.districts(scans.sparkSession)), "sort_code", "left").select("scan_id", "barangay", "district")


@query("join_sort_code", "places", f"WITH d AS (SELECT * FROM {_values([r[1:4] for r in dic.district_rows()], 'v(barangay, district, code)')}), r AS (SELECT scan_id, CASE WHEN scan_id % 2 = 0 THEN 'Muzon' ELSE 'Nowhere' END AS barangay, 'North' AS district FROM places) SELECT scan_id, coalesce(code, 'FEX-UNKNOWN') AS code FROM r LEFT JOIN d USING (barangay, district)")
def _(places):
    rows = places.select("scan_id", F.when(C("scan_id") % 2 == 0, "Muzon").otherwise("Nowhere").alias("barangay"), F.lit("North").alias("district"))
    return rows.join(match.small(dic.districts(places.sparkSession)), ["barangay", "district"], "left").select("scan_id", F.coalesce("sort_code", F.lit("FEX-UNKNOWN")).alias("code"))


@query("join_rts_infer", "places", f"WITH a AS (SELECT * FROM {_values(dic.AREA_CODES, 'v(barangay, district, code)')}), r AS (SELECT scan_id, CASE scan_id % 3 WHEN 0 THEN 'Muzon' WHEN 1 THEN 'Norzagaray' ELSE 'Elsewhere' END AS barangay, 'near NORTH gate' AS note FROM places) SELECT scan_id, code FROM r LEFT JOIN a ON r.barangay = a.barangay AND (a.district IS NULL OR contains(lower(note), lower(a.district)))")
def _(places):
    areas = places.sparkSession.createDataFrame(dic.AREA_CODES, "barangay string, district string, code string")
    rows = places.select("scan_id", F.when(C("scan_id") % 3 == 0, "Muzon").when(C("scan_id") % 3 == 1, "Norzagaray").otherwise("Elsewhere").alias("b"), F.lit("near NORTH gate").alias("note"))
    named = (C("b") == C("barangay")) & (C("district").isNull() | F.contains(F.lower("note"), F.lower("district")))
    return rows.join(match.small(areas), named, "left").select("scan_id", "code")


_EXPECT = _values([r[1:4] for r in dic.district_rows()], "e(barangay, district, code)")


@query("join_address_confidence", "places", f"WITH r AS (SELECT scan_id, barangay_text AS b, {_D_TEXT} AS t, 'FEX-BUL-SJDM-MZN1-GY01' AS code FROM places) SELECT scan_id, round(((1 - levenshtein(upper(b), upper(barangay)) / greatest(length(b), length(barangay))) + (1 - levenshtein(upper(t), upper(district)) / greatest(length(t), length(district)))) / 2, 6) AS confidence FROM r JOIN {_EXPECT} USING (code)")
def _(places):
    rows = places.select("scan_id", C("barangay_text").alias("b"), F.expr(_D_TEXT).alias("t"), F.lit("FEX-BUL-SJDM-MZN1-GY01").alias("sort_code")).join(match.small(dic.districts(places.sparkSession)), "sort_code")
    mean = (sim.edit_similarity(F.upper("b"), F.upper("barangay")) + sim.edit_similarity(F.upper("t"), F.upper("district"))) / 2
    return rows.select("scan_id", F.round(mean, 6).alias("confidence"))


@query("join_keyword_score", "label_text", f"WITH w AS (SELECT scan_id, unnest(list_distinct(regexp_split_to_array(upper(raw_text), '[\\s:-]+'))) AS w FROM label_text), c AS (SELECT pos, word, unnest(string_split(word, '-')) AS part, unnest(range(5)) AS i FROM {_values(list(enumerate(dic.KEYWORD_CODES)), 'k(pos, word)')}), h AS (SELECT DISTINCT w, word, pos, i FROM (SELECT DISTINCT w FROM w), c WHERE levenshtein(part, w) <= 2), s AS (SELECT scan_id, word, pos, count(DISTINCT i) AS score FROM w JOIN h USING (w) GROUP BY ALL) SELECT scan_id, word AS top_code, score AS top_score, CASE WHEN score >= 3 THEN word END AS code FROM s QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, pos) = 1")
def _(t):
    return match.keyword_scores(t, "scan_id", "raw_text", dic.words(t.sparkSession, dic.KEYWORD_CODES))


_NAMES = _values([(n,) for n in dic.FIRST_NAMES + dic.LAST_NAMES], "n(word)")
_LINE = "CASE scan_id % 4 WHEN 0 THEN 'Carlos Johnson' WHEN 1 THEN 'Carlo Jonson' WHEN 2 THEN 'Tomas 123' ELSE buyer_name END"


@query("str_name_score", "scans", f"WITH RECURSIVE r AS (SELECT scan_id, {_LINE} AS line FROM scans), t AS (SELECT scan_id, lower(regexp_replace(unnest(regexp_split_to_array(line, '\\s+')), '[^A-Za-z0-9_]', '', 'g')) AS t FROM r), x AS (SELECT DISTINCT t FROM t WHERE t <> '' AND t NOT LIKE '%000%'), p AS (SELECT DISTINCT t AS a, lower(word) AS b FROM x, {_NAMES} WHERE abs(length(t) - length(word)) <= 4), {_LCS}, h AS (SELECT DISTINCT a FROM lcs WHERE 200.0 * n / (length(a) + length(b)) >= 85) SELECT scan_id, round(avg(CASE WHEN a IS NULL THEN 0 ELSE 1 END), 6) AS score FROM t LEFT JOIN h ON a = t GROUP BY scan_id")
def _(scans):
    rows = scans.select("scan_id", F.expr(_LINE).alias("line"))
    return match.name_score(rows, "scan_id", "line", dic.names(scans.sparkSession)).select("scan_id", F.round("score", 6).alias("score"))
