"""Golden values and properties of the rules."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sortlane.functions import similarity as sim
from sortlane.functions import text as tx
from sortlane.operators import candidates, extract, lidar, match, store
from sortlane.sources import dictionaries as dic
from sortlane.sources.files import read_orders
from sortlane.sources.generator import labels, permuted
from sortlane.sources.versioned import VersionedTable


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        line = _next(line, x, b)
    return line[-1]


def _next(line, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(line[j] + 1 if x == y else max(out[-1], line[j + 1]))
    return out


def test_ratio_equals_the_table(spark):
    random.seed(1)
    words = ["muzon", "north", "kitten", "gy02", ""] + ["".join(random.choice("abcde") for _ in range(random.randint(1, 60))) for _ in range(40)]
    pairs = [(a, b) for a in words[:25] for b in words[15:] if a or b]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.ratio(F.col("a"), F.col("b")).alias("r"), sim.ratio(F.col("b"), F.col("a")).alias("s"), sim.may_reach(F.col("a"), F.col("b"), 80.0).alias("m")).collect()
    for r in rows:
        want = 200 * lcs(r.a, r.b) / (len(r.a) + len(r.b))
        assert r.r == pytest.approx(want) and r.s == pytest.approx(want)
        assert r.m or want < 80


def test_golden_ratios(spark):
    rows = spark.createDataFrame([("muzonn", "muzon"), ("nort", "north"), ("gy01", "gy02"), ("kitten", "sitting")], "a string, b string")
    assert [round(r[0], 6) for r in rows.select(sim.ratio(F.col("a"), F.col("b"))).collect()] == [90.909091, 88.888889, 75.0, 61.538462]


def test_matching_blocks(spark):
    row = spark.createDataFrame([("bulacan", "bulakan")], "a string, b string").select(sim.matching_blocks_ratio("a", "b")).first()
    assert row[0] == pytest.approx(SequenceMatcher(None, "bulacan", "bulakan").ratio())


def test_corrections(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.fix_digits(F.lit("FE12345678Olo|ZSB"))) == "FE123456780101258"
    value, ok = tx.validated(F.lit("FE123456789O"), tx.TRACKING)
    assert (one(value), one(ok)) == ("FE1234567890", True)
    value, ok = tx.validated(F.lit("FE12345678"), tx.TRACKING)
    assert (one(value), one(ok)) == ("FE12345678", False)
    assert one(tx.clean_address(F.lit("123 Main St, Brgy. Muzon, SJDM, Bulacan 3023 ) 1, iy"))) == "123 Main St, Brgy. Muzon, SJDM, Bulacan 3023"


def test_dictionary_matches(spark):
    texts = spark.createDataFrame([("Muzonn",), ("Nowhere at all",), (None,)], "t string")
    assert {r.t: r.matched for r in match.best_ratio(texts, "t", dic.barangays(spark)).collect()} == {"Muzonn": "Muzon", "Nowhere at all": None, None: None}
    codes = spark.createDataFrame([("GY0l",), ("FEX-BUL-SJDM-MZN1-GY0l",)], "t string")
    assert {r.t: r.matched for r in match.first_ratio(codes, "t", dic.riders(spark)).collect()}["GY0l"] == "GY01"
    assert {r.t: r.matched for r in match.first_ratio(codes, "t", dic.sort_codes(spark)).collect()}["FEX-BUL-SJDM-MZN1-GY0l"] == "FEX-BUL-SJDM-MZN1-GY01"


def test_angles(spark):
    rows = spark.createDataFrame([(180.0, -180.0), (190.0, -170.0), (-190.5, 169.5), (0.0, 0.0)], "a double, want double")
    for r in rows.select(lidar.norm_angle(F.col("a")).alias("n"), lidar.norm_angle(lidar.norm_angle(F.col("a"))).alias("nn"), "want").collect():
        assert r.n == r.want == r.nn


def test_mask(spark):
    points = spark.createDataFrame([(1, 0.0, 200.0), (2, 0.0, 900.0), (3, 90.0, 50.0), (4, 10.0, 0.0)], "point_id int, angle double, distance double")
    mask = spark.createDataFrame([("front", -30.0, 30.0, 280.0)], "name string, angle_min double, angle_max double, min_distance_mm double")
    assert sorted(r.point_id for r in lidar.body_masked(points, mask).collect()) == [2, 3]
    assert lidar.body_masked(points, mask.limit(0)).count() == 4


def test_orders(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a.jpg": {"tracking_id": "FE1", "weight": "5g"}, "b.jpg": {"weight": "1g"}, "c.jpg": {"tracking_id": "FE1", "weight": "7g"}}')
    assert [(r.tracking_id, r.weight, r.image) for r in read_orders(spark, str(tmp_path / "o.json")).collect()] == [("FE1", "7g", "c.jpg")]


def test_masks_of_many_sectors(spark):
    points = spark.createDataFrame([(1, 0.0, 200.0)], "point_id int, angle double, distance double")
    mask = spark.createDataFrame([(f"s{i}", float(i), float(i + 1), 280.0) for i in range(11)], "name string, angle_min double, angle_max double, min_distance_mm double")
    with pytest.raises(ValueError):
        lidar.body_masked(points, mask)
    both = mask.withColumn("robot", F.lit(1)).unionByName(mask.limit(10).withColumn("robot", F.lit(2))).unionByName(spark.createDataFrame([("", 0.0, 1.0, 1.0, 3)], "name string, angle_min double, angle_max double, min_distance_mm double, robot int"))
    assert {r.robot: r.mask_valid for r in lidar.checked_masks(both, "robot").collect()} == {1: False, 2: True, 3: False}


LABEL = """FLASH EXPRESS
Buyer
COD
Carlos Johnson
zzz www
Muzon North
nothing here
Brgy. Tungko
Zip Code 3023
Brgy. Behind"""


def test_buyer_blocks(spark):
    rows = spark.createDataFrame([(1, LABEL), (2, "Buyer\n12\nDistrict Name\nab"), (3, None), (4, "no buyer\nCarlos Johnson"), (5, "x\nBUYER\nAl Bo")], "k int, t string")
    got = {r.k: (r.buyer_name, r.buyer_address) for r in extract.buyer_blocks(extract.label_lines(rows, "k", "t"), "k").collect()}
    assert got == {1: ("Carlos Johnson", "Muzon North, Brgy. Tungko"), 5: ("Al Bo", None)}


def zones(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r.name, r.address) for r in extract.buyer_zones(extract.label_lines(rows, "k", "t"), "k").collect()}
    return [got.get(i) for i in range(len(texts))]


def test_buyer_zones_without_two_plain_words(spark):
    """A name of other capitalised words counts if no line has two plain ones; a tag behind it goes."""
    want = {
        "BUYER\nJOSE RIZAL PDG\nLot 5\nCOD\nBrgy. Muzon\nZIP CODE 3023\nx": ("JOSE RIZAL", "Lot 5, Brgy. Muzon"),
        "Lot 5 A\nBUYER NAME\nMaria de la Peña prepaid\nx y": (None, None),
        "MAR|A de la Peña\nx y": ("MARIA de la Peña", "x y"),
        "Maria Muñoz\r\nPDG\r\nBrgy. Muzon\r\n": ("Maria Muñoz", "Brgy. Muzon"),
        "JOSE RIZAL\nx\nCarlos Johnson\nLot 5": ("Carlos Johnson", "Lot 5"),
        "Carlos Paid\nLot 5": ("Carlos", "Lot 5"),
        "A Bo\nno name\nAB CD COD COD": ("AB CD COD", None),
        "A B C D E": (None, None),
        "A B" + " " * 300_000 + "C": ("A B" + " " * 300_000 + "C", None),
        "A" * 300_000 + " B\n" + "\n" * 20_000 + "x": ("A" * 300_000 + " B", "x"),
        "": (None, None),
    }
    assert dict(zip(want, zones(spark, want))) == want


def test_buyer_zones_equal_brute_force(spark):
    def brute(text):
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        plain = [re.search(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b", x) for x in lines]
        no_name = ("district", "city", "zip", "province", "street", "buyer", "seller", "flash express")
        few = [len(x) >= 5 and not re.search(r"\d", x) and not any(w in x.lower() for w in no_name) and len(x.split()) <= 4 and sum(w[0].isupper() for w in x.split()) >= 2 for x in lines]
        at = next((i for i, m in enumerate(plain) if m), None)
        name = None if at is None else plain[at][1]
        if at is None and any(few):
            at = few.index(True)
            name = lines[at]
        if name is None:
            return None, None
        name = re.sub(r"\s+(PDG|COD|Paid|Prepaid)$", "", name, flags=re.IGNORECASE).replace("|", "I").replace("0", "O")
        address = []
        for x in lines[at + 1 :]:
            if any(w in x.lower() for w in ("district", "street", "city", "province", "zip code", "seller", "flash express", "gaya-gaya")):
                break
            if x.lower() not in ("buyer", "seller", "pdg", "cod"):
                address.append(x)
        return name, ", ".join(address) or None

    random.seed(5)
    words = ["JOSE", "RIZAL", "Maria", "Muñoz", "Ángel", "de", "la", "|sa", "Mar|a", "Al", "A", "b", "PDG", "cod", "Paid", "prePAID", "Lot", "5", "٣", "0", "½a", "_x", "Brgy.", "Ñ", "n\u0303o", "ǅa", "Ⓐb", "李", "É", "San", "Buyer", "zip", "Zip Code", "gaya-gaya", "Streets", "\U0001d400b"]
    gaps = [" ", " ", " ", " ", "  ", "\t", "\xa0", "\u3000", "\x1c", "\r", "-", ""]
    line = lambda: random.choice(gaps) + "".join(random.choice(words) + random.choice(gaps) for _ in range(random.randint(0, 5)))
    texts = ["\n".join(line() for _ in range(random.randint(0, 6))) for _ in range(6000)]
    want = [brute(t) for t in texts]
    assert sum(n is None for n, _ in want) > 500 and sum(n is not None and not re.search("[A-Z][a-z]+ [A-Z][a-z]", n) for n, _ in want) > 500
    assert [(t[:200], g) for t, g, w in zip(texts, zones(spark, texts), want) if g != w] == []


def test_name_lines_need_known_names(spark):
    rows = spark.createDataFrame([(1, "x\nQwerty Zxcvbn is here\nshort\nMaria Santos lives here"), (2, "Qwerty Zxcvbn is here"), (3, "")], "k int, t string")
    assert {r.k: r.name for r in extract.name_lines(extract.label_lines(rows, "k", "t"), "k").collect()} == {1: "Maria Santos"}


def test_addresses(spark):
    texts = [(1, "12 Mabini St, Brgy. Muzon, San Jose del Monte, Bulacan 3023"), (2, "Carlos Johnson\nLot 5\nbrgy Tungko\nSJDM 3024\nFE123\nPDG"), (3, "brgy only\nno code"), (4, None)]
    got = {r.k: r.buyer_address for r in extract.addresses(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()}
    assert got == {1: texts[0][1], 2: "Lot 5, brgy Tungko, SJDM 3024", 3: None, 4: None}


def test_anchors_equal_brute_force(spark):
    def partial(a, b):
        short, long = sorted((a, b), key=len)
        m = len(short)
        windows = [long[max(i, 0) : i + m] for i in range(1 - m, len(long))]
        return max(200 * lcs(short, w) / (m + len(w)) for w in windows)

    def brute(line):
        clean = "".join(c for c in line if c.isalnum() or c in "_ ").lower().strip()
        for name, texts in extract.ANCHORS.items():
            if 3 <= len(clean) <= 6 * min(map(len, texts)) and any(partial(clean, t) >= 80 for t in texts):
                return name
        return None

    random.seed(4)
    lines = ["Order ID: FE1", "0rder lD", "Rider: GY01", "RTS Sort Code:", "s0rt c0de", "Buyer", "8uyer", "Weight: 5g", "Quantlty", "COD", "x", "", "Brgy. Muzon"]
    lines += ["".join(random.choice("ordebuyiwtgqs :") for _ in range(random.randint(1, 30))) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", extract.anchor_of("line").alias("a")).collect()
    assert {r.line: r.a for r in got} == {x: brute(x) for x in lines}


def test_generated_labels(spark):
    from sortlane.sources.generator import labels

    rows = labels(spark.range(500).withColumnRenamed("id", "k"), "k").collect()
    assert len(rows) == 500 and len({r.tracking_id for r in rows}) == 500
    assert all(100 <= r.weight_g <= 7000 and r.quantity == max(1, r.weight_g // 500) for r in rows)


def test_latency_report_equals_sorted_values(spark):
    random.seed(9)
    values = {g: [random.choice([5.0, 7.5, random.random() * 400]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 40))}
    got = {r.g: r for r in store.latency_report(spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("e", None)], "g string, v double"), "g", "v").collect()}
    for g, vs in values.items():
        vs, n = sorted(vs), len(vs)
        assert got[g].n == n and got[g].p95 == vs[int(n * 0.95)] and got[g].median == pytest.approx((vs[(n - 1) // 2] + vs[n // 2]) / 2, abs=1e-6)


def test_appends_keep_rejects_apart(spark, tmp_path):
    new = spark.createDataFrame([(1, 0.5), (2, 7.0), (3, 0.1), (3, 0.2)], "id long, confidence double")
    new = new.withColumns({c: F.lit(1) for c in ("weight_g", "quantity", "processing_time_ms")})
    table = VersionedTable(spark, f"file://{tmp_path}/t", new.schema)
    table.replace(lambda _: new.where("id = 1"), "first")
    rejected = store.append(new, table, "second", "id")
    assert sorted((r.id, r.reason) for r in rejected.collect()) == [(1, "duplicate"), (2, "check"), (3, "duplicate in batch")]
    assert sorted((r.id, r.confidence) for r in table.rows().collect()) == [(1, 0.5), (3, 0.1)]


def test_matches_with_a_dictionary_that_is_not_small(spark, monkeypatch):
    """By segments, the matches are the same as with a broadcast dictionary."""
    random.seed(6)
    texts = spark.createDataFrame([("".join(random.choice("muzongt ") for _ in range(random.randint(1, 9))),) for _ in range(60)] + [("Muzonn",), ("GY0l",), (None,), ("N0RTH",), ("",)], "t string")
    runs = [
        lambda: match.best_ratio(texts, "t", dic.barangays(spark), 60.0), lambda: match.first_ratio(texts, "t", dic.riders(spark)), lambda: match.best_code(texts, "t", dic.riders(spark)),
        lambda: match.nearest_edit(texts, "t", dic.riders(spark), 3), lambda: match.best_variation(texts, "t", dic.variations(spark, dic.DISTRICT_VARIATIONS)),
    ]
    wide = [sorted(map(str, f().collect())) for f in runs]
    monkeypatch.setattr(candidates, "MOST_WORDS", 2)
    assert [sorted(map(str, f().collect())) for f in runs] == wide


def test_matching_blocks_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice("abc de") for _ in range(rng.randint(0, 25))), "".join(rng.choice("abc de") for _ in range(rng.randint(0, 25)))) for _ in range(600)]
    rows += [(a, a[: len(a) // 2] + "x" + a[len(a) // 2 :]) for a, _ in rows[:200]] + [("", ""), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", sim.matching_blocks_ratio("a", "b").alias("s"), sim.blocks_may_reach(F.col("a"), F.col("b"), 0.8).alias("may")).collect():
        if r.a is None:
            assert r.s is None
            continue
        want = SequenceMatcher(None, r.a, r.b).ratio()
        assert r.s == pytest.approx(want) and (r.may or want < 0.8), (r.a, r.b)


def test_second_courier_labels(spark):
    rows = [(1, "th1234567890\n rts-02 ORD1234567"), (2, "RTS-07 TH12345"), (3, " min\tburl "), (4, ""), (5, None), (6, "Phaya Thai")]
    got = {r.k: tuple(r)[1:] for r in extract.th_fields(spark.createDataFrame(rows, "k int, t string"), "k", "t", dic.words(spark, dic.TH_DISTRICTS), dic.RETURN_CODES).collect()}
    assert got == {1: ("TH1234567890", "RTS-02", "ORD1234567", None), 2: (None, None, None, None), 3: (None, None, None, "Min Buri"), 4: (None,) * 4, 5: (None,) * 4, 6: (None, None, None, "Phaya Thai")}


def test_generated_ids_never_repeat(spark):
    n = 1_000_000
    keys = spark.range(n, numPartitions=8).select((F.col("id") * 9999).alias("id"))
    made = labels(keys, "id")
    one = made.agg(*(F.countDistinct(c).alias(c) for c in ("tracking_id", "order_id", "ph_number")), F.count_if(F.col("order_id").rlike("^FE[0-9]{6}[A-Z0-9]{6}$") & F.col("tracking_id").rlike("^FE[0-9]{10}$") & F.col("ph_number").rlike("^FE [0-9]{12}$") & (F.length("street") > 5)).alias("fit")).first()
    assert tuple(one) == (n, n, n, n)
    small = spark.range(49).select(permuted(F.col("id"), "x", 7).alias("p"))
    assert sorted(r.p for r in small.collect()) == list(range(49))
    with pytest.raises(Exception, match="must be below"):
        labels(spark.createDataFrame([(10**10,)], "id long"), "id").collect()


def test_extended_addresses(spark):
    one = lambda s: spark.range(1).select(tx.clean_address_extended(F.lit(s))).first()[0]
    assert one(") 1, 123 Main St, Bulacan mi 3023, iy") == "123 Main St, Bulacan 3023"
    assert one("i Lot 5  Block 2 iy 3024") == "Lot 5 Block 2 3024"
