"""String rules of label text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that recognition confuses with digits, and the digits (fixed values).
CONFUSED, DIGITS = "OIZSBoizsbLl|", "0125801258111"
#: Field patterns of the two couriers (fixed values).
TRACKING, ORDER, PHONE = r"^FE\d{10}$", r"^FE\d{6}[A-Z0-9]{6}$", r"^FE \d{12}$"
#: Field patterns by courier (fixed values), and grams for each unit of quantity.
COURIER_FIELDS = {
    "flash": {"tracking": r"^FE\d{10}$", "order": r"^FE\d{6}[A-Z0-9]{6}$", "phone": r"^FE \d{12}$"},
    "spx": {"tracking": r"^SPX\d{9}$", "order": r"^SH[0-9A-Z]{10}$", "phone": r"^SPX\d{12}$"},
}
GRAMS = {"flash": 500, "spx": 400}
#: Names of colours and detection algorithms on screen (fixed values).
COLOURS = {1: "Red", 2: "Green", 3: "Blue", 4: "Yellow"}
NAMED = {"ALGORITHM_FACE_RECOGNITION": "Face", "ALGORITHM_OBJECT_TRACKING": "Object", "ALGORITHM_TAG_RECOGNITION": "Tag"}


def fix_digits(s: Column) -> Column:
    return F.translate(s, CONFUSED, DIGITS)


def validated(s: Column, pattern: str) -> tuple[Column, Column]:
    """The value as it is or with its digits fixed, and whether either fits the pattern."""
    fixed = fix_digits(s)
    value = F.when(~s.rlike(pattern) & fixed.rlike(pattern), fixed).otherwise(s)
    return value, F.coalesce(s.rlike(pattern) | fixed.rlike(pattern), F.lit(False))


def quantity_of(weight: Column, courier: Column) -> Column:
    """At least one, else a unit for each full weight of the courier's rule; null for other couriers."""
    grams = F.lit(None).cast("int")
    for name, n in GRAMS.items():
        grams = F.when(courier == name, n).otherwise(grams)
    return F.when(grams.isNotNull(), F.greatest(F.lit(1), F.floor(weight / grams).cast("int")))


def first_match(s: Column, pattern: str, group: int = 0) -> Column:
    """Null where the pattern does not occur."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


# Junk around an address, a text up to its last four-digit number, signs of an address.
JUNK_IN_FRONT, JUNK_BEHIND, UP_TO_CODE, PUNCTUATION_AROUND = r"^[^\w\s,.-]+", r"[^\w\s,.-]+$", r"^(.*\b\d{4}\b)", r"^[ ,.-]+|[ ,.-]+$"
SHORT_FRONT, SHORT_BEHIND, STRAY_MI = r"^[^\w\d]+", r"[^\w\d]+$", r"\bmi\s+(\d{4})\b"
VILLAGE_SIGN, CITY_SIGN, CODE_SIGN, NO_ADDRESS = "brgy|barangay", "san jose del monte|sjdm", r"\b302[0-9]\b", "district|zip code"


def clean_address(s: Column) -> Column:
    """Leading junk goes, then all behind the last four-digit number; without one, trailing junk."""
    t = F.regexp_replace(F.trim(s), JUNK_IN_FRONT, "")
    coded = F.regexp_extract(t, UP_TO_CODE, 1)
    plain = F.regexp_replace(F.regexp_replace(t, JUNK_BEHIND, ""), r"\s+", " ")
    return F.when(coded != "", coded).otherwise(F.regexp_replace(plain, PUNCTUATION_AROUND, ""))


def clean_address_short(s: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(s, SHORT_FRONT, ""), SHORT_BEHIND, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, STRAY_MI, "$1"), r"\s+", " "))


#: What the extended clean-up takes off in front, in order; what may follow a postal code; stray words before one.
LEADING_JUNK = [r"^[\)\]\}\|]{0,2}\s*\d{1,2}\s*[,\s]+", r"^[a-z]\s+", r"^[^\w\d]+"]
BEHIND_CODE = r"(\d{4})([^\w\s].*)?$"
STRAY_WORD = r"\b(mi|iy)\s+(\d{4})\b"


def clean_address_extended(s: Column) -> Column:
    """Numbers, single letters and symbols in front go, what follows a last four-digit number, and stray words before one."""
    for pattern in LEADING_JUNK:
        s = F.regexp_replace(s, pattern, "")
    t = F.regexp_replace(F.regexp_replace(s, BEHIND_CODE, "$1"), STRAY_WORD, "$2")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def name_valid(s: Column) -> Column:
    """Two to four words of four letters or more, each with a capital first, no digit or artefact."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    ok = F.size(words).between(2, 4) & F.forall(words, lambda w: (F.length(w) >= 4) & w.rlike("^[A-Z]")) & ~s.rlike(r"[0-9|_~^]")
    return F.coalesce(ok, F.lit(False))


def address_valid(s: Column) -> Column:
    low = F.lower(s)
    ok = (F.length(s) >= 20) & low.rlike(VILLAGE_SIGN) & low.rlike(CITY_SIGN) & s.rlike(CODE_SIGN) & ~low.rlike(NO_ADDRESS)
    return F.coalesce(ok, F.lit(False))


def typos_fixed(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in the given order."""
    for wrong, right in pairs:
        s = F.replace(s, F.lit(wrong), F.lit(right))
    return s


def kept_lines(s: Column) -> Column:
    """Lines of three characters or more, at least half of them letters or digits, joined by blanks."""
    lines = F.transform(F.split(s, "\n"), lambda x: F.trim(x))
    share = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) / F.length(x)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 3) & (share(x) >= 0.5)), " ")


def detection_label(algorithm: Column, obj_id: Column) -> Column:
    n = F.concat(F.lit(" #"), obj_id.cast("string"))
    colour = F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))
    out = F.when(algorithm == "ALGORITHM_COLOR_RECOGNITION", F.coalesce(F.try_element_at(colour, obj_id), F.concat(F.lit("Color"), n)))
    for name, shown in NAMED.items():
        out = out.when(algorithm == name, F.concat(F.lit(shown), n))
    return out.otherwise(F.concat(F.lit("ID"), n))
