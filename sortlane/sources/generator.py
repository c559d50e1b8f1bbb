"""Synthetic labels at any scale: every value follows from the row's key, so retries agree.

Ids are unique without a shuffle: a keyed permutation of all numbers of their kind takes a row's key to its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionaries import FIRST_NAMES, LAST_NAMES, STREETS, district_rows


def draw(key: Column, salt: str, n: int) -> Column:
    """A number from 0 to ``n`` - 1."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n))


def pick(key: Column, salt: str, items: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (draw(key, salt, len(items)) + 1).cast("int"))


#: Rounds of the permutation.
ROUNDS = 4


def divided(x: Column, n: int) -> Column:
    """Whole-number division of a number that is not negative."""
    return ((x - F.pmod(x, F.lit(n))) / n).cast("long")


def permuted(key: Column, salt: str, root: int) -> Column:
    """A permutation of the numbers below ``root`` squared (a Feistel network over pairs of numbers below ``root``).

    A key beyond that is an error, as ids would repeat; a null key gives null.
    """
    left, right = divided(key, root), F.pmod(key, F.lit(root))
    for i in range(ROUNDS):
        left, right = right, F.pmod(left + F.pmod(F.xxhash64(right, F.lit(f"{salt}{i}")), F.lit(root)), F.lit(root))
    outside = F.raise_error(F.lit(f"keys of {salt} ids must be below {root} squared")).cast("long")
    return F.when((key < 0) | (key >= root * root), outside).otherwise(left * root + right)


def in_digits(number: Column, base: int, n: int, digits: str) -> Column:
    """``number`` in ``n`` digits of ``base``."""
    places = [F.substring(F.lit(digits), F.pmod(divided(number, base**i), F.lit(base)).cast("int") + 1, F.lit(1)) for i in reversed(range(n))]
    return F.concat(*places)


def labels(keys: DataFrame, key: str) -> DataFrame:
    """A label for each key (whole numbers below 10^10, unique): tracking, order and phone ids do not repeat."""
    k = F.col(key).cast("long")
    # 10^10 tracking ids, 10^6 * 36^6 order ids, 10^12 phone ids
    tracking, order, phone = permuted(k, "tracking", 10**5), permuted(k, "order", 10**3 * 36**3), permuted(k, "phone", 10**6)
    letters = in_digits(F.pmod(order, F.lit(36**6)), 36, 6, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    weight = (100 + draw(k, "weight", 6901)).cast("int")
    rows = district_rows()
    place = draw(k, "place", len(rows)) + 1
    of = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in rows)), place.cast("int"))
    return keys.select(
        k.alias("label_id"), F.concat(F.lit("FE"), padded(tracking, 10)).alias("tracking_id"), F.concat(F.lit("FE"), padded(divided(order, 36**6), 6), letters).alias("order_id"),
        F.concat(F.lit("FE "), padded(phone, 12)).alias("ph_number"), weight.alias("weight_g"), F.greatest(F.lit(1), F.floor(weight / 500).cast("int")).alias("quantity"),
        F.concat_ws(" ", pick(k, "first", FIRST_NAMES), pick(k, "last", LAST_NAMES)).alias("buyer_name"), F.concat_ws(" ", (1 + draw(k, "house", 999)).cast("string"), pick(k, "street", STREETS)).alias("street"), of(1).alias("barangay"), of(2).alias("district"), of(3).alias("rts_code"),
        (1000 + draw(k, "zip", 9000)).cast("string").alias("zip_code"),
    )
