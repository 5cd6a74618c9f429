"""Masks for personal data. Each takes a string Column and gives a string Column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import hints
from tablewright.functions.text import digits_of, is_blank

STRATEGIES = ("mask", "full", "hash", "token", "null")


def _left(c, n):
    return F.substring(c, 1, n)


def _right(c, n):
    return F.right(c, F.lit(n))


def mask_phone(c: Column) -> Column:
    digits = digits_of(c)
    return (
        F.when(c.rlike(r"^1\p{Nd}{10}$"), F.concat(_left(c, 3), F.lit("****"), c.substr(F.lit(8), F.length(c))))
        .when(F.length(digits) >= 11, F.concat(_left(digits, 3), F.lit("****"), _right(digits, 4)))
        .when(F.length(c) > 5, F.concat(_left(c, 3), F.lit("****"), _right(c, 2)))
        .otherwise("***")
    )


def mask_id_card(c: Column) -> Column:
    # a well-formed id is 18 long, so both of its rules give first four + last four
    return F.when(F.length(c) >= 14, F.concat(_left(c, 4), F.lit("*" * 10), _right(c, 4))).otherwise("***")


def mask_email(c: Column) -> Column:
    parts = F.split(c, "@", -1)
    local, domain = parts[0], F.get(parts, 1)
    return (
        F.when(F.size(parts) != 2, "***@***")
        .when(F.length(local) <= 2, F.concat(F.lit("*@"), domain))
        .otherwise(F.concat(_left(local, 2), F.lit("***@"), domain))
    )


def mask_bank_card(c: Column) -> Column:
    digits = digits_of(c)
    return (
        F.when(F.length(digits) >= 16, F.concat(_left(digits, 4), F.lit(" **** **** "), _right(digits, 4)))
        .when(F.length(c) > 8, F.concat(_left(c, 4), F.lit("****"), _right(c, 4)))
        .otherwise("***")
    )


def mask_name(c: Column) -> Column:
    size = F.length(c)
    return (
        F.when(size <= 1, "*")
        .when(size == 2, F.concat(_left(c, 1), F.lit("*")))
        .otherwise(F.concat(_left(c, 1), F.repeat(F.lit("*"), size - 2), _right(c, 1)))
    )


def mask_address(c: Column) -> Column:
    prefix = F.regexp_extract(c, f"^({'|'.join(hints.ADDRESS_PREFIXES)})", 1)
    return (
        F.when(prefix != "", F.concat(prefix, F.lit("***")))
        .when(F.length(c) > 6, F.concat(_left(c, 6), F.lit("***")))
        .otherwise("***")
    )


def mask_other(c: Column) -> Column:
    return F.when(F.length(c) > 4, F.concat(_left(c, 2), F.lit("***"), _right(c, 2))).otherwise("***")


_BY_KIND = {
    hints.PHONE: mask_phone,
    hints.ID_CARD: mask_id_card,
    hints.EMAIL: mask_email,
    hints.BANK_CARD: mask_bank_card,
    hints.NAME: mask_name,
    hints.ADDRESS: mask_address,
}


def salted_hash(c: Column, salt: str) -> Column:
    """First 16 hex digits of SHA-256(salt + value); equal values keep equal hashes."""
    return F.left(F.sha2(F.concat(F.lit(salt), c), 256), F.lit(16))


def masked(c: Column, kind: str, strategy: str, salt: str | None = None) -> Column:
    """The value under one strategy. Null and blank values stay, except under ``null``.

    ``token`` needs a dictionary over the whole table and lives in ``operators.mask``.
    """
    if strategy == "null":
        return F.lit("")
    if strategy == "full":
        new = F.lit("***")
    elif strategy == "hash":
        if not salt:
            raise ValueError("the hash strategy needs a salt, or runs will not agree")
        new = salted_hash(c, salt)
    elif strategy == "mask":
        new = _BY_KIND.get(kind, mask_other)(c)
    else:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return F.when(c.isNull() | is_blank(c), c).otherwise(new)
