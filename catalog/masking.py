"""Masking queries."""

from pyspark.sql import functions as F

from catalog.inputs import PEOPLE, frame, per_column, q_blank, q_digits, table, with_src
from catalog.registry import ORACLES, query
from tablewright.functions import hints, masking
from tablewright.operators import mask

SALT = "fixed-salt"
_KINDS = {
    "name": hints.NAME, "phone": hints.PHONE, "email": hints.EMAIL, "id_card": hints.ID_CARD,
    "bank_card": hints.BANK_CARD, "address": hints.ADDRESS,
}
_PLAIN = "CAST(cust_id AS BIGINT) AS cust_id"


def _q_star(n):
    return f"repeat('*', {n})"


_MASKS = {
    "phone": f"""CASE WHEN regexp_matches(phone, '^1[0-9]{{10}}$') THEN concat(left(phone, 3), '****', substr(phone, 8))
        WHEN length({q_digits('phone')}) >= 11 THEN concat(left({q_digits('phone')}, 3), '****', right({q_digits('phone')}, 4))
        WHEN length(phone) > 5 THEN concat(left(phone, 3), '****', right(phone, 2)) ELSE '***' END""",
    "id_card": "CASE WHEN length(id_card) >= 14 THEN concat(left(id_card, 4), '**********', right(id_card, 4)) ELSE '***' END",
    "email": """CASE WHEN length(email) - length(replace(email, '@', '')) <> 1 THEN '***@***'
        WHEN strpos(email, '@') <= 3 THEN concat('*@', split_part(email, '@', 2))
        ELSE concat(left(email, 2), '***@', split_part(email, '@', 2)) END""",
    "bank_card": f"""CASE WHEN length({q_digits('bank_card')}) >= 16 THEN concat(left({q_digits('bank_card')}, 4), ' **** **** ', right({q_digits('bank_card')}, 4))
        WHEN length(bank_card) > 8 THEN concat(left(bank_card, 4), '****', right(bank_card, 4)) ELSE '***' END""",
    "name": "CASE length(name) WHEN 1 THEN '*' WHEN 2 THEN concat(left(name, 1), '*') ELSE concat(left(name, 1), repeat('*', length(name) - 2), right(name, 1)) END",
    "address": """CASE WHEN starts_with(address, '上海市') THEN '上海市***' WHEN starts_with(address, '广东省') THEN '广东省***'
        WHEN starts_with(address, '北京') THEN '北京***' WHEN length(address) > 6 THEN concat(left(address, 6), '***') ELSE '***' END""",
}


def _kept(c, new):
    """Null and blank cells stay as they are."""
    return f"CASE WHEN {c} IS NULL OR {q_blank(c)} THEN {c} ELSE {new} END"


def _one(name, c):
    @query(name, with_src(PEOPLE, f"SELECT {_PLAIN}, {_kept(c, _MASKS[c])} AS {c} FROM src"))
    def run(spark, sf):
        people = frame(spark, sf, PEOPLE)
        return people.select("cust_id", masking.masked(F.col(c), _KINDS[c], "mask").alias(c))


for _name, _c in (
    ("m2_mask_phone", "phone"), ("m3_mask_id_card", "id_card"), ("m4_mask_email", "email"),
    ("m5_mask_bank_card", "bank_card"), ("m6_mask_name", "name"), ("m7_mask_address", "address"),
):
    _one(_name, _c)


@query(
    "m1_personal_columns",
    with_src(PEOPLE, per_column(_KINDS, lambda c: f"""SELECT '{c}' AS "column", '{_KINDS[c]}' AS label, 'column_name' AS rule,
        count_if(NOT {q_blank(c)}) AS n FROM src""")),
    n="BIGINT",
)
def m1(spark, sf):
    return mask.personal_columns(frame(spark, sf, PEOPLE))


@query(
    "m8_mask_other",
    "SELECT p_partkey, CASE WHEN length(p_name) > 4 THEN concat(left(p_name, 2), '***', right(p_name, 2)) ELSE '***' END AS p_name FROM part",
)
def m8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", masking.masked(F.col("p_name"), "", "mask").alias("p_name"))


def _all(new):
    """Every personal column of the table under one rule, the other columns untouched."""
    cells = ", ".join(f"{new(c)} AS {c}" for c in _KINDS)
    return with_src(PEOPLE, f"SELECT cust_id, {cells}, amount, status, created_date FROM src")


@query("m_mask_table", _all(lambda c: _kept(c, _MASKS[c])))
def m_table(spark, sf):
    return mask.desensitize(frame(spark, sf, PEOPLE), "mask")


@query("m9_full", _all(lambda c: _kept(c, "'***'")))
def m9(spark, sf):
    return mask.desensitize(frame(spark, sf, PEOPLE), "full")


@query("m10_null", _all(lambda c: "''"))
def m10(spark, sf):
    return mask.desensitize(frame(spark, sf, PEOPLE), "null")


@query("m11_hash", _all(lambda c: _kept(c, f"left(sha256(concat('{SALT}', {c})), 16)")))
def m11(spark, sf):
    return mask.desensitize(frame(spark, sf, PEOPLE), "hash", SALT)


_TOKENS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS value FROM src WHERE {c} IS NOT NULL AND NOT {q_blank(c)}" for c, k in _KINDS.items())


def _token(c):
    return f"coalesce((SELECT token FROM tokens t WHERE t.kind = '{_KINDS[c]}' AND t.value = src.{c}), {c})"


@query(
    "m12_token",
    with_src(PEOPLE, f""", tokens AS (SELECT kind, value, concat(upper(left(kind, 4)), '_',
        CASE WHEN number < 10000 THEN lpad(CAST(number AS VARCHAR), 4, '0') ELSE CAST(number AS VARCHAR) END) AS token
        FROM (SELECT kind, value, row_number() OVER (ORDER BY kind, value) AS number FROM (SELECT DISTINCT kind, value FROM ({_TOKENS}))))
    SELECT cust_id, {', '.join(f'{_token(c)} AS {c}' for c in _KINDS)}, amount, status, created_date FROM src""".lstrip()),
)
def m12(spark, sf):
    return mask.desensitize(frame(spark, sf, PEOPLE), "token")


@query("m12_token_by_cells", ORACLES["m12_token"])
def m12_cells(spark, sf):
    people = frame(spark, sf, PEOPLE)
    return mask.tokenize(people, mask.personal_kinds(people), broadcast_bytes=0, row_key="cust_id")


def _changed(c):
    return f"SELECT '{c}' AS \"column\", '{_KINDS[c]}:mask' AS detail, count_if({_kept(c, _MASKS[c])} IS DISTINCT FROM {c}) AS n FROM src"


@query(
    "m13_mask_log",
    with_src(PEOPLE, f""", changed AS ({per_column(_KINDS, _changed)})
    SELECT 'desensitize' AS op, "column", detail, CAST(n AS BIGINT) AS n FROM changed
    UNION ALL SELECT 'desensitize', '*', 'detected', count(*) FROM changed
    UNION ALL SELECT 'desensitize', '*', 'masked', CAST(sum(n) AS BIGINT) FROM changed""".lstrip()),
)
def m13(spark, sf):
    return mask.mask_log(frame(spark, sf, PEOPLE), "mask")
