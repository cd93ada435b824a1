"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

A value found in a text is validated (Luhn, calendar, octets, number ranges, IBAN check digits) and permuted
under a key within its own format, so equal values stay equal in all documents and others stay apart:

* numbers and dates map to integers below a * b; Feistel rounds add a keyed hash of one half to the other,
  modulo a and modulo b in turn, which is a permutation of exactly that range;
* strings (e-mail names, phone numbers, secrets) do the same with two halves of characters, each within its
  own class: digits, upper-case and lower-case letters, and letters of other scripts (``RANGES``); check digits are
  computed anew.

E-mail names and secrets are matched up to their last sign, however long, so no part of a found value stays.  The
text between the values isn't touched.

In scope: e-mail addresses (the name is replaced, the host stays), keys and passwords behind their usual marks, dates
as 2024-01-31, 31.1.2024, 31/1/2024 and 1/31/2024, IPv4 addresses, IBANs, US social security numbers, phone numbers
with a country code or as ten digits in three parts, and card numbers.  Other nations' phone numbers without a
country code, dates with months in words and IPv6 addresses aren't looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "confluence-pii"
ROUNDS = 8
# Days from 1900-01-01 on that dates are permuted within (200 * 365), and patterns.
FIRST_DAY, DAY_FACTORS = "1900-01-01", (200, 365)
# Month-first dates, whose day is over 12, are permuted among such days of 1900 to 2102 (112 * 401).
LATE_FACTORS, LATE_MONTHS = (112, 401), 203 * 12
# Letters and digits that are permuted, as (first code point, how many): each range is one class.
ASCII = ((0x30, 10), (0x41, 26), (0x61, 26))
# Latin with signs, combining marks, Greek, Cyrillic, Hebrew, Arabic, kana, Han and Hangul.
RANGES = (
    (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x300, 112), (0x391, 17), (0x3A3, 9), (0x3AC, 35), (0x410, 32), (0x430, 32), (0x450, 16),
    (0x5D0, 27), (0x621, 26), (0x641, 10), (0x1E00, 150), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172),
)
_LETTERS = "A-Za-z0-9" + "".join(f"{chr(first)}-{chr(first + n - 1)}" for first, n in RANGES)
# No bound lies within what is permuted.  Where a name begins is fixed by the sign before it and a run is never given back,
# so long runs of letters without an @ are read once.
EMAIL = rf"(?<![{_LETTERS}._%+-])[{_LETTERS}._%+-]++@[{_LETTERS}-][{_LETTERS}.-]*\.[A-Za-z]{{2,}}(?![{_LETTERS}_])"
MARK = r"(?i:\b(?:password|passwd|pwd|token|secret|api_?key))\s{0,2}[=:]\s{0,2}[\"']?"
SECRET = rf"\bAKIA[A-Z0-9]{{16}}\b|\b(?:ghp_|sk-|xox[abp]-)[A-Za-z0-9_-]{{16,}}|{MARK}[{_LETTERS}_.~+/-]{{5,}}[{_LETTERS}_+/]={{0,2}}"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}|(?![\w/-]))|\d{1,2}[./]\d{1,2}[./]\d{4}(?![\w/-]))"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.+-])(?<!\d )[2-9]\d{2}(?:-\d{3}-|\.\d{3}\.| [2-9]\d{2} )\d{4}(?![\w-]|[ .]\d)"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
KINDS = {"email": EMAIL, "secret": SECRET, "date": DATE, "ip": IPV4, "iban": IBAN, "ssn": SSN, "phone": PHONE, "card": CARD}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these holds nothing to find.
HINT = r"[0-9@]|AKIA|(?i:passw|pwd|token|secret|api_?key|ghp_|sk-|xox)"


def _hashed(key: str, *parts: Column) -> Column:
    """A keyed 48-bit number."""
    data = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(data.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def permuted_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    start = F.struct(F.floor((value - F.pmod(value, F.lit(b))) / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _hashed(key, F.lit(kind), i, s["r"]), F.lit(a))
        right = F.pmod(s["r"] + _hashed(key, F.lit(kind), i, s["l"]), F.lit(b))
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).cast("long").alias("l"), F.when(even, s["r"]).otherwise(right).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _shifted(c: Column, by: Column) -> Column:
    """A character moved on within its class; others stay."""
    code = F.ascii(c)
    base = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
    moved = F.char(base + F.pmod(code - base + by, F.when(base == 48, 10).otherwise(26)))
    starts, sizes = (F.lit([r[i] for r in RANGES]) for i in (0, 1))
    place = F.size(F.filter(starts, lambda x: x <= code))
    first, n = F.element_at(starts, F.greatest(place, F.lit(1))), F.element_at(sizes, F.greatest(place, F.lit(1)))
    other = F.decode(F.unhex(F.lpad(F.hex(first + F.pmod(code - first + by, n)), 4, "0")), "UTF-16BE")
    wide = (code >= F.lit(RANGES[0][0])) & (code < first + n)
    return F.when(base.isNotNull(), moved).when(wide, other).otherwise(c)


def permuted_string(text: Column, key: str, kind: Column) -> Column:
    """A keyed permutation of the strings whose characters have the same classes, place by place.

    A round hashes the other half once, and this with each place, so the time grows with the length.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def moved(side: Column, other: Column, i: Column) -> Column:
        chars = F.filter(F.split(side, ""), lambda c: c != "")
        digest = F.array(_hashed(key, kind, i, other))
        return F.transform(digest, lambda d: F.array_join(F.transform(chars, lambda c, at: _shifted(c, _hashed(key, at, d))), ""))[0]

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], i)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["k"] + 1, F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))
        )

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def _luhn(payload: Column) -> Column:
    """The check digit behind a string of digits."""
    digits = F.filter(F.split(F.reverse(payload), ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(digits, one), F.lit(0), lambda s, d: s + d)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0).cast("long"), lambda s, c: F.when(c.between("0", "9"), s * 10 + value(c)).otherwise(s * 100 + value(c)).cast("long") % 97)


def kind_of(value: Column) -> Column:
    """The kind of a value that PATTERN found, or null where its validation fails."""
    whole = lambda name: value.rlike(f"^(?:{KINDS[name]})$")
    number = _digits(value)
    octets = F.split(value, r"\.")
    iban = F.replace(value, F.lit(" "), F.lit(""))
    day, late = _day(value), _late(value)
    return (
        F.when(whole("email"), "email")
        .when(whole("secret"), "secret")
        .when(whole("date"), F.when(day.between(0, DAY_FACTORS[0] * DAY_FACTORS[1] - 1) | late.between(0, LATE_FACTORS[0] * LATE_FACTORS[1] - 1), "date"))
        .when(whole("ip"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(whole("iban"), F.when(_mod97(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))) == 1, "iban"))
        .when(whole("ssn"), F.when(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "ssn"))
        .when(whole("card"), F.when(_luhn(F.substring(number, F.lit(1), F.length(number) - 1)) == F.right(number, F.lit(1)), "card"))
        .when(whole("phone"), F.when(F.length(number).between(7, 15), "phone"))
    )


def _day(value: Column) -> Column:
    """Days from FIRST_DAY on of an ISO or day-month-year date; null where there is no such day."""
    iso = F.try_to_date(value, "yyyy-MM-dd")
    local = F.try_to_date(F.regexp_replace(value, "/", "."), "d.M.yyyy")
    return F.datediff(F.coalesce(F.when(value.rlike("^[0-9]{4}-"), iso).otherwise(local)), F.lit(FIRST_DAY).cast("date")).cast("long")


def _late(value: Column) -> Column:
    """The place of a month-first date among all days over 12 since FIRST_DAY; null where it can be day-first, or isn't one."""
    date = F.when(_day(value).isNull(), F.try_to_date(value, "M/d/yyyy"))
    return (F.datediff(date, F.lit(FIRST_DAY).cast("date")) - 12 * ((F.year(date) - 1900) * 12 + F.month(date))).cast("long")


def _late_date(place: Column) -> Column:
    """The date at a place of ``_late``: the last month that begins at or before it, and what is left."""
    first = F.lit(FIRST_DAY).cast("date")
    guess = F.floor(place * LATE_MONTHS / (LATE_FACTORS[0] * LATE_FACTORS[1])).cast("int")
    begun = lambda m: F.datediff(F.add_months(first, m), first) - 12 * m <= place
    month = F.greatest(*[F.when(begun(guess + i), guess + i) for i in (-2, -1, 0, 1, 2)])
    return F.date_add(first, (place + 12 * (month + 1)).cast("int"))


def _code(value: Column) -> Column:
    """Digits of a phone number's country code that stay: the first one (1, 7) or two."""
    return F.when(F.substring(value, 1, 1) == "+", F.when(_digits(value).rlike("^[17]"), 1).otherwise(2)).otherwise(0)


def _lead(value: Column) -> Column:
    return F.regexp_extract(value, "^(?:AKIA|ghp_|sk-|xox[abp]-|\\w+\\s*[=:]\\s*[\"']?)", 0)


def moved_part(value: Column, kind: Column, key: str = KEY) -> Column:
    """The permuted string within a value: an e-mail's name, a secret's tail, an account, a card's digits but the last,
    a phone number's digits, so that it links in all its spellings.  Empty for other kinds."""
    number, solid = _digits(value), F.replace(value, F.lit(" "), F.lit(""))
    parts = {
        "email": F.substring_index(value, "@", 1), "secret": F.substring(value, F.length(_lead(value)) + 1, F.length(value)), "iban": F.substring(solid, F.lit(5), F.length(solid)),
        "card": F.substring(number, F.lit(1), F.length(number) - 1), "phone": F.substring(number, _code(value) + 1, F.length(number)),
    }
    return permuted_string(F.coalesce(*[F.when(kind == name, text) for name, text in parts.items()], F.lit("")), key, kind)


def moved_day(value: Column, kind: Column, key: str = KEY) -> Column:
    """The date that a date becomes: a month-first one among such days, others among all; null for other kinds."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(_day(value), *DAY_FACTORS, key, "date").cast("int"))
    late = _late_date(permuted_number(_late(value), *LATE_FACTORS, key, "late"))
    return F.when(kind == "date", F.when(_day(value).isNull(), late).otherwise(day))


def moved_number(value: Column, kind: Column, key: str = KEY) -> Column:
    """The place that an SSN gets among all valid ones; null for other kinds."""
    number = _digits(value)
    area = F.substring(number, 1, 3).cast("long")
    order = (area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + (F.substring(number, 4, 2).cast("long") - 1) * 9999 + F.substring(number, 6, 4).cast("long") - 1
    return F.when(kind == "ssn", permuted_number(order, 898, 99 * 9999, key, "ssn"))


def pseudonym(value: Column, kind: Column, moved_text: Column, day: Column, placed: Column, key: str = KEY) -> Column:
    """The pseudonym of a value of this kind, from its ``moved_part``, ``moved_day`` and ``moved_number``; a value without a
    kind stays."""
    number, solid = _digits(value), F.replace(value, F.lit(" "), F.lit(""))
    email = F.concat(moved_text, F.substring(value, F.instr(value, "@"), F.length(value)))
    secret = F.concat(_lead(value), moved_text)
    mark = F.when(F.instr(value, "/") > 0, "/").otherwise(".")
    wide = value.rlike("^[0-9]{2}[./][0-9]{2}")
    day_text = F.when(wide, F.date_format(day, "dd")).otherwise(F.dayofmonth(day).cast("string"))
    month_text = F.when(wide, F.date_format(day, "MM")).otherwise(F.month(day).cast("string"))
    local = F.concat(day_text, mark, month_text, mark, F.date_format(day, "yyyy"))
    date = F.when(value.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).otherwise(local)
    late_text = F.concat(month_text, F.date_format(day, "/dd/yyyy"))
    date = F.when(_day(value).isNull(), late_text).otherwise(date)
    octet = F.split(value, r"\.")
    packed = F.aggregate(F.transform(octet, lambda o: o.cast("long")), F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    moved = permuted_number(packed, 1 << 16, 1 << 16, key, "ip")
    ip = F.array_join(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.floor(moved / F.pow(F.lit(2), s)).cast("long").bitwiseAND(F.lit(255)).cast("string")), ".")
    account = moved_text
    country = F.substring(solid, 1, 2)
    check = F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.when(F.instr(value, " ") > 0, F.rtrim(F.regexp_replace(F.concat(country, check, account), "(.{4})", "$1 "))).otherwise(F.concat(country, check, account))
    new_area = F.floor(placed / (99 * 9999)).cast("long") + 1
    ssn = F.concat_ws("-", F.lpad(F.when(new_area >= 666, new_area + 1).otherwise(new_area).cast("string"), 3, "0"), F.lpad((F.floor(placed / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((placed % 9999 + 1).cast("string"), 4, "0"))
    # a card and a phone number are refilled alike: what stays in front, the part, and a card's check digit
    card = phone = _refilled(value, F.concat(F.when(kind == "phone", F.substring(number, F.lit(1), _code(value))).otherwise(""), moved_text, F.when(kind == "card", _luhn(moved_text)).otherwise("")))
    forms = {"email": email, "secret": secret, "date": date, "ip": ip, "iban": iban, "ssn": ssn, "card": card, "phone": phone}
    out = value
    for name, form in forms.items():
        out = F.when(kind == name, form).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` replaced, and ``pii``: the kinds of the values replaced, in order.

    Null texts stay null with no kinds; texts without values stay as they are.  All rows and other columns
    are kept, except that a column ``pii`` of the input is replaced.
    """
    value = F.col(text).cast("string")
    hinted = F.coalesce(value.rlike(HINT), F.lit(False))
    none = F.array().cast("array<string>")
    found = docs.withColumn("pii", F.when(hinted, F.regexp_extract_all(value, F.lit(PATTERN), 0)).otherwise(none))
    # a kind and what is permuted are made once and used by every branch
    known = F.transform("pii", lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    of = {"moved": moved_part, "day": moved_day, "placed": moved_number}
    moved = F.transform(known, lambda m: F.struct(m["value"].alias("value"), m["kind"].alias("kind"), *[f(m["value"], m["kind"], key).alias(n) for n, f in of.items()]))
    fresh = F.transform(moved, lambda m: F.struct(pseudonym(*[m[n] for n in ("value", "kind", *of)], key).alias("value"), m["kind"].alias("kind")))
    found = found.withColumn("pii", F.when(F.size("pii") > 0, fresh))
    pieces = F.zip_with(F.split(value, PATTERN, -1), "pii", lambda p, m: F.concat(p, F.coalesce(m["value"], F.lit(""))))
    replaced = F.when(F.col("pii").isNotNull(), F.array_join(pieces, "")).otherwise(value)
    kinds = F.coalesce(F.filter(F.transform("pii", lambda m: m["kind"]), lambda k: k.isNotNull()), none)
    return found.withColumns({text: replaced, "pii": kinds})


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (pseudonyms in it), n_values, kinds (those that occur, sorted) of each row.

    A null text stays null, without values.  Rows with null or repeated ids are treated like others; an
    empty table gives an empty result; other columns are ignored.
    """
    own = pseudonymised(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return own.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("pii")), ",").alias("kinds"))
