r"""Format-preserving pseudonyms for personal data, as built-in expressions only.

One pattern finds candidates; each is validated for its kind (Luhn for cards,
modulo 97 for IBANs, the calendar for dates, issued ranges for social security
numbers, octets for addresses), and what is valid is replaced by a keyed
Feistel permutation within its format.  A permutation has no collisions and
needs no table: equal values get equal pseudonyms in every document, and
different values stay different.  The pseudonyms are valid again: check digits
are recomputed, dates are dates.  E-mail names, e-mail domains and secrets have
no numeric format; they get keyed digests, equal for equal values.  What fails
its validation is ordinary text and stays, but for a card or IBAN that a number or
word beside it makes too long: such a run is parted where a shorter one is valid.

Defined results: a null text stays null with 0 replacements; empty texts stay;
repeated rows are treated alike; of kinds that fit one place the first of KINDS
counts; texts of any length are read whole; an input column named like the count
is replaced, all others stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import common

#: For tests and examples; a production run passes its own secret.
KEY = "example-key"
ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: The kinds in the order in which they are tried at a place.
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "address": ADDRESS, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())

#: What may be parted, groups of a card that stands in a longer run, and the mark between parts (private characters).
LONG = r"[0-9](?:[ -]?[0-9]){13}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2}"
GROUPS = r"^[0-9]{4,}(?:[ -][0-9]{3,})*$"
MARK = "\ue0f1\ue0f2\ue0f3"
#: A part may meet what follows it in another run, which is parted once more.
PARTINGS = 2

#: Dates are permuted within the years 1900 to 2099 (73,049 days) and within all other years up to 9999 (3,579,010 days,
#: 693,595 of them before 1900); the sides of both ranges, whose product is the number of days.
EPOCH = "1900-01-01"
COMMON, BEFORE = 73_049, 693_595
COMMON_SIDES, OTHER_SIDES = (17, 4297), (170, 21_053)
#: Steps of a walk to a day after the twelfth; six in ten end it.
WALK = 64
#: Social security numbers: areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
SSN_LEFT, SSN_RIGHT = 898 * 99, 9999


def draw(key: str, kind: str, n: Column, r: Column, value: Column, below: Column) -> Column:
    """The keyed round function: a number below ``below`` from the SHA-256 of all that it depends on."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), r.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), below)


def feistel(key: str, kind: str, n: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A permutation of the pairs (left, right): struct(l, r) after alternating keyed additions."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.struct(
            F.when(i % 2 == 1, F.pmod(s["l"] + draw(key, kind, n, i, s["r"], left_size), left_size)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, F.pmod(s["r"] + draw(key, kind, n, i, s["l"], right_size), right_size)).otherwise(s["r"]).alias("r"),
        ),
    )


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """As many digits, permuted within all strings of that length (2 to 36 digits)."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a
    mixed = feistel(key, kind, n, F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, b), power(a), power(b))
    return F.concat(F.lpad(mixed["l"].cast("string"), a, "0"), F.lpad(mixed["r"].cast("string"), b, "0"))


def filled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in turn."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    is_digit = lambda c: (c >= "0") & (c <= "9")
    return F.aggregate(
        F.split(form, ""),
        state,
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(is_digit(c), F.substring(digits, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["n"] + F.when(is_digit(c), 1).otherwise(0)).alias("n"),
        ),
    )["out"]


def luhn(digits: Column) -> Column:
    """The Luhn sum of digits of which the last is the check digit."""
    reversed_digits = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(reversed_digits, lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda acc, x: acc + x,
    )


def modulo_97(text: Column) -> Column:
    """Digits and letters (A = 10) as one number, modulo 97."""
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c >= "A", 100).otherwise(10) + value(c), F.lit(97)))


def valid_card(m: Column) -> Column:
    return F.pmod(luhn(digits_of(m)), F.lit(10)) == 0


def valid_iban(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return (modulo_97(F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))) == 1) & (F.length(plain) >= 15)


def parted(m: Column) -> Column:
    """A card or IBAN candidate that is not valid, with a mark after its longest valid beginning, or before its longest valid end (a card)."""
    whole = lambda kind, x: x.rlike(f"^(?:{KINDS[kind]})$")
    is_card = lambda x: F.when(x.rlike(GROUPS) & whole("card", x), valid_card(x)).otherwise(False)
    is_iban = lambda x: F.when(whole("iban", x), valid_iban(x)).otherwise(False)
    gap = lambda k: F.substring(m, k, F.lit(1)).isin(" ", "-")
    places = F.sequence(F.lit(1), F.length(m))
    head, tail = (lambda k: F.substring(m, F.lit(1), k - 1)), (lambda k: F.substring(m, k + 1, F.length(m)))
    after = lambda good: F.array_max(F.filter(places, lambda k: F.when(gap(k), good(head(k))).otherwise(False)))
    before = F.array_min(F.filter(places, lambda k: F.when(gap(k), is_card(tail(k))).otherwise(False)))
    first = lambda k: F.concat(head(k), F.lit(MARK), F.substring(m, k, F.length(m)))
    last = lambda k: F.concat(F.substring(m, F.lit(1), k), F.lit(MARK), tail(k))
    as_card = F.coalesce(first(after(is_card)), last(before), m)
    return F.when(whole("iban", m) & ~valid_iban(m), F.coalesce(first(after(is_iban)), m)).when(whole("card", m) & ~valid_card(m), as_card).otherwise(m)


def card(key: str, m: Column) -> Column:
    digits = digits_of(m)
    payload = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    check = F.pmod(10 - F.pmod(luhn(F.concat(payload, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(valid_card(m), filled(m, F.concat(payload, check.cast("string"))))


def iban(key: str, m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    numbers = digits_of(body)
    changed = filled(body, F.when(F.length(numbers) >= 2, permuted_digits(key, "iban", numbers)).otherwise(numbers))
    check = F.lpad((98 - modulo_97(F.concat(changed, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid_iban(m), filled(m, digits_of(F.concat(check, changed))))


def ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    mixed = feistel(key, "ssn", F.lit(9), index, serial - 1, F.lit(SSN_LEFT), F.lit(SSN_RIGHT))
    back = F.floor(mixed["l"] / 99) + 1
    text = F.format_string("%03d-%02d-%04d", back + F.when(back >= 666, 1).otherwise(0), mixed["l"] % 99 + 1, mixed["r"] + 1)
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), text)


def address(key: str, m: Column) -> Column:
    octets = F.split(m, r"\.")
    octet = lambda k: F.get(octets, F.lit(k)).cast("bigint")
    mixed = feistel(key, "address", F.lit(4), octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536))
    part = lambda x: (F.floor(mixed[x] / 256).cast("string"), (mixed[x] % 256).cast("string"))
    return F.concat_ws(".", *part("l"), *part("r"))


def bound(value: Column, f) -> Column:
    """``f`` of the value, which is computed once; null of null."""
    return F.element_at(F.transform(F.array(value), lambda x: F.when(x.isNotNull(), f(x))), 1)


def permuted_day(key: str, day: Column) -> Column:
    """A day (counted from EPOCH) permuted within its range of years."""
    common = (day >= 0) & (day < COMMON)
    side = lambda k: F.when(common, F.lit(COMMON_SIDES[k])).otherwise(F.lit(OTHER_SIDES[k]))
    index = F.when(common, day).when(day < 0, day + BEFORE).otherwise(day - COMMON + BEFORE)
    mixed = feistel(key, "date", F.when(common, F.lit(0)).otherwise(F.lit(1)), F.floor(index / side(1)), index % side(1), side(0), side(1))
    back = lambda x: F.when(common, x).when(x < BEFORE, x - BEFORE).otherwise(x - BEFORE + COMMON)
    return bound(bound(mixed, lambda s: s["l"] * side(1) + s["r"]), back)


def date(key: str, m: Column) -> Column:
    """A date of the same form.  Slashes: month first where that is a date, else day first.

    A date that only day first can be read as walks on until it is such a date
    again, so that the pseudonyms of both readings never meet.
    """
    epoch = F.lit(EPOCH).cast("date")
    day = lambda form: F.datediff(F.try_to_date(m, form), epoch).cast("bigint")
    at = lambda d: F.date_add(epoch, d.cast("int"))
    walked = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permuted_day(key, d), lambda x, _: F.when(F.dayofmonth(at(x)) > 12, x).otherwise(permuted_day(key, x)))
    moved = lambda form, f: bound(bound(day(form), f), lambda d: F.date_format(at(d), form))
    plain = [moved(form, lambda d: permuted_day(key, d)) for form in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")]
    return F.coalesce(*plain, moved("dd/MM/yyyy", walked))


def phone(key: str, m: Column) -> Column:
    """The country code stays; the ten digits are permuted."""
    prefix = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])[ .-]?", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    return F.concat(prefix, filled(rest, permuted_digits(key, "phone", digits_of(rest))))


def email(key: str, m: Column) -> Column:
    digest = lambda what, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), what), 256), 1, n)
    name, host = F.substring_index(m, "@", 1), F.lower(F.substring_index(m, "@", -1))
    return F.concat(F.lit("u"), digest(F.concat_ws("@", name, host), 16), F.lit("@h"), digest(host, 10), F.lit(".invalid"))


def secret(key: str, m: Column) -> Column:
    digest = F.concat(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), m), 256), F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret more"), m), 256))
    lower = F.substring(digest, F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(lower)).otherwise(lower)


MAKERS = {"email": email, "secret": secret, "iban": iban, "address": address, "date": date, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of a candidate: of the first kind whose whole pattern and validation it meets, else itself."""
    return F.coalesce(*[F.when(m.rlike(f"^(?:{KINDS[k]})$"), make(key, m)) for k, make in MAKERS.items()], m)


def pseudonymised(docs: DataFrame, key: str = KEY, count: str | None = "n_pii") -> DataFrame:
    """The documents with the personal data in ``text`` replaced, and the number of replacements in ``count``.

    The text between candidates is split off by the same pattern, so that both
    lists alternate and join to the whole text again.
    """
    df = common.packed(docs, text=F.col("text"), plain=F.col("text"))
    for _ in range(PARTINGS):
        df = df.withColumn("runs", F.when(F.col("text").rlike(LONG), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
        df = df.withColumn("parts", F.when(F.size("runs") > 0, F.transform("runs", parted)))
        marked = F.array_join(F.zip_with(F.split("text", ANY, -1), F.concat("parts", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        df = df.withColumn("text", F.when(F.col("parts") != F.col("runs"), marked).otherwise(F.col("text"))).drop("runs", "parts")
    # every candidate but an e-mail or a secret has a run of digits; both of those have "@" or 32 hexadecimal digits
    df = df.withColumn("found", F.when(F.col("text").rlike("[0-9@]|[A-Fa-f]{32}"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    df = df.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(key, m))))
    df = df.withColumn("between", F.when(F.size("found") > 0, F.split("text", ANY, -1)))
    joined = F.array_join(F.zip_with("between", F.concat("new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    joined = F.when(F.col("text") == F.col("plain"), joined).otherwise(F.replace(joined, F.lit(MARK), F.lit("")))
    df = df.withColumn("clean", F.when(F.size("found") > 0, joined).otherwise(F.col("plain")))
    outputs = {"text": F.col("clean")}
    if count:
        changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
        outputs[count] = F.when(F.size("found") > 0, changed).otherwise(0).cast("bigint")
    df = common.fenced(df.select("row", F.col("clean"), outputs[count].alias("n") if count else F.lit(0).alias("n")), "clean", "n")
    outputs = {"text": F.col("clean"), **({count: F.col("n")} if count else {})}
    if count is None:  # the input's columns in the input's order
        return df.select(*[(F.col("clean") if c.lower() == "text" else F.col(f"row.{common.quoted(c)}")).alias(c) for c in docs.columns])
    return common.unpacked(df, docs.columns, **outputs)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """All documents' ids and texts under pseudonyms, and the number of replacements."""
    return pseudonymised(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
