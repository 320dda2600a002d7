"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame expressions only.

Personal values are found by pattern, validated (Luhn, mod 97, calendar, octet
and area ranges) and replaced by another valid value of the same format. Each
replacement is a keyed permutation of the valid values, so equal values stay
equal in all documents, different ones stay different, and nothing is stored.

Two networks do the work. ``permute_pair`` runs on a pair of residues and
permutes Z_a x Z_b exactly, so no value has to be walked back into its range.
``permute_text`` runs on the halves of a string; each round shifts the
characters of one half within their class (digit, small, capital) by a keyed
hash of the other half, for any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DEMO_KEY = "demo key; pass your own"

EMAIL = r"(?<![\w.+\p{L}\p{M}-])[\p{L}0-9][\p{L}\p{M}0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: countries by the length of their IBAN
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# first the length of the country, so that capitals or digits behind a number stay text; then any other length
IBAN = r"(?<!\w)(?:(?:%s)|[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?!\w)" % "|".join(
    r"(?:%s)\d{2}(?: ?[A-Z0-9]){%d}(?!\w)" % (names.replace(" ", "|"), n - 4) for n, names in IBAN_COUNTRIES.items())
# small letters only without spaces, so that words behind a number are never part of it
SMALL_IBAN = r"(?<!\w)(?:%s)(?!\w)" % "|".join(
    r"(?:%s)\d{2}[a-z0-9]{%d}(?!\w)" % (names.lower().replace(" ", "|"), n - 4) for n, names in IBAN_COUNTRIES.items())
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
ISO_DATE = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?:(?=T\d)|(?![\w-]))"
DAY_DATE = r"(?<![\w./])\d{1,2}[./]\d{1,2}[./]\d{4}(?![\w/])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)"
# groups of digits of any number with 13 digits or more at their start; possessive, so that long runs need no stack
RUN = r"(?<!\w)(?=\d(?:[ -]?\d){12})\d++(?!\w)(?:[ -]\d++(?!\w))*+"
PHONE = r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\(?\d{3}\)?[ .-])\d{3}[ .-]\d{4}(?!\w)"
INTL_PHONE = r"\+\d(?:[ .-]?\(?\d\)?){7,14}(?!\w)"
ACCESS_KEY = r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)"
SECRET = r"(?<!\w)(?i:password|passwd|secret|token|api[_-]?key)(?-i: ?[=:] ?\"?)(?:[A-Za-z0-9_/+-]{8,}|(?=[A-Za-z_/+-]{0,6}\d)[A-Za-z0-9_/+-]{6,7})"
KINDS = {
    "email": EMAIL, "secret": SECRET, "access_key": ACCESS_KEY, "iban": IBAN, "small_iban": SMALL_IBAN, "ipv4": IPV4, "iso_date": ISO_DATE,
    "day_date": DAY_DATE, "ssn": SSN, "phone": PHONE, "intl_phone": INTL_PHONE, "card": CARD,
}
#: cards are looked for in whole runs of digit groups first
ANY = "|".join(RUN if kind == "card" else pattern for kind, pattern in KINDS.items())
#: inside a run, found cards stand in angle brackets, which no run holds
IN_RUN = "|".join(["<[0-9 -]+>", *(pattern for kind, pattern in KINDS.items() if kind != "card")])
#: groups as cards are printed; before any other group ends, so that a number next to a card does not join it
PRINTED = [("4,4,4,4", 4), ("4,6,5", 3), ("4,6,4", 3), ("4,4,4,4,3", 5)]
#: lengths of cards, usual ones first
CARD_LENGTHS = [16, 15, 14, 13, 19, 18, 17]
# 73,100 days from 1900-01-01 = 340 x 215
DATE_DOMAIN = (340, 215)
# areas 001-665 and 667-899; group 01-99 and serial 0001-9999
SSN_DOMAIN = (898, 99 * 9999)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where a lambda reads it at every step."""
    return F.transform(F.array(value), then)[0]


def _prf(key: str, kind: str, round_no: Column, value: Column) -> Column:
    """Keyed hash, as 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"), value.cast("string"), F.lit(key)), 256)


def permute_pair(left: Column, right: Column, domain: tuple[int, int], key: str, kind: str) -> Column:
    """struct(l, r): a keyed permutation of Z_a x Z_b."""
    a, b = domain
    shift = lambda i, x: F.conv(F.substring(_prf(key, kind, i, x), 1, 13), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + shift(i, s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + shift(i, s["l"])) % b).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shifted(text: Column, other: Column, key: str, kind: str, round_no: Column) -> Column:
    """``text`` with every digit and ASCII letter moved within its class by a keyed hash of ``other``."""

    def move(ch: Column, i: Column) -> Column:
        # the lengths belong to the hash, so that halves of several splits never share a stream
        stream = _prf(key, kind, F.concat_ws(".", round_no.cast("string"), F.floor(i / 14).cast("string")), other)
        by = F.conv(F.substring(stream, ((i % 14) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")
        within = lambda low, n: F.char(F.lit(ord(low)).cast("long") + (F.ascii(ch) - ord(low) + by) % n)
        return (
            F.when(ch.between("0", "9"), within("0", 10)).when(ch.between("a", "z"), within("a", 26))
            .when(ch.between("A", "Z"), within("A", 26)).otherwise(ch)
        )

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permute_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with the same digits, small and capital letter positions."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shifted(s["l"], s["r"], key, kind, i)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(_shifted(s["r"], s["l"], key, kind, i)).alias("r"),
        )

    def start(known: Column) -> Column:
        half = F.floor(F.length(known) / 2).cast("int")
        return F.struct(F.substring(known, F.lit(1), half).alias("l"), F.substring(known, half + 1, F.length(known)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _let(text, start), turn, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _into(form: Column, chars: Column, is_slot) -> Column:
    """``form`` with its slots filled by ``chars`` in order; everything else stays in place."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def filled(known: Column) -> Column:
        def put(s: Column, ch: Column) -> Column:
            return F.struct(
                F.concat(s["out"], F.when(is_slot(ch), F.substring(known, s["at"], F.lit(1))).otherwise(ch)).alias("out"),
                (s["at"] + F.when(is_slot(ch), 1).otherwise(0)).alias("at"),
            )

        return F.aggregate(F.split(form, ""), start, put)["out"]

    return _let(chars, filled)


def _is_digit(ch: Column) -> Column:
    return ch.between("0", "9")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one is the check digit."""

    def summed(known: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(known, -(i + 1), F.lit(1)).cast("int")
            return total + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

        return F.aggregate(F.sequence(F.lit(0), F.length(known) - 1), F.lit(0), add)

    return _let(digits, summed)


def card(value: Column, key: str) -> Column:
    """Luhn-valid numbers of 13 to 19 digits; the first digit (the scheme) and the separators stay."""

    def checked(digits: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), permute_text(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
        whole = _let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(digits) % 10 == 0, _into(value, whole, _is_digit)).otherwise(value)

    return _let(_digits(value), checked)


def _luhn(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def _printed_card(groups: Column, i: Column) -> Column:
    """Number of groups of the valid card that starts with group i as cards are printed; 0 without one."""
    form = F.concat(F.array_join(F.transform(F.slice(groups, i + 1, 5), lambda g: F.length(g).cast("string")), ","), F.lit(","))
    taken = lambda n: F.array_join(F.slice(groups, i + 1, n), "")
    found = F.when(F.length(groups[i]).between(13, 19) & _luhn(groups[i]), 1)
    for want, n in PRINTED:
        found = found.when(form.startswith(want + ",") & _luhn(taken(n)), n)
    return found.otherwise(0)


def _grouped_card(groups: Column, printed: Column, i: Column) -> Column:
    """Number of groups of the valid card that starts with group i and ends with any; 0 without one.

    It holds no group with which a printed card starts. Usual lengths go first.
    """
    def ends(n: Column) -> Column:
        digits = F.array_join(F.slice(groups, i + 1, n), "")
        place = F.array_position(F.array(*map(F.lit, CARD_LENGTHS)), F.length(digits))
        free = ~F.exists(F.slice(printed, i + 1, n), lambda x: x > 0)
        return F.when((place > 0) & free, F.when(_luhn(digits), F.struct(place.alias("place"), n.alias("n"))))

    most = F.least(F.lit(19), F.size(groups) - i)
    return F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(1), most), ends), lambda x: x.isNotNull()))["n"], F.lit(0))


def _taken(found: Column) -> Column:
    """Per group: 1 first, 2 last, 3 only group of a card, 0 else; from left to right, of all groups of a run.

    The walk goes in stretches of 256 groups, so a step never copies more than a stretch.
    """
    state = lambda skip, out: F.struct(skip.cast("int").alias("skip"), out.alias("out"))

    def step(s: Column, n: Column) -> Column:
        mark = F.when(s["skip"] > 1, 0).when(s["skip"] == 1, 2).when(n == 1, 3).when(n > 1, 1).otherwise(0)
        return state(F.when(s["skip"] > 0, s["skip"] - 1).otherwise(F.greatest(n - 1, F.lit(0))), F.concat(s["out"], F.array(mark)))

    def stretch(s: Column, at: Column) -> Column:
        walked = F.aggregate(F.slice(found, at, 256), state(s["skip"], F.expr("cast(array() as array<int>)")), step)
        return _let(walked, lambda w: state(w["skip"], F.concat(s["out"], F.array(w["out"]))))

    none = state(F.lit(0), F.expr("cast(array() as array<array<int>>)"))
    return F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(256)), none, stretch, lambda s: F.flatten(s["out"]))


def _marked_run(run: Column) -> Column:
    """A match of ``RUN`` with every card in it in angle brackets."""

    def marked(groups: Column, pieces: Column) -> Column:
        def found(printed: Column) -> Column:
            each = lambda n, i: F.when(n > 0, n).otherwise(_grouped_card(groups, printed, i))
            return F.transform(printed, each)

        def put(piece: Column, mark: Column) -> Column:
            digits = _digits(piece)
            return F.concat(F.when(mark.isin(1, 3), "<").otherwise(""), digits, F.when(mark.isin(2, 3), ">").otherwise(""),
                            F.substring(piece, F.length(digits) + 1, F.lit(1)))

        counts = _let(F.transform(groups, lambda g, i: _printed_card(groups, i)), found)
        return F.array_join(F.zip_with(pieces, _let(counts, _taken), put), "")

    pieces = F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0))
    return _let(pieces, lambda p: _let(F.transform(p, _digits), lambda g: marked(g, p)))


def _mod97(text: Column) -> Column:
    def add(rest: Column, ch: Column) -> Column:
        return F.when(_is_digit(ch), (rest * 10 + ch.cast("int")) % 97).otherwise((rest * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def iban(value: Column, key: str) -> Column:
    """Numbers that pass mod 97; country, spaces and the size of letters stay, the check digits are made anew."""

    def checked(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        whole = _let(permute_text(account, key, "iban"), lambda b: F.concat(country, check(b), b))
        valid = _mod97(F.concat(account, country, F.substring(plain, 3, 2))) == 1
        sized = _into(value, whole, lambda ch: ch != " ")
        return F.when(valid, F.when(value == F.lower(value), F.lower(sized)).otherwise(sized)).otherwise(value)

    return _let(F.upper(F.regexp_replace(value, " ", "")), checked)


def ipv4(value: Column, key: str) -> Column:
    """Addresses with octets up to 255, permuted as a pair of 16-bit numbers."""

    def written(t: Column) -> Column:
        return F.concat_ws(".", *[x.cast("string") for x in (F.floor(t["l"] / 256), t["l"] % 256, F.floor(t["r"] / 256), t["r"] % 256)])

    def checked(part: Column) -> Column:
        to = permute_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), key, "ipv4")
        return F.when(F.forall(part, lambda x: x <= 255), _let(to, written)).otherwise(value)

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), checked)


def _moved_date(day: Column, key: str, tweak: str) -> Column:
    """Another date of [1900-01-01, 2100-02-20]; null outside of it."""
    a, b = DATE_DOMAIN
    number = F.datediff(day, F.lit("1900-01-01").cast("date"))
    moved = _let(permute_pair(F.floor(number / b), number % b, DATE_DOMAIN, key, tweak), lambda t: t["l"] * b + t["r"])
    return F.when(number.between(0, a * b - 1), F.date_add(F.lit("1900-01-01").cast("date"), moved.cast("int")))


def _try_date(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def iso_date(value: Column, key: str) -> Column:
    """Calendar dates of the domain as yyyy-mm-dd."""
    return F.coalesce(F.date_format(_moved_date(_try_date(value, "yyyy-MM-dd"), key, "date"), "yyyy-MM-dd"), value)


def day_date(value: Column, key: str) -> Column:
    """d.m.yyyy day first; with a slash m/d/yyyy where that is a date, else d/m/yyyy.

    Days and months are written with two digits. The layout is part of the
    permutation's key, all else of the domain is as for ISO dates.
    """
    layouts = [(F.instr(value, ".") > 0, "d.M.yyyy", "dd.MM.yyyy"), (F.instr(value, "/") > 0, "M/d/yyyy", "MM/dd/yyyy"),
               (F.instr(value, "/") > 0, "d/M/yyyy", "dd/MM/yyyy")]
    read = [F.when(when, F.date_format(_moved_date(_try_date(value, form), key, form), out)) for when, form, out in layouts]
    return F.coalesce(*read, value)


def ssn(value: Column, key: str) -> Column:
    """Area not 000, 666 or 9xx, group not 00, serial not 0000."""
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    to = permute_pair(place, (group - 1) * 9999 + serial - 1, SSN_DOMAIN, key, "ssn")
    out = _let(to, lambda t: F.concat_ws(
        "-", F.lpad((t["l"] + F.when(t["l"] > 664, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.floor(t["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((t["r"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(valid, out).otherwise(value)


def phone(value: Column, key: str) -> Column:
    """The last ten digits are permuted (all, if fewer); country code and separators stay.

    So one number keeps one pseudonym with and without its country code.
    """

    def moved(digits: Column) -> Column:
        local = F.least(F.lit(10), F.length(digits))
        head = F.substring(digits, F.lit(1), F.length(digits) - local)
        return _into(value, F.concat(head, permute_text(F.right(digits, local), key, "phone")), _is_digit)

    return _let(_digits(value), moved)


def email(value: Column, key: str) -> Column:
    """Digits and ASCII letters before the @ are permuted; other letters and the domain stay."""
    return F.concat(permute_text(F.substring_index(value, "@", 1), key, "email"), F.lit("@"), F.substring_index(value, "@", -1))


def access_key(value: Column, key: str) -> Column:
    return F.concat(F.substring(value, 1, 4), permute_text(F.substring(value, F.lit(5), F.length(value)), key, "access key"))


def secret(value: Column, key: str) -> Column:
    """The value behind the name and its sign; the name stays."""
    held = F.regexp_extract(value, "[A-Za-z0-9_/+-]+$", 0)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(held)), permute_text(held, key, "secret"))


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY``; a value that fails its check stays as it is."""
    whole = lambda name: match.rlike(f"^(?:{KINDS[name]})$")
    return (
        F.when(F.instr(match, "@") > 0, email(match, key)).when(whole("secret"), secret(match, key))
        .when(whole("access_key"), access_key(match, key)).when(whole("iban") | whole("small_iban"), iban(match, key))
        .when(whole("ipv4"), ipv4(match, key)).when(whole("iso_date"), iso_date(match, key))
        .when(whole("day_date"), day_date(match, key)).when(whole("ssn"), ssn(match, key))
        .when(whole("phone") | whole("intl_phone"), phone(match, key)).when(whole("card"), card(match, key)).otherwise(match)
    )


def _cut(text: Column, pattern: str, part) -> Column:
    """struct(lead, parts): the text before the first match of ``pattern`` and, per match, part(match, text up to the next)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(F.split(text, pattern, -1), lambda between: F.struct(
        between[0].alias("lead"), F.zip_with(found, F.slice(between, F.lit(2), F.size(between)), part).alias("parts")))


def _matches(text: Column) -> Column:
    """struct(lead, parts): the text before the first value and, per value, struct(value, behind).

    A run of digit groups gives all its cards and the values of other kinds
    between them. A run stands behind an empty value, which stays as it is.
    """
    part = lambda value, behind: F.struct(value.alias("value"), behind.alias("behind"))
    inner = lambda match, behind: part(F.translate(match, "<>", ""), behind)

    def parts(match: Column, behind: Column) -> Column:
        run = lambda cut: F.concat(F.array(part(F.lit(""), cut["lead"])), cut["parts"], F.array(part(F.lit(""), behind)))
        return F.when(match.rlike(f"^(?:{RUN})$"), _let(_cut(_marked_run(match), IN_RUN, inner), run)).otherwise(F.array(part(match, behind)))

    return _let(_cut(text, ANY, parts), lambda cut: F.struct(cut["lead"].alias("lead"), F.flatten(cut["parts"]).alias("parts")))


def pseudonymise(docs: DataFrame, text: str = "text", key: str = DEMO_KEY, changed: str = "values_changed") -> DataFrame:
    """The same rows with personal values in ``text`` replaced and ``changed``, the number of values replaced.

    Row by row, without a shuffle. Texts without a digit or one of @ = : are not
    searched further. A null text stays null and an empty one empty (0 changed); values
    that match a pattern but fail its check stay; repeated values and rows get
    the same pseudonym; very long texts are treated whole; an empty table gives
    an empty one. Other columns pass through, whatever their names; one that is
    called like ``changed`` is replaced.
    """
    # numbered columns, so that names of any kind pass through
    at = docs.columns.index(text)
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    body = F.col(f"c{at}")
    new = lambda m: F.struct(pseudonym(m["value"], key).alias("new"), m["value"].alias("value"), m["behind"].alias("behind"))
    found = numbered.withColumn("found", F.when(body.rlike("[0-9@=:]"), _matches(body))).withColumn("new", F.transform("found.parts", new))
    made = F.concat(F.col("found.lead"), F.array_join(F.transform("new", lambda m: F.concat(m["new"], m["behind"])), ""))
    count = F.size(F.filter("new", lambda m: m["new"] != m["value"])).cast("long")
    text_now = F.when(F.size("new") > 0, made).otherwise(body)
    columns = [(text_now if k == at else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns) if c != changed]
    return found.select(*columns, F.when(F.size("new") > 0, count).otherwise(F.lit(0).cast("long")).alias(changed))
