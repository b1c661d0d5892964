"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in built-in functions.

Validated values change into other valid values of their own format; equal values change alike in all
documents, whatever separators they are written with, so records stay linked. Without the key nobody
can tell which value stood there. What stays in clear by design: the domain of an e-mail address, the country
code of a phone number, the first digit of a card, the form of a date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.llm.common import packed, unpacked

#: The key of tests and queries; production passes its own.
DEMO_KEY = "not-a-secret"
ROUNDS = 8

#: What may be personal data, the first kind that fits counts.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
#: Around a value: no digit and no Latin letter, which makes it part of a name or version; other scripts do without spaces.
_FREE, _DONE = r"(?<![\p{IsLatin}\p{N}])", r"(?![\p{IsLatin}\p{N}])"
#: Checks that a pattern can make are made by it, so that a value which fails them takes no text away from others.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: Before it no part of a longer number either, by the separators of its own form.
IP = _FREE + r"(?<![0-9]\.)" + _OCTET + r"(?:\." + _OCTET + r"){3}" + _DONE + r"(?!\.[0-9])"
_D28, _D30, _D31 = "(?:0[1-9]|1[0-9]|2[0-8])", "(?:0[1-9]|[12][0-9]|30)", "(?:0[1-9]|[12][0-9]|3[01])"
_M30, _M31 = "(?:0[469]|11)", "(?:0[13578]|1[02])"
_YEAR = "(?:1[6-9]|2[0-9])[0-9]{2}"
_LEAP = "(?:(?:1[6-9]|2[0-9])(?:0[48]|[2468][048]|[13579][26])|(?:16|2[048])00)"


def _calendar(form: str, mark: str) -> str:
    """The dates that exist, in the order of the letters of ``form``."""
    days = ((_D31, _M31, _YEAR), (_D30, _M30, _YEAR), ("(?:29|30)", "(?:0[13-9]|1[0-2])", _YEAR), (_D28, "02", _YEAR), ("29", "02", _LEAP))
    return "(?:" + "|".join(mark.join(dict(zip("dmy", x))[c] for c in form) for x in days) + ")"


_DATE_DONE = "(?:" + _DONE + "|(?=T[0-9]{2}))"
DATE = _FREE + "(?:" + "|".join(
    f"(?<![0-9]{mark})" + _calendar(form, mark) for form, mark in (("ymd", "-"), ("dmy", r"\."), ("mdy", "/"), ("dmy", "/"))) + ")" + _DATE_DONE
SSN = _FREE + r"(?<![0-9]-)(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _DONE
_LOCAL = r"(?<![\p{IsLatin}\p{N}])(?<![0-9][.-])[0-9]{3}-[0-9]{3}-[0-9]{4}" + _DONE
#: The groups that cards are written in.
CARD_FORM = "(?:[0-9]{13,19}|" + "|".join(
    rf"[0-9]{{4}}(?:{x}[0-9]{{4}}){{3}}(?:{x}[0-9]{{3}})?|[0-9]{{4}}{x}[0-9]{{6}}{x}[0-9]{{4,5}}" for x in (" ", "-")) + ")"
#: A phone's next group is not where another value begins, nor a date that does not exist.
_OTHER = "(?:" + "|".join([IP, DATE, _FREE + "[0-9]{4}-[0-9]{2}-[0-9]{2}" + _DONE, SSN, r"(?<![0-9])" + CARD_FORM + _DONE]) + ")"
PHONE = (
    _FREE + r"(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![.-]?[0-9])"
    rf"|\+[0-9]{{1,3}}(?![ .-]?{_OTHER})[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:(?![ .-]?{_OTHER})[ .-]?[0-9]{{2,4}}){{1,4}}"
    + r"(?<=\+" + 8 * r"[ .()-]{0,2}[0-9]" + 7 * r"(?:[ .()-]{0,2}[0-9])?" + ")"
    r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|" + _LOCAL + ")" + _DONE
)
#: A run of numbers with 13 digits or more; which of its numbers are a card is seen afterwards.
CARD_RUN = (
    _FREE + r"(?<![0-9]\.)(?=(?:[0-9][ -]?){13})[0-9]++" + _DONE + r"(?:[ -](?!" + "|".join([IP, DATE, SSN, _LOCAL]) + r")[0-9]++" + _DONE + ")*+"
)
#: Country codes of one and two digits; all others have three. None is the beginning of another.
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD_RUN}
#: Any of the kinds.
ANY = "|".join(KINDS.values())

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)


def _draw(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.conv(F.substring(_digest(key, kind, turn, half), 1, 15), 16, 10).cast("bigint")


def _pair(key: str, kind: str, a: Column, b: Column, most_a: Column, most_b: Column) -> Column:
    """A permutation of all pairs a < most_a, b < most_b: each round adds a keyed function of one to the other."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        new_a = F.pmod(s["a"] + _draw(key, kind, i, s["b"]), most_a.cast("bigint"))
        new_b = F.pmod(s["b"] + _draw(key, kind, i, s["a"]), most_b.cast("bigint"))
        even = i % 2 == 0
        return F.struct(F.when(even, new_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of one length, two digits at least."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    a, b = F.substr(digits, F.lit(1), left), F.substr(digits, left + 1, right)
    # The length is part of the key: strings of different lengths change independently.
    moved = F.transform(F.array(_pair(key, kind, a, b, _power(left), _power(right))), lambda p: F.concat(
        F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), right, "0")))
    return moved[0]


#: Runs of letters in other scripts, as first code point and number of letters: Latin with marks,
#: Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Hiragana, Katakana, Han, Hangul.
SCRIPTS = (
    (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 7), (0x100, 48), (0x14A, 46), (0x391, 17), (0x3A3, 7), (0x3B1, 25), (0x410, 32), (0x430, 32),
    (0x5D0, 27), (0x621, 26), (0x641, 10), (0x905, 53), (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172),
)


def _moved_letter(c: Column, by: Column) -> Column:
    """A letter of another script moved within its run; whatever is in no run stays."""
    point = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("bigint")
    new = reduce(lambda rest, run: F.when(point.between(run[0], run[0] + run[1] - 1), (point - run[0] + by) % run[1] + run[0]).otherwise(rest),
                 SCRIPTS, F.lit(None).cast("bigint"))
    return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(new), 4, "0")), "UTF-16BE"), c)


def _shifted(text: Column, stream: Column) -> Column:
    """Every letter and digit moved within its own alphabet by a byte of the stream."""
    def move(c: Column, j: Column) -> Column:
        by = F.conv(F.substr(stream, 2 * (j % 32) + 1, F.lit(2)), 16, 10).cast("int")
        out = F.when(c > "\x7f", _moved_letter(c, by)).otherwise(c)
        for alphabet in (_DIGITS, _LOWER, _UPPER):
            at = F.instr(F.lit(alphabet), c)
            out = F.when((c != "") & (at > 0), F.substr(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permuted_name(key: str, kind: str, text: Column) -> Column:
    """A permutation of the texts of one shape; characters other than digits, ASCII letters and those of ``SCRIPTS`` stay."""
    n = F.length(text)
    left = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), left).alias("a"), F.substr(text, left + 1, n).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shifted(s["a"], _digest(key, kind, i, s["b"]))).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(_shifted(s["b"], _digest(key, kind, i, s["a"]))).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refilled(m: Column, digits: Column) -> Column:
    """The digits put where the digits of ``m`` stood."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def put(s: Column, c: Column) -> Column:
        is_digit = F.instr(F.lit(_DIGITS), c) > 0
        return F.when(c == "", s).when(
            is_digit, F.struct(F.concat(s["out"], F.substr(digits, s["used"] + 1, F.lit(1))).alias("out"), (s["used"] + 1).alias("used"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["used"].alias("used")))

    return F.aggregate(F.split(m, ""), start, put, lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, those at ``doubled``, ``doubled`` + 2 ... counted twice, digit by digit."""
    places = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    worth = lambda p: F.when(p["i"] % 2 == doubled, 2 * p["d"] - F.when(p["d"] > 4, 9).otherwise(0)).otherwise(p["d"])
    return F.aggregate(places, F.lit(0), lambda s, p: s + worth(p))


def _email(key: str, m: Column) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permuted_name(key, "email", name), F.substr(m, F.length(name) + 1, F.length(m)))


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def _ip(key: str, m: Column) -> Column:
    o = _octets(m)
    size = F.lit(65536)
    p = _pair(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], size, size)
    byte = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return F.transform(F.array(p), lambda q: F.concat_ws(".", *byte(q["a"]), *byte(q["b"])))[0]


#: Days of the 400 years after which the calendar repeats, and their factors.
_CYCLE, _CYCLE_A, _CYCLE_B = 146_097, 189, 773


def _as_date(m: Column) -> Column:
    """The date written, or null. Slashes put the month first where that is a date."""
    iso = F.try_to_date(m, "yyyy-MM-dd")
    dotted = F.try_to_date(m, "dd.MM.yyyy")
    slashed = F.coalesce(F.try_to_date(m, "MM/dd/yyyy"), F.try_to_date(m, "dd/MM/yyyy"))
    found = F.when(F.contains(m, F.lit("-")), iso).when(F.contains(m, F.lit(".")), dotted).otherwise(slashed)
    return F.when(found >= F.lit("1600-01-01").cast("date"), found)


def _date(key: str, m: Column) -> Column:
    days = F.datediff(_as_date(m), F.lit("1600-01-01").cast("date"))
    x = F.pmod(days, F.lit(_CYCLE))
    p = _pair(key, "date", F.floor(x / _CYCLE_B), x % _CYCLE_B, F.lit(_CYCLE_A), F.lit(_CYCLE_B))

    def written(q: Column) -> Column:
        new = F.date_add(F.lit("1600-01-01").cast("date"), (days - x + q["a"] * _CYCLE_B + q["b"]).cast("int"))
        month_first = F.try_to_date(m, "MM/dd/yyyy").isNotNull()
        return (
            F.when(F.contains(m, F.lit("-")), F.date_format(new, "yyyy-MM-dd"))
            .when(F.contains(m, F.lit(".")), F.date_format(new, "dd.MM.yyyy"))
            .when(month_first, F.date_format(new, "MM/dd/yyyy"))
            .otherwise(F.date_format(new, "dd/MM/yyyy"))
        )

    return F.transform(F.array(p), written)[0]


def _phone(key: str, m: Column) -> Column:
    """The country code stays; all other digits change together, wherever separators stand."""
    d = _digits(m)
    country = F.when(m.startswith("+"), F.regexp_extract(d, COUNTRY, 0)).otherwise(F.lit(""))
    return _refilled(m, F.concat(country, permuted_digits(key, "phone", F.substr(d, F.length(country) + 1, F.length(d)))))


def _card(key: str, m: Column) -> Column:
    """The first digit stays, the last one is the checksum of the new number."""
    d = _digits(m)
    n = F.length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(key, "card", F.substr(d, F.lit(2), n - 2)))
    check = F.pmod(-luhn_sum(body, 0), F.lit(10)).cast("string")
    return _refilled(m, F.concat(body, check))


def _ssn(key: str, m: Column) -> Column:
    """A permutation of the valid numbers: areas 001 to 899 but 666, groups from 01, serials from 0001."""
    d = _digits(m)
    area, group, serial = (F.substring(d, at, n).cast("bigint") for at, n in ((1, 3), (4, 2), (6, 4)))
    moved = _pair(key, "ssn", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

    def written(q: Column) -> Column:
        new = (q["a"] + F.when(q["a"] >= 665, 2).otherwise(1), F.floor(q["b"] / 9999) + 1, q["b"] % 9999 + 1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip(new, (3, 2, 4))])

    return F.transform(F.array(moved), written)[0]


def kind_of(m: Column) -> Column:
    """The validated kind of a value, or null: it looks like personal data but cannot be any."""
    d = _digits(m)
    valid_ip = m.rlike("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$") & ~F.exists(_octets(m), lambda x: x > 255)
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$"), F.when(valid_ip, "ip"))
        .when(m.rlike("^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), F.when(_as_date(m).isNotNull(), "date"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(?:000|666|9..)|-00-|-0000$"), "ssn"))
        .when(m.rlike("^[+(]|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), F.when(F.length(d).between(8, 15), "phone"))
        .when(F.length(d).between(13, 19), F.when(luhn_sum(d, 1) % 10 == 0, "card"))
    )


_CHANGE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(key: str, m: Column, kind: Column) -> Column:
    return reduce(lambda rest, k: F.when(kind == k, _CHANGE[k](key, m)).otherwise(rest), _CHANGE, m)


def _cards(run: Column, shape: str, *counts: int) -> Column:
    """The run cut into (m, kind) pieces: cards, and what lies between them. A card is of whole numbers of the run;
    at each number the ``counts`` (of all, if none) are tried in turn, those of another shape or checksum left out."""
    numbers = F.regexp_extract_all(run, F.lit("([0-9]+[ -]?)"), F.lit(1))

    def cut(g: Column) -> Column:
        forms = F.array(*map(F.lit, counts)) if counts else F.array(F.size(g))
        text = lambda start, count: F.array_join(F.slice(g, start, count), "")
        bare = lambda start, count: F.regexp_replace(text(start, count), "[ -]$", "")

        def is_card(start: Column, count: Column) -> Column:
            return F.exists(F.array(bare(start, count)), lambda m: F.when(
                m.rlike(f"^{shape}$") & F.length(_digits(m)).between(13, 19), luhn_sum(_digits(m), 1) % 10 == 0).otherwise(False))

        def longest(i: Column) -> Column:
            return F.coalesce(F.get(F.filter(forms, lambda k: (i + k <= F.size(g)) & is_card(i + 1, k)), F.lit(0)), F.lit(0))

        best = F.transform(g, lambda _, i: F.struct(i.alias("at"), longest(i).alias("n")))
        none = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("picks"), F.lit(0).alias("next"))
        picks = F.aggregate(
            F.filter(best, lambda x: x["n"] > 0), none,
            lambda s, x: F.when(x["at"] < s["next"], s).otherwise(F.struct(F.concat(s["picks"], F.array(x)).alias("picks"), (x["at"] + x["n"]).alias("next"))),
            lambda s: s["picks"],
        )

        def pieces(p: Column) -> Column:
            ends = F.concat(F.array(F.lit(0)), F.transform(p, lambda x: x["at"] + x["n"]))
            starts = F.concat(F.transform(p, lambda x: x["at"]), F.array(F.size(g)))
            # The separator behind a card belongs to what follows.
            def around(start: Column, i: Column) -> Column:
                end = F.get(ends, i)
                gap = F.concat(F.when(end > 0, F.regexp_extract(text(end, F.lit(1)), "[ -]?$", 0)).otherwise(""), text(end + 1, start - end))
                card = F.get(p, i)
                return F.array(
                    F.struct(gap.alias("m"), F.lit(None).cast("string").alias("kind")),
                    F.struct(F.coalesce(bare(card["at"] + 1, card["n"]), F.lit("")).alias("m"), F.when(card.isNotNull(), "card").alias("kind")),
                )

            return F.filter(F.flatten(F.transform(starts, around)), lambda x: x["m"] != "")

        return F.transform(F.array(picks), pieces)[0]

    return F.transform(F.array(numbers), cut)[0]


def _run_pieces(run: Column) -> Column:
    """Numbers in the usual groups of cards first, the shorter forms before the longer ones; then what is left, as
    a whole, in any groups. Parts of it in any groups would make cards of a tenth of all plain numbers."""
    known = _cards(run, CARD_FORM, 4, 3, 1, 5)
    rest = lambda p: F.when(p["kind"].isNull() & (F.length(_digits(p["m"])) >= 13), F.concat(
        F.filter(F.array(F.struct(F.regexp_extract(p["m"], "^[ -]?", 0).alias("m"), F.lit(None).cast("string").alias("kind"))), lambda x: x["m"] != ""),
        _cards(F.regexp_replace(p["m"], "^[ -]", ""), "[0-9 -]+"),
    )).otherwise(F.array(p))
    return F.flatten(F.transform(known, rest))


def _found(text: Column) -> Column:
    """The pieces (m, kind) of every match, a null kind where a piece stays; a cheap look at the text first."""
    def pieces(m: Column) -> Column:
        is_run = m.rlike("^[0-9][0-9 -]*$") & (F.length(_digits(m)) >= 13)
        return F.when(is_run, _run_pieces(m)).otherwise(F.array(F.struct(m.alias("m"), kind_of(m).alias("kind"))))

    return F.when(text.rlike("[0-9]|@"), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), pieces))


def _rewritten(text: Column, found: Column, key: str) -> Column:
    new = F.transform(found, lambda f: F.array_join(F.transform(f, lambda p: F.coalesce(pseudonym(key, p["m"], p["kind"]), p["m"])), ""))
    parts = F.zip_with(F.split(text, ANY, -1), new, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit(""))))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.array_join(parts, "")).otherwise(text)


def pseudonymised(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """All rows and columns, personal data in ``text`` replaced; ``n_chars`` stays, as lengths do not change
    (but where a number of an address gets longer or shorter, so it is counted anew if there is one).

    A null text stays null. Repeated rows change alike.
    """
    rows = packed(docs).withColumn("found", _found(F.col("row.text")))
    new_text = _rewritten(F.col("row.text"), F.col("found"), key)
    rows = rows.withColumn("new_text", new_text)
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        same = F.length("new_text") == F.length(F.col("row.text"))
        new["n_chars"] = F.when(same | F.col("new_text").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text")).cast(docs.schema["n_chars"].dataType)
    return unpacked(rows, replaced=new)


def pseudonym_report(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """(doc_id, text, n_email, n_ip, n_date, n_ssn, n_phone, n_card) with the replaced values counted."""
    rows = docs.select("doc_id", F.col("text").alias("old"), _found(F.col("text")).alias("found"))
    count = lambda k: F.coalesce(F.size(F.filter(F.flatten("found"), lambda f: f["kind"] == k)), F.lit(0)).cast("bigint")
    return rows.select("doc_id", _rewritten(F.col("old"), F.col("found"), key).alias("text"), *[F.greatest(count(k), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS])
