"""Surrogates for personal data, in DataFrame operations only.

One expression finds e-mail addresses, IPv4 addresses, IBANs, card, social-security and phone numbers, and names after a title. Each
becomes units: an address has a local part and a domain, a name has given and family names, a number is its digits, a phone number those without its
country code. A unit's surrogate is built from a keyed SHA-256 of the unit, so equal units have equal surrogates everywhere: mentions of one person or
domain still refer to each other, with a title or without. Surrogates keep type, length, layout, letter case, script (Latin or Cyrillic), the
country code of a phone number or IBAN, the validity of a card number's or IBAN's check digits, and the gender that a title tells; a title that
tells none, like Dr, leaves it to what most other mentions of the given name tell. Inside a text, names that were found after a title
are replaced wherever they stand as words.

Distinctness is checked over all documents: two units of a type may not share a surrogate, and no surrogate may be a unit that really
occurs. Units that do are drawn again with a counter until none is left; only these few have to be looked up while texts are rewritten. A
layout with fewer forms than units keeps its clashes after ``MOST_ROUNDS`` rounds.

13 to 19 digits without gaps are a card number if they begin with 2 to 6 as those do, and 13 digits also need a right check digit; other
numbers, such as times in milliseconds, stay. Null texts stay null, empty ones empty. Rows are rewritten one by one, so keys may be null or repeated. Other
columns are ignored; an own column ``entities`` is replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, fresh, small, stored

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = (
    r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\w-])"
)
MALE = ("Mr", "Herr", "Monsieur", "Señor", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "госпожа", "г-жа")
EITHER = ("Dr", "Prof")
NAME = rf"(?<![\w-])(?:{'|'.join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True))})\.? (?:\p{{Lu}}[\p{{Ll}}'’-]+)(?: \p{{Lu}}[\p{{Ll}}'’-]+){{0,2}}"
ENTITY = "|".join([EMAIL, IP, IBAN, CARD, SSN, PHONE, NAME])
TITLED = "(?:" + "|".join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True)) + r")\.? \p{Lu}"
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "name")
#: Syllables of made-up names: 16 starts and 8 vowels in either script.
LATIN, CYRILLIC = ("b c d f g h k l m n p r s t v z".split(), "a e i o u a e o".split()), ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у а е о".split())
#: The key where neither the caller nor the session's ``spark.sluicelog.surrogates.key`` gives one. It is no secret: give one for real data.
KEY = "surrogates-1"
MOST_ROUNDS = 40
#: Control characters that mark entities while a text is cut; texts that hold one are cut by the expression itself.
OPEN, CLOSE = "\x01", "\x02"


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def kind_of(m: Column) -> Column:
    """An entity's kind; ``none`` for a long number that isn't a card's."""
    n = F.length(digits_of(m))
    is_card = m.rlike(r"^\d+[ -]") | (m.rlike("^[2-6]") & ((n >= 14) | (_luhn(digits_of(m)) == 0)))
    return (
        F.when(F.contains(m, F.lit("@")), "email").when(m.rlike(r"^\d+(\.\d+){3}$"), "ip").when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\p{L}"), "name").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(n.between(13, 19) & ~m.rlike(r"^\+|\("), F.when(is_card, "card").otherwise("none")).otherwise("phone")
    )


def hinted(text: Column) -> Column:
    """Whether a text has what every entity has: an @, three digits close together, or a title. Plain searches come before expressions."""
    titled = reduce(or_, [F.contains(text, F.lit(t)) for t in MALE + FEMALE + EITHER])
    return F.contains(text, F.lit("@")) | (text.rlike("[0-9]") & text.rlike(r"[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9]")) | (titled & text.rlike(TITLED))


def found_in(text: Column) -> Column:
    """All entities of a text in order."""
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def name_words(m: Column) -> Column:
    """The given and family names after the title."""
    return F.split(F.regexp_replace(m, r"^[^ ]+ ", ""), " ")


def gender_of(m: Column) -> Column:
    title = F.regexp_replace(F.substring_index(m, " ", 1), r"\.$", "")
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def country_code(m: Column) -> Column:
    """The digits of a phone number's country code: what is set off at its start, else one digit after + for 1 and 7 and two for others."""
    return (
        F.when(m.rlike(r"^\+?\d{1,3}[ .-]?\("), F.regexp_extract(m, r"^\+?(\d{1,3})", 1)).when(m.rlike(r"^\+\d{1,3}[ .-]"), F.regexp_extract(m, r"^\+(\d{1,3})", 1))
        .when(m.rlike(r"^\+[17]"), F.substring(m, 2, 1)).when(F.startswith(m, F.lit("+")), F.substring(m, 2, 2)).otherwise("")
    )


def number_of(m: Column, kind: Column) -> Column:
    """A number without its layout, a phone number also without its country code."""
    plain = F.upper(F.regexp_replace(m, r"[ ()+-]", ""))
    return F.when(kind == "phone", F.substr(digits_of(m), F.length(country_code(m)) + 1, F.lit(32))).otherwise(plain)


def units_of(m: Column) -> Column:
    """The units of an entity: what gets one surrogate wherever it stands, written canonically, with the gender that a given name's title tells."""
    unit = lambda kind, value, gender=None: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"), (F.lit("n") if gender is None else gender).alias("gender"))
    words, low = name_words(m), F.lower(m)
    given = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: unit("given", w, gender_of(m)))
    none = F.array().cast("array<struct<kind:string,value:string,gender:string>>")
    return bound(kind_of(m), lambda kind: (
        F.when(kind == "email", F.array(unit("local", low), unit("domain", F.substring_index(low, "@", -1))))
        .when(kind == "name", F.concat(given, F.array(unit("family", F.element_at(words, -1)))))
        .when(kind == "none", none).otherwise(F.array(unit(kind, number_of(m, kind))))
    ))


def _hash(kind: Column, value: Column, attempt: Column, key: str, strength: int) -> Column:
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    if strength < 64:
        inner = F.substring(inner, 1, strength)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _byte(h: Column, i: Column | int) -> Column:
    """The i-th byte of a hexadecimal digest, around and around."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _same_classes(value: Column, h: Column, keep: Column | int = 0) -> Column:
    """A digit for every digit (the first not zero unless it was) and a letter for every letter but the first ``keep`` characters."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def other(c: Column, i: Column) -> Column:
        letter = F.substr(letters, _byte(h, i) % 26 + 1, F.lit(1))
        digit = F.when((i == 0) & (c != "0"), _byte(h, i) % 9 + 1).otherwise(_byte(h, i) % 10).cast("string")
        new = F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)
        return F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _padded(value: Column, h: Column, least: int) -> Column:
    """Short values get letters at the end, since their own length leaves too few surrogates."""
    extra = F.translate(F.substring(h, 40, least), "0123456789", "ghijklmnop")
    return F.concat(value, F.substr(extra, F.lit(1), F.greatest(F.lit(least) - F.length(value), F.lit(0))))


def _luhn(digits: Column) -> Column:
    """The Luhn sum, mod 10: 0 for a valid number."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda s, x: s + x) % 10


def _mod97(code: Column) -> Column:
    """The remainder by 97 of an IBAN's characters, letters as 10 to 35."""
    digit = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(code, ""), F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97)


def _iban(value: Column, h: Column) -> Column:
    """The country stays, check digits are right if the unit's were, else wrong."""
    country, account = F.substring(value, 1, 2), F.substr(_same_classes(value, h), F.lit(5), F.lit(64))
    right = F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))
    valid = _mod97(F.concat(F.substr(value, F.lit(5), F.lit(64)), F.substring(value, 1, 4))) == 1
    check = F.when(valid, right).otherwise((right + _byte(h, 30) % 90 + 1) % 97)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)


#: Endings of given names by gender, and that of family names, in either script.
ENDINGS = {"m": ("n", "н"), "f": ("na", "на"), "n": ("y", "й")}
NAME_LETTERS = 12


def _name(value: Column, h: Column) -> Column:
    """A capitalised made-up name of six syllables in the unit's script, without its ending."""

    def build(starts: list[str], vowels: list[str]) -> Column:
        s, v = F.array(*map(F.lit, starts)), F.array(*map(F.lit, vowels))
        return F.initcap(F.concat(*[F.concat(F.get(s, _byte(h, 2 * i) % 16), F.get(v, _byte(h, 2 * i + 1) % 8)) for i in range(NAME_LETTERS // 2)]))

    return F.when(value.rlike(r"\p{IsCyrillic}"), build(*CYRILLIC)).otherwise(build(*LATIN))


def ended(name: Column, gender: Column) -> Column:
    """A made-up name with the ending of a gender."""
    script = F.when(name.rlike(r"\p{IsCyrillic}"), 1).otherwise(0)
    end = lambda g: F.get(F.array(*map(F.lit, ENDINGS[g])), script)
    return F.concat(name, F.when(gender == "m", end("m")).when(gender == "f", end("f")).otherwise(end("n")))


def core_of(kind: Column | str, value: Column, attempt: Column, key: str, strength: int = 64) -> Column:
    """A unit's surrogate in canonical form; names without their ending. A kind that is known as text needs only its own branch."""
    named = F.lit(kind) if isinstance(kind, str) else kind
    unit = F.struct(named.alias("kind"), value.alias("value"), _hash(named, value, attempt, key, strength).alias("h"))
    if isinstance(kind, str):
        return bound(unit, lambda u: _core(kind, u["value"], u["h"]))
    return bound(unit, lambda u: (
        F.when(u["kind"].isin("given", "family"), _core("given", u["value"], u["h"])).when(u["kind"].isin("ssn", "phone"), _core("ssn", u["value"], u["h"]))
        .otherwise(reduce(lambda found, k: F.when(u["kind"] == k, _core(k, u["value"], u["h"])).otherwise(found), ("local", "domain", "ip", "iban", "card"), F.lit(None)))
    ))


def _core(kind: str, value: Column, h: Column) -> Column:
    """The surrogate of a value of a kind of unit, from its hash."""
    if kind in ("given", "family"):
        return _name(value, h)
    if kind in ("ssn", "phone"):
        return _same_classes(value, h)
    if kind == "iban":
        return _iban(value, h)
    if kind == "local":
        return _padded(_same_classes(F.substring_index(value, "@", 1), h), h, 8)
    if kind == "domain":
        return F.concat_ws(".", _padded(_same_classes(F.regexp_replace(value, r"\.[^.]*$", ""), h), h, 8), F.substring_index(value, ".", -1))
    if kind == "ip":
        return F.concat_ws(".", (_byte(h, 0) % 223 + 1).cast("string"), *[_byte(h, i).cast("string") for i in (1, 2, 3)])

    def card(digits: Column) -> Column:
        # the last digit makes the sum that of a valid number, or moves it off where the unit wasn't valid
        head = F.substr(digits, F.lit(1), F.length(digits) - 1)
        check = ((F.lit(10) - _luhn(F.concat(head, F.lit("0")))) % 10).cast("int")
        return F.concat(head, F.when(_luhn(value) == 0, check).otherwise((check + 1 + _byte(h, 31) % 9) % 10).cast("string"))

    return bound(_same_classes(value, h), card)


def _laid_out(m: Column, core: Column) -> Column:
    """The characters of ``core`` in place of the letters and digits of ``m``, in its case; what ``core`` has more follows."""
    places = F.split(F.regexp_replace(m, "[^0-9A-Za-z]", ""), "")
    own = F.zip_with(places, F.slice(F.split(core, ""), F.lit(1), F.size(places)), lambda c, s: F.when(c.rlike("[A-Z]"), F.upper(s)).otherwise(s))
    gaps = F.split(m, "[0-9A-Za-z]", -1)
    tail = F.substr(core, F.length(F.regexp_replace(m, "[^0-9A-Za-z]", "")) + 1, F.lit(1 << 20))
    woven = F.zip_with(gaps, F.concat(own, F.array(F.lit(""))), lambda g, s: F.concat(g, s))
    return F.concat(F.array_join(woven, ""), tail)


def rewritten(m: Column, looked_up: Column | None, key: str, strength: int = 64) -> Column:
    """An entity's surrogate in the entity's own layout. ``looked_up`` maps units to attempt and gender where these aren't 0 and the title's."""

    def entry(kind: Column | str, value: Column, field: str, default: Column) -> Column:
        if looked_up is None:
            return default
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.coalesce(F.try_element_at(looked_up, F.concat_ws("|", kind, value))[field], default)

    def core(kind: Column | str, value: Column) -> Column:
        return core_of(kind, value, entry(kind, value, "attempt", F.lit(0)), key, strength)

    low, words = F.lower(m), name_words(m)
    strip = lambda c: F.regexp_replace(c, "[^0-9A-Za-z]", "")
    email = F.concat_ws("@", _laid_out(F.substring_index(m, "@", 1), strip(core("local", low))), core("domain", F.substring_index(low, "@", -1)))
    gender = lambda w: F.when(gender_of(m) == "n", entry("given", w, "gender", F.lit("n"))).otherwise(gender_of(m))
    given = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: ended(core("given", w), gender(w)))
    name = F.concat_ws(" ", F.substring_index(m, " ", 1), given, ended(core("family", F.element_at(words, -1)), F.lit("n")))
    number = lambda kind: strip(core(kind, number_of(m, F.lit(kind))))
    digits = lambda kind: (
        F.when(kind == "iban", number("iban")).when(kind == "card", number("card")).when(kind == "ssn", number("ssn")).otherwise(F.concat(country_code(m), number("phone")))
    )
    plain = lambda kind: bound(digits(kind), lambda core: _laid_out(m, core))
    return bound(kind_of(m), lambda kind: F.when(kind == "email", email).when(kind == "name", name).when(kind == "ip", core("ip", m)).when(kind == "none", m).otherwise(plain(kind)))


def redrawn(units: DataFrame, key: str, strength: int = 64) -> DataFrame:
    """``(kind, value, attempt)`` of the units whose first surrogate another unit of the kind has too, or is one; ``units`` are distinct.

    In every round the smallest unit of a shared surrogate keeps it, unless the surrogate is itself a unit; the others draw again.
    """
    settled = stored(units.select("kind", "value", F.lit(0).alias("attempt")), "surrogate-draws")
    # whatever ending it gets, a made-up name isn't a real one if it doesn't begin as one
    real_value = F.when(F.col("kind").isin("given", "family"), F.substring("value", 1, NAME_LETTERS)).otherwise(F.col("value"))
    real = units.select(F.col("kind").alias("r_kind"), real_value.alias("r_value")).distinct()
    for _ in range(MOST_ROUNDS):
        drawn = settled.withColumn("core", core_of(F.col("kind"), F.col("value"), F.col("attempt"), key, strength))
        order = F.row_number().over(W.partitionBy("kind", "core").orderBy("attempt", "value"))
        checked = drawn.withColumn("place", order).join(real, (F.col("kind") == F.col("r_kind")) & (F.col("core") == F.col("r_value")), "left")
        clash = (F.col("place") > 1) | F.col("r_value").isNotNull()
        checked = stored(checked.select("kind", "value", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")), "surrogate-draws")
        clashes = checked.where("clash").count()
        discard(settled)
        settled = checked
        if not clashes:
            break
    again = stored(settled.where("attempt > 0").select("kind", "value", "attempt"), "surrogate-redrawn")
    discard(settled)
    return again


def told_genders(units: DataFrame) -> DataFrame:
    """``(kind, value, gender)`` of given names that stand after a title without gender, where most other titles tell one; ``units`` have their mentions."""
    n = lambda g: F.sum(F.when(F.col("gender") == g, F.col("mentions")).otherwise(0))
    counted = units.where("kind = 'given'").groupBy("kind", "value").agg(n("m").alias("m"), n("f").alias("f"), n("n").alias("n")).where("n > 0 and m <> f")
    return counted.select("kind", "value", F.when(F.col("m") > F.col("f"), "m").otherwise("f").alias("gender"))


def surrogates(docs: DataFrame, text: str = "text", key: str | None = None, strength: int = 64) -> DataFrame:
    """``docs`` with ``text`` rewritten and a column ``entities`` (how many were replaced, by kind); an own column of that name is replaced."""
    key = key or docs.sparkSession.conf.get("spark.sluicelog.surrogates.key", KEY)
    source = docs.select(F.col(text).alias("text"))
    matched = source.select(F.explode(found_in(F.col("text"))).alias("m"))
    every = stored(matched.select(F.explode(units_of(F.col("m"))).alias("u")).select("u.*").groupBy("kind", "value", "gender").agg(F.count(F.lit(1)).alias("mentions")), "surrogate-units")
    again = redrawn(every.select("kind", "value").distinct(), key, strength)
    special = stored(again.join(told_genders(every), ["kind", "value"], "full").select("kind", "value", F.coalesce("attempt", F.lit(0)).alias("attempt"), "gender"), "surrogate-special")
    discard(again)

    names = fresh(docs, *[f"_{n}_of_surrogates" for n in ("found", "pieces", "lookup", "text_key", "marked", "new", "parts")])
    found, pieces, lookup, text_key, marked, new, parts = names
    rows, looked_up = docs, None
    if not special.isEmpty():
        # only texts that hold such a unit need its entry
        keyed = source.where(hinted(F.col("text"))).select(F.xxhash64("text").alias(text_key), F.explode(found_in(F.col("text"))).alias("m"))
        keyed = keyed.select(text_key, F.explode(units_of(F.col("m"))).alias("u")).select(text_key, "u.kind", "u.value", F.col("u.gender").alias("own"))
        hit = keyed.join(small(special), ["kind", "value"]).where("attempt > 0 or own = 'n'")
        entry = F.struct(F.concat_ws("|", "kind", "value").alias("unit"), F.struct("attempt", "gender").alias("e"))
        needed = stored(hit.groupBy(text_key).agg(F.map_from_entries(F.collect_set(entry)).alias(lookup)), "surrogate-needed")
        rows = rows.withColumn(text_key, F.xxhash64(text)).join(small(needed), text_key, "left")
        looked_up = F.col(lookup)

    t = F.col(text)
    # one pass of the expression marks the entities; the rest is cut at the marks
    odd = F.contains(t, F.lit(OPEN)) | F.contains(t, F.lit(CLOSE))
    rows = rows.withColumn(marked, F.when(hinted(t) & ~odd, F.regexp_replace(t, ENTITY, f"{OPEN}$0{CLOSE}")))
    rows = rows.withColumn(parts, F.when(F.contains(F.col(marked), F.lit(OPEN)), F.split(marked, OPEN, -1)))
    inside = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.substring_index(p, CLOSE, 1))
    rest = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.substring_index(p, CLOSE, -1)))
    rows = rows.withColumns({found: F.when(odd, found_in(t)).otherwise(inside), pieces: F.when(odd, F.split(t, ENTITY, -1)).otherwise(rest)})
    rows = rows.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: rewritten(m, looked_up, key, strength))))
    woven = F.array_join(F.zip_with(_repeats_replaced(F.col(pieces), F.col(found), F.col(new)), F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    kinds = F.transform(F.coalesce(F.col(found), F.array().cast("array<string>")), kind_of)
    counts = bound(kinds, lambda k: F.struct(*[(F.size(k) - F.size(F.array_remove(k, kind))).cast("long").alias(kind) for kind in KINDS]))
    rows = rows.withColumns({"entities": counts, text: F.when(F.size(new) > 0, woven).otherwise(t)})
    return rows.drop(*names)


def _repeats_replaced(pieces: Column, found: Column, new: Column) -> Column:
    """The text between entities with the words of its titled names replaced, longer ones first."""
    is_name = lambda m: m.rlike(r"^\p{L}[^@]*$") & ~m.rlike(r"^[A-Z]{2}\d{2}")
    pairs = F.zip_with(found, new, lambda m, s: F.when(is_name(m), F.zip_with(name_words(m), name_words(s), lambda w, x: F.struct((-F.length(w)).alias("n"), w.alias("word"), x.alias("new")))))
    words = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    word = lambda w: F.concat(F.lit(r"(?<![\p{L}\w-])"), w, F.lit(r"(?![\p{L}\w-])"))
    replaced = lambda p: F.aggregate(words, p, lambda acc, w: F.when(F.contains(acc, w["word"]), F.regexp_replace(acc, word(w["word"]), w["new"])).otherwise(acc))
    return F.when(F.exists(found, is_name), F.transform(pieces, replaced)).otherwise(pieces)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = surrogates(docs.select("doc_id", "text"))
    return rows.select("doc_id", "text", *[F.col(f"entities.{k}").alias(f"n_{k}") for k in KINDS])


QUERIES = {"op3_surrogates": op3_surrogates}
SQL: dict[str, str] = {}
