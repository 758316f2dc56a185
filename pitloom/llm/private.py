"""Keyed surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern and told apart by their form.  Each unit of
identity (an e-mail address, the digits of a number, a surname, a given name)
gets a surrogate of its kind from an HMAC of its canonical form, so the same
entity has the same surrogate everywhere, in whatever format it is written.
A person is found by a title; other mentions of the names found in a text are
then replaced in that text too, and a title that tells no gender takes that
which the corpus gives the same full name elsewhere.
All units of the corpus are then checked: a surrogate that two units share, or
that is itself a unit of the corpus, is drawn again for all but one, until
none is left.  Redrawn units are few; texts without one need no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed

_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]{1,63}\.){1,126}\p{L}{2,63}"
_KEYWORD = r"(?i:token|secret|password|passwd|api[_\-]?key)[\"']?\s?[=:]\s?[\"']?"
#: Dots lie between its characters, so that a sentence's full stop is no part of it.
_SECRET_CHAR = r"[A-Za-z0-9+/_=~\-]"
_SECRET = rf"(?<![\p{{L}}]){_KEYWORD}(?=[A-Za-z+/_=~.\-]*+[0-9])(?=[A-Za-z0-9+/_=~.\-]{{7}}\.*+{_SECRET_CHAR}){_SECRET_CHAR}++(?:\.++{_SECRET_CHAR}++)*+"
_ACCESS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w\-])\d{3}-\d{3}-\d{4}(?![\d\-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_IPV6 = r"(?<![A-Za-z0-9:])(?=[A-Fa-f:]*+[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9:])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<![\d\-])(?:\d[ \-]?){12,18}\d(?![\d])"
#: Titles by gender, fixed values.
_MALE = r"Mr|MR|Mister|Herr|HERR|Señor|Sr|Monsieur|господин|г-н"
_FEMALE = r"Mrs|MRS|Ms|MS|Miss|Frau|FRAU|Señora|Sra|Srta|Madame|Mme|госпожа|г-жа"
_NEUTRAL = r"Dr|DR|Prof|PROF"
_NAME = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\-]*\p{L}(?:['’]\p{Lu}[\p{L}\-]*\p{L})?"
#: A name away from a title.
_BARE = rf"(?<![\p{{L}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}])"
_PERSON = rf"(?<![\p{{L}}])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? {_NAME}(?: {_NAME})?"
PATTERN = "|".join([_EMAIL, _SECRET, _ACCESS, _IBAN, _PHONE, _IP, _IPV6, _CARD, _PERSON])
KINDS = ["email", "secret", "access_key", "iban", "phone", "ip", "ipv6", "card", "person"]

_LATIN = "ba be bi bo da de di do fa fe ga ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa ta".split()
_CYRILLIC = "ба бе би бо да де ди до фа фе га ка ке ки ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са та".split()
_ENDINGS = {"m": ["n", "rd", "s", "k"], "f": ["na", "la", "ra", "ta"], "n": ["y", "e", "i", "o"], "s": ["ner", "berg", "man", "sen"]}
_CYRILLIC_ENDINGS = {"m": ["н", "рд", "с", "к"], "f": ["на", "ла", "ра", "та"], "n": ["и", "е", "ы", "о"], "s": ["нер", "берг", "ман", "сен"]}

#: So few redrawn units are written into the plan; more are joined.
PLAN_UNITS = 50


def _keyed_hash(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hex."""
    raw = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in raw)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _number(h: Column, at: int, width: int) -> Column:
    return F.conv(F.substring(h, at, width), 16, 10).cast("long")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _digits(h: Column) -> Column:
    return F.translate(h, "abcdef", "012345")


def _luhn_sum(digits: Column, odd_from_right: bool) -> Column:
    """Luhn sum of a digit string; odd_from_right: the last digit is doubled."""
    values = F.reverse(F.split(digits, ""))
    return F.aggregate(
        F.transform(values, lambda c, i: F.when((i % 2 == (0 if odd_from_right else 1)), (lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2))(c.cast("int"))).otherwise(c.cast("int"))),
        F.lit(0), lambda a, b: a + b,
    )


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _account(m: Column) -> Column:
    """An IBAN without its spaces."""
    return F.replace(m, F.lit(" "), F.lit(""))


def _mod_97(account: Column) -> Column:
    """Remainder by 97 of an IBAN whose first four characters come last and whose letters count from 10."""
    chars = F.split(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4)), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.try_to_number(c, F.lit("9")).cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def kind_of(m: Column) -> Column:
    """The kind of a match; null for a number that is none."""
    digits = _only_digits(m)
    return (
        F.when(m.rlike("^" + _KEYWORD), "secret").when(m.contains("@"), "email").when(m.rlike("^AKIA[0-9A-Z]{16}$"), "access_key")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]*$"), F.when(_mod_97(_account(m)) == 1, F.lit("iban"))).when(m.rlike("^[0-9A-Fa-f]+:"), "ipv6")
        .when(m.rlike(r"^[+(]|^\d{3}-\d{3}-\d{4}$"), "phone").when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(m.rlike(r"^[\d \-]+$"), F.when(_luhn_sum(digits, False) % 10 == 0, F.lit("card"))).otherwise("person")
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "c").otherwise("l")


def _parts(m: Column) -> tuple[Column, Column, Column, Column]:
    """Title with its space, given name (or ''), surname and gender of a person."""
    title = F.regexp_extract(m, rf"^(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? ", 0)
    names = F.split(F.substring(m, F.length(title) + 1, F.lit(400)), " ")
    given = F.when(F.size(names) > 1, names[0]).otherwise("")
    gender = F.when(title.rlike(rf"^(?:{_MALE})\.? "), "m").when(title.rlike(rf"^(?:{_FEMALE})\.? "), "f").otherwise("n")
    return title, given, F.element_at(names, -1), gender


def _full_name(m: Column) -> Column:
    """Given name and surname in lower case; null without a given name or for another kind of match."""
    _, given, surname, _ = _parts(m)
    return F.when((kind_of(m) == "person") & (given != ""), F.lower(F.concat(given, F.lit(" "), surname)))


def units_of(m: Column, gender_found: Column | None = None) -> Column:
    """The units of a match, as an array of (kind, canon); gender_found stands in where the title tells none."""
    def unit(kind, canon):
        return F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), canon.alias("canon"))

    _, given, surname, gender = _parts(m)
    if gender_found is not None:
        gender = F.when(gender == "n", F.coalesce(gender_found, gender)).otherwise(gender)
    kind = kind_of(m)
    person = F.array(unit(F.concat(F.lit("given_"), gender, _script(given)), F.lower(given)), unit(F.concat(F.lit("surname_"), _script(surname)), F.lower(surname)))
    person = F.filter(person, lambda u: u["canon"] != "")
    return (
        F.when(kind == "person", person).when(kind == "email", F.array(unit("email", F.lower(m)))).when(kind == "secret", F.array(unit("secret", F.regexp_replace(m, "^" + _KEYWORD, ""))))
        .when(kind.isNotNull(), F.array(unit(kind, F.when(kind.isin("phone", "card"), _only_digits(m)).when(kind == "iban", _account(m)).when(kind == "ipv6", F.lower(m)).otherwise(m)))).otherwise(F.filter(F.array(unit("", F.lit(""))), lambda u: u["kind"] != ""))
    )


def _choose(values: Column, index: Column) -> Column:
    return F.element_at(values, (index % F.size(values) + 1).cast("int"))


def _name(h: Column, cyrillic: Column | None = None, ending: Column | None = None) -> Column:
    """A name of four syllables, in the script and with the ending (m, f, n or s for a surname) asked for."""
    def array(values):
        return F.array(*map(F.lit, values))

    syllables, endings = array(_LATIN), array(_ENDINGS["n"])
    if cyrillic is not None:
        syllables = F.when(cyrillic, array(_CYRILLIC)).otherwise(syllables)
        endings = F.element_at(F.create_map(*[x for k in "mfns" for x in (F.lit(k), array(_ENDINGS[k]), F.lit("c" + k), array(_CYRILLIC_ENDINGS[k]))]), F.concat(F.when(cyrillic, "c").otherwise(""), ending))
    return F.initcap(F.concat(*(_choose(syllables, _number(h, 1 + 4 * i, 4)) for i in range(4)), _choose(endings, _number(h, 20, 4))))


def _drawn(key: str, family: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Canonical surrogate of a unit of one family of kinds."""
    message = F.concat_ws("|", kind, canon, attempt.cast("string"))
    h = _keyed_hash(key, message)
    n = F.length(canon)
    if family == "name":
        return _name(h, kind.endswith("c"), F.when(kind.startswith("given"), F.substring(kind, 7, 1)).otherwise("s"))
    if family == "card":
        body = F.concat(F.substring(canon, 1, 1), F.substring(_digits(h), F.lit(1), n - 2))
        return F.concat(body, ((10 - _luhn_sum(body, True) % 10) % 10).cast("string"))
    if family == "phone":
        return F.concat(F.when(n > 10, F.substring(canon, F.lit(1), n - 10)).otherwise(""), (_number(h, 1, 4) % 8 + 2).cast("string"), F.substring(_digits(h), F.lit(8), F.least(n, F.lit(10)) - 1))
    if family == "ip":
        return F.concat_ws(".", _number(h, 1, 4) % 222 + 1, _number(h, 5, 4) % 256, _number(h, 9, 4) % 256, _number(h, 13, 4) % 254 + 1)
    if family == "email":
        return F.concat(F.lower(_name(h)), F.lit("."), F.lower(_name(F.substring(h, 25, 30))), (_number(h, 50, 4) % 90 + 10).cast("string"), F.lit("@example."), _pick(["com", "net", "org"], _number(h, 60, 2)))
    if family == "access_key":
        return F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16)))
    if family == "iban":
        letters = F.translate(h, "0123456789abcdef", "ABCDEFGHIJKLMNOP")
        body = F.transform(F.split(F.substring(canon, F.lit(5), n), ""), lambda c, i: F.substring(F.when(c.rlike("[0-9]"), _digits(h)).otherwise(letters), i + 1, F.lit(1)))
        plain = F.concat(F.substring(canon, 1, 2), F.lit("00"), F.array_join(body, ""))
        return F.concat(F.substring(canon, 1, 2), F.lpad((98 - _mod_97(plain)).cast("string"), 2, "0"), F.substring(plain, F.lit(5), n))
    if family == "ipv6":
        return F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(h, i + 1, F.lit(1)))), "")
    blocks = F.transform(F.sequence(F.lit(1), F.ceil(F.greatest(n, F.lit(1)) / 64).cast("int")), lambda i: F.when(i == 1, h).when(i == 2, _keyed_hash(key, F.concat_ws("|", message, F.lit("more")))).otherwise(_keyed_hash(key, F.concat_ws("|", message, F.lit("more"), i.cast("string")))))
    more = F.array_join(blocks, "")
    place = {c: F.translate(more, "0123456789abcdef", t) for c, t in (("digit", "0123456789012345"), ("lower", "cdefghijklmnopqr"), ("upper", "CDEFGHIJKLMNOPQR"))}
    hexed = canon.rlike("^[0-9a-f]+$")
    at = lambda x, i: F.substring(x, i + 1, F.lit(1))
    return F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(hexed, at(more, i)).when(c.rlike("[0-9]"), at(place["digit"], i)).when(c.rlike("[a-z]"), at(place["lower"], i)).when(c.rlike("[A-Z]"), at(place["upper"], i)).otherwise(c)), "")


_FAMILIES = ["card", "phone", "ip", "email", "access_key", "iban", "ipv6", "secret", "name"]


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Canonical surrogate of a unit of any kind."""
    out = F.when(F.lit(False), F.lit(""))
    for family in _FAMILIES[:-1]:
        out = out.when(kind == family, _drawn(key, family, kind, canon, attempt))
    return out.otherwise(_drawn(key, "name", kind, canon, attempt))


def _redrawn(units: DataFrame, key: str) -> DataFrame:
    """Units (kind, canon, attempt) whose first surrogate is taken, with the attempt that is free."""
    state = checkpointed(units.withColumn("attempt", F.lit(0)))
    while True:
        drawn = state.withColumn("out", F.lower(surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))))
        several = drawn.groupBy("kind", "out").agg(F.min("canon").alias("keeps"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "out", "keeps")
        real = drawn.join(units.select("kind", F.lower("canon").alias("out")).distinct(), ["kind", "out"], "left_semi").select("kind", "canon")
        losers = drawn.join(several, ["kind", "out"]).where("canon <> keeps").select("kind", "canon").unionByName(real).distinct()
        losers = checkpointed(losers)
        if losers.isEmpty():
            return state.where("attempt > 0")
        state = checkpointed(state.join(losers.withColumn("_again", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt")))


def _spaced(m: Column, account: Column) -> Column:
    """account with m's spaces."""
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(account, F.length(_account(F.substring(m, F.lit(1), i + 1))), F.lit(1)))), "")


def _dressed(name: Column, new: Column) -> Column:
    """new in the form of name: all in capitals, or with a particle such as O'."""
    new = F.concat(F.regexp_extract(name, "^\\p{Lu}['’]", 0), new)
    return F.when(name == F.upper(name), F.upper(new)).otherwise(new)


def _spread(m: Column, digits: Column) -> Column:
    """digits in the places of m's digits."""
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_only_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _gender(m: Column, overrides: Column | None) -> Column:
    """Gender of a person's title or, where that tells none, of the same full name elsewhere."""
    gender = _parts(m)[3]
    if overrides is None:
        return gender
    found = F.element_at(overrides, F.concat(F.lit("gender|"), _full_name(m)))
    return F.when(gender != "n", gender).when(found == 1, "m").when(found == 2, "f").otherwise("n")


def _names(key: str, m: Column, overrides: Column | None) -> tuple[Column, Column]:
    """Surrogates of a person's given name and surname, in their form."""
    def draw(kind: Column, name: Column) -> Column:
        attempt = F.lit(0) if overrides is None else F.coalesce(F.element_at(overrides, F.concat_ws("|", kind, F.lower(name))), F.lit(0))
        return _dressed(name, _drawn(key, "name", kind, F.lower(name), attempt))

    _, given, surname, _ = _parts(m)
    return draw(F.concat(F.lit("given_"), _gender(m, overrides), _script(given)), given), draw(F.concat(F.lit("surname_"), _script(surname)), surname)


def _replacement(key: str, m: Column, kind: Column, overrides: Column | None) -> Column:
    """Surrogate of a match that is no person."""
    def draw(family: str, canon: Column) -> Column:
        attempt = F.lit(0) if overrides is None else F.coalesce(F.element_at(overrides, F.concat_ws("|", F.lit(family), canon)), F.lit(0))
        return _drawn(key, family, F.lit(family), canon, attempt)

    digits = _only_digits(m)
    out = F.when(kind == "phone", _spread(m, draw("phone", digits))).when(kind == "card", _spread(m, draw("card", digits)))
    out = out.when(kind == "secret", F.concat(F.regexp_extract(m, "^" + _KEYWORD, 0), draw("secret", F.regexp_replace(m, "^" + _KEYWORD, ""))))
    out = out.when(kind == "iban", _spaced(m, draw("iban", _account(m)))).when(kind == "ipv6", draw("ipv6", F.lower(m)))
    return out.when(kind == "email", draw("email", F.lower(m))).when(kind == "ip", draw("ip", m)).when(kind == "access_key", draw("access_key", m)).otherwise(m)


def _overrides(matches: DataFrame, key: str) -> DataFrame:
    """(name, value): the attempt of each redrawn unit ("kind|canon"), and 1 (male) or 2 (female) for full names ("gender|name") that stand with a neutral title too."""
    persons = matches.select(_full_name(F.col("m")).alias("full"), _parts(F.col("m"))[3].alias("gender")).where("full is not null")
    gender = F.when(F.col("gender") != "n", F.col("gender"))
    known = persons.groupBy("full").agg(F.min(gender).alias("g"), F.max(gender).alias("other"), F.bool_or(F.col("gender") == "n").alias("neutral"))
    known = checkpointed(known.where("neutral and g = other").select("full", "g"))
    named = matches.withColumn("full", _full_name(F.col("m"))).join(known, "full", "left")
    units = checkpointed(named.select(F.explode(units_of(F.col("m"), F.col("g"))).alias("u")).select("u.kind", "u.canon").distinct())
    again = _redrawn(units, key).select(F.concat_ws("|", "kind", "canon").alias("name"), "attempt")
    return checkpointed(again.unionByName(known.select(F.concat(F.lit("gender|"), "full").alias("name"), F.when(F.col("g") == "m", 1).otherwise(2).alias("attempt"))))


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with a `text` whose entities are replaced, and a count `n_<kind>` of each of KINDS.

    Different entities stay different and equal ones equal, in all of docs.
    Digits keep their places and separators, numbers their country code or
    brand and check digits, names their gender (from the title), script,
    capitals and particle, secrets their alphabet.  Names found with a title
    are replaced wherever they stand as words of the same text (a name written
    like a capitalized word takes that along); counts are of titled ones.  A
    given name under titles of both genders stands for two people; where bare,
    it takes the female one's surrogate.  A text without entities, empty or
    null is left as it is.  Numbers that fail a card's or account's check
    digits are left alone.  Repeated rows are treated alike.  A column of docs
    named like a count is replaced.
    """
    table = checkpointed(docs.select(F.struct("*").alias("_row"), F.coalesce(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>")).alias("_found")))
    overridden = _overrides(checkpointed(table.select(F.explode("_found").alias("m")).distinct()), key)
    few = overridden.limit(PLAN_UNITS + 1).collect()
    overrides, rows = None, table
    if 0 < len(few) <= PLAN_UNITS:
        overrides = F.create_map(*[F.lit(x) for r in few for x in (r["name"], r["attempt"])])
    elif few:
        ids = [F.xxhash64("_found").alias("_k1"), F.xxhash64(F.lit("second"), F.col("_found")).alias("_k2")]
        each = table.where(F.size("_found") > 0).select(*ids, F.explode("_found").alias("m")).distinct()
        unit_names = F.flatten(F.array(*(F.transform(units_of(F.col("m"), F.lit(g)), lambda u: F.concat_ws("|", u["kind"], u["canon"])) for g in "nmf")))
        wanted = each.select("_k1", "_k2", F.explode(F.array_union(unit_names, F.array(F.coalesce(F.concat(F.lit("gender|"), _full_name(F.col("m"))), F.lit(""))))).alias("name")).distinct()
        own = wanted.join(overridden, "name").groupBy("_k1", "_k2").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("_overrides"))
        rows = rows.select("*", *ids).join(own, ["_k1", "_k2"], "left")
        overrides = F.col("_overrides")
    new = lambda m, kind: (lambda names: F.struct(m.alias("m"), kind.alias("kind"), F.when(kind != "person", _replacement(key, m, kind, overrides)).alias("new"), F.when(kind == "person", names[0]).alias("given"), F.when(kind == "person", names[1]).alias("surname")))(_names(key, m, overrides))
    rows = rows.withColumn("_kinds", F.transform("_found", lambda m: F.coalesce(kind_of(m), F.lit(""))))
    rows = rows.withColumn("_new", F.zip_with("_found", "_kinds", new))
    pairs = F.flatten(F.transform(F.filter("_new", lambda x: x["kind"] == "person"), lambda x: (lambda p: F.array(F.struct(p[1].alias("name"), x["given"].alias("new")), F.struct(p[2].alias("name"), x["surname"].alias("new"))))(_parts(x["m"]))))
    rows = rows.withColumn("_pairs", F.array_sort(F.array_distinct(F.filter(pairs, lambda x: x["name"] != ""))))
    rows = rows.withColumn("_names", F.map_from_entries(F.filter("_pairs", lambda x, i: (i == 0) | (F.get("_pairs", i - 1)["name"] != x["name"]))))

    def without_names(gap: Column) -> Column:
        bare = F.transform(F.regexp_extract_all(gap, F.lit(_BARE), F.lit(0)), lambda w: F.coalesce(F.try_element_at("_names", w), w))
        return F.array_join(F.zip_with(F.split(gap, _BARE, -1), bare, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    gaps = F.split("_row.text", PATTERN, -1)
    gaps = F.when(F.size("_pairs") == 0, gaps).otherwise(F.transform(gaps, without_names))
    written = F.transform("_new", lambda x: F.coalesce(x["new"], F.concat(_parts(x["m"])[0], F.when(_parts(x["m"])[1] != "", F.concat(x["given"], F.lit(" "))).otherwise(""), x["surname"])))
    text = F.when(F.size("_found") == 0, F.col("_row.text")).otherwise(F.array_join(F.zip_with(gaps, written, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), ""))
    counts = [(F.size("_kinds") - F.size(F.array_remove("_kinds", k))).cast("long").alias(f"n_{k}") for k in KINDS]
    names = {f"n_{k}" for k in KINDS}
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in names), *counts)
