"""Surrogates for personal data, with DataFrame functions only.

Entities are found by pattern and cut into units: a mail address, a number, or one word of a name. Every
distinct unit of the corpus gets one replacement, drawn with a key from the values of its type: same
format and length for numbers (cards keep a valid or invalid check digit), same gender and script for
given names, same script for surnames. Candidates that equal another unit's replacement, or any value that
really occurs, are drawn again, from a wider space where a format is crowded (longer names and numbers, addresses
of other networks), so that the draws always end. Different units stay different, and a unit looks the same wherever it
occurs: in another format, after a title, or alone in the text, given names as well as surnames.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.runtime import Scratch, fresh_name

# Given names by gender and script, titles by gender, syllables of made-up names.
GIVEN = {
    "GIVEN_M_LATIN": "James John Robert Michael William David Richard Joseph Thomas Charles Peter Hans Klaus Jürgen Pierre Jacques François José Carlos Miguel".split(),
    "GIVEN_F_LATIN": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Ursula Monika Sabine Brigitte Françoise Chantal Carmen Isabel Lucía Pilar".split(),
    "GIVEN_M_CYRILLIC": "Иван Пётр Сергей Дмитрий Алексей Николай Михаил Владимир Андрей Борис".split(),
    "GIVEN_F_CYRILLIC": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
}
TITLES = {"M": "Mr Herr Monsieur Señor господин".split(), "F": "Mrs Ms Miss Frau Madame Señora госпожа".split(), "": "Dr Prof".split()}
SYLLABLES = {
    "LATIN": "bal bren cor dal den fal gar hol kel lin mar nor pel quin ros sten tor val wen zan".split(),
    "CYRILLIC": "бал вер гор дан ждан зор кал лев мир нов пав рос сан тер фад хол цар чер шал юр".split(),
}
NAME = r"\p{Lu}[\p{L}'-]*\p{Ll}[\p{L}'-]*"
_TITLE = "|".join(t for group in TITLES.values() for t in group)
_GIVEN = "|".join(n for group in GIVEN.values() for n in group)
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
PERSON = rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? (?:{NAME} )?{NAME}|(?:{_GIVEN}) {NAME})"
ENTITY = "|".join([EMAIL, IP, SSN, PHONE, CARD, IBAN, PERSON])
#: Most texts have none of these, and are not searched further.
TRIGGER = rf"[@0-9]|(?<!\p{{L}})(?:{_TITLE}|{_GIVEN})(?!\p{{L}})"


def _words(names) -> Column:
    return F.array(*(F.lit(n.lower()) for n in names))


def kind_of(entity: Column) -> Column:
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(entity, F.lit("@")), "EMAIL").when(whole(IP), "IP").when(whole(SSN), "SSN").when(whole(PHONE), "PHONE")
        .when(whole(CARD), "CARD").when(whole(IBAN), "IBAN").otherwise("PERSON")
    )


def _is_title(word: Column) -> Column:
    return F.array_contains(_words(t for g in TITLES.values() for t in g), F.lower(F.rtrim(word, F.lit("."))))


def hits(text: Column) -> tuple[Column, Column]:
    """(entities in order, the pattern that finds them): names found once are also found alone."""
    first = F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    people = F.filter(first, lambda e: kind_of(e) == "PERSON")
    every = F.array_distinct(F.flatten(F.transform(people, lambda e: F.split(e, " "))))
    names = F.filter(every, lambda w: ~_is_title(w))
    alone = F.array_join(F.transform(names, lambda s: F.concat(F.lit("\\Q"), s, F.lit("\\E"))), "|")
    pattern = F.when(F.size(names) > 0, F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), alone, F.lit(r")(?!\p{L})"))).otherwise(F.lit(ENTITY))
    return F.when(F.size(names) > 0, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(first), pattern


def units(entity: Column) -> Column:
    """array<struct<unit, kind, canon>>: what is replaced; a title is not."""
    kind = kind_of(entity)
    plain = F.regexp_replace(entity, "[^0-9A-Za-z]", "")
    canon = F.when(kind == "EMAIL", F.lower(entity)).when(kind == "IP", entity).otherwise(plain)
    words = F.split(entity, " ")
    bare = lambda w: F.rtrim(w, F.lit("."))
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "CYRILLIC").otherwise("LATIN")
    led = lambda g: F.array_contains(_words(TITLES[g]), F.lower(bare(F.element_at(words, 1))))

    def of(w: Column, i: Column) -> Column:
        listed = F.lit(None).cast("string")
        for name, group in GIVEN.items():
            listed = F.when(F.array_contains(_words(group), F.lower(w)), name).otherwise(listed)
        gender = F.when(led("M"), "M").when(led("F"), "F").otherwise("X")
        guessed = F.when(i == F.size(words) - 1, F.concat(F.lit("SURNAME_"), script(w))).otherwise(F.concat(F.lit("GIVEN_"), gender, F.lit("_"), script(w)))
        last = (i == F.size(words) - 1) & (F.size(words) > 1)
        of_kind = F.when(last, F.concat(F.lit("SURNAME_"), script(w))).otherwise(F.coalesce(listed, guessed))
        return F.struct(i.cast("int").alias("unit"), F.when(_is_title(w), None).otherwise(of_kind).alias("kind"), F.lower(w).alias("canon"))

    person = F.filter(F.transform(words, of), lambda u: u["kind"].isNotNull())
    return F.when(kind == "PERSON", person).otherwise(F.array(F.struct(F.lit(0).alias("unit"), kind.alias("kind"), canon.alias("canon"))))


def _as_named(unit: Column, entity: Column) -> Column:
    """A word that stands alone has the kind that it has in the first person of its text (column named) with it."""
    before = F.get(F.filter("named", lambda n: n["canon"] == unit["canon"]), F.lit(0))["kind"]
    alone = ~F.contains(entity, F.lit(" ")) & unit["kind"].rlike("^(GIVEN|SURNAME)_")
    return F.struct(unit["unit"].alias("unit"), F.when(alone, F.coalesce(before, unit["kind"])).otherwise(unit["kind"]).alias("kind"), unit["canon"].alias("canon"))


def draw(kind: Column, canon: Column, key: str, attempt: int) -> Column:
    """A candidate for (kind, canon); other for each attempt."""
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), kind, canon, F.lit(str(attempt))), 512)

    def number(i: Column, digest: Column = digest) -> Column:
        return F.conv(F.substring(digest, (F.pmod(i, F.lit(32)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")

    def shaped(text: Column, digest: Column = digest) -> Column:
        """Digits become digits, letters letters of the same case; all else stays."""
        letter = lambda n: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))
        one = lambda c, i: F.when(c.rlike("[0-9]"), (number(i, digest) % 10).cast("string")).when(c.rlike("[a-z]"), letter(number(i, digest))).when(c.rlike("[A-Z]"), F.upper(letter(number(i, digest)))).otherwise(c)
        return F.array_join(F.transform(F.split(text, ""), one), "")

    more = F.substring(digest, F.lit(121), F.lit(min(8, 2 * max(0, attempt - 2)))) if attempt > 2 else F.lit("")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    of_domain = F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("DOMAIN"), domain), 512)
    ending = F.when(domain.rlike(r"\.(com|net|org)$"), F.substring_index(domain, ".", -1)).otherwise("com")
    mail = F.concat(shaped(local), more, F.lit("@"), shaped(F.substring_index(domain, ".", 1), of_domain), F.lit(".example."), ending)
    octet = lambda i: (number(F.lit(i)) % 256).cast("string")
    private = canon.rlike(r"^(10|127|192\.168)\.")
    address = F.concat_ws(".", F.when(private, F.substring_index(canon, ".", 2)).otherwise(F.concat((number(F.lit(0)) % 223 + 1).cast("string"), F.lit("."), octet(1))), octet(2), octet(3))
    if attempt >= 6:  # a private network that is nearly full
        address = F.when(private, F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))).otherwise(address)
    if attempt >= 12:
        group = lambda i: F.lower(F.hex(number(F.lit(i))))
        address = F.concat_ws(":", F.lit("2001:db8"), *(group(i) for i in range(6)))
    digits = max(0, attempt // 3 - 2)  # a format that is nearly full gets longer
    wide = F.concat(canon, F.lit("0" * digits))
    run = shaped(wide)
    body = F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(run, F.lit(2), F.length(wide) - 2))
    ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string")))
    luhn = lambda x: F.call_function("luhn_check", x)
    card = F.element_at(F.filter(ends, lambda x: luhn(x) == luhn(canon)), 1)
    long_phone = (F.length(canon) == 11) & canon.startswith("1")
    area = (number(F.lit(20)) % 8 + 2).cast("string")
    phone = F.when(long_phone, F.concat(F.lit("1"), area, F.substring(run, 3, 99))).when(F.length(canon) == 10, F.concat(area, F.substring(run, 2, 99))).otherwise(F.concat(F.substring(canon, 1, 1), F.substring(run, 2, 99)))
    iban = F.concat(F.substring(canon, 1, 2), F.substring(run, 3, 99))

    def made(script: str, syllables: int, ending: Column) -> Column:
        table = F.array(*(F.lit(s) for s in SYLLABLES[script]))
        return F.concat(*(F.get(table, number(F.lit(i + 8)) % len(SYLLABLES[script])) for i in range(syllables)), ending)

    name = F.lit(None).cast("string")
    for script in SYLLABLES:
        size = 3 + min(20, attempt // 3)
        name = F.when(kind == f"SURNAME_{script}", made(script, size, F.lit(""))).otherwise(name)
        for gender in "MFX":
            final = F.lit({"LATIN": "a", "CYRILLIC": "а"}[script] if gender == "F" else "")
            listed = _words(GIVEN.get(f"GIVEN_{gender}_{script}", GIVEN[f"GIVEN_M_{script}"] + GIVEN[f"GIVEN_F_{script}"]))
            given = F.get(listed, F.pmod(number(F.lit(1)), F.size(listed))) if attempt < 3 else made(script, size - 1, final)
            name = F.when(kind == f"GIVEN_{gender}_{script}", given).otherwise(name)
    return (
        F.when(kind == "EMAIL", mail).when(kind == "IP", address).when(kind == "SSN", run).when(kind == "CARD", card)
        .when(kind == "PHONE", phone).when(kind == "IBAN", iban).otherwise(name)
    )


def choose(found: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(kind, canon) distinct -> (kind, canon, surrogate), without two alike and without one that really occurs."""
    real = scratch.save(found.select("kind", "canon").distinct(), "units")
    given, waiting = None, real
    for attempt in itertools.count():
        drawn = waiting.withColumn("surrogate", draw(F.col("kind"), F.col("canon"), key, attempt))
        taken = real.select("kind", F.col("canon").alias("surrogate"))
        if given is not None:
            taken = taken.union(given.select("kind", "surrogate"))
        free = scratch.save(drawn.join(taken, ["kind", "surrogate"], "left_anti"), "drawn")
        first = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        won = scratch.save(first.select("kind", "canon", "surrogate"), "won")
        given = won if given is None else given.union(won)
        waiting = scratch.save(waiting.join(won, ["kind", "canon"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return given


def _rendered(entity: Column, chosen: Column) -> Column:
    """The entity with its units replaced (chosen: map of unit -> surrogate), in the entity's own format."""
    only = F.element_at(chosen, F.lit(0))
    filled = F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(only, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^0-9A-Za-z]", "")) + 1, F.lit(1))).otherwise(c))
    signs = F.length(F.regexp_replace(entity, "[^0-9A-Za-z]", ""))
    longer = F.concat(F.array_join(filled, ""), F.substring(only, signs + 1, F.length(only)))
    cased = lambda w, s: F.when(w == F.upper(w), F.upper(s)).otherwise(F.initcap(s))
    words = F.transform(F.split(entity, " "), lambda w, i: F.coalesce(cased(w, F.element_at(chosen, i.cast("int"))), w))
    kind = kind_of(entity)
    return F.when(kind.isin("EMAIL", "IP"), only).when(kind == "PERSON", F.array_join(words, " ")).otherwise(longer)


def replace_entities(docs: DataFrame, scratch: Scratch, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the entities of the text replaced; last, under a free name, their number.

    A null or empty text stays as it is. Rows with equal id and text get the same result. Which text an
    entity is in does not matter for its surrogate, only `key` does. An entity that a third of all texts
    holds is one row of the table of surrogates; the join to it can be split by adaptive execution.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text, ident = (F.col(f"c{docs.columns.index(c)}") for c in (text_col, id_col))
    keyed = plain.withColumn("id", ident.cast("string")).withColumn("text", text).withColumn("h", F.xxhash64("id", "text"))
    searched = keyed.select("id", "h", hits(F.col("text"))[0].alias("hits")).where(F.size("hits") > 0)
    people = F.filter("hits", lambda e: F.contains(e, F.lit(" ")) & (kind_of(e) == "PERSON"))
    searched = searched.select("id", "h", "hits", F.flatten(F.transform(people, units)).alias("named"))
    each = searched.select("id", "h", "named", F.posexplode("hits").alias("at", "entity"))
    found = each.select("id", "h", "at", "entity", F.explode(F.transform(units(F.col("entity")), lambda u: _as_named(u, F.col("entity")))).alias("u"))
    found = scratch.save(found.select("id", "h", "at", "entity", "u.unit", "u.kind", "u.canon"), "found")
    chosen = scratch.save(choose(found, scratch, key), "chosen")
    named = found.join(chosen, ["kind", "canon"]).groupBy("id", "h", "at", "entity").agg(F.map_from_entries(F.collect_set(F.struct("unit", "surrogate"))).alias("chosen"))
    shown = named.select("id", "h", "at", _rendered(F.col("entity"), F.col("chosen")).alias("shown"))
    per_text = shown.groupBy(F.col("id").alias("id_"), F.col("h").alias("h_")).agg(F.sort_array(F.collect_list(F.struct("at", "shown"))).alias("all"))  # bounded by one text
    joined = keyed.join(per_text, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    between = F.split(F.col("text"), hits(F.col("text"))[1], -1)
    by_place = F.map_from_entries(F.transform("all", lambda a: F.struct(a["at"], a["shown"])))
    woven = F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.element_at(by_place, i.cast("int")), F.lit(""))))
    replaced = F.when(F.col("all").isNull(), F.col("text")).otherwise(F.array_join(woven, ""))
    columns = [(replaced if n == text_col else F.col(f"c{i}")).alias(n) for i, n in enumerate(docs.columns)]
    count = F.when(F.col("all").isNull(), 0).otherwise(F.size("all"))
    return joined.select(*columns, count.alias(fresh_name(docs.columns, "entities")))
