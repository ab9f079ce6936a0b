"""Surrogates for personal data, natively in Spark.

Every detected entity is replaced by one of its own kind: digits by digits, vowels by vowels,
consonants by consonants, of the same case and script, separators kept; card numbers keep
their check digit valid, addresses their top-level domain, given names their gender. The
replacement depends on a key and the entity alone, so an entity reads the same wherever it
stands. Entities that would share a surrogate, or get one that is itself a real entity,
draw again; what some rounds leave open is dealt out by rank within its format.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanmill.sources.scratch import Scratch

# Given names by gender and script.
GIVEN = {
    "female_latin": "Anna Maria Laura Julia Sophie Emma Clara Isabel Carmen Claire Ingrid Mary Susan Linda",
    "male_latin": "John Peter Paul Thomas Michael Hans Karl Pierre Louis Carlos Miguel Robert James David",
    "female_cyrillic": "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана",
    "male_cyrillic": "Иван Пётр Сергей Дмитрий Алексей Николай Андрей Михаил",
    "female_greek": "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη",
    "male_greek": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος",
}
# Titles that a name follows.
TITLES = (
    "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Señor Señora Sr Sra Don Doña Monsieur Madame Mme"
    " Господин Госпожа Κύριος Κυρία"
)
# Letters that are exchanged among themselves.
LETTERS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäåèéêëìíîïòóôöøùúûü", "ÀÁÂÄÅÈÉÊËÌÍÎÏÒÓÔÖØÙÚÛÜ", "çñšžß", "ÇÑŠŽ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
DIGITS = "0123456789"
# Rounds of draws before the entities still open are ranked.
_DRAWS = 6

_GIVEN = "|".join(name for names in GIVEN.values() for name in names.split())
_TITLES = "|".join(TITLES.split())
# A capitalised word that is no title, without a possessive 's.
_PART = r"\p{L}|['’-](?=\p{L})(?![sS](?!\p{L}))"
_NAME = rf"(?!(?:{_TITLES})(?!\p{{L}}))\p{{Lu}}(?:{_PART})+"
#: In order; where several could begin at one place the first wins.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "name": rf"(?=\p{{Lu}})(?:(?<!\p{{L}})(?:{_GIVEN})(?: {_NAME})*(?!\p{{L}})"
    rf"|(?<=(?<!\p{{L}})(?:{_TITLES})\.? ){_NAME}(?: {_NAME})*)",
}
# What begins with a digit, sign or bracket is looked for only there, names at capitals.
_NUMBERS = "|".join(f"(?:{KINDS[kind]})" for kind in ("ip", "card", "ssn", "phone"))
PATTERN = f"{KINDS['email']}|(?=[0-9(+])(?:{_NUMBERS})|{KINDS['name']}"
# Any other capitalised word: an entity where it is a word of a name found in the same text.
# It stops where an entity can begin within it, at an address or a hyphened given name.
_MENTION = (
    r"(?<!\p{L})(?=\p{Lu})(?![\p{L}0-9._%+'’-]*@)"
    + _NAME.replace(_PART, rf"\p{{L}}|(?!.(?:{_GIVEN})(?!\p{{L}}))(?:{_PART})") + r"(?!\p{L})"
)
EVERY = f"({PATTERN})|{_MENTION}"


def kind_of(entity: Column) -> Column:
    whole = [F.when(entity.rlike(f"^(?:{p})$"), kind) for kind, p in KINDS.items() if kind != "name"]
    return F.coalesce(*whole, F.lit("name"))


def _drawn(seed: Column, at: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, at), F.lit(n)).cast("int")


def _alike(c: Column, at: Column, seed: Column, sets: list[str]) -> Column:
    """A character of the same set as `c`; others stay."""
    out = c
    for letters in sets:
        pick = F.substring(F.lit(letters), _drawn(seed, at, len(letters)) + 1, F.lit(1))
        out = F.when(F.instr(F.lit(letters), c) > 0, pick).otherwise(out)
    return out


def _each(text: Column, seed: Column, sets: list[str], start: int = 0) -> Column:
    """Every character but the first `start` exchanged."""
    return F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c, i: F.when(i < start, c).otherwise(_alike(c, i, seed, sets)),
        ),
        "",
    )


def _luhn_sum(number: Column) -> Column:
    """Luhn sum of the digits of a text, doubling every second one from the right."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def _card(entity: Column, seed: Column) -> Column:
    """Issuer digit kept, and the check digit valid where it was."""
    drawn = _each(entity, seed, [DIGITS], start=1)
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    return F.when(_luhn_sum(entity) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(drawn)


def _address(entity: Column, seed: Column, key: str) -> Column:
    """Local part by the whole address, domain by the domain alone, last label kept."""
    sets = [DIGITS, *LETTERS[:4]]
    domain = F.substring_index(entity, "@", -1)
    last = F.substring_index(domain, ".", -1)
    front = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    of_domain = F.sha2(F.concat(F.lit(f"{key}|domain|"), F.lower(domain)), 256)
    return F.concat(
        _each(F.substring_index(entity, "@", 1), seed, sets), F.lit("@"),
        _each(front, of_domain, sets), F.lit("."), last,
    )


def _moved(word: Column, key: str) -> Column:
    """A listed given name moved round within its list."""
    out = F.lit(None).cast("string")
    for group, listed in GIVEN.items():
        names = F.array(*map(F.lit, listed.split()))
        n = len(listed.split())
        # A step from 1 to n - 1 that the key fixes: no name stays, no two meet.
        step = F.pmod(F.xxhash64(F.lit(f"{key}|{group}")), F.lit(n - 1)) + 1
        place = (F.array_position(names, word) - 1 + step) % n
        out = F.when(F.array_contains(names, word), F.get(names, place.cast("int"))).otherwise(out)
    return out


def _word(word: Column, key: str, attempt: Column) -> Column:
    """Another word by letters; one that holds none of LETTERS is spelled in Latin ones."""
    seed = F.sha2(F.concat(F.lit(f"{key}|name|"), word, F.lit("|"), attempt.cast("string")), 256)
    known = word.rlike(f"[{''.join(LETTERS)}]")
    spelled = F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "B"), r"[\p{L}&&[^B]]", "b")
    return _each(F.when(known, word).otherwise(spelled), seed, LETTERS)


def _code(phone: Column) -> Column:
    return F.regexp_extract(phone, r"^\+[0-9]{1,3}(?=[ .(-])", 0)


def surrogate(kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """A draw for an entity that is no name, or for a "word" of a name."""
    parts = [F.lit(f"{key}|"), kind, F.lit("|"), entity, F.lit("|"), attempt.cast("string")]
    seed = F.sha2(F.concat(*parts), 256)
    octet = F.transform(
        F.split(entity, r"\."), lambda _, i: (_drawn(seed, i, 254) + 1).cast("string")
    )
    code = F.length(_code(entity))
    return (
        F.when(kind == "email", _address(entity, seed, key))
        .when(kind == "ip", F.array_join(octet, "."))
        .when(kind == "card", _card(entity, seed))
        .when(
            kind == "phone",
            F.concat(
                F.substring(entity, F.lit(1), code),
                _each(F.substring(entity, code + 1, F.length(entity)), seed, [DIGITS]),
            ),
        )
        .when(kind == "ssn", _each(entity, seed, [DIGITS]))
        .otherwise(_word(entity, key, attempt))
    )


def _form(kind: Column, entity: Column) -> list[Column]:
    """`head`, `form`, `tail`: what stays of an entity, and its letters and digits by set."""
    none = F.lit("")
    head = F.when(kind == "phone", _code(entity)).otherwise(none)
    tail = F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(entity, "@", -1))).otherwise(none)
    body = F.substring(entity, F.length(head) + 1, F.length(entity) - F.length(head) - F.length(tail))
    sets = [DIGITS, *LETTERS]
    form = F.translate(body, "".join(sets), "".join(x[0] * len(x) for x in sets))
    return [head.alias("head"), form.alias("form"), tail.alias("tail")]


def _by_set(c: Column, value, other: Column) -> Column:
    out = other
    for letters in [DIGITS, *LETTERS]:
        out = F.when(c == letters[0], value(letters)).otherwise(out)
    return out


def _members(form: Column) -> Column:
    """How many texts have a form, 2^60 at most."""
    size = lambda c: _by_set(c, lambda x: F.lit(float(len(x))), F.lit(1.0))
    n = F.aggregate(F.split(form, ""), F.lit(1.0), lambda n, c: n * size(c))
    return F.least(n, F.lit(2.0**60)).cast("long")


def _member(form: Column, number: Column) -> Column:
    """The text of that number among those of a form."""

    def more(made, c):
        n = _by_set(c, lambda x: F.lit(len(x)), F.lit(1)).cast("long")
        at = (made["rest"] % n + 1).cast("int")
        letter = _by_set(c, lambda x: F.substring(F.lit(x), at, F.lit(1)), c)
        rest = F.call_function("div", made["rest"], n)
        return F.struct(rest.alias("rest"), F.concat(made["made"], letter).alias("made"))

    start = F.struct(number.cast("long").alias("rest"), F.lit("").alias("made"))
    return F.aggregate(F.split(form, ""), start, more)["made"]


def _spelled(kind: Column, entity: Column, key: str) -> Column:
    """A text of 60 keyed bits in no form that entities have, where a form's texts run out."""
    seed = F.sha2(F.concat(F.lit(f"{key}|spare|"), kind, F.lit("|"), entity), 256)
    digits = F.lpad(F.conv(F.substring(seed, F.lit(1), F.lit(15)), 16, 10), 19, "0")
    letters = F.translate(F.substring(seed, F.lit(1), F.lit(15)), "0123456789abcdef", "bcdfghklmnprstvz")
    return (
        F.when(kind == "email", F.concat(F.lit("user."), letters, F.lit("@"), F.substring_index(entity, "@", -1)))
        .when(kind == "ip", F.regexp_replace(digits, r"(.{3})(?=.)", "$1."))
        .when(kind == "word", F.initcap(letters))
        .otherwise(digits)
    )


def _ranked(checked: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Exact surrogates for all entities of the forms in which a draw is still open.

    Entities and free texts of a form are both ranked by a keyed hash and meet by rank. Real
    ones are dealt out only where a form has no other left, and none to itself: an entity
    without a partner gets a longer text of its own, as do addresses and card numbers, whose
    forms hold texts that are none.
    """
    form = ["kind", "head", "form", "tail"]
    rank = lambda c: F.xxhash64(F.lit(f"{key}|rank"), c)
    kind = F.col("kind")
    formed = checked.select("kind", "entity", "again", *_form(kind, F.col("surrogate")))
    busy = scratch.keep(
        formed.groupBy(*form).agg(F.max("again").alias("open"), F.count("*").alias("n")).where("open"),
        "busy",
    )
    spelled = _spelled(kind, F.col("entity"), key)
    strict = kind.isin("ip", "card")
    checked = checked.withColumn(
        "surrogate", F.when(F.col("again") & strict, spelled).otherwise(F.col("surrogate"))
    )
    busy = busy.where(~strict)
    real = checked.select("kind", F.col("entity").alias("member"), *_form(kind, F.col("entity")))
    real = scratch.keep(real.join(busy, form, "left_semi"), "busy_real")
    held = real.groupBy(*form).agg(F.count("*").alias("held"))
    given = _GIVEN.split("|")
    # So many texts hold enough free ones, if the form has them.
    sized = busy.join(held, form, "left").withColumn("size", _members(F.col("form")))
    enough = F.least("size", F.col("n") + F.coalesce("held", F.lit(0)) + len(given))
    first = F.pmod(rank(F.concat("head", "form", "tail")), F.col("size"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), enough - 1)).alias("i")
    text = _member(F.col("form"), (F.col("i") + F.col("first")) % F.col("size"))
    texts = (
        sized.select(*form, "size", first.alias("first"), numbers)
        .select(*form, F.concat("head", text, "tail").alias("member"))
        .where((kind != "word") | ~F.col("member").isin(given))
        .join(real.withColumn("real", F.lit(1)), [*form, "member"], "left")
        .withColumn("real", F.coalesce("real", F.lit(0)))
    )
    in_form = Window.partitionBy(*form)
    texts = scratch.keep(
        texts.withColumn("place", F.row_number().over(in_form.orderBy("real", rank(F.col("member")), "member")))
        .withColumn("free", F.sum(1 - F.col("real")).over(in_form))
        .withColumn("all", F.count("*").over(in_form)),
        "texts",
    )
    own = texts.where("real = 1").select(*form, F.col("member").alias("entity"), F.col("place").alias("own"))
    counts = texts.select(*form, "free", "all").distinct()
    order = in_form.orderBy(F.col("own").isNull(), rank(F.col("entity")), "entity")
    # Real texts follow the free ones in the same order, so rank i gets the real one i - free.
    place = F.when(F.col("free") > 0, F.row_number().over(order)).otherwise(F.col("own") % F.col("all") + 1)
    dealt = (
        formed.join(busy.select(*form), form).join(own, [*form, "entity"], "left").join(counts, form, "left")
        .withColumn("place", place)
        .join(texts.select(*form, "place", F.col("member").alias("surrogate")), [*form, "place"], "left")
        .withColumn("none", F.coalesce(F.col("surrogate") == F.col("entity"), F.lit(True)))
        .select("kind", "entity", F.when(F.col("none"), spelled).otherwise(F.col("surrogate")).alias("surrogate"))
    )
    dealt = scratch.keep(dealt, "dealt")
    rest = checked.select("kind", "entity", "surrogate", *_form(kind, F.col("surrogate")))
    return rest.join(busy, form, "left_anti").select("kind", "entity", "surrogate").union(dealt)


def _distinct(items: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """`kind`, `entity`, `surrogate` by draws, and by rank where draws don't settle it."""
    rows = items.withColumn("attempt", F.lit(0))
    for step in range(_DRAWS):
        drawn = scratch.keep(
            rows.withColumn(
                "surrogate", surrogate(F.col("kind"), F.col("entity"), key, F.col("attempt"))
            ),
            f"drawn_{step}",
        )
        alike = Window.partitionBy("kind", "surrogate").orderBy("attempt", "entity")
        real = drawn.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        listed = (F.col("kind") == "word") & F.col("surrogate").isin(_GIVEN.split("|"))
        checked = (
            drawn.withColumn("nth", F.row_number().over(alike))
            .join(real, ["kind", "surrogate"], "left")
            .withColumn("again", (F.col("nth") > 1) | F.col("real").isNotNull() | listed)
        )
        checked = scratch.keep(checked, f"checked_{step}")
        if checked.where("again").isEmpty():
            return drawn.select("kind", "entity", "surrogate")
        rows = checked.select(
            "kind", "entity", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")
        )
    return _ranked(checked, key, scratch)


def assigned(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """`kind`, `entity`, `surrogate`, all surrogates of a kind distinct and none of them real.

    A word of a name keeps its surrogate in every name: listed given names move within their
    lists, where others move along, so a single one may read as another real one; all other
    words get one that is no word of any name, so no name with such a word is met again. A
    name of listed words alone has its last one exchanged like a family name. Only a form of
    which more than half of all texts are real entities hands real ones round.
    """
    name = F.col("kind") == "name"
    words = F.split("entity", " ")
    listed = F.array(*map(F.lit, _GIVEN.split("|")))
    only_listed = F.size(F.array_except(words, listed)) == 0
    parts = scratch.keep(
        entities.where(name)
        .select("entity", only_listed.alias("only"), F.size(words).alias("n"), F.posexplode(words).alias("pos", "word"))
        .withColumn(
            "given",
            F.array_contains(listed, F.col("word"))
            & ~(F.col("only") & (F.col("n") > 1) & (F.col("pos") == F.col("n") - 1)),
        ),
        "parts",
    )
    exchanged = parts.where("NOT given").select(F.lit("word").alias("kind"), F.col("word").alias("entity"))
    items = entities.where(~name).select("kind", "entity").union(exchanged.distinct())
    made = _distinct(items, key, scratch)
    of_words = made.where("kind = 'word'").select(F.col("entity").alias("word"), "surrogate")
    spelled = parts.where("NOT given").join(of_words, "word").select("entity", "pos", "surrogate").union(
        parts.where("given").select("entity", "pos", _moved(F.col("word"), key))
    )
    in_order = F.sort_array(F.collect_list(F.struct("pos", "surrogate")))
    named = spelled.groupBy("entity").agg(F.array_join(in_order["surrogate"], " ").alias("surrogate"))
    return made.where("kind <> 'word'").union(named.select(F.lit("name"), "entity", "surrogate"))


def replace_entities(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """`row` (all columns of the document), `safe_text`, `n_entities`.

    The words of the names found in a text are replaced wherever else they stand in it as whole
    words of the same capitals. Null texts stay null, texts without entities stay as they are.
    Rows with equal texts get equal results. An empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    digest = F.xxhash64("text").alias("digest")
    # Rows equal in doc_id and text bring the same entities; once each is enough.
    sure = scratch.keep(
        rows.where(has)
        .select("doc_id", digest, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("sure"))
        .select("doc_id", "digest", F.explode(F.array_distinct("sure")).alias("entity"))
        .distinct()
        .withColumn("kind", kind_of(F.col("entity"))),
        "sure",
    )
    words = sure.where("kind = 'name'").select(
        "doc_id", "digest", F.explode(F.split("entity", " ")).alias("entity"), F.lit("name").alias("kind")
    )
    found = scratch.keep(sure.select(*words.columns).union(words).distinct(), "found")
    names = assigned(found.select("kind", "entity").distinct(), key, scratch)
    by_row = (
        found.join(names, ["kind", "entity"])
        .groupBy(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"))
        .agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("new"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.xxhash64("text") == F.col("of_digest"))
    # What stands between the entities and mentions, and they themselves: new where they are known.
    gaps = F.split("text", EVERY, -1)
    met = F.regexp_extract_all("text", F.lit(EVERY), F.lit(0))
    put = F.transform(met, lambda x: F.coalesce(F.try_element_at("new", x), x))
    woven = F.zip_with(gaps, put, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    n_entities = F.size(F.filter(met, lambda x: F.map_contains_key("new", x)))
    changed = (
        rows.where(has).join(by_row, same)
        .select("row", F.array_join(woven, "").alias("safe_text"), n_entities.alias("n_entities"))
    )
    kept = rows.where(~has).select("row", F.col("text").alias("safe_text"), F.lit(0).alias("n_entities"))
    return kept.union(changed)
