"""Keyed surrogates for personal data, in DataFrame functions alone.

One pattern finds e-mail and network addresses, secrets, bank and social security numbers, phone and card numbers and
names; where a document names somebody, later mentions of the same surname or first name alone are found as well. An
entity's surrogate is drawn from a keyed digest of its canonical form, so that it is the same wherever the entity stands:
characters give way to others of their kind and script, separators, case, country codes, private address ranges and check
digits stay right. A name is replaced word by word: a listed first name by another of its gender and script, any other
word by an invented one, so that all mentions of a person agree. Surrogates that meet each other or an original are drawn
again until all distinct entities differ; where a format has too few values left for that, draws grow longer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import cut, drop_cut, small

#: Draws in an entity's own format; each one after them has a digit, syllable or other part more than the one before.
ROUNDS = 20

# First names by gender and script.
FEMALE = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Karen", "Sarah", "Lisa", "Nancy", "Sandra", "Betty", "Ashley", "Emily", "Kimberly", "Margaret", "Donna", "Michelle", "Carol", "Amanda", "Melissa", "Deborah", "Stephanie", "Dorothy", "Rebecca", "Sharon", "Laura", "Cynthia", "Amy", "Kathleen", "Angela", "Emma", "Anna", "Nicole", "Helen", "Alice", "Maria", "Julia")
MALE = ("James", "Robert", "John", "Michael", "David", "William", "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Daniel", "Matthew", "Anthony", "Mark", "Donald", "Steven", "Paul", "Andrew", "Joshua", "Kenneth", "Kevin", "Brian", "George", "Timothy", "Ronald", "Edward", "Jason", "Jeffrey", "Ryan", "Jacob", "Peter", "Eric", "Jonathan", "Stephen", "Frank", "Henry", "Walter", "Hans", "Carlos")
FEMALE_CYRILLIC = ("Мария", "Ольга", "Татьяна", "Ирина", "Наталья", "Светлана", "Елена", "Анна", "Екатерина", "Юлия")
MALE_CYRILLIC = ("Сергей", "Дмитрий", "Алексей", "Владимир", "Николай", "Михаил", "Иван", "Андрей", "Александр", "Павел")
# Titles.
TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Mrs", "Ms", "Miss", "Madam", "Madame", "Frau", "Señora", "Госпожа", "Dr", "Prof")
# Words that begin sentences and are no first names before a surname.
OPENERS = ("The", "This", "That", "These", "Those", "And", "But", "For", "From", "When", "While", "Where", "What", "Who", "Why", "How", "With", "Then", "There", "Here", "Yes", "Not", "His", "Her", "Their", "Our", "Your", "Its", "He", "She", "It", "They", "We", "You", "If", "In", "On", "At", "By", "To", "As", "So", "Or", "An", "Is", "Was", "Are", "Dear", "Der", "Die", "Das", "Und", "El", "La", "Los", "Las", "Le", "Les", "De", "Del", *TITLES)
# Letters that invented names are made of.
_OPEN, _VOWEL = "bdfgklmnprstvz", "aeiou"
_OPEN_CYRILLIC, _VOWEL_CYRILLIC = "бвгдклмнпрст", "аеиоу"
# Domains that are kept free for examples.
_RESERVED = (".com", ".net", ".org")

_GIVEN = "|".join((*FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC))
_TITLES = "|".join(TITLES)
_LEFT, _RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_WORD = r"\p{Lu}(?:\p{L}+|['’]\p{Lu}\p{L}+)(?:['’-]\p{Lu}\p{L}+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order in which they are tried, with a pattern for the whole entity.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,6}",
    "ip": rf"(?<![\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "secret": rf"{_LEFT}(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{36}}|sk-[0-9A-Za-z]{{20,64}}){_RIGHT}",
    "iban": rf"{_LEFT}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_RIGHT}",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}+-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\p{L}\p{N}])",
    "name": rf"{_LEFT}(?:(?:{_TITLES})\.? {_WORD}(?: {_WORD})?|(?:{_GIVEN})(?: {_WORD}){{1,2}}){_RIGHT}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these hold no entity.
HINT = rf"[0-9@]|AKIA|[0-9a-fA-F]{{32}}|gh[pousr]_|sk-|{_LEFT}(?:{_TITLES}|{_GIVEN})[. ]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entities(text: Column) -> Column:
    """All entities of a text in order, but for later mentions of names; an empty array for null."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _is_name(entity: Column) -> Column:
    """Of all entities only names are capitalised words with blanks between."""
    return entity.rlike(r"^\p{Lu}[^0-9@]* ")


def name_words(found: Column) -> Column:
    """The distinct words, titles left out, of the names among the entities of one text."""
    words = F.flatten(F.transform(F.filter(found, _is_name), lambda e: F.split(e, " ")))
    return F.array_distinct(F.filter(words, lambda w: ~F.regexp_replace(w, r"\.", "").isin(*TITLES)))


def mentions(words: Column) -> Column:
    """The pattern of entities and of mentions of the words, in capitals as well: each alone, or after another capitalised word that opens no sentence."""
    return F.concat(F.lit(rf"{PATTERN}|{_LEFT}(?:(?!(?:{'|'.join(OPENERS)}) ){_WORD} )?(?:"), F.array_join(F.array_distinct(F.concat(words, F.transform(words, F.upper))), "|"), F.lit(rf"){_RIGHT}"))


def kind(entity: Column) -> Column:
    """The first kind whose pattern the entity fits; a mention of a name fits none."""
    out = F.lit("name")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def canonical(entity: Column, kind_: Column) -> Column:
    """What all spellings of an entity share."""
    return (
        F.when(kind_ == "phone", F.regexp_replace(entity, r"[^0-9+]", ""))
        .when(kind_.isin("card", "ssn"), F.regexp_replace(entity, r"[^0-9]", ""))
        .when(kind_ == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind_ == "name", F.regexp_replace(entity, r"\.", ""))
        .when(kind_.isin("email", "word"), F.lower(entity))
        .otherwise(entity)
    )


def _digest(key: str, what: Column, attempt: Column, blocks: int = 5) -> Column:
    seed = F.concat_ws("\x1f", F.lit(key), attempt.cast("string"), what)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{b}")), 256) for b in range(blocks)])


def _byte(digest: Column, at: Column) -> Column:
    """The at-th byte of a hex digest, from 1; beyond its end it starts again."""
    return F.conv(F.substr(digest, F.pmod(at - 1, F.length(digest) / F.lit(2)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))


def _characters(text: Column, each) -> Column:
    """each(character, place from 1), joined again."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: each(F.substr(text, i, F.lit(1)), i)), "")


_LOWER, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"


def _like(character: Column, number: Column, hexadecimal: bool = False) -> Column:
    """A character of the same kind, case and script; separators stay."""
    latin = "abcdef" if hexadecimal else _LOWER
    return (
        F.when(character.rlike("[0-9]"), _letter("0123456789", number))
        .when(character.rlike(r"\p{IsCyrillic}"), F.when(F.upper(character) == character, F.upper(_letter(_CYRILLIC, number))).otherwise(_letter(_CYRILLIC, number)))
        .when(character.rlike(r"\p{Lu}"), _letter(latin.upper(), number))
        .when(character.rlike(r"\p{L}"), _letter(latin, number))
        .otherwise(character)
    )


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return total + F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _spelled(digits: Column, entity: Column) -> Column:
    """digits in the places of the entity's digits."""
    return _characters(entity, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(c))


def _more(attempt: Column) -> Column:
    """Parts by which a draw is longer than its format."""
    return F.greatest(attempt - F.lit(ROUNDS), F.lit(0))


def _longer(attempt: Column, each) -> Column:
    """each(place from 1) for all parts by which a draw is longer, joined; null where there are none."""
    return F.when(_more(attempt) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(_more(attempt), F.lit(1))), each), ""))


def _invented(word: Column, key: str, attempt: Column) -> Column:
    """An invented name of four syllables or more in the word's script and case."""

    def build(h: Column) -> Column:
        latin = F.concat(*[x for k in range(4) for x in (_letter(_OPEN, _byte(h, F.lit(2 * k + 1))), _letter(_VOWEL, _byte(h, F.lit(2 * k + 2))))])
        cyrillic = F.concat(*[x for k in range(4) for x in (_letter(_OPEN_CYRILLIC, _byte(h, F.lit(2 * k + 1))), _letter(_VOWEL_CYRILLIC, _byte(h, F.lit(2 * k + 2))))])
        own, open_, vowel = word.rlike(r"\p{IsCyrillic}"), lambda i: _byte(h, 2 * i + 7), lambda i: _byte(h, 2 * i + 8)
        latin = F.concat(latin, F.coalesce(_longer(attempt, lambda i: F.concat(_letter(_OPEN, open_(i)), _letter(_VOWEL, vowel(i)))), F.lit("")))
        cyrillic = F.concat(cyrillic, F.coalesce(_longer(attempt, lambda i: F.concat(_letter(_OPEN_CYRILLIC, open_(i)), _letter(_VOWEL_CYRILLIC, vowel(i)))), F.lit("")))
        made = F.when(own, cyrillic).otherwise(latin)
        return F.when(F.upper(word) == word, F.upper(made)).otherwise(F.concat(F.upper(F.substr(made, F.lit(1), F.lit(1))), F.substr(made, F.lit(2))))

    return _let(_digest(key, F.lower(word), attempt, 1), build)


def given_names(key: str) -> dict[str, str]:
    """For each listed first name another of its gender and script: the next one in an order that the key gives, so that distinct names stay distinct."""
    out = {}
    for names in (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC):
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1fgiven\x1f{n}".encode()).hexdigest())
        out.update(zip(order, [*order[1:], order[0]]))
    return out


def _name(entity: Column, key: str, attempt_of) -> Column:
    """A name replaced word by word; titles stay."""
    table = F.create_map(*[F.lit(x) for pair in given_names(key).items() for x in pair])

    def each(word: Column) -> Column:
        own = F.try_element_at(table, word)
        return F.when(F.regexp_replace(word, r"\.", "").isin(*TITLES), word).when(own.isNotNull(), own).otherwise(_let(attempt_of(F.lit("word"), F.lower(word)), lambda n: _invented(word, key, n)))

    return F.array_join(F.transform(F.split(entity, " "), each), " ")


def _mod97(text: Column) -> Column:
    """The number that digits and capitals (A is 10) spell, modulo 97."""

    def add(total: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.pmod(total * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(total * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def surrogate(entity: Column, kind_: Column, key: str, attempt_of) -> Column:
    """The entity's replacement, spelled like the entity; attempt_of(kind, canonical form) tells which draw. The kind should be a plain
    column or variable: it stands in many places."""
    other = _let(canonical(entity, kind_), lambda known: _let(attempt_of(kind_, known), lambda n: _drawn(entity, kind_, known, key, n)))
    return F.when(kind_.isin("word", "name"), _name(entity, key, attempt_of)).otherwise(other)


def _drawn(entity: Column, kind_: Column, known: Column, key: str, attempt: Column) -> Column:
    def drawn(digest: Column) -> Column:
        whole = _characters(entity, lambda c, i: _like(c, _byte(digest, i)))
        hexadecimal = _characters(entity, lambda c, i: _like(c, _byte(digest, i), True))
        kept = F.when(kind_ == "phone", F.when(known.rlike(r"^\+[17]"), 1).when(known.startswith("+"), 2).otherwise(0)).otherwise(0)
        bare = F.replace(known, F.lit("+"), F.lit(""))
        digits = _characters(bare, lambda c, i: F.when(i <= kept, c).otherwise(_letter("0123456789", _byte(digest, i))))
        checked = _let(F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("0")), lambda d: F.concat(F.substr(d, F.lit(1), F.length(d) - 1), F.pmod(_luhn(bare) - _luhn(d), F.lit(10)).cast("string")))
        octet = lambda o, n: F.when(F.length(o) == 1, F.pmod(n, F.lit(10))).when(F.length(o) == 2, 10 + F.pmod(n, F.lit(90))).otherwise(100 + F.pmod(n, F.lit(156)))
        parts = F.split(known, r"\.")
        # private ranges stay themselves; a public first octet gives way to one that no private or reserved range has
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        kept_octets = F.when(first.isin("10", "127"), 1).when((first == "192") & (second == "168"), 2).when((first == "169") & (second == "254"), 2).otherwise(0)
        inner = (first == "172") & (F.length(second) == 2) & second.between("16", "31")
        public = lambda n: F.when(F.length(first) == 1, 1 + F.pmod(n, F.lit(9))).when(F.length(first) == 2, 11 + F.pmod(n, F.lit(89))).otherwise(128 + F.pmod(n, F.lit(40)))
        longer = F.coalesce(_longer(attempt, lambda i: _letter("0123456789", _byte(digest, i + 100))), F.lit(""))
        # octets of any length first, then a number after them
        free = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: _byte(digest, i + 100).cast("string")), "."), F.when(_more(attempt) > 20, F.concat(F.lit("."), longer)).otherwise(F.lit("")))
        place = lambda o, i: F.when(i < kept_octets, o).when(inner & (i == 0), o).when(inner & (i == 1), (16 + F.pmod(_byte(digest, i + 1), F.lit(16))).cast("string")).when(i == 0, public(_byte(digest, i + 1)).cast("string")).otherwise(octet(o, _byte(digest, i + 1)).cast("string"))
        address = F.array_join(F.transform(parts, place), ".")
        tail = F.lower(F.regexp_extract(entity, r"(\.[\p{L}\p{N}-]+)$", 1))
        domain = F.regexp_extract(known, r"@(.*)\.[^.]+$", 1)
        mailbox = F.regexp_extract(entity, r"^([^@]*)@", 1)
        host = _let(_digest(key, F.concat(F.lit("domain\x1f"), domain, tail), F.lit(0)), lambda h: _characters(domain, lambda c, i: _like(c, _byte(h, i))))
        # below a name that no one can register
        mail = F.concat(_characters(mailbox, lambda c, i: _like(c, _byte(digest, i))), longer, F.lit("@"), host, F.lit(".example"), F.when(tail.isin(*_RESERVED), tail).otherwise(F.lit("")))
        country = F.substr(entity, F.lit(1), F.lit(2))
        base = F.concat(F.substr(whole, F.lit(5)), longer)
        account = F.concat(country, F.lpad((98 - _mod97(F.concat(F.replace(base, F.lit(" "), F.lit("")), country, F.lit("00")))).cast("string"), 2, "0"), base)
        prefixed = F.regexp_extract(entity, r"^(AKIA|gh[pousr]_|sk-)", 1)
        secret = F.when(prefixed != "", F.concat(prefixed, F.substr(whole, F.length(prefixed) + 1))).otherwise(hexadecimal)
        return (
            F.when(kind_ == "email", mail)
            .when(kind_ == "ip", F.when(_more(attempt) > 0, free).otherwise(address))
            .when(kind_ == "secret", F.concat(secret, longer))
            .when(kind_ == "iban", account)
            .when(kind_ == "card", F.concat(_spelled(checked, entity), longer))
            .otherwise(F.concat(_spelled(digits, entity), longer))
        )

    return _let(_digest(key, F.concat(kind_, F.lit("\x1f"), known), attempt), drawn)


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """(kind, known, attempt) of the entities of found(kind, known) whose first surrogate meets another or an original.

    Of those that meet, the smallest canonical form keeps its draw, unless that is an original. After ROUNDS draws an
    entity's space grows beyond its format, so that all differ in the end however full the format is.
    """
    drawn = cut(found.select("kind", "known", F.lit(0).alias("attempt")))
    while True:
        made = drawn.withColumn("made", _let(surrogate(F.col("known"), F.col("kind"), key, lambda kind_, known: F.col("attempt")), lambda s: canonical(s, F.col("kind"))))
        made = cut(made)
        first = made.groupBy("kind", "made").agg(F.min("known").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "made", "first")
        meets = made.join(first, ["kind", "made"]).where("known <> first").select("kind", "known")
        shows = made.select("kind", F.col("made").alias("known"), F.col("known").alias("from")).join(found, ["kind", "known"]).select("kind", F.col("from").alias("known"))
        again = cut(meets.union(shows).distinct())
        if again.isEmpty():
            return drawn.where("attempt > 0")
        drawn, before = cut(drawn.join(again.withColumn("_again", F.lit(1)), ["kind", "known"], "left").select("kind", "known", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt"))), drawn
        for done in (before, made, again):
            drop_cut(done)


def replaced(text: Column, words: Column, surrogates: Column) -> Column:
    """The text with its entities, in order, replaced; words: those whose mentions count as entities."""
    between = F.when(F.size(words) > 0, F.split(text, mentions(words), -1)).otherwise(F.split(text, PATTERN, -1))
    return F.array_join(F.flatten(F.transform(between, lambda s, i: F.array_compact(F.array(s, F.get(surrogates, i))))), "")


def _elements(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, kind, known of rows(keep, entity): what a surrogate is drawn for, a name's words that are not listed among them."""
    each = rows.withColumn("kind", kind(F.col("entity")))
    words = F.filter(F.split("entity", " "), lambda w: ~F.regexp_replace(w, r"\.", "").isin(*TITLES, *FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC))
    parts = F.when(F.col("kind") == "name", F.transform(words, lambda w: F.struct(F.lit("word").alias("kind"), F.lower(w).alias("known"))))
    return each.select(*keep, F.explode(F.coalesce(parts, F.array(F.struct(F.col("kind").alias("kind"), canonical(F.col("entity"), F.col("kind")).alias("known"))))).alias("e")).select(*keep, "e.kind", "e.known")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates for the entities in text_col, and columns _entities (how many) and _kinds (sorted, distinct, comma-joined).

    A null text stays null with no entities; texts without entities stay as they are. Equal entities get equal surrogates
    in all rows, distinct ones distinct surrogates, under the same key. Rows are told apart by numbers given to them, so
    that null and repeated ids are like any others; id_col is not read. All other columns pass; the new ones must be free
    names, columns that the plan adds on the way have names of their own. An empty table gives no rows.
    """
    free = lambda name: name + "_" * (1 + max((len(c) for c in docs.columns), default=0))  # noqa: E731 - longer than any column
    row, all_, named, draws = map(free, ("row", "found", "words", "draws"))
    text = F.col(text_col)
    base = docs.withColumn(all_, entities(text)).withColumn(named, name_words(F.col(all_)))
    base = base.withColumn(all_, F.when(F.size(named) > 0, F.regexp_extract_all(text, mentions(F.col(named)), F.lit(0))).otherwise(F.col(all_)))
    base = cut(base.withColumn(row, F.monotonically_increasing_id()))  # written: found once, and a row keeps its number
    found = cut(_elements(base.select(F.explode(all_).alias("entity")).distinct()).distinct())
    again = cut(redrawn(found, key))
    held = _elements(base.where(F.size(all_) > 0).select(row, F.explode(all_).alias("entity")), row).join(small(again, 100), ["kind", "known"])
    entry = F.struct(F.concat_ws("\x1f", "kind", "known").alias("key"), "attempt")
    rows = cut(held.groupBy(row).agg(F.map_from_entries(F.collect_set(entry)).alias(draws)))  # of one document those that were drawn again
    joined = base.join(small(rows, 200), row, "left")

    def attempt_of(kind_: Column, known: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(draws), F.concat_ws("\x1f", kind_, known)), F.lit(0))

    new = F.transform(all_, lambda e: _let(kind(e), lambda k: surrogate(e, k, key, attempt_of)))
    counted = {"_entities": F.size(all_).cast("long"), "_kinds": F.array_join(F.array_sort(F.array_distinct(F.transform(all_, kind))), ",")}
    return joined.withColumns(counted).withColumn(text_col, F.when(F.size(all_) > 0, replaced(text, F.col(named), new)).otherwise(text)).drop(row, all_, named, draws)


def surrogate_texts(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds of every document; cases as in pseudonymise()."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pseudonymise(docs, key).select("doc_id", "text", F.col("_entities").alias("n_entities"), F.col("_kinds").alias("kinds"))
