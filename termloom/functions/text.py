"""String functions on columns: tokens, normalisation, names and a light stemmer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRINTABLE = r"^[\x20-\x7E\t\n\r\x0B\x0C]*$"


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def separators_to_blanks(text: Column) -> Column:
    """Slashes, hyphens, double quotes and underscores give way to blanks."""
    return F.regexp_replace(text, '[/\\-"_]', " ")


def without_brackets(text: Column) -> Column:
    """Drops bracketed parts, round or square, shortest match first."""
    return F.regexp_replace(text, r"[\(\[].*?[\)\]]", "")


def punctuation_to_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[!-/:-@\[-`{-~]", " ")


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")


def query_characters(text: Column) -> Column:
    """Anything but word characters, # ( ) , : - and white space becomes a blank."""
    return F.regexp_replace(text, r"[^\w#(),:\-\s]+", " ")


def normalised(text: Column) -> Column:
    """Separators and punctuation as single blanks, lower case, trimmed."""
    return F.trim(F.regexp_replace(F.lower(punctuation_to_blanks(separators_to_blanks(text))), " +", " "))


def printable(text: Column) -> Column:
    return text.rlike(PRINTABLE)


def plain_name(name: Column) -> Column:
    """A name without brackets if it is then letters only, else null; lower case."""
    bare = without_brackets(name)
    return F.when(bare.rlike("^[A-Za-z]+$"), F.lower(F.trim(bare)))


def uri_leaf(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


# The suffix rules of Porter's stemmer (1980), longest suffix first where two fit.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Shapes of a stem: measure above 0, 1 and above 1, a vowel, consonant-vowel-consonant at the end.
SHAPES = {"m0": f"^({_C})?{_V}{_C}", "one": f"^({_C})?{_V}{_C}({_V})?$", "m1": f"^({_C})?{_V}{_C}{_V}{_C}", "vowel": f"^({_C})?[aeiouy]", "cvc": f"^{_C}[aeiouy][^aeiouwxy]$"}


class _Columns:
    """The steps of a stemmer in Spark columns; another class may build the same steps as text."""

    text = staticmethod(F.lit)
    test = staticmethod(lambda x, pattern: x.rlike(pattern))
    group = staticmethod(lambda x, pattern, k: F.regexp_extract(x, pattern, k))
    join = staticmethod(F.concat)
    last = staticmethod(lambda x, k: F.substr(x, F.length(x) - (k - 1), F.lit(1)))
    less = staticmethod(lambda x, k: F.substr(x, F.lit(1), F.length(x) - k))
    both = staticmethod(lambda a, b: a & b)
    neither = staticmethod(lambda a: ~a)
    same = staticmethod(lambda a, b: a == b)

    @staticmethod
    def let(x, body):
        return F.get(F.transform(F.array(x), body), F.lit(0))

    @staticmethod
    def case(pairs, default):
        out = default
        for condition, value in reversed(pairs):
            out = F.when(condition, value).otherwise(out)
        return out


def porter(word, by=_Columns):
    """The stem of a lower-case word by Porter's rules, from the pieces `by` offers; words of one or two letters stay."""
    t, j = by.test, by.join

    def suffixed(x, rules: dict, shape: str):
        pattern = f"^(.+?)({'|'.join(rules)})$"
        stem, end = by.group(x, pattern, 1), by.group(x, pattern, 2)
        return by.case([(by.both(t(x, pattern), by.both(by.same(end, by.text(k)), t(stem, SHAPES[shape]))), j(stem, by.text(v))) for k, v in rules.items()], x)

    def plural(x):
        return by.case([(t(x, "^.+(ss|i)es$"), by.less(x, 2)), (t(x, "^.+[^s]s$"), by.less(x, 1))], x)

    def past(x):
        eed, ed = "^(.+?)eed$", "^(.+?)(ed|ing)$"

        def mended(s):
            double = by.both(by.same(by.last(s, 1), by.last(s, 2)), t(s, "[^aeiouylsz]$"))
            return by.case([(t(s, "(at|bl|iz)$"), j(s, by.text("e"))), (double, by.less(s, 1)), (by.both(t(s, SHAPES["one"]), t(s, SHAPES["cvc"])), j(s, by.text("e")))], s)

        return by.case([(t(x, eed), by.case([(t(by.group(x, eed, 1), SHAPES["m0"]), by.less(x, 1))], x)), (by.both(t(x, ed), t(by.group(x, ed, 1), SHAPES["vowel"])), by.let(by.group(x, ed, 1), mended))], x)

    def final_y(x):
        return by.case([(by.both(t(x, "^.+y$"), t(by.less(x, 1), SHAPES["vowel"])), j(by.less(x, 1), by.text("i")))], x)

    def long_suffix(x):
        plain, ion = f"^(.+?)({'|'.join(STEP_4)})$", "^(.+?)(s|t)(ion)$"
        at = j(by.group(x, ion, 1), by.group(x, ion, 2))
        return by.case([(t(x, plain), by.case([(t(by.group(x, plain, 1), SHAPES["m1"]), by.group(x, plain, 1))], x)), (by.both(t(x, ion), t(at, SHAPES["m1"])), at)], x)

    def final_e(x):
        stem = by.less(x, 1)
        short = by.both(t(stem, SHAPES["one"]), by.neither(t(stem, SHAPES["cvc"])))
        return by.case([(by.both(t(x, "^.+e$"), t(stem, SHAPES["m1"])), stem), (by.both(t(x, "^.+e$"), short), stem)], x)

    def final_l(x):
        return by.case([(by.both(t(x, "ll$"), t(x, SHAPES["m1"])), by.less(x, 1))], x)

    def lowered(x):
        return by.case([(t(x, "^Y"), j(by.text("y"), by.group(x, "^Y(.*)$", 1)))], x)

    out = by.case([(t(word, "^y"), j(by.text("Y"), by.group(word, "^y(.*)$", 1)))], word)  # a first y is a consonant
    steps = (plural, past, final_y, lambda x: suffixed(x, STEP_2, "m0"), lambda x: suffixed(x, STEP_3, "m0"), long_suffix, final_e, final_l, lowered)
    for step in steps:
        out = by.let(out, step)
    return by.case([(t(word, "^[a-z]{3,}$"), out)], word)


def stem(term: Column) -> Column:
    """Porter's stem of a lower-case word; other terms stay. Best taken once a vocabulary term, not once a token."""
    return porter(term)


def without_marks(word: Column) -> Column:
    """A word without parentheses, 's, commas and apostrophes."""
    return F.regexp_replace(F.regexp_replace(word, r"\(|\)|'s|,", ""), "'", "")


def without_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", "")


def capitalised(text: Column) -> Column:
    """First letter upper case, all others lower."""
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def concept_uri(text: Column, language: str = "en") -> Column:
    """The address of a concept: /c/<language>/ and the lower-case words joined by underscores, articles left out."""
    words = F.filter(F.split(F.lower(F.trim(separators_to_blanks(text))), r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))
    return F.concat(F.lit(f"/c/{language}/"), F.array_join(words, "_"))


def inverted_map(mapping: Column) -> Column:
    """Values to keys; of several keys with one value the largest counts."""
    pairs = F.array_sort(F.transform(F.map_entries(mapping), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))))
    last = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i + 1)["value"] != p["value"], F.lit(True)))
    return F.map_from_arrays(F.transform(last, lambda p: p["value"]), F.transform(last, lambda p: p["key"]))


def merged_map(left: Column, right: Column) -> Column:
    """Both maps' entries; where keys meet the right one counts."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a blank; a single word stands for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, pairs).otherwise(words)
