"""String functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivel.functions import rules as R


def _folding() -> tuple[str, str]:
    """Letters with marks and their base letters, by Unicode's own decomposition (Latin, Greek and Cyrillic ranges)."""
    src, dst = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(base) == 1 and len(parts) > 1 and base[0].isalpha():
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_SRC, _DST = _folding()


def unused(columns: list[str], name: str) -> str:
    """A name for a helper column that none of the columns has."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: What str.strip() takes off: all of Unicode's white space, and the four separators before the space.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column | str) -> Column:
    """Without white space at both ends, of whatever kind."""
    return F.trim(c, F.lit(SPACES))


def one_of(patterns: list[str]) -> str:
    """One pattern for several, each with its own flags, under one anchor: an alternation without it is tried at every place of a text.

    Patterns that begin with ^ are tried at the start only; others follow whatever stands before them.
    """
    ways = []
    for p in patterns:
        flags, body = ("(?iu:", p[5:]) if p.startswith("(?iu)") else ("(?:", p)
        parts = body.split("|^") if body.startswith("^") else [body]
        ways.append(("" if body.startswith("^") else "(?s:.*)") + flags + "|".join(x.removeprefix("^") for x in parts) + ")")
    return r"\A(?:" + "|".join(ways) + ")"


def fold(c: Column) -> Column:
    """STR1: without diacritics, in lower case; đ stays."""
    return F.lower(F.regexp_replace(F.translate(c, _SRC, _DST), r"\p{Mn}", ""))


def folded(x: Column) -> Column:
    """`fold` of a value that is at hand, as x is used more than once: a text of ASCII letters has no marks to take off."""
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(fold(x))


def label(c: Column) -> Column:
    """STR2: folded, anything but letters, digits and spaces as a space, one space between."""
    return strip(F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def plain(c: Column) -> Column:
    """STR3"""
    return F.regexp_replace(strip(F.lower(c)), r"\s+", " ")


def is_noise(c: Column) -> Column:
    """FLT1: blank, or a page mark, a checkbox, a line to sign on."""
    return strip(c).rlike(one_of([r"^\z", *R.NOISE]))


def is_form_label(c: Column) -> Column:
    """FLT2: a field label of a form rather than data."""
    return strip(c).rlike(one_of(R.FORM_LABELS))


def is_data(c: Column) -> Column:
    """Neither noise nor a form label, of a line that is stripped already: one pattern, and no white space taken off again."""
    return ~c.rlike(one_of([r"^\z", *R.NOISE, *R.FORM_LABELS]))


def words_pattern(words: list[str]) -> str:
    """A pattern that finds a text with one of the words, for a search at every place.

    Common beginnings are written once, a word that begins with another one is left out, and a look at the first letter comes before all else.
    """
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        if "" in node:
            return ""
        ways = [re.escape(letter) + written(then) for letter, then in sorted(node.items())]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return "" if "" in root else f"(?=[{''.join(map(re.escape, sorted(root)))}]){written(root)}"


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether c holds one of the words (at least one is given). One pattern, so c is worked out once wherever it stands."""
    return c.rlike(words_pattern(words))


def first_hit(c: Column, table: dict[str, str]) -> Column:
    """MAP1: the value of the first keyword that c contains."""
    return F.coalesce(*(F.when(c.contains(k), F.lit(v)) for k, v in table.items()))


def name_parts(c: Column) -> Column:
    """STR4: struct of full, first, middle and last name, the honorific off."""
    def parts(full: Column, w: Column) -> Column:
        n = F.size(w)
        middle = F.when(n > 2, F.array_join(F.slice(w, 2, F.greatest(n - 2, F.lit(0))), " ")).otherwise("")
        return F.struct(full.alias("full"), F.when(n > 0, F.try_element_at(w, F.lit(1))).otherwise("").alias("first"), middle.alias("middle"), F.when(n > 0, F.try_element_at(w, F.lit(-1))).otherwise("").alias("last"))

    return bound(F.regexp_replace(strip(c), R.HONORIFIC, ""), lambda full: bound(F.filter(F.split(full, r"\s+"), lambda x: x != ""), lambda w: parts(full, w)))


def name_case(c: Column) -> Column:
    """STR5: names in capitals only get title case, a new word after anything but a letter."""
    words = lambda x: F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    titled = lambda x: F.array_join(F.transform(words(x), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    return bound(c, lambda x: F.when((x == F.upper(x)) & x.rlike(r"\p{L}"), titled(x)).otherwise(x))


def is_name(c: Column) -> Column:
    """FLT3: 2 to 6 words that read like a person's name. Patterns over the trimmed text, so c is used four times only."""
    t = strip(c)
    no_phrase = ~contains_any(fold(c), [*dict.fromkeys([*R.NAME_PHRASES, *R.ORG_WORDS])])
    words = t.rlike(r"^\s*[^\s@*#{}\[\]()=+<>]{1,15}(?:\s+[^\s@*#{}\[\]()=+<>]{1,15}){1,5}\s*$")
    two_of_letters = t.rlike(r"(?<!\S)\p{L}+(?!\S)[\s\S]*(?<!\S)\p{L}+(?!\S)")
    two_initials = t.rlike(r"(?<!\S)\S(?!\S)[\s\S]*(?<!\S)\S(?!\S)")
    return no_phrase & words & two_of_letters & ~two_initials


def is_family_name_first(c: Column) -> Column:
    """FLT4"""
    return F.coalesce(fold(F.element_at(F.split(strip(c), r"\s+"), 1)).isin(R.FAMILY_NAMES), F.lit(False))


def masked(c: Column) -> Column:
    """STR6: the first four and the last two characters."""
    return F.when(F.length(c) > 6, F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(2)))).otherwise(c)


def before_pipe(c: Column) -> Column:
    """STR7"""
    return F.when(c.contains("|"), strip(F.substring_index(c, "|", 1))).otherwise(c)


def without_bullet(c: Column) -> Column:
    """STR8"""
    return strip(F.regexp_replace(c, r"^[-•●○*+> ]+", ""))


def json_object(c: Column) -> Column:
    """STR9, RX17, JSN1: the outermost braces of a reply, fences off, commas before a closing bracket off."""
    body = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def prompt(text: Column, spec: str, pairs: Column, most: int = 12_000) -> Column:
    """STR10, FLT15: field spec, the first characters of the text, then its label and value lines."""
    return F.concat(F.lit(spec + "\n\n"), F.left(text, F.lit(most)), F.lit("\n\n"), F.array_join(F.transform(pairs, lambda p: F.concat(p["label"], F.lit(": "), p["value"])), "\n"))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def phone(c: Column) -> Column:
    """TVF18: the first phone number, a Vietnamese one before others, with 7 to 15 digits."""
    one = strip(F.coalesce(F.regexp_substr(c, F.lit(R.PHONE_VN)), F.regexp_substr(c, F.lit(R.PHONE_INTL))))
    return bound(one, lambda x: F.when(F.length(F.regexp_replace(x, r"\D", "")).between(7, 15), x))
