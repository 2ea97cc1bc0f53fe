"""Text as columns: tokens, counts, layers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Unicode white space, spelled out: Spark's trim strips U+0020 only.
BLANK = "[\\s\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def any_of(text: Column, parts: list[str] | tuple[str, ...]) -> Column:
    """Whether any of the parts occurs."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def count_of(text: Column, parts: list[str] | tuple[str, ...]) -> Column:
    """How many of the parts occur; each counts once. The text is worked out once, and long lists stay out of the code."""
    words = F.array(*[F.lit(p) for p in parts])
    return once(text, lambda t: F.size(F.filter(words, lambda w: F.contains(t, w))))


#: The same characters one by one.
BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without blanks at both ends; what lies between isn't looked at."""
    return F.btrim(text, F.lit(BLANKS))


def chars_of(text: Column, chars: str) -> Column:
    """How many of a text's characters are among these: a table lookup a character, where a class of many in a pattern costs a search."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


# --- Tokens ---


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased; a run of Chinese characters is one token."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def char_tokens(text: Column) -> Column:
    """Characters, with signs taken for spaces and U+0020 left out; case and other white space stay."""
    plain = F.replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), F.lit(" "), F.lit(""))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, ""))


def raw_char_tokens(text: Column) -> Column:
    """All characters but U+0020."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, ""))


def blank_tokens(text: Column) -> Column:
    """What stands between white space, lower-cased."""
    return F.array_remove(F.split(F.lower(text), f"{BLANK}+"), "")


def overlap(query: Column, doc: Column) -> Column:
    """Shared distinct tokens over distinct query tokens."""
    own = F.array_distinct(query)
    return F.size(F.array_intersect(own, doc)) / F.greatest(F.size(own), F.lit(1))


# --- Layers ---


def abstract(text: Column, delimiter: str = ".", most: int = 400) -> Column:
    """The first sentence, stripped, then cut."""
    return F.substr(stripped(F.substring_index(text, delimiter, 1)), F.lit(1), F.lit(most))


def overview(text: Column, lines: int = 5, most: int = 8000) -> Column:
    """The first lines, cut."""
    return F.substr(F.substring_index(text, "\n", lines), F.lit(1), F.lit(most))


def layered(text: Column, delimiter: str = ".") -> dict[str, Column]:
    return {"l0": abstract(text, delimiter), "l1": overview(text), "l2": text}


def layer(name: str, columns: dict[str, Column]) -> Column:
    """l0, l1, or else l2."""
    return columns.get(name, columns["l2"])


def token_estimate(*texts: Column) -> Column:
    """A quarter of the characters, rounded down once."""
    return F.floor(reduce(lambda a, b: a + b, [F.char_length(t) for t in texts]) / 4).cast("long")


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text)


def percent(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", x * 100)


# --- Counts and parsers ---

ENTITIES = {"urls": r"https?://\S+", "emails": r"\S+@\S+", "code": r"`[^`]+`", "numbers": r"[0-9]+"}


def entity_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in ENTITIES.values()])


def capitalised_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z][a-z]+"))


def parsed_score(reply: Column, default: float = 0.5) -> Column:
    """The first number of a model's reply, within 0 and 1."""
    number = F.nullif(F.regexp_extract(reply, r"([0-9]*\.?[0-9]+)", 1), F.lit(""))
    return F.least(F.greatest(F.coalesce(number.try_cast("double"), F.lit(default)), F.lit(0.0)), F.lit(1.0))


def parsed_order(reply: Column, n: Column) -> Column:
    """The first array of indices in a model's reply, out-of-range ones skipped; without one the identity."""
    found = F.from_json(F.nullif(F.regexp_extract(reply, r"\[[0-9,\s]+\]", 0), F.lit("")), "array<int>")
    identity = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i - 1)
    return F.filter(F.coalesce(found, identity), lambda i: (i >= 0) & (i < n))


def parsed_verdict(reply: Column) -> Column:
    """A judge's verdict: success, partial or fail, by its words or its score."""
    complete = F.contains(reply, F.lit("是")) & ~F.contains(reply, F.lit("部分"))
    score = F.coalesce(F.nullif(F.regexp_extract(reply, r"([0-9]+)\s*分", 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(complete | (score >= 80), "success").when(F.contains(reply, F.lit("部分")) | (score >= 50), "partial").otherwise("fail")
