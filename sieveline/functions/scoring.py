"""Quality scores and the noise test as columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, blank_tokens, capitalised_count, chars_of, count_of, entity_count, once, stripped

DIMENSIONS = ("type", "length", "entity", "destructive", "template", "metadata")
FACTORS = ("type", "length", "entity", "stopwords", "template", "metadata")


@dataclass(frozen=True)
class Additive:
    """What sets the editions of the additive score apart."""

    weights: tuple[float, ...]
    types: tuple
    hedges: tuple[str, ...]
    hedge_scores: tuple[float, float]
    openings: tuple[str, ...]
    opening_score: float
    categories: dict[str, float]
    lengths: tuple[tuple[int, float], ...]
    short_circuits: bool = False
    fields: tuple[str, ...] = field(default=DIMENSIONS)


LONG = Additive(
    fixed.WEIGHTS_LONG, fixed.TYPE_LONG, tuple(dict.fromkeys(fixed.HEDGES_LONG)), (0.5, 0.2), fixed.OPENINGS_LONG, 0.2, fixed.CATEGORY_LONG,
    ((5, 0.05), (10, 0.1), (15, 0.2), (20, 0.3), (30, 0.4), (50, 0.5), (100, 0.7)), True,
)
SHORT = Additive(fixed.WEIGHTS_SHORT, fixed.TYPE_SHORT, fixed.HEDGES_SHORT, (0.7, 0.3), fixed.OPENINGS_SHORT, 0.4, fixed.CATEGORY_SHORT, ((50, 0.3),))

#: Dimensions that a short-circuit reports beside its score.
_SILENT = {"type": 0.7, "entity": 0.6, "destructive": 1.0, "template": 0.2, "metadata": 1.0}


def chosen(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first case that holds."""
    if not cases:
        return F.lit(otherwise)
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for test, value in cases[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def by_name(name: Column, values: dict[str, float], otherwise: float = 1.0) -> Column:
    return chosen([(name == k, v) for k, v in values.items()], otherwise)


def additive_dimensions(text: Column, category: Column, edition: Additive = LONG, low: Column | None = None, bare: Column | None = None) -> dict[str, Column]:
    """low, bare: the lower-cased and the stripped text, where they are at hand."""
    low, bare, n = F.lower(text) if low is None else low, stripped(text) if bare is None else bare, F.char_length(text)
    density = entity_count(text) / F.greatest(n / 100, F.lit(1.0))
    hedges = count_of(low, edition.hedges)
    middle = [((n >= 200) & (n <= 2000), 1.0), (n > 5000, 0.5)]
    #: One pattern with the anchor in front is tried at the start of the text only.
    opens = bare.rlike("(?iud)^(?:" + "|".join(f"(?:{p.removeprefix('^')})" for p in edition.openings) + ")")
    return {
        "type": chosen([(any_of(low, parts), score) for score, parts in edition.types], fixed.TYPE_ELSE),
        "length": chosen([*[(n < cut, score) for cut, score in edition.lengths], *middle], 0.8),
        "entity": chosen([(density > 5, 1.0), (density > 2, 0.8)], 0.6),
        "destructive": chosen([(hedges == 0, 1.0), (hedges <= 2, edition.hedge_scores[0])], edition.hedge_scores[1]),
        "template": chosen([(opens, edition.opening_score)], 1.0),
        "metadata": by_name(category, edition.categories),
    }


#: Score and length dimension of texts that say nothing, by the number of their test.
_SILENCES = ((0.3, 0.1), (0.2, 0.2), (0.25, 0.3), (0.2, 0.2))


def silence(bare: Column) -> Column:
    """The number of the first test that the stripped text meets, or null; the empty text is a filler."""
    n = F.char_length(bare)
    tests = [
        bare.isin(*fixed.GREETINGS) | ((n <= 40) & F.regexp_replace(bare, "[.!]+$", "").isin(*fixed.GREETINGS)) | bare.rlike(f"^(?:{'|'.join(fixed.GREETINGS)})[.!]+$"),
        (n <= 5) & bare.rlike(f"^[{fixed.FILLERS}]*$"),
        (n >= 3) & bare.rlike(f"^[{fixed.DOTS}]+$"),
        (n >= 3) & bare.rlike(r"(?s)^(.)\1+$"),
    ]
    return F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])


def _combined(dims: dict[str, Column], quiet: Column | None, edition: Additive) -> tuple[Column, dict[str, Column]]:
    total = reduce(lambda a, b: a + b, [dims[k] * F.lit(w) for k, w in zip(DIMENSIONS, edition.weights, strict=True)])
    if quiet is None:
        return total, dims
    by = lambda place: chosen([(quiet == i, x[place]) for i, x in enumerate(_SILENCES)], 0.0)
    return F.when(quiet.isNotNull(), by(0)).otherwise(total), {k: F.when(quiet.isNotNull(), by(1) if k == "length" else F.lit(_SILENT[k])).otherwise(v) for k, v in dims.items()}


def additive_score(text: Column, category: Column, edition: Additive = LONG) -> tuple[Column, dict[str, Column]]:
    """The score, and its dimensions, as columns. Over a table ``with_additive`` computes what they share once."""
    return _combined(additive_dimensions(text, category, edition), silence(stripped(text)) if edition.short_circuits else None, edition)


def with_additive(df: DataFrame, text: str = "content", category: str = "category", edition: Additive = LONG, out: str = "quality", dimensions: bool = False) -> DataFrame:
    """``df`` with the score, and with dimensions its parts as d_*.

    What several parts read (the stripped and the lower-cased text), and the parts that the total reads, are structs that come out
    of generators of one row: Spark doesn't paste their expressions into each place that reads them.
    """
    one, two = (_free(df, k) for k in ("__texts", "__parts"))
    t = F.col(f"`{text}`")
    rows = df.select("*", F.explode(F.array(F.struct(F.lower(t).alias("low"), stripped(t).alias("bare")))).alias(one))
    dims = additive_dimensions(t, F.col(f"`{category}`"), edition, F.col(one)["low"], F.col(one)["bare"])
    quiet = silence(F.col(one)["bare"]) if edition.short_circuits else F.lit(None).cast("int")
    rows = rows.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(F.struct(*[c.alias(k) for k, c in dims.items()], quiet.alias("quiet")))).alias(two))
    total, dims = _combined({k: F.col(two)[k] for k in DIMENSIONS}, F.col(two)["quiet"] if edition.short_circuits else None, edition)
    more = [c.alias(f"d_{k}") for k, c in dims.items()] if dimensions else []
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != out], total.alias(out), *more)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def stub_score(text: Column) -> Column:
    return F.when(stripped(text).isin(*fixed.GREETINGS_STUB), F.lit(0.3)).otherwise(F.lit(0.7))


def stop_share(text: Column, stop_chars: str = fixed.STOP_CHARS) -> Column:
    """Stop characters, none of them a blank, among those that aren't blank; null where there are none."""
    return F.try_divide(chars_of(text, stop_chars), F.char_length(F.translate(text, " \n\t", "")))


def multiplicative_score(text: Column, kind: Column, has_metadata: Column) -> Column:
    n = F.char_length(text)
    entities = capitalised_count(text) + count_of(text, fixed.ENTITY_WORDS)
    factors = [
        by_name(kind, fixed.TYPE_FACTOR),
        chosen([(n < 10, 0.5), (n < 20, 0.8), (n > 100, 1.1)], 1.0),
        chosen([(entities >= 2, 1.2), (entities == 0, 0.8)], 1.0),
        chosen([(F.coalesce(stop_share(text), F.lit(0.0)) > 0.5, 0.7)], 1.0),
        chosen([(any_of(text, fixed.TEMPLATE_PARTS), 0.6)], 1.0),
        chosen([(has_metadata, 1.1)], 1.0),
    ]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a * b, factors)))


def learner_features(text: Column, kind: Column, entities: Column, has_metadata: Column) -> dict[str, Column]:
    """The six factors that the learners weigh. entities: person, project and tech, joined."""
    n = F.char_length(text)
    share = chars_of(text, fixed.STOP_CHARS_LEARNER) / F.greatest(n, F.lit(1))
    return {
        "type": by_name(kind, fixed.TYPE_FACTOR),
        "length": chosen([(n < 10, 0.5), (n < 20, 0.8), (n > 100, 1.1)], 1.0),
        "entity": chosen([(F.char_length(entities) > 0, 1.2)], 0.8),
        "stopwords": chosen([(share > 0.5, 0.7)], 1.0),
        "template": chosen([(any_of(text, fixed.TEMPLATE_PARTS_LEARNER), 0.6)], 1.0),
        "metadata": chosen([(has_metadata, 1.1)], 1.0),
    }


def predicted_quality(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    w = dict.fromkeys(FACTORS, 1.0) | (weights or {})
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a * b, [F.lit(w[k]) * features[k] for k in FACTORS])))


#: Stop words of one character: they also count where the characters are looked at one by one.
_STOP_SIGNS = fixed.STOP_CHARS + "".join(w for w in fixed.STOP_WORDS if len(w) == 1)


def noise_counts(text: Column) -> Column:
    """A struct of what the noise test reads: all characters but U+0020 (chars), what stands between white space (words), how many of both are
    stop words (stops), and whether there is a placeholder. The words are the only list, and each is looked up in a set."""
    stops = [*dict.fromkeys([*fixed.STOP_CHARS, *fixed.STOP_WORDS])]
    found = lambda words: F.size(F.filter(words, lambda w: w.isin(*stops)))
    return once(
        blank_tokens(text),
        lambda words: F.struct(F.char_length(F.replace(text, F.lit(" "), F.lit(""))).alias("chars"), F.size(words).alias("words"), (chars_of(text, _STOP_SIGNS) + found(words)).alias("stops"), any_of(text, fixed.PLACEHOLDERS).alias("placeholder")),
    )


def noisy(counts: Column, min_tokens: int = 5, stop_ratio: float = 0.8) -> Column:
    """The noise test on ``noise_counts``."""
    every = counts["chars"] + counts["words"]
    return ((counts["chars"] < min_tokens) & (counts["words"] < min_tokens)) | (every == 0) | (F.coalesce(F.try_divide(counts["stops"], every), F.lit(0.0)) > stop_ratio) | counts["placeholder"]


def is_noise(text: Column, min_tokens: int = 5, stop_ratio: float = 0.8) -> Column:
    """Too short, mostly stop words, or with a placeholder."""
    return once(noise_counts(text), lambda counts: noisy(counts, min_tokens, stop_ratio))


def quality_band(score: Column, high: float = 0.7, low: float = 0.4) -> Column:
    return F.when(score >= high, "high").when(score < low, "low").otherwise("medium")
