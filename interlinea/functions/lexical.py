"""Scalar text functions as Column expressions: trimming, normalising English, counting it, suffixes, ordinals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space in texts: also the no-break space, which Java's \s leaves out.
WS = r"[\s\x{A0}]"

# Steps of the normaliser, in order; each is (pattern, replacement) on the trimmed text and a space.
HYPHEN_AFFIXES = (
    "-level|-final|-initial|-medial|-like|-reference|tense-|sub-|inter-|intra-|cross-|extra-|"
    "pre-|post-|mid-|self-|proto-|morpho-|semi-|trans-|non-"
)
#: Whether a text has one of these: it is asked at hyphens only, where the alternatives themselves would be tried at every place.
HAS_AFFIX = "-(?:level|final|initial|medial|like|reference|(?<=(?:tense|sub|inter|intra|cross|extra|pre|post|mid|self|proto|morpho|semi|trans|non)-))"
#: White space that isn't one plain space.
WIDE = rf"{WS}{{2,}}|[\t-\r" "\xa0]"
BEFORE_LOWER = [
    (WIDE, " "),
    (HYPHEN_AFFIXES, ""),
    ("/.{1,2}/", ""),
    ("([^.] )[A-Z][a-z]+", r"\1"),
    (r"[(\[]?[0-9]+(?:\.[0-9])?%?[)\]]?", ""),
    (" [A-Z]{2,} ", " "),
]
AFTER_LOWER = [
    ("[/~]", " "),
    ("n[’']t", ""),
    ("[’'](?:s|d|ll|ve|m|re) ", " "),
    (r"[.,!?:;‘’“”(){}\[\]]", ""),
    (r"(^| )vs\.? ", "versus "),
    (" +$", ""),
]
#: A small lexicon of function words for when none is given.
FUNCTION_WORDS = "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you".split()
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx xxi xxii xxiii xxiv xxv xxvi xxvii xxviii xxix xxx xxxi xxxii xxxiii xxxiv xxxv xxxvi xxxvii xxxviii xxxix xl xli xlii xliii xliv xlv xlvi xlvii xlviii xlix".split()


def _java(replacement: str) -> str:
    return replacement.replace("\\1", "$1").replace("\\2", "$2")


def trim(text: Column) -> Column:
    """Without white space at either end, no-break spaces included."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\xa0"))


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """The first match only; regexp_replace replaces all."""
    return F.regexp_replace(text, f"^([\\s\\S]*?)(?:{pattern})", "$1" + replacement)


def has_any(text: Column, parts: list[str] | str) -> Column:
    """Whether a text holds one of some plain strings: a look at its bytes, where a pattern would make a string of it first."""
    return reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


#: White space other than the plain space, and what else `$` may stand before.
ODD_SPACES = ["\t", "\n", "\x0b", "\f", "\r", "\xa0"]
LINE_ENDS = ["\n", "\r", "\x85", "\u2028", "\u2029"]


def is_wide(text: Column) -> Column:
    """Whether WIDE matches somewhere."""
    return has_any(text, ["  ", *ODD_SPACES])


def simplify_english(text: Column) -> Column:
    """Lower-case words without names, numbers, acronyms, clitics and punctuation."""
    out = F.concat(trim(text), F.lit(" "))
    for pattern, replacement in BEFORE_LOWER:
        new = F.regexp_replace(out, pattern, _java(replacement))
        out = F.when(out.rlike(HAS_AFFIX), new).otherwise(out) if pattern == HYPHEN_AFFIXES else new
    out = F.lower(out)
    for pattern, replacement in AFTER_LOWER:
        out = F.regexp_replace(out, pattern, _java(replacement))
    return out


def tokens(simplified: Column) -> Column:
    """White-space tokens and an empty last one, as the counts expect."""
    # A pattern of one plain character is the only kind that split() doesn't compile anew for each row.
    return F.split(F.regexp_replace(F.concat(simplified, F.lit(" ")), WIDE, " "), " ", -1)


def with_tokens(d: DataFrame, text: str, out: str) -> DataFrame:
    """d with tokens(simplify_english(text)) as a column.

    A step is only taken on texts that hold what its pattern can't match without: most lines have little of it, and patterns are what costs. Each step
    is a column, as it is named more than once in the next."""
    c = F.col(out)

    def step(guard: Column, pattern: str, replacement: str) -> None:
        nonlocal d
        d = d.withColumn(out, F.when(guard, F.regexp_replace(c, pattern, _java(replacement))).otherwise(c))

    (wide, affixes, slashes, names, numbers, acronyms), (marks, negations, clitics, punctuation, versus, spaces) = BEFORE_LOWER, AFTER_LOWER
    d = d.withColumn(out, F.concat(trim(F.col(text)), F.lit(" ")))
    step(is_wide(c), *wide)
    step(c.contains("-") & c.rlike(HAS_AFFIX), *affixes)
    step(c.contains("/"), *slashes)
    step(F.lower(c) != c, *names)
    step(c.rlike("[0-9]"), *numbers)
    step(c.rlike(" [A-Z]{2}"), *acronyms)
    d = d.withColumn(out, F.lower(c))
    step(has_any(c, "/~"), *marks)
    step(has_any(c, ["n't", "n’t"]), *negations)
    step(has_any(c, [f"{q}{x} " for q in "’'" for x in ("s", "d", "ll", "ve", "m", "re")]), *clitics)
    d = d.withColumn(out, F.regexp_replace(c, *punctuation))
    step(c.contains("vs"), *versus)
    # A run of spaces at the end, or before the sign of a line's end that is the last character.
    d = d.withColumn(out, F.when(F.substring(c, -1, 1).isin(LINE_ENDS), F.regexp_replace(c, *spaces)).otherwise(F.rtrim(c)))
    d = d.withColumn(out, F.concat(c, F.lit(" ")))
    step(is_wide(c), *wide)
    return d.withColumn(out, F.split(c, " ", -1))


def count_tokens(t: Column, lexicon: list[str]) -> tuple[Column, Column]:
    """word_count and english_count (types in the lexicon) of tokens, for a lexicon that fits an expression; t is best a column: a filter's
    array would be computed apart from, and beside, what else is made of the same expression."""
    known = [w for w in lexicon if w]
    english = F.size(F.array_distinct(F.filter(t, lambda w: w.isin(known)))) if known else F.when(t.isNotNull(), 0)
    return (F.size(t) - 1).cast("int"), english.cast("int")


def count_english(text: Column, lexicon: list[str]) -> tuple[Column, Column]:
    """word_count (tokens) and english_count (types in the lexicon) of a text."""
    return count_tokens(tokens(simplify_english(text)), lexicon)


def count_english_by_join(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, word_count, english_count with a lexicon (word) of any size: types are exploded once and joined; sums are partial."""
    t = texts.select(*keys, tokens(simplify_english(F.col(text))).alias("t"))
    counted = t.select(*keys, (F.size("t") - 1).cast("int").alias("word_count"), F.explode(F.array_distinct("t")).alias("w"))
    known = lexicon.where("word <> ''").select(F.col("word").alias("w"), F.lit(1).alias("known")).distinct()
    joined = counted.join(known, "w", "left")
    return joined.groupBy(*keys, "word_count").agg(F.count("known").cast("int").alias("english_count"))


def proportion_english(words: Column, english: Column) -> Column:
    return F.coalesce(english / F.nullif(words, F.lit(0)), F.lit(0.0))


def weight_of_english(words: Column, english: Column) -> Column:
    short = F.when(english == words, "majority").when(english == 0, "minority").otherwise("inconclusive")
    return F.when(words < 3, short).when(english / F.nullif(words, F.lit(0)) > 0.5, "majority").otherwise("minority")


def suffix_s(w: Column) -> Column:
    for pattern, replacement in (("([sxz])$", "$1es"), ("([sc]h)$", "$1es"), ("y$", "ies"), ("([^s])$", "$1s")):
        w = F.regexp_replace(w, pattern, replacement)
    return w


def suffix_ed(w: Column) -> Column:
    return F.when(w.endswith("e"), F.concat(w, F.lit("d"))).when(w.endswith("y"), F.regexp_replace(w, "y$", "ied")).otherwise(F.concat(w, F.lit("ed")))


def suffix_ing(w: Column) -> Column:
    return F.concat(F.regexp_replace(w, "e$", ""), F.lit("ing"))


def build_lexicon(senses: DataFrame, *more: DataFrame) -> DataFrame:
    """word: from (word, pos) with pos n, v, r or a, their inflections, and further (word) tables; words with digits are left out."""
    base = senses.where(~F.col("word").rlike("[0-9]"))
    w = F.col("word")
    forms = F.when(F.col("pos") == "n", F.array(w, suffix_s(w))).when(F.col("pos") == "v", F.array(w, suffix_s(w), suffix_ed(w), suffix_ing(w))).when(F.col("pos").isin("r", "a"), F.array(w))
    out = base.select(F.explode(forms).alias("word"))
    for m in more:
        out = out.unionByName(m.select("word"))
    return out.distinct()


def common_characters(a: Column, b: Column) -> Column:
    return F.array_join(F.array_intersect(F.split(a, ""), F.split(b, "")), "")


def str_if(s: Column, condition: Column) -> Column:
    return F.when(condition, s).otherwise(F.lit(""))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def ordinal(sub: Column, use_roman: bool = False) -> Column:
    """Order of a sub-example number: none 0, digits, Roman numerals where the grammar uses them, letters; else null."""
    low = F.lower(sub)
    roman = F.create_map(*[x for i, r in enumerate(ROMAN, 1) for x in (F.lit(r), F.lit(i))])
    out = F.when(sub.isNull(), 0).when(sub.rlike("^[0-9]+$"), sub.try_cast("int"))
    if use_roman:
        out = out.when(low.rlike("^[ivx]+$"), F.try_element_at(roman, low))
    return out.when(low.rlike("^[a-z]$"), F.ascii(low) - 96).cast("int")
