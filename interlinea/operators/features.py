"""Features of lines and, from them, which functions a line can't have and which it has signs of.

Bits of the masks: header 1, parsed vernacular 2, unparsed vernacular 4, gloss 8, free translation that goes on 16,
final free translation 32. Input: lines(doc_id, line_id, text) and, if there, is_end_body, n_vernacular,
n_abbreviation. All windows are by document in the order of line_id: one shuffle on doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import FUNCTION_WORDS, LINE_ENDS, ODD_SPACES, WS, count_tokens, has_any, is_wide, proportion_english, weight_of_english, with_tokens, zero_if_null

XH, XV, XU, XG, XFTN, XFTF = 1, 2, 4, 8, 16, 32
FUNCTIONS = ["xu", "xv", "xg", "xftn", "xftf", "xh"]
BITS = {"xh": XH, "xv": XV, "xu": XU, "xg": XG, "xftn": XFTN, "xftf": XFTF}

# The patterns that lines are read by.
JUNCTURE = "[A-Za-z0-9](?:[-=+:﹤﹥][A-Za-z0-9]|(?<=[A-Za-z])\\.[A-Za-z])"
JUNCTURE_DISTRACTORS = "-level|-final|-initial|-medial|-like|sub-|inter-|intra-|cross-|extra-|^-|-$"
#: Characters without which nothing is quoted.
QUOTES = "\"'‘“’”"
QUOTED = "[\"'‘“].+[\"'’”]|^[^\"'‘“]+[\"'’”]$|^[\"'‘“][^\"'’”]+$"
LEFT_QUOTES = "\"'‘“"
#: Bracketed stuff that no closing quote follows. The rest of the line is matched too and put back.
METADATA = rf"{WS}*[\[(].+[\])]([^\"'’”]*)$"
CONTINUER = rf"[A-Za-z,-;]{WS}*$"
TERMINATOR = rf"[!?.][\"'’”\)\]]?{WS}*$"
BOUNDARY_SPACE = rf"[-=+:﹤﹥]{WS}|{WS}[-=+:﹤﹥]"
PLAIN_SPACE = "[^ ] [^ ]"
PAD_SPACE = r"  +|\x{A0}\x{A0}+"
SECTION = r"^[0-9]+\.[0-9]"

DEFAULTS = {"ex_number_regex": r"^\([0-9]+\)", "ex_head_number_regex": "[0-9]+", "ex_sub_number_regex": "", "language_identifier_xf_line_regex": ""}

#: The evidence matrix: for each function the conditions that affirm and that disqualify it.
AFFIRM = {
    "xu": ["weight_of_english = 'minority'", "is_short_terminating", "has_multi_vernacular"],
    "xv": ["weight_of_english = 'minority'", "is_short_terminating", "has_multi_vernacular", "has_many_junctures"],
    "xg": ["is_short_terminating", "has_multi_abbreviation", "is_pad_space_dominant", "has_many_junctures"],
    "xftn": ["weight_of_english = 'majority'", "is_long_continuing", "is_left_quoted", "has_xf_identifier"],
    "xftf": ["weight_of_english = 'majority'", "is_short_terminating", "is_left_quoted", "is_mostly_quoted", "has_xf_identifier"],
    "xh": ["has_ex_number"],
}
_WORDY = ["(line_word_length > 5 AND proportion_english > 0.75)", "(line_word_length > 8 AND weight_of_english = 'majority')"]
_PROSE = "(is_long_continuing AND is_plain_space_dominant AND weight_of_english = 'majority')"
DISQUALIFY = {
    "xu": ["has_section_number", "has_multi_abbreviation", "has_many_junctures", *_WORDY, _PROSE, "NOT is_even_length_with_next_line"],
    "xv": ["has_section_number", "has_multi_abbreviation", *_WORDY, _PROSE, "NOT is_even_length_with_next_line"],
    "xg": ["has_section_number", _PROSE, "has_clause_break"],
    "xftn": ["has_section_number", "has_many_junctures", "has_multi_abbreviation", "is_terminating", "is_shorter_than_next_line", "is_pad_space_dominant"],
    "xftf": ["has_section_number", "has_many_junctures", "has_multi_abbreviation", "is_pad_space_dominant"],
    "xh": ["NOT has_ex_number"],
}


def mask_sql(matrix: dict[str, list[str]]) -> str:
    """SQL for a mask; both engines read it."""
    return " + ".join(f"(CASE WHEN {' OR '.join(matrix[f])} THEN {BITS[f]} ELSE 0 END)" for f in FUNCTIONS)


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _counted(text: Column, pattern: str, guard: Column) -> Column:
    """_count() of texts that may have a match."""
    return F.when(~guard, 0).otherwise(_count(text, pattern))


def _spaces(text: Column) -> Column:
    """How many stretches of white space a text has, less those at junctures."""
    stretches = F.when(~is_wide(text), F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).otherwise(_count(text, f"{WS}+"))
    beside = [x for j in "-=+:﹤﹥" for x in (f"{j} ", f" {j}")]
    return stretches - _counted(text, BOUNDARY_SPACE, has_any(text, [*beside, *ODD_SPACES]))


def _ends(text: Column, pattern: str, said: Column) -> Column:
    """Whether a pattern of a text's end and white space matches: by its last characters, unless white space follows them."""
    return F.when(F.substring(text, -1, 1).isin([" ", *ODD_SPACES, *LINE_ENDS]), text.rlike(pattern)).otherwise(said)


def _terminates(text: Column) -> Column:
    last = lambda n: F.substring(text, -n, 1)
    stop = lambda c: c.isin("!", "?", ".")
    return _ends(text, TERMINATOR, stop(last(1)) | (last(1).isin(list("\"'’”)]")) & stop(last(2))))


def _continues(text: Column) -> Column:
    last = F.substring(text, -1, 1)
    return _ends(text, CONTINUER, last.between("A", "Z") | last.between("a", "z") | last.between(",", ";"))


def _matched(text: Column, pattern: Column) -> Column:
    """The first match, or null; an empty pattern is no pattern."""
    return F.when(F.coalesce(pattern, F.lit("")) != "", F.regexp_substr(text, pattern))


def line_features(lines: DataFrame, params: DataFrame | dict | None = None, lexicon: list[str] | None = None) -> DataFrame:
    """One row a line with its features and the masks affirm and disq.

    params: a dict, or a table (doc_id, regex columns) that is joined by document."""
    names, d = list(DEFAULTS), lines
    if isinstance(params, DataFrame):
        p = params.select(F.col("doc_id").alias("p_doc"), *[F.col(n).alias(f"p_{n}") for n in names])
        d = d.join(p, F.col("doc_id").eqNullSafe(F.col("p_doc")), "left").drop("p_doc")
    else:
        d = d.withColumns({f"p_{n}": F.lit((DEFAULTS | (params or {}))[n]) for n in names})
    # Documents are dealt out and sorted before the features are computed: lines are narrow then, and all windows by line keep this partitioning and order.
    # By a stated number, which isn't coalesced: a line has few bytes, but much work is done on it.
    d = d.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "line_id")
    text = F.col("text")
    d = d.withColumns({"is_end_body": F.coalesce(_column(lines, "is_end_body", F.lit(False)), F.lit(False)), "n_vernacular": zero_if_null(_column(lines, "n_vernacular", F.lit(0))), "n_abbreviation": zero_if_null(_column(lines, "n_abbreviation", F.lit(0)))})
    bare = F.when(text.contains("(") | text.contains("["), F.regexp_replace(text, METADATA, "$1")).otherwise(text)
    d = d.withColumn("text_minus_metadata", bare)
    bare = F.col("text_minus_metadata")
    d = with_tokens(d, "text_minus_metadata", "english_tokens")
    words, english = count_tokens(F.col("english_tokens"), lexicon or FUNCTION_WORDS)
    d = d.withColumns({"word_count": words, "english_count": english}).drop("english_tokens")
    d = d.withColumns(
        {
            "length_minus_metadata": F.length(bare),
            "length_quoted": zero_if_null(F.when(has_any(bare, QUOTES), F.length(F.regexp_substr(bare, F.lit(QUOTED))))),
            "line_word_length": 1 + _spaces(text),
            "proportion_english": proportion_english(F.col("word_count"), F.col("english_count")),
            "weight_of_english": weight_of_english(F.col("word_count"), F.col("english_count")),
            "plain_space_count": _counted(bare, PLAIN_SPACE, bare.contains(" ")),
            "pad_space_count": _counted(bare, PAD_SPACE, has_any(bare, ["  ", "\xa0\xa0"])),
            "ex_number_text": F.when(~F.col("is_end_body"), _matched(text, F.col("p_ex_number_regex"))),
        }
    )
    d = d.withColumns(
        {
            "ex_number_head": _matched(F.col("ex_number_text"), F.col("p_ex_head_number_regex")),
            "ex_number_sub": _matched(F.col("ex_number_text"), F.col("p_ex_sub_number_regex")),
            "has_ex_number": F.col("ex_number_text").isNotNull(),
            "is_terminating": _terminates(text),
            "is_continuing": _continues(text),
            "is_short": F.col("length_minus_metadata") < 70,
        }
    )
    w = Window.partitionBy("doc_id").orderBy("line_id")
    after = F.lead("line_word_length", 1, 0).over(w) - F.col("line_word_length")
    d = d.withColumn("length_step", after)
    d = d.withColumns(
        {
            "is_short_terminating": F.col("is_terminating") & F.col("is_short"),
            "is_long_continuing": F.col("is_continuing") & ~F.col("is_short"),
            "is_even_length_with_next_line": F.abs("length_step") < 4,
            "is_shorter_than_next_line": F.col("length_step") > 4,
            "has_vernacular": F.col("n_vernacular") > 0,
            "has_multi_vernacular": F.col("n_vernacular") > 1,
            "has_abbreviation": F.col("n_abbreviation") > 0,
            "has_multi_abbreviation": F.col("n_abbreviation") > 1,
            "is_plain_space_dominant": F.col("plain_space_count") > F.col("pad_space_count") + 3,
            "is_pad_space_dominant": F.col("pad_space_count") > F.col("plain_space_count") + 3,
            "has_many_junctures": (_count(bare, JUNCTURE) > 2) & (_count(bare, JUNCTURE) - _count(bare, JUNCTURE_DISTRACTORS) > 2),
            "is_mostly_quoted": 2 * F.col("length_quoted") > F.col("length_minus_metadata"),
            "is_left_quoted": F.substring(bare, 1, 1).isin(list(LEFT_QUOTES)),
            "has_clause_break": has_any(bare, ",;"),
            "has_xf_identifier": _matched(text, F.col("p_language_identifier_xf_line_regex")).isNotNull(),
            "has_section_number": ~F.col("has_ex_number") & F.substring(bare, 1, 1).between("0", "9") & bare.rlike(SECTION),
        }
    )
    d = d.withColumns({"affirm": F.expr(mask_sql(AFFIRM)), "disq": F.expr(mask_sql(DISQUALIFY))})
    return d.drop("length_step", *[f"p_{n}" for n in names])


def run_length(flag: Column, by: list[str], order: list[Column | str]) -> Column:
    """How many rows in a row, up to this one, have the flag; 0 where it is false or null."""
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.coalesce(flag, F.lit(False))
    i = F.row_number().over(w)
    broke = F.max(F.when(~flag, i)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(flag, i - F.coalesce(broke, F.lit(0))).otherwise(0).cast("int")
