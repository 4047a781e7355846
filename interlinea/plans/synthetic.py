"""Lines in the shape of interlinear examples, made of the words of `documents`: the same in Spark and in SQL.

All words of a text are used, twelve for each example; the last example takes the words it lacks from the text's start, so a short
text gives one example. The shape turns with the document and the example: a plain one, one with an unparsed line, one with two lines of
translation, and one with a sub-number and a follow-on group. Marks of lines turn too: ends of body text and counts of vernacular
words and abbreviations, as layout and annotation would find them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes: lines of numbers (words of the example, from 1) and text. {n} is the example's number.
SHAPES = [
    ["({n}) ", 1, "-", 2, " ", 3, "-", 4, "|", 5, "-PST ", 6, "-SG|‘", 7, " ", 8, " ", 9, ".’"],
    ["({n}) ", 1, 2, " ", 3, 4, " ", 5, "|", 1, "-", 2, " ", 3, "=", 4, " ", 5, "|", 6, "-PL ", 7, "=3 ", 8, "|‘", 9, " the ", 10, ".’"],
    ["({n}) ", 1, "-", 2, " ", 3, "|", 4, "-DEM ", 5, " ", 6, "|‘", 7, " of the ", 8, "|", 9, " ", 10, " and ", 11, ".’"],
    ["({n}) a. ", 1, "-", 2, " ", 3, "+", 4, "|", 5, "-NEG ", 6, "+Q|‘", 7, " ", 8, ".’|", 9, "-", 10, " ", 11, "|", 12, "-1 ", 1, "|‘", 2, " ", 3, ".’"],
]
WORDS = 12
EX_NUMBER = r"^\([0-9]+\)( [a-z]\.)?"
PARAMS = {"ex_number_regex": EX_NUMBER, "ex_head_number_regex": "[0-9]+", "ex_sub_number_regex": "[a-z]", "language_identifier_xf_line_regex": " of the "}


def _expression(shape: list, word, lit, concat):
    return concat(*[lit(x) if isinstance(x, str) else word(x) for x in shape])


def igt_lines(docs: DataFrame) -> DataFrame:
    """lines(doc_id, line_id, text, is_end_body, n_vernacular, n_abbreviation), line_id from 1."""
    d = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)
    d = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / WORDS).cast("int"))).alias("c"))
    word = lambda i: F.lower(F.get("w", F.pmod(F.col("c") * WORDS + i - 1, F.size("w"))))
    lit = lambda s: F.concat(F.lit(s.split("{n}")[0]), (F.col("c") + 1).cast("string"), F.lit(s.split("{n}")[1])) if "{n}" in s else F.lit(s)
    shapes = [_expression(s, word, lit, F.concat) for s in SHAPES]
    kind = F.pmod(F.col("doc_id") + F.col("c"), F.lit(len(SHAPES)))
    block = F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).when(kind == 2, shapes[2]).otherwise(shapes[3])
    each = d.select("doc_id", "c", F.posexplode(F.split(block, r"\|")).alias("i", "text"))
    turn = lambda a, b, n: F.pmod(F.col("doc_id") + a * F.col("c") + b * F.col("i"), F.lit(n))
    n_abbreviation = F.when(turn(2, 1, 9) == 0, 2).when(turn(2, 1, 9) == 1, 1).otherwise(0)
    return each.select("doc_id", (F.col("c") * 8 + F.col("i") + 1).cast("int").alias("line_id"), "text", (turn(3, 1, 13) == 0).alias("is_end_body"), turn(1, 2, 4).cast("int").alias("n_vernacular"), n_abbreviation.alias("n_abbreviation"))


def _sql_shape(shape: list) -> str:
    def one(x) -> str:
        if isinstance(x, int):
            return f"lower(w[(c * {WORDS} + {x} - 1) % len(w) + 1])"
        if "{n}" in x:
            a, b = x.split("{n}")
            return f"'{a}' || (c + 1) || '{b}'"
        return f"'{x}'"

    return " || ".join(map(one, shape))


LINES_SQL = f"""
igt_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents),
igt_cycles AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // {WORDS} + 1)) AS c FROM igt_words WHERE len(w) > 0),
igt_blocks AS (
  SELECT doc_id, c, CASE (doc_id + c) % {len(SHAPES)} WHEN 0 THEN {_sql_shape(SHAPES[0])} WHEN 1 THEN {_sql_shape(SHAPES[1])}
         WHEN 2 THEN {_sql_shape(SHAPES[2])} ELSE {_sql_shape(SHAPES[3])} END AS block
  FROM igt_cycles),
igt_split AS (SELECT doc_id, c, string_split(block, '|') AS parts FROM igt_blocks),
igt_each AS (SELECT doc_id, c, unnest(range(0, len(parts))) AS i, parts FROM igt_split),
lines AS (
  SELECT doc_id, CAST(c * 8 + i + 1 AS INTEGER) AS line_id, parts[i + 1] AS text, (doc_id + 3 * c + i) % 13 = 0 AS is_end_body,
         CAST((doc_id + c + 2 * i) % 4 AS INTEGER) AS n_vernacular, CASE (doc_id + 2 * c + i) % 9 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_abbreviation
  FROM igt_each)"""
