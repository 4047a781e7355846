"""SQL for DuckDB that says the same as the Spark operators, as chains of common table expressions."""

from __future__ import annotations

from .synthetic import LINES_SQL

# What the described behaviour says, written out here a second time, so that SQL holds the operators to them.
WS = r"[\s\x{A0}]"
EX_NUMBER = '^\\([0-9]+\\)( [a-z]\\.)?'
NORMALISER_BEFORE_LOWER = [
    ('[\\s\\x{A0}]+', ' '),
    ('-level|-final|-initial|-medial|-like|-reference|tense-|sub-|inter-|intra-|cross-|extra-|pre-|post-|mid-|self-|proto-|morpho-|semi-|trans-|non-', ''),
    ('/.{1,2}/', ''),
    ('([^.] )[A-Z][a-z]+', '\\1'),
    ('(\\(|\\[)?[0-9]+(\\.[0-9])?%?(\\)|\\])?', ''),
    (' [A-Z]{2,} ', ' '),
]
NORMALISER_AFTER_LOWER = [
    ('[/~]', ' '),
    ("n(’|')t", ''),
    ("(’|')(s|d|ll|ve|m|re) ", ' '),
    ('[.,!?:;‘’“”(){}\\[\\]]', ''),
    ('(^| )vs\\.? ', 'versus '),
    (' +$', ''),
]
FUNCTION_WORDS = 'a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you'.split()
METADATA = '[\\s\\x{A0}]*[\\[(].+[\\])]([^\\"\'’”]*)$'
QUOTED = '["\'‘“].+["\'’”]|^[^"\'‘“]+["\'’”]$|^["\'‘“][^"\'’”]+$'
LEFT_QUOTED = '^["\'‘“]'
JUNCTURE = '([A-Za-z0-9][-=+:﹤﹥][A-Za-z0-9])|([A-Za-z]\\.[A-Za-z])'
JUNCTURE_DISTRACTORS = '-level|-final|-initial|-medial|-like|sub-|inter-|intra-|cross-|extra-|^-|-$'
CONTINUER = '[A-Za-z,-;][\\s\\x{A0}]*$'
TERMINATOR = '[!?.][\\"\'’”\\)\\]]?[\\s\\x{A0}]*$'
BOUNDARY_SPACE = '[-=+:﹤﹥][\\s\\x{A0}]|[\\s\\x{A0}][-=+:﹤﹥]'
PLAIN_SPACE = '[^ ] [^ ]'
PAD_SPACE = '  +|\\x{A0}\\x{A0}+'
SECTION = '^[0-9]+\\.[0-9]'
EDGE_LEFT, EDGE_RIGHT = '([A-Za-z0-9][-=+:﹤﹥.])', '([-=+:﹤﹥.][A-Za-z0-9])'
ABBREVIATIONS = '([Pp][Ss5][Tt]|[Dd][Ee][Mm]|[Nn][Ee][GCg]|3[Pp][Lli1]|[Ss5][GCg]|[Pp][Lli1]|[Qq])'
SENTENCE_BOUNDARY, SENTENCE_END = '([A-Za-z\'"”’)][!?.])\\s+([A-Z])', '([A-Za-z\'"”’)][!?.])\\s+$'
OPAQUE = '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<!DOCTYPE[^>]*>'
TOKEN = """(</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[A-Za-z][^>]*>|<[!?/][^>]*>|[^<]+|<)"""
ENTITIES = [('&lt;', '﹤'), ('&gt;', '﹥'), ('&amp;', '﹠'), ('&#13;', '\n'), ('&nbsp;', '\xa0'), ('&quot;', '"'), ('&apos;', "'"), ('&#39;', "'"), ('&copy;', '©'), ('&middot;', '·')]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count(col: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({col}, {q(pattern)})) AS INTEGER)"


def simplified(col: str) -> str:
    """The English normaliser as nested calls."""
    out = f"regexp_replace({col}, {q(f'^{WS}+|{WS}+$')}, '', 'g') || ' '"
    for pattern, replacement in NORMALISER_BEFORE_LOWER:
        out = f"regexp_replace({out}, {q(pattern)}, {q(replacement)}, 'g')"
    out = f"lower({out})"
    for pattern, replacement in NORMALISER_AFTER_LOWER:
        out = f"regexp_replace({out}, {q(pattern)}, {q(replacement)}, 'g')"
    return out


def first(col: str, pattern: str) -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}), '')"


WEIGHT = "CASE WHEN word_count < 3 THEN CASE WHEN english_count = word_count THEN 'majority' WHEN english_count = 0 THEN 'minority' ELSE 'inconclusive' END WHEN english_count * 1.0 / nullif(word_count, 0) > 0.5 THEN 'majority' ELSE 'minority' END"
PROPORTION = "coalesce(CAST(english_count AS DOUBLE) / nullif(word_count, 0), 0.0)"
LEXICON = "[" + ", ".join(q(w) for w in FUNCTION_WORDS) + "]"
TOKENS = f"string_split_regex(simple || ' ', {q(WS + '+')})"

FEATURES = f"""{LINES_SQL},
f0 AS (SELECT *, regexp_replace(text, {q(METADATA)}, '\\1') AS bare FROM lines),
f1 AS (SELECT *, {simplified('bare')} AS simple FROM f0),
f2 AS (SELECT *, CAST(len({TOKENS}) - 1 AS INTEGER) AS word_count, CAST(len(list_intersect(list_distinct({TOKENS}), {LEXICON})) AS INTEGER) AS english_count FROM f1),
f3 AS (
  SELECT *, CAST(length(bare) AS INTEGER) AS length_minus_metadata, CAST(length(regexp_extract(bare, {q(QUOTED)})) AS INTEGER) AS length_quoted,
         1 + {count('text', WS + '+')} - {count('text', BOUNDARY_SPACE)} AS line_word_length,
         {PROPORTION} AS proportion_english, {WEIGHT} AS weight_of_english,
         {count('bare', PLAIN_SPACE)} AS plain_space_count, {count('bare', PAD_SPACE)} AS pad_space_count,
         CASE WHEN NOT is_end_body THEN {first('text', EX_NUMBER)} END AS ex_number_text, regexp_matches(text, {q(TERMINATOR)}) AS is_terminating,
         regexp_matches(text, {q(CONTINUER)}) AS is_continuing
  FROM f2),
f4 AS (
  SELECT *, {first('ex_number_text', '[0-9]+')} AS ex_number_head, {first('ex_number_text', '[a-z]')} AS ex_number_sub, ex_number_text IS NOT NULL AS has_ex_number,
         length_minus_metadata < 70 AS is_short,
         coalesce(lead(line_word_length) OVER (PARTITION BY doc_id ORDER BY line_id), 0) - line_word_length AS length_step
  FROM f3),
features0 AS (
  SELECT *, is_terminating AND is_short AS is_short_terminating, is_continuing AND NOT is_short AS is_long_continuing,
         abs(length_step) < 4 AS is_even_length_with_next_line, length_step > 4 AS is_shorter_than_next_line,
         n_vernacular > 1 AS has_multi_vernacular, n_abbreviation > 1 AS has_multi_abbreviation,
         plain_space_count > pad_space_count + 3 AS is_plain_space_dominant, pad_space_count > plain_space_count + 3 AS is_pad_space_dominant,
         {count('bare', JUNCTURE)} - {count('bare', JUNCTURE_DISTRACTORS)} > 2 AS has_many_junctures,
         2 * length_quoted > length_minus_metadata AS is_mostly_quoted, regexp_matches(bare, {q(LEFT_QUOTED)}) AS is_left_quoted,
         regexp_matches(bare, '[,;]') AS has_clause_break, regexp_matches(text, ' of the ') AS has_xf_identifier,
         NOT has_ex_number AND regexp_matches(bare, {q(SECTION)}) AS has_section_number
  FROM f4),
judged AS (
  SELECT *, weight_of_english = 'minority' AS little_english, weight_of_english = 'majority' AS much_english,
         (line_word_length > 5 AND proportion_english > 0.75) OR (line_word_length > 8 AND weight_of_english = 'majority') AS is_wordy,
         is_long_continuing AND is_plain_space_dominant AND weight_of_english = 'majority' AS is_prose
  FROM features0),
features AS (
  SELECT *,
         CAST(CASE WHEN has_ex_number THEN 1 ELSE 0 END
            + CASE WHEN little_english OR is_short_terminating OR has_multi_vernacular OR has_many_junctures THEN 2 ELSE 0 END
            + CASE WHEN little_english OR is_short_terminating OR has_multi_vernacular THEN 4 ELSE 0 END
            + CASE WHEN is_short_terminating OR has_multi_abbreviation OR is_pad_space_dominant OR has_many_junctures THEN 8 ELSE 0 END
            + CASE WHEN much_english OR is_long_continuing OR is_left_quoted OR has_xf_identifier THEN 16 ELSE 0 END
            + CASE WHEN much_english OR is_short_terminating OR is_left_quoted OR is_mostly_quoted OR has_xf_identifier THEN 32 ELSE 0 END AS INTEGER) AS affirm,
         CAST(CASE WHEN has_ex_number THEN 0 ELSE 1 END
            + CASE WHEN has_section_number OR has_multi_abbreviation OR is_wordy OR is_prose OR NOT is_even_length_with_next_line THEN 2 ELSE 0 END
            + CASE WHEN has_section_number OR has_multi_abbreviation OR has_many_junctures OR is_wordy OR is_prose OR NOT is_even_length_with_next_line THEN 4 ELSE 0 END
            + CASE WHEN has_section_number OR is_prose OR has_clause_break THEN 8 ELSE 0 END
            + CASE WHEN has_section_number OR has_many_junctures OR has_multi_abbreviation OR is_terminating OR is_shorter_than_next_line OR is_pad_space_dominant THEN 16 ELSE 0 END
            + CASE WHEN has_section_number OR has_many_junctures OR has_multi_abbreviation OR is_pad_space_dominant THEN 32 ELSE 0 END AS INTEGER) AS disq
  FROM judged)"""

FEATURE_COLUMNS = (
    "doc_id, line_id, word_count, english_count, length_minus_metadata, length_quoted, line_word_length, plain_space_count, pad_space_count, "
    "ex_number_head, ex_number_sub, is_terminating, is_continuing, is_left_quoted, is_mostly_quoted, has_many_junctures, has_clause_break, affirm, disq"
)

#: Every choice of parts, the most expected first; the translation varies fastest, the header slowest.
GRID = """
grid0 AS (
  SELECT *, list_concat(xh, flatten(list_transform(range(n), lambda i: list_concat(xu, xv, xg))), ft) AS codes
  FROM (VALUES (1, [16, 16, 32]), (2, [16, 32]), (3, [32])) AS a(ft_no, ft), (SELECT unnest([6, 5, 4, 3, 2, 1]) AS n) AS b,
       (VALUES (1, CAST([] AS INTEGER[])), (2, [4])) AS c(xu_no, xu), (VALUES (1, [2]), (2, CAST([] AS INTEGER[]))) AS d(xv_no, xv),
       (VALUES (1, [8]), (2, [8, 8])) AS e(xg_no, xg), (VALUES (1, CAST([] AS INTEGER[])), (2, [1])) AS g(xh_no, xh)
  WHERE len(xu) + len(xv) > 0),
templates AS (
  SELECT row_number() OVER (ORDER BY xh_no, xg_no, xv_no, xu_no, n DESC, ft_no) AS rank, len(codes) AS n_lines, codes,
         array_to_string(list_transform(codes, lambda x: CASE x WHEN 1 THEN 'xh' WHEN 2 THEN 'xv' WHEN 4 THEN 'xu' WHEN 8 THEN 'xg' WHEN 16 THEN 'xftn' ELSE 'xftf' END), ',') AS template
  FROM grid0)"""

LABELS = f"""{FEATURES},
{GRID},
numbered AS (SELECT *, max(CASE WHEN has_ex_number THEN line_id END) OVER (PARTITION BY doc_id ORDER BY line_id) AS x_line FROM features),
unended AS (
  SELECT * FROM numbered WHERE x_line IS NOT NULL
  QUALIFY NOT coalesce(max(is_end_body AND line_id > x_line) OVER (PARTITION BY doc_id, x_line ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)),
ordered AS (SELECT doc_id, x_line, line_id, disq, affirm, row_number() OVER (PARTITION BY doc_id, x_line ORDER BY line_id) AS p,
                   count(*) OVER (PARTITION BY doc_id, x_line) AS size FROM unended),
positions AS (SELECT rank, n_lines, unnest(range(1, n_lines + 1)) AS p, codes FROM templates),
feasible AS (
  SELECT o.doc_id, o.x_line, t.rank, t.n_lines FROM ordered o JOIN positions t ON o.p = t.p AND t.n_lines <= o.size
  WHERE (o.disq & t.codes[t.p]) = 0 GROUP BY ALL HAVING count(*) = t.n_lines),
best AS (SELECT doc_id, x_line, min(rank) AS rank FROM feasible GROUP BY ALL),
chosen AS (SELECT b.doc_id, b.x_line, t.n_lines, t.codes, list_filter(t.codes, lambda c: c NOT IN (1, 16, 32)) AS core FROM best b JOIN templates t ON b.rank = t.rank),
options AS (SELECT doc_id, x_line, unnest([list_concat(core, [32]), list_concat(core, [16, 32]), list_concat(core, [16, 16, 32])]) AS codes FROM chosen),
option_lines AS (SELECT doc_id, x_line, codes, len(codes) AS n, unnest(range(1, len(codes) + 1)) AS i FROM options),
follow0 AS (
  SELECT o.doc_id, o.x_line, s.p AS s, o.codes, o.n
  FROM option_lines o JOIN ordered s ON o.doc_id = s.doc_id AND o.x_line = s.x_line JOIN ordered z ON o.doc_id = z.doc_id AND o.x_line = z.x_line AND z.p = s.p + o.i - 1
  WHERE (z.disq & o.codes[o.i]) = 0 AND (z.affirm & o.codes[o.i]) <> 0 GROUP BY ALL HAVING count(*) = o.n),
follow AS (SELECT doc_id, x_line, s, arg_min(codes, n) AS codes, min(n) AS n FROM follow0 GROUP BY doc_id, x_line, s),
chain AS (
  SELECT doc_id, x_line, 1 AS pass, CAST(0 AS BIGINT) AS ofs, CAST(n_lines AS BIGINT) AS n, codes FROM chosen
  UNION ALL
  SELECT c.doc_id, c.x_line, c.pass + 1, c.ofs + c.n, CAST(f.n AS BIGINT), f.codes
  FROM chain c JOIN follow f ON c.doc_id = f.doc_id AND c.x_line = f.x_line AND f.s = c.ofs + c.n + 1),
chain_lines AS (SELECT doc_id, x_line, pass, ofs, unnest(range(1, n + 1)) AS i, codes FROM chain),
labels AS (
  SELECT c.doc_id, o.line_id, c.x_line, CAST(c.codes[c.i] AS INTEGER) AS code, CAST(c.pass AS INTEGER) AS pass,
         CASE c.codes[c.i] WHEN 1 THEN 'xh' WHEN 2 THEN 'xv' WHEN 4 THEN 'xu' WHEN 8 THEN 'xg' ELSE 'xf' END AS fn
  FROM chain_lines c JOIN ordered o ON c.doc_id = o.doc_id AND c.x_line = o.x_line AND o.p = c.ofs + c.i)"""

GROUPS = f"""{LABELS},
marked AS (
  SELECT *, lag(fn) OVER (PARTITION BY doc_id, x_line ORDER BY line_id) AS before FROM labels),
started AS (SELECT *, fn = 'xu' OR (fn = 'xv' AND coalesce(before, '') <> 'xu') AS starts_xgg FROM marked),
counted AS (
  SELECT *, sum(CAST(starts_xgg AS INTEGER)) OVER w AS g, sum(CASE WHEN starts_xgg AND coalesce(before, 'xf') IN ('xf', 'xh') THEN 1 ELSE 0 END) OVER w AS t
  FROM started WINDOW w AS (PARTITION BY doc_id, x_line ORDER BY line_id)),
groups0 AS (
  SELECT doc_id, x_line, line_id, fn, code, pass, CAST(CASE WHEN fn IN ('xu', 'xv', 'xg') AND g > 0 THEN g END AS INTEGER) AS xgg_no,
         CAST(CASE WHEN fn <> 'xh' AND t > 0 THEN t END AS INTEGER) AS xfg_no FROM counted),
example_lines AS (
  SELECT g.*, max(CASE WHEN g.line_id = g.x_line THEN f.ex_number_head END) OVER w AS x_number,
         max(CASE WHEN g.line_id = g.x_line THEN f.ex_number_sub END) OVER w AS x_sub_number,
         CASE WHEN g.line_id = g.x_line THEN regexp_replace(substr(f.text, length(f.ex_number_text) + 1), {q('^' + WS + '+')}, '') ELSE f.text END AS text
  FROM groups0 g JOIN features f ON g.doc_id = f.doc_id AND g.line_id = f.line_id WINDOW w AS (PARTITION BY g.doc_id, g.x_line))"""

_REJOIN1, _REJOIN2 = r"([-=+.﹤﹥])[\s\x{A0}]+([A-Za-z0-9])", r"([A-Za-z0-9])[\s\x{A0}]+([-=+﹤﹥])"
WORDS = f"""{GROUPS},
xgg_lines AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, x_line, xgg_no, fn ORDER BY line_id) AS INTEGER) AS line_no,
         list_filter(string_split_regex(regexp_replace(regexp_replace(text, {q(_REJOIN1)}, '\\1\\2', 'g'), {q(_REJOIN2)}, '\\1\\2', 'g'), '[ \\x{{A0}}]+'), lambda x: x <> '') AS ws
  FROM example_lines WHERE xgg_no IS NOT NULL),
words AS (SELECT doc_id, x_line, xgg_no, x_number, x_sub_number, line_id, fn, line_no, unnest(ws) AS word, CAST(unnest(range(1, len(ws) + 1)) AS INTEGER) AS word_no FROM xgg_lines)"""

ALIGNMENT = """
line_counts AS (SELECT doc_id, x_line, xgg_no, line_id, fn, count(*) AS n FROM {words} GROUP BY ALL),
{name} AS (
  SELECT doc_id, x_line, xgg_no, min(n) <> max(n) AS word_misalignment,
         min(n) <> max(n) AND coalesce(max(CASE WHEN fn = 'xg' THEN n END) > max(CASE WHEN fn IN ('xu', 'xv') THEN n END), false) AS long_gloss
  FROM line_counts GROUP BY doc_id, x_line, xgg_no)"""
ALIGNED = f"{WORDS}, {ALIGNMENT.format(words='words', name='aligned')}"

PAIRS = f"""{ALIGNED},
v AS (SELECT *, lower(regexp_replace(word, '[!?.,;]$', '')) AS xv FROM words WHERE fn = 'xv' AND line_no = 1),
g AS (SELECT *, regexp_replace(word, '[!?.,;]$', '') AS xg FROM words WHERE fn = 'xg' AND line_no = 1),
pairs AS (
  SELECT v.doc_id, v.x_line, v.xgg_no, v.x_number, v.x_sub_number, v.word_no, v.xv, g.xg,
         array_to_string(regexp_extract_all(v.xv, '[-=+﹤﹥]'), '') AS xv_junctures, array_to_string(regexp_extract_all(g.xg, '[-=+﹤﹥]'), '') AS xg_junctures
  FROM v JOIN aligned a USING (doc_id, x_line, xgg_no) JOIN g ON v.doc_id = g.doc_id AND v.x_line = g.x_line AND v.xgg_no = g.xgg_no AND v.word_no = g.word_no
  WHERE NOT a.word_misalignment)"""

MORPHEMES = f"""{PAIRS},
good AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, x_line, xgg_no ORDER BY word_no) AS INTEGER) AS word_number,
                string_split_regex(xv, '[-=+﹤﹥]') AS ms, string_split_regex(xg, '[-=+﹤﹥]') AS gs FROM pairs WHERE xv_junctures = xg_junctures),
parts AS (SELECT doc_id, x_line, xgg_no, coalesce(x_number, '??') || coalesce('-' || nullif(x_sub_number, ''), '') AS ex_number, word_number,
                 CAST(unnest(range(1, len(ms) + 1)) AS INTEGER) AS morph_no, unnest(ms) AS morph, unnest(gs) AS gloss FROM good),
morphemes AS (
  SELECT *, '/' || lag(morph, 1, '#') OVER w || '__' AS prev_morph, '/__' || lead(morph, 1, '#') OVER w AS next_morph,
         '/' || lag(gloss, 1, '#') OVER w || '__' AS prev_gloss, '/__' || lead(gloss, 1, '#') OVER w AS next_gloss
  FROM parts WINDOW w AS (PARTITION BY doc_id, x_line, xgg_no, word_number ORDER BY morph_no))"""


MULTIWORD = "regexp_extract(word, '[a-z]+$') <> '' AND regexp_extract(next_word, '^[a-z]+') <> '' AND regexp_extract(word, '[a-z]+$') || '_' || regexp_extract(next_word, '^[a-z]+') IN ('the_the', 'of_the', 'and_the', 'in_the', 'to_the', 'la_la', 'de_la', 'die_der')"
PERSON = "regexp_matches(word, '[123]$')"


def repaired(glue: str, hit: str) -> str:
    return f"""{ALIGNED},
long_words AS (SELECT w.*, a.long_gloss AND w.fn = 'xg' AS is_long, lead(w.word) OVER v AS next_word
  FROM words w JOIN aligned a USING (doc_id, x_line, xgg_no) WINDOW v AS (PARTITION BY w.doc_id, w.x_line, w.xgg_no, w.line_id ORDER BY w.word_no)),
hits AS (SELECT *, coalesce(is_long AND {hit}, false) AS hit FROM long_words),
tied AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY doc_id, x_line, xgg_no, line_id ORDER BY word_no), false) AS tied FROM hits),
islands AS (SELECT *, CAST(sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, x_line, xgg_no, line_id ORDER BY word_no) AS INTEGER) AS island FROM tied)
SELECT doc_id, x_line, xgg_no, line_id, fn, island AS word_no, string_agg(word, {q(glue)} ORDER BY word_no) AS word FROM islands GROUP BY doc_id, x_line, xgg_no, line_id, fn, island"""


def report(source: str) -> str:
    return f"""
r0 AS (SELECT *, CAST(nullif(regexp_extract(x_number, '([0-9]+)$', 1), '') AS INTEGER) AS ex_order, nullif(x_sub_number, '') AS sub FROM {source} WHERE x_number IS NOT NULL OR nullif(x_sub_number, '') IS NOT NULL),
r1 AS (SELECT *, CASE WHEN sub IS NULL THEN 0 WHEN regexp_matches(sub, '^[0-9]+$') THEN CAST(sub AS INTEGER) WHEN regexp_matches(lower(sub), '^[a-z]$') THEN ascii(lower(sub)) - 96 END AS subex_order FROM r0),
r2 AS (SELECT *, ex_order - lag(ex_order, 1, 0) OVER w AS diff, subex_order - lag(subex_order, 1, 0) OVER w AS subdiff FROM r1 WINDOW w AS (PARTITION BY doc_id ORDER BY id))
SELECT doc_id, '#' || id AS id, x_number || coalesce('-' || sub, '') AS full_ex_number,
       'text' || CASE WHEN coalesce((diff = 0 AND subdiff <> 1) OR (diff = 1 AND subex_order > 1) OR diff > 1, true) THEN ' **' ELSE '   ' END AS kind FROM r2"""


# The nested examples, those to correct by hand, and the marked-up page.
EXAMPLES = f"""{GROUPS},
held AS (SELECT * FROM example_lines WHERE fn = 'xh' OR xfg_no IS NOT NULL),
of_kind AS (
  SELECT doc_id, x_line, x_number, x_sub_number, xfg_no, xgg_no,
         coalesce(list(text ORDER BY line_id) FILTER (fn = 'xu'), []) AS xu, coalesce(list(text ORDER BY line_id) FILTER (fn = 'xv'), []) AS xv, coalesce(list(text ORDER BY line_id) FILTER (fn = 'xg'), []) AS xg
  FROM held WHERE xgg_no IS NOT NULL GROUP BY ALL),
glossed AS (SELECT doc_id, x_line, xfg_no, list(struct_pack(xgg_no := xgg_no, xu := xu, xv := xv, xg := xg) ORDER BY xgg_no) AS xggs FROM of_kind GROUP BY ALL),
free_ AS (SELECT doc_id, x_line, xfg_no, list(text ORDER BY line_id) AS xf FROM held WHERE fn = 'xf' GROUP BY ALL),
xfg AS (
  SELECT doc_id, x_line, xfg_no, struct_pack(xfg_no := xfg_no, xggs := coalesce(xggs, []), xf := coalesce(xf, [])) AS g
  FROM glossed FULL JOIN free_ USING (doc_id, x_line, xfg_no) WHERE xfg_no IS NOT NULL),
heads AS (SELECT DISTINCT doc_id, x_line, x_number, x_sub_number FROM held)
SELECT h.doc_id, h.x_line, any_value(h.x_number) AS x_number, any_value(h.x_sub_number) AS x_sub_number, count(g) AS n_xfg,
       coalesce(CAST(to_json(list(g ORDER BY xfg_no) FILTER (g IS NOT NULL)) AS VARCHAR), '[]') AS xfgs
FROM heads h LEFT JOIN xfg USING (doc_id, x_line) GROUP BY h.doc_id, h.x_line"""

_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
EDITABLE = f"""{PAIRS},
chosen_xgg AS (SELECT DISTINCT doc_id, x_line, xgg_no FROM (SELECT doc_id, x_line, xgg_no FROM aligned WHERE word_misalignment UNION ALL SELECT doc_id, x_line, xgg_no FROM pairs WHERE xv_junctures <> xg_junctures)),
ed_lines AS (
  SELECT doc_id, x_line, xgg_no, line_id, coalesce(any_value(x_number), '??') || coalesce('-' || nullif(any_value(x_sub_number), ''), '') AS number,
         '<' || fn || '>' || string_agg('<xw>' || {_ESCAPED.format('word')} || '</xw>', '' ORDER BY word_no) || '</' || fn || '>' AS s
  FROM words SEMI JOIN chosen_xgg USING (doc_id, x_line, xgg_no) GROUP BY doc_id, x_line, xgg_no, line_id, fn),
ed_groups AS (SELECT doc_id, x_line, xgg_no, '<xgg ex_number="' || {_ESCAPED.format('number')} || '">' || string_agg(s, '' ORDER BY line_id) || '</xgg>' AS s FROM ed_lines GROUP BY doc_id, x_line, xgg_no, number)
SELECT doc_id, '<xgg_editor>' || string_agg(s, '' ORDER BY x_line, xgg_no) || '</xgg_editor>' AS xml FROM ed_groups GROUP BY doc_id"""

PAGE = f"""{GROUPS},
sections AS (
  SELECT doc_id, x_line, coalesce(nullif(concat_ws('-', x_number, nullif(x_sub_number, '')), ''), '') AS label,
         string_agg('<div class="' || fn || '">' || {_ESCAPED.format('text')} || '</div>', '' ORDER BY line_id) AS s
  FROM example_lines GROUP BY doc_id, x_line, x_number, x_sub_number)
SELECT doc_id, '<html><body>' || string_agg('<section class="x" data-number="' || {_ESCAPED.format('label')} || '">' || s || '</section>', '' ORDER BY x_line) || '</body></html>' AS html
FROM sections GROUP BY doc_id"""


def abbreviations(pattern: str) -> str:
    one = f"regexp_replace(text, {q(EDGE_LEFT + pattern + '(' + EDGE_RIGHT + '|[ ' + chr(92) + 'x{A0}])')}, '\\1⟦\\2⟧\\3', 'g')"
    return f"regexp_replace({one}, {q('(' + EDGE_LEFT + '|[ ' + chr(92) + 'x{A0}])' + pattern + EDGE_RIGHT)}, '\\1⟦\\3⟧\\4', 'g')"


# The lines as the extraction finds them in pages: numbered through, no vernacular runs, abbreviations counted, and no end of body at the last.
_MADE = LINES_SQL.replace("lines AS (\n", "made AS (\n")
_TAGGED = abbreviations(ABBREVIATIONS)
PAGE_TEXT = f"""{_MADE},
tagged AS (SELECT *, {_TAGGED} AS tagged, row_number() OVER (PARTITION BY doc_id ORDER BY line_id DESC) AS from_end FROM made),
lines AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_id) AS INTEGER) AS line_id, text, is_end_body AND from_end > 1 AS is_end_body,
         0 AS n_vernacular, CAST(length(tagged) - length(replace(tagged, '⟦', '')) AS INTEGER) AS n_abbreviation
  FROM tagged)"""
EXTRACTED = GROUPS.replace(LINES_SQL, PAGE_TEXT)
EXTRACTED_REPORT = f"""{EXTRACTED},
prose AS (SELECT doc_id, line_id AS place, text || ' ' AS text FROM lines ANTI JOIN labels USING (doc_id, line_id)),
cut AS (SELECT doc_id, place, string_split(regexp_replace(regexp_replace(text, {q(SENTENCE_BOUNDARY)}, '\\1' || chr(1) || '\\2', 'g'), {q(SENTENCE_END)}, '\\1' || chr(1)), chr(1)) AS said FROM prose),
block_places AS (
  SELECT doc_id, place, 0 AS a, 'para' AS kind FROM prose
  UNION ALL SELECT doc_id, place, unnest(range(1, len(said) + 1)), 'sentence' FROM (SELECT doc_id, place, list_filter(said, lambda s: trim(s) <> '') AS said FROM cut)
  UNION ALL SELECT DISTINCT doc_id, x_line, 0, 'x' FROM labels),
block_no AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, a) AS INTEGER) AS id FROM block_places) WHERE kind = 'x'),
numbered_x AS (SELECT e.doc_id, b.id, e.x_number, e.x_sub_number FROM example_lines e JOIN block_no b ON e.doc_id = b.doc_id AND e.x_line = b.place WHERE e.line_id = e.x_line),
{report('numbered_x')}"""


def _decoded(col: str) -> str:
    for entity, to in ENTITIES:
        col = f"replace({col}, {q(entity)}, {q(to)})" if to != "\n" else f"replace({col}, {q(entity)}, chr(10))"
    return col


TOKENS_CTE = f"""
cut AS (SELECT page_id AS doc_id, regexp_extract_all(regexp_replace(coalesce(html, ''), {q(OPAQUE)}, '', 'g'), {q(TOKEN)}) AS toks FROM pages),
tok AS (SELECT doc_id, CAST(unnest(range(1, len(toks) + 1)) AS INTEGER) AS ord, unnest(toks) AS tok FROM cut),
named AS (SELECT *, CASE WHEN tok LIKE '<%' THEN lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) ELSE '' END AS name FROM tok),
kinds AS (SELECT *, CASE WHEN tok NOT LIKE '<_%' THEN 'text' WHEN name = '' OR name IN ('meta', 'link', 'br', 'img', 'hr', 'input') OR (tok LIKE '%/>' AND tok NOT LIKE '</%') THEN 'empty' WHEN tok LIKE '</%' THEN 'close' ELSE 'open' END AS kind FROM named),
tokens AS (SELECT *, CASE WHEN kind = 'text' THEN CASE WHEN tok = '<' THEN '﹤' ELSE {_decoded('tok')} END END AS text FROM kinds)"""

#: Tag after tag, with the list of open elements, the innermost last; what a tag ends is told by two tables.
BALANCED = f"""{TOKENS_CTE},
ending AS (SELECT * FROM (VALUES
  ('p', ['p'], ['td', 'th', 'table', 'caption', 'button']), ('li', ['li'], ['ul', 'ol', 'td', 'th', 'table']), ('dt', ['dt', 'dd'], ['dl', 'td', 'th', 'table']),
  ('dd', ['dt', 'dd'], ['dl', 'td', 'th', 'table']), ('option', ['option'], ['select', 'td', 'th', 'table']), ('tr', ['tr', 'td', 'th'], ['table', 'thead', 'tbody', 'tfoot']),
  ('td', ['td', 'th'], ['tr', 'table', 'thead', 'tbody', 'tfoot']), ('th', ['td', 'th'], ['tr', 'table', 'thead', 'tbody', 'tfoot']),
  ('thead', ['thead', 'tbody', 'tfoot', 'tr', 'td', 'th'], ['table']), ('tbody', ['thead', 'tbody', 'tfoot', 'tr', 'td', 'th'], ['table']), ('tfoot', ['thead', 'tbody', 'tfoot', 'tr', 'td', 'th'], ['table'])) AS v(name, ends, stops)),
bal_tags AS (
  SELECT t.doc_id, t.ord, t.kind, t.name, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.ord) AS n,
         CASE WHEN kind = 'close' THEN [t.name] ELSE coalesce(e.ends, []) END AS ends,
         CASE WHEN kind = 'open' THEN coalesce(e.stops, []) WHEN t.name IN ('table', 'html', 'body') THEN [] WHEN t.name IN ('tr', 'td', 'th', 'thead', 'tbody', 'tfoot', 'caption') THEN ['table'] ELSE ['td', 'th', 'table', 'caption'] END AS stops
  FROM tokens t LEFT JOIN ending e ON e.name = t.name WHERE kind IN ('open', 'close')),
bal AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS ord, CAST([] AS VARCHAR[]) AS stack, CAST([] AS VARCHAR[]) AS ended, false AS dropped FROM cut
  UNION ALL
  SELECT doc_id, n, ord,
         CASE WHEN kind = 'open' THEN list_append(stack[:place - 1], name) WHEN place <= len(stack) THEN stack[:place - 1] ELSE stack END,
         CASE WHEN kind = 'open' THEN list_reverse(stack[place:]) ELSE list_reverse(stack[place + 1:]) END,
         kind = 'close' AND place > len(stack)
  FROM (SELECT t.*, b.stack,
               -- The place from which on elements end: of an end tag the last of its name, of a start tag the first of what it implies.
               coalesce(CASE WHEN t.kind = 'close' THEN list_max(p.hits) ELSE list_min(p.hits) END, len(b.stack) + 1) AS place
        FROM bal b JOIN bal_tags t ON t.doc_id = b.doc_id AND t.n = b.n + 1,
             LATERAL (SELECT coalesce(list_max(list_filter(range(1, len(b.stack) + 1), lambda i: list_contains(t.stops, b.stack[i]))), 0) AS stop) s,
             LATERAL (SELECT list_filter(range(1, len(b.stack) + 1), lambda i: i > s.stop AND list_contains(t.ends, b.stack[i])) AS hits) p)),
bal_last AS (SELECT doc_id, stack FROM bal QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1),
bal_rows AS (
  SELECT t.doc_id, t.ord, 1000000 AS j, t.kind, t.name, coalesce(t.text, '') AS text, false AS implied FROM tokens t ANTI JOIN (SELECT * FROM bal WHERE dropped) d USING (doc_id, ord)
  UNION ALL SELECT doc_id, ord, unnest(range(len(ended))), 'close', unnest(ended), '', true FROM bal WHERE len(ended) > 0
  UNION ALL SELECT doc_id, 1000000000, unnest(range(len(stack))), 'close', unnest(list_reverse(stack)), '', true FROM bal_last WHERE len(stack) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, j) AS INTEGER) AS ord, kind, name, text, implied FROM bal_rows"""


#: An element ends at the first end tag after it at which as many elements are open as before it.
BALANCED_CTE = BALANCED.replace("\nSELECT doc_id, CAST(row_number()", ",\nbalanced_tokens AS (SELECT doc_id, CAST(row_number()") + ")"
REGIONS = BALANCED_CTE + """,
open_now AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM balanced_tokens),
regions0 AS (
  SELECT doc_id, ord AS start, ord AS "end", CAST(n + 1 AS INTEGER) AS level, name FROM open_now WHERE kind = 'empty'
  UNION ALL SELECT a.doc_id, a.ord, min(b.ord), CAST(a.n AS INTEGER), a.name FROM open_now a JOIN open_now b ON a.doc_id = b.doc_id AND b.ord > a.ord AND b.kind = 'close' AND b.n = a.n - 1 WHERE a.kind = 'open' GROUP BY ALL),
regions AS (SELECT x.*, coalesce((SELECT max(y.start) FROM regions0 y WHERE y.doc_id = x.doc_id AND y.start < x.start AND y."end" > x.start), 0) AS parent FROM regions0 x)"""
AXES = """
SELECT x.doc_id, x.start, x."end" AS stop, x.level, x.name, x.parent,
       count(*) FILTER (y.start > x.start AND y.start < x."end") AS descendants, count(*) FILTER (y.start < x.start AND y."end" > x.start) AS ancestors,
       count(*) FILTER (y."end" < x.start) AS preceding, count(*) FILTER (y.start > x."end") AS following,
       count(*) FILTER (y.parent = x.parent AND y.start < x.start) AS siblings_before, count(*) FILTER (y.parent = x.parent AND y.start > x.start) AS siblings_after
FROM regions x LEFT JOIN (SELECT * FROM regions WHERE name = 'p') y ON x.doc_id = y.doc_id GROUP BY ALL"""


def depth(names: list[str]) -> str:
    among = ", ".join(map(q, names))
    return f"sum(CASE WHEN name IN ({among}) AND kind = 'open' THEN 1 WHEN name IN ({among}) AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord)"


_PARA = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "h7", "h8", "h9", "li"]
_IN_PARA = ", ".join(map(q, _PARA))
PAGE_LINES = f"""
starts AS (SELECT *, kind = 'open' AND name IN ({_IN_PARA}) AS starts FROM tokens),
placed AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER w AS INTEGER) AS para_id, sum(CAST(starts OR name = 'br' AS INTEGER)) OVER w AS line_no,
                  {depth(_PARA)} AS in_para, {depth(['table'])} AS in_table, last_value(CASE WHEN starts THEN name LIKE 'h_' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS header
           FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
joined AS (SELECT doc_id, line_no, min(para_id) AS para_id, arg_min(header, ord) AS header, string_agg(text, '' ORDER BY ord) AS text
           FROM placed WHERE kind = 'text' AND in_para > 0 AND in_table <= 0 GROUP BY doc_id, line_no),
trimmed AS (SELECT doc_id, line_no, para_id, header, regexp_replace(regexp_replace(text, '[ \\t]*\\n[ \\t]*', ' ', 'g'), {q(f'^{WS}+|{WS}+$')}, '', 'g') AS text FROM joined)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS line_id, para_id, header, text FROM trimmed WHERE text <> ''"""

TEXT_LINES = "text_split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), text_lines AS (SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_id, unnest(ls) AS text FROM text_split)"


def _escaped(col: str) -> str:
    return f"replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


#: Character by character: what stands over each one, and which tags end or begin between it and the next.
MARKED = f"""
mk_words AS (SELECT doc_id, line_id, unnest(w) AS w, unnest(range(len(w))) AS k, len(w) AS n_words FROM (SELECT *, regexp_extract_all(text, '[^\\s\\x{{A0}}]+') AS w FROM text_lines)),
mk_placed AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id, line_id ORDER BY k) AS e FROM mk_words),
mk_sizes AS (SELECT doc_id, line_id, max(e) AS n FROM mk_placed GROUP BY ALL),
mk_spans AS (
  SELECT doc_id, line_id, e - length(w) AS a, e AS b, 9 AS rank, 'v' AS tag FROM mk_placed WHERE regexp_matches(w, '^[A-Z]')
  UNION ALL SELECT doc_id, line_id, e - length(w) + 1, e - 1, 10, 'abbr' FROM mk_placed WHERE k % 3 = 2 AND length(w) > 2
  UNION ALL SELECT doc_id, line_id, min(e - length(w)), max(e), 5, 'i' FROM mk_placed WHERE k BETWEEN 1 AND 3 AND n_words > 3 GROUP BY ALL
  UNION ALL SELECT doc_id, line_id, min(e - length(w)) + 1, max(e), 6, 'u' FROM mk_placed WHERE k BETWEEN 2 AND 5 AND n_words > 5 GROUP BY ALL
  UNION ALL SELECT doc_id, line_id, n // 4, n // 2, 7, 'sup' FROM mk_sizes WHERE n > 3
  UNION ALL SELECT doc_id, line_id, n // 3, 2 * n // 3, 2, 'intx' FROM mk_sizes WHERE n > 2),
mk_units AS (SELECT doc_id, line_id, unnest(u) AS unit, unnest(range(len(u))) AS p FROM (SELECT doc_id, line_id, regexp_extract_all(text, '[^\\s\\x{{A0}}][\\s\\x{{A0}}]*') AS u FROM text_lines)),
mk_over AS (SELECT u.doc_id, u.line_id, u.p, list({{'a': s.a, 'b': s.b, 'rank': s.rank, 'tag': s.tag}} ORDER BY s.a, s.b DESC, s.rank) AS st
            FROM mk_units u JOIN mk_spans s ON u.doc_id = s.doc_id AND u.line_id = s.line_id AND s.a <= u.p AND s.b > u.p GROUP BY ALL),
mk_stacks AS (SELECT u.*, coalesce(o.st, []) AS st FROM mk_units u LEFT JOIN mk_over o USING (doc_id, line_id, p)),
mk_near AS (SELECT *, coalesce(lag(st) OVER w, []) AS before, coalesce(lead(st) OVER w, []) AS after FROM mk_stacks WINDOW w AS (PARTITION BY doc_id, line_id ORDER BY p)),
mk_kept AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, len(st) + 1), lambda i: coalesce(st[i] = before[i], false)), false), 0) - 1, len(st)) AS k0,
                   coalesce(nullif(list_position(list_transform(range(1, len(st) + 1), lambda i: coalesce(st[i] = after[i], false)), false), 0) - 1, len(st)) AS k1 FROM mk_near),
mk_out AS (SELECT doc_id, line_id, string_agg(
      coalesce(array_to_string(list_transform(st[k0 + 1:], lambda x: '<' || x.tag || '>'), ''), '') || {_escaped("unit[1]")}
      || coalesce(array_to_string(list_reverse(list_transform(st[k1 + 1:], lambda x: '</' || x.tag || '>')), ''), '') || substr(unit, 2), '' ORDER BY p) AS body FROM mk_kept GROUP BY ALL)
SELECT doc_id, line_id, regexp_extract(text, '^[\\s\\x{{A0}}]*') || coalesce(body, '') AS marked FROM text_lines LEFT JOIN mk_out USING (doc_id, line_id)"""


def lexicon(least: int) -> str:
    return f"lexicon AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[a-z]+'))) AS word FROM documents WHERE lang = 'en') GROUP BY word HAVING count(*) >= {least})"


ENGLISH_COUNTS = f"""
s AS (SELECT doc_id, line_id, string_split_regex({simplified('text')} || ' ', {q(WS + '+')}) AS t FROM text_lines),
e AS (SELECT doc_id, line_id, CAST(len(t) - 1 AS INTEGER) AS word_count, unnest(list_distinct(t)) AS w FROM s),
c AS (SELECT e.doc_id, e.line_id, e.word_count, CAST(count(l.word) AS INTEGER) AS english_count FROM e LEFT JOIN lexicon l ON e.w = l.word AND l.word <> '' GROUP BY ALL)
SELECT doc_id, line_id, word_count, english_count, {PROPORTION} AS proportion, {WEIGHT} AS weight FROM c"""


def sentences(keys: str) -> str:
    marked = f"regexp_replace(regexp_replace(text, {q(SENTENCE_BOUNDARY)}, '\\1' || chr(1) || '\\2', 'g'), {q(SENTENCE_END)}, '\\1' || chr(1), 'g')"
    return f"""
cut_s AS (SELECT {keys}, list_filter(string_split(replace({marked}, '¬ ', ''), chr(1)), lambda s: trim(s) <> '') AS ss FROM paras),
sentences AS (SELECT {keys}, CAST(unnest(range(1, len(ss) + 1)) AS INTEGER) AS sentence_no, unnest(ss) AS text FROM cut_s)"""


OCR = """
noisy AS (SELECT list_distinct(string_split_regex(translate(text, 'livs', '148$'), '[ \\x{A0}]+')) AS ws FROM text_lines),
types AS (SELECT old, count(*) AS n FROM (SELECT unnest(ws) AS old FROM noisy) WHERE regexp_matches(old, '[148$]') AND regexp_matches(old, '[a-z]') GROUP BY old)
SELECT old, translate(old, '148$', 'livs') AS new, n FROM types WHERE lower(translate(old, '148$', 'livs')) IN (SELECT word FROM lexicon)"""

SUFFIXES = """
SELECT word, regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '([sxz])$', '\\1es'), '([sc]h)$', '\\1es'), 'y$', 'ies'), '([^s])$', '\\1s') AS s,
       CASE WHEN word LIKE '%e' THEN word || 'd' WHEN word LIKE '%y' THEN regexp_replace(word, 'y$', 'ied') ELSE word || 'ed' END AS ed,
       regexp_replace(word, 'e$', '') || 'ing' AS ing FROM lexicon"""

RUN_LENGTHS = """
WITH n AS (SELECT event_id, user_id, event_type <> 'click' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS j FROM events)
SELECT event_id, user_id,
       CAST(CASE WHEN f THEN i - coalesce(max(CASE WHEN NOT f THEN i END) OVER (PARTITION BY user_id ORDER BY i), 0) ELSE 0 END AS INTEGER) AS since,
       CAST(CASE WHEN f THEN j - coalesce(max(CASE WHEN NOT f THEN j END) OVER (PARTITION BY user_id ORDER BY j), 0) ELSE 0 END AS INTEGER) AS until FROM n"""


def param_lines(lines: list[str]) -> str:
    listed = ", ".join("replace(" + q(x.replace("\t", "<tab>")) + ", '<tab>', chr(9))" for x in lines)
    return f"WITH lines AS (SELECT n_name AS doc_id, n_nationkey AS n, unnest([{listed}, 'ex_head_number_regex:' || chr(9) || '[' || n_nationkey || '-9]+']) AS text FROM nation)"


TAXONOMY = """
WITH t AS (
  SELECT 0 AS line_id, 0 AS depth, 'World' AS label UNION ALL SELECT r_regionkey * 1000 + 1, 1, r_name FROM region
  UNION ALL SELECT n_regionkey * 1000 + n_nationkey + 2, 2, n_name FROM nation),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY line_id) AS INTEGER) AS id FROM t)
SELECT 1 AS doc_id, id, CAST(coalesce((SELECT max(p.id) FROM n p WHERE p.id < n.id AND p.depth = n.depth - 1), 0) AS INTEGER) AS parent_id, CAST(depth AS INTEGER) AS depth, 'geo::' || label AS label, false AS skips FROM n"""
#: Places of edits: the last token before that is neither moved nor passed, then what comes first.
REPELLED = """
left_kinds AS (SELECT *, CASE WHEN kind = 'empty' AND name IN ('br', 'img') THEN 1 WHEN kind = 'open' AND name IN ('b', 'i', 'a', 'p') THEN 2 ELSE 0 END AS side FROM balanced_tokens),
left_places AS (SELECT *, coalesce(max(CASE WHEN side = 0 THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS stretch FROM left_kinds),
lefted AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stretch, side, ord) AS ord, kind, name, text FROM left_places),
right_kinds AS (SELECT *, CASE WHEN kind = 'close' AND name IN ('b', 'i', 'a', 'p') THEN 1 WHEN kind = 'empty' AND name IN ('br', 'img') THEN 2 ELSE 0 END AS side FROM lefted),
right_places AS (SELECT *, coalesce(max(CASE WHEN side = 0 THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS stretch FROM right_kinds)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY stretch, side, ord) AS INTEGER) AS ord, kind, name, coalesce(text, '') AS text FROM right_places"""
LAYERS = """
put AS (
  SELECT doc_id, ord, 0 AS side, kind, name, text FROM balanced_tokens
  UNION ALL SELECT doc_id, start, -1, 'open', 'block', '' FROM regions WHERE name IN ('p', 'img')
  UNION ALL SELECT doc_id, start, 1, 'open', 'body', '' FROM regions WHERE name = 'p'
  UNION ALL SELECT doc_id, "end", -1, 'close', 'body', '' FROM regions WHERE name = 'p'
  UNION ALL SELECT doc_id, "end", 1, 'close', 'block', '' FROM regions WHERE name IN ('p', 'img'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, side) AS INTEGER) AS ord, kind, name, coalesce(text, '') AS text FROM put"""
