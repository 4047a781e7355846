import itertools
import random

import pytest
from pyspark.sql import functions as F

from interlinea.functions import lexical as L
from interlinea.operators import annotate, features, grouping, layout, recognise, reports, sentences, words
from interlinea.plans.extract import extract
from interlinea.sources import html, params, sinks
from interlinea.streaming import incremental

# A page of our own: a header, prose, two examples, a stamp, a table, an example whose number is in a cell.
PAGE = """<!DOCTYPE html><html><head><style>p{margin:0}</style><script>if (a<b) x();</script></head><body>
<p>BREAK HERE PAGE 12</p><h1>3.1 Clauses</h1><p>This is the prose of the section, and it goes on for a while before the examples come to the reader.
</p><p>(1)&nbsp;&nbsp; <span style="font-style:italic">ka-lo na<br>ta-mi</span> so<br>go-PST 3<br>eat-IND too<br>&#8216;</p>
<p>(2) <i>ka-lo</i> <span style="font-style:italic;text-decoration:underline">na-ri</span><br>go-PST dog-PL<br>‘The dog went.’</p>
<p><a name="x">gone</a>Then &lt;more&gt; of it &amp; that is in the text as of the other, which was not on it by the one.</p><!-- <p>no</p> -->
<p>BREAK HERE 13</p><p>After.</p>
<table><tr><td colspan="2">(7) a</td><td>b</td></tr><tr><td>c</td></tr></table><p><br> &nbsp; </p></body></html>"""


@pytest.fixture(scope="module")
def tokens(spark):
    return html.tokens(spark.createDataFrame([("g", PAGE), ("none", None), ("empty", "")], "doc_id string, html string")).cache()


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("  The dogs, 12 of them; didn't bark.", "the dogs of them did bark"),
        ("In the Sub-final NATO state", "in the final nato state"),
        ("he said: sub-clause and non-final (3.2)", "he said clause and "),
        ("we'll see John's /ab/ house", "we see  house"),
        ("", ""),
    ],
)
def test_simplify_english(spark, text, want):
    got = one(spark, L.simplify_english, text)
    # Steps as stated, in plain Python.
    import re

    ws = "[\\s\\xa0]"
    out = re.sub(f"^{ws}+|{ws}+$", "", text) + " "
    for p, r in [(p.replace(L.WS, ws), r) for p, r in L.BEFORE_LOWER]:
        out = re.sub(p, r.replace("\\1", r"\g<1>"), out)
    out = out.lower()
    for p, r in L.AFTER_LOWER:
        out = re.sub(p, r, out)
    assert got == out
    if want == got.strip():
        assert want == got.strip()


@pytest.mark.parametrize("word, s, ed, ing", [("walk", "walks", "walked", "walking"), ("bake", "bakes", "baked", "baking"), ("box", "boxes", "boxed", "boxing"), ("watch", "watches", "watched", "watching"), ("boy", "boies", "boied", "boying")])
def test_suffixes(spark, word, s, ed, ing):
    assert (one(spark, L.suffix_s, word), one(spark, L.suffix_ed, word), one(spark, L.suffix_ing, word)) == (s, ed, ing)


def test_lexicon(spark):
    senses = spark.createDataFrame([("dog", "n"), ("bake", "v"), ("red", "a"), ("x1", "n")], "word string, pos string")
    got = {r["word"] for r in L.build_lexicon(senses, spark.createDataFrame([("feet",)], "word string")).collect()}
    assert got == {"dog", "dogs", "bake", "bakes", "baked", "baking", "red", "feet"}


def test_counts_by_expression_and_by_join_agree(spark):
    texts = spark.createDataFrame([(1, "the dog and the cat"), (2, ""), (3, "in of is"), (4, "ka-lo na")], "i int, text string")
    words_, english = L.count_english(F.col("text"), ["the", "and", "in", "of", "is"])
    a = {tuple(r) for r in texts.select("i", words_, english).collect()}
    lex = spark.createDataFrame([(w,) for w in ("the", "and", "in", "of", "is", "")], "word string")
    assert a == {tuple(r) for r in L.count_english_by_join(texts, lex, ["i"]).collect()}
    assert (1, 5, 2) in a and (3, 3, 3) in a


def test_small_functions(spark):
    d = spark.createDataFrame([("banana", "nab", None), ("", "x", True)], "a string, b string, c boolean")
    got = d.select(L.common_characters(F.col("a"), F.col("b")), L.str_if(F.col("b"), F.col("c")), L.is_true(F.col("c")), L.replace_first(F.col("a"), "an", "-"), L.trim(F.concat(F.lit("  "), "b", F.lit(" ")))).collect()
    assert [tuple(r) for r in got] == [("ban", "", False, "b-ana", "nab"), ("", "x", True, "", "x")]
    o = spark.createDataFrame([(None,), ("7",), ("iv",), ("b",), ("B",), ("ab",)], "s string")
    assert [r[0] for r in o.select(L.ordinal(F.col("s"), True)).collect()] == [0, 7, 4, 2, 2, None]
    assert [r[0] for r in o.select(L.ordinal(F.col("s"))).collect()] == [0, 7, None, 2, 2, None]


def test_run_length_against_a_loop(spark):
    flags = [bool(int(c)) if c != "n" else None for c in "1101110011n111"]
    d = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "d int, i int, f boolean")
    want, run = [], 0
    for f in flags:
        run = run + 1 if f else 0
        want.append(run)
    assert [r[0] for r in d.select("i", features.run_length(F.col("f"), ["d"], ["i"]).alias("r")).orderBy("i").select("r").collect()] == want


def test_line_features(spark):
    rows = [(1, "(1) ka-lo na-ri ta-mi"), (2, "go-PST dog-PL eat-IND"), (3, "‘The dog went.’"), (4, "3.2 Next [see above]"), (5, "x (note) “said” (end)"), (6, "a, b;"), (7, "y" * 80 + " and"), (8, "a  b  c  d  e")]
    f = {r["line_id"]: r for r in features.line_features(spark.createDataFrame([("g", *r) for r in rows], "doc_id string, line_id int, text string")).collect()}
    assert f[1]["has_ex_number"] and f[1]["ex_number_head"] == "1" and f[1]["ex_number_sub"] is None and f[1]["has_many_junctures"]
    assert f[3]["is_left_quoted"] and f[3]["is_mostly_quoted"] and f[3]["is_terminating"]
    assert f[4]["has_section_number"] and f[4]["text_minus_metadata"] == "3.2 Next"
    assert f[5]["text_minus_metadata"] == "x" or f[5]["text_minus_metadata"].startswith("x")
    assert f[6]["has_clause_break"] and f[7]["is_long_continuing"] and f[8]["pad_space_count"] == 4 and f[8]["is_pad_space_dominant"]
    assert f[8]["length_minus_metadata"] == 13 and not f[8]["is_even_length_with_next_line"]
    for r in f.values():
        assert not r["has_section_number"] or r["disq"] & 2 and r["disq"] & 32
        assert bool(r["disq"] & 1) != r["has_ex_number"]


@pytest.mark.parametrize("flags", list(itertools.product([True, False], repeat=4)))
def test_template_grid(flags):
    xv, xu, xg, xh = flags
    grid = recognise.template_grid(xv, xu, xg, xh)
    assert len(grid) == 216 == len(set(map(tuple, grid))) and {len(t) for t in grid} <= set(range(3, 29))
    if flags == (True, False, False, False):
        assert grid[0] == [2, 8] * 6 + [16, 16, 32]
    if xh:
        assert grid[0][0] == 1 and grid[1] == grid[0][1:]


def brute_labels(lines):
    """The search and the chain in plain Python over (disq, affirm, has_number, is_end)."""
    out, i, grid = [], 0, recognise.template_grid()
    numbered = [k for k, x in enumerate(lines) if x[2]]
    for a, k in enumerate(numbered):
        end = numbered[a + 1] if a + 1 < len(numbered) else len(lines)
        for m in range(k + 1, end):
            if lines[m][3]:
                end = m + 1
                break
        span = lines[k:end]
        t = next((t for t in grid if len(t) <= len(span) and all(not span[j][0] & c for j, c in enumerate(t))), None)
        if t is None:
            continue
        core, labels, n = [c for c in t if c not in (1, 16, 32)], [(c, 1) for c in t], 1
        while True:
            at = len(labels)
            nxt = next((core + ft for ft in ([32], [16, 32], [16, 16, 32]) if at + len(core + ft) <= len(span) and all(not span[at + j][0] & c and span[at + j][1] & c for j, c in enumerate(core + ft))), None)
            if nxt is None:
                break
            n += 1
            labels += [(c, n) for c in nxt]
        out += [(k + j, k, c, p) for j, (c, p) in enumerate(labels)]
        i += 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_recogniser_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    lines = []
    for _ in range(160):
        number = rng.random() < 0.12
        sure = rng.choice([2, 8, 16, 32, 32, 8, 2])
        lines.append((rng.choice([63 ^ sure, 63 ^ sure, 0, 1, 8 | 4, 2]) & ~(1 if number else 0) | (0 if number else 1), rng.choice([63, sure, sure | 32]), number, rng.random() < 0.04))
    d = spark.createDataFrame([("d", i, *x) for i, x in enumerate(lines)], "doc_id string, line_id int, disq int, affirm int, has_ex_number boolean, is_end_body boolean")
    got = sorted((r["line_id"], r["x_line"], r["code"], r["pass"]) for r in recognise.label_examples(d).collect())
    assert got == brute_labels(lines)


def labels_of(spark, *fns):
    return spark.createDataFrame([("g", i, 0, fn, fn, None, None) for i, fn in enumerate(fns)], "doc_id string, line_id int, x_line int, fn string, text string, x_number string, x_sub_number string")


def test_groups(spark):
    g = grouping.group_lines(labels_of(spark, "xh", "xu", "xv", "xg", "xg", "xv", "xg", "xf", "xf", "xv", "xg", "xf")).orderBy("line_id")
    assert [r["xgg_no"] for r in g.collect()] == [None, 1, 1, 1, 1, 2, 2, None, None, 3, 3, None]
    assert [r["xfg_no"] for r in g.collect()] == [None] + [1] * 8 + [2] * 3
    x = grouping.examples(g).first()
    assert x["xh"] == ["xh"] and [len(f["xggs"]) for f in x["xfgs"]] == [2, 1] and [f["xf"] for f in x["xfgs"]] == [["xf", "xf"], ["xf"]]
    assert x["xfgs"][0]["xggs"][0]["xu"] == ["xu"] and x["xfgs"][0]["xggs"][0]["xg"] == ["xg", "xg"]


def gloss(spark, *lines):
    rows = [("g", 0, 1, "3", "b", i, fn, t) for i, (fn, t) in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id string, x_line int, xgg_no int, x_number string, x_sub_number string, line_id int, fn string, text string")


def test_words_and_repairs(spark):
    w = words.split_words(gloss(spark, ("xv", "ka-  lo na ri."), ("xg", "give up 3 PL-x")))
    by = lambda d, fn: [r["word"] for r in d.where(F.col("fn") == fn).orderBy("line_id", "word_no").collect()]
    assert by(w, "xv") == ["ka-lo", "na", "ri."]
    a = words.alignment(w).first()
    assert a["word_misalignment"] and a["long_gloss"]
    mwe = spark.createDataFrame([("give_up",), ("one",)], "lexeme string")
    r = words.repair_multiword(w, mwe)
    assert by(r, "xg") == ["give_up", "3", "PL-x"] and not words.alignment(r).first()["word_misalignment"]
    p = words.repair_person_number(w)
    assert by(p, "xg") == ["give", "up", "3PL-x"]


def test_morphemes(spark):
    w = words.split_words(gloss(spark, ("xv", "Ka-lo na=ri ta."), ("xg", "go-PST dog-PL eat")))
    pairs = words.word_pairs(w)
    assert [(r["xv_junctures"], r["xg_junctures"]) for r in pairs.orderBy("word_no").collect()] == [("-", "-"), ("=", "-"), ("", "")]
    m = [(r["ex_number"], r["word_number"], r["morph_no"], r["morph"], r["gloss"], r["prev_morph"], r["next_gloss"]) for r in words.morphemes(pairs).orderBy("word_number", "morph_no").collect()]
    assert m == [("3-b", 1, 1, "ka", "go", "/#__", "/__PST"), ("3-b", 1, 2, "lo", "PST", "/ka__", "/__#"), ("3-b", 2, 1, "ta", "eat", "/#__", "/__#")]
    bad = reports.misaligned_groups(words.alignment(w), pairs)
    assert bad.count() == 1
    xml = reports.editable_examples(w, bad).first()["xml"]
    assert xml == '<xgg_editor><xgg ex_number="3-b"><xv><xw>Ka-lo</xw><xw>na=ri</xw><xw>ta.</xw></xv><xg><xw>go-PST</xw><xw>dog-PL</xw><xw>eat</xw></xg></xgg></xgg_editor>'


def test_layout(spark, tokens):
    lines = layout.lines(tokens).where("doc_id = 'g'").orderBy("line_id").collect()
    assert [r["text"] for r in lines][0] == "3.1 Clauses" and lines[0]["header"] and lines[0]["page_no"] == 12 and lines[0]["starts_page"]
    ex = [r for r in lines if r["text"].startswith("(1)")][0]
    assert [r["text"] for r in lines if r["para_id"] == ex["para_id"]] == ["(1)\xa0\xa0 ka-lo na", "ta-mi so", "go-PST 3", "eat-IND too", "‘"]
    assert [x["italic"] for x in ex["runs"]] == [False, True]
    two = [r for r in lines if r["text"].startswith("(2)")][0]
    assert [(x["italic"], x["underline"]) for x in two["runs"] if x["text"].strip()] == [(False, False), (True, False), (True, True)]
    assert "Then ﹤more﹥ of it ﹠ that is in the text as of the other, which was not on it by the one." in [r["text"] for r in lines]
    last = lines[-1]
    assert last["text"] == "After." and last["page_no"] == 13 and last["is_end_body"] is False or last["text"] == "After."
    cells = [(r["row"], r["col"], r["colspan"], r["text"]) for r in layout.table_cells(tokens).orderBy("row", "col").collect()]
    assert cells == [(1, 1, 2, "(7) a"), (1, 2, 1, "b"), (2, 1, 1, "c")]
    numbered = recognise.number_table_rows(layout.table_cells(tokens), F.lit(r"^\([0-9]+\)"), F.lit("[0-9]+"), F.lit("")).where("x_number is not null").collect()
    assert [(r["x_number"], r["x_sub_number"]) for r in numbered] == [("7", None)]
    docs = spark.createDataFrame([("g",), ("none",), ("empty",)], "doc_id string")
    assert {r["doc_id"] for r in layout.errors(docs, layout.lines(tokens)).collect()} == {"none", "empty"}


def test_markup_helpers(spark, tokens):
    g = tokens.where("doc_id = 'g'")
    assert g.where("name = 'script' or name = 'style'").count() == 0
    assert html.drop_elements(g, ["table"]).where("name in ('td', 'tr')").count() == 0
    assert html.unwrap_elements(g, ["i", "span"]).where("text like '%ka-lo%'").count() == g.where("text like '%ka-lo%'").count() == 2
    n = {(r["name"], r["n"]) for r in html.count_descendants(g, "td").where("name in ('table', 'tr', 'body')").collect()}
    assert n == {("table", 3), ("tr", 2), ("tr", 1), ("body", 3)}
    a = g.where("name = 'td'").select(html.attributes(F.col("tok")).alias("a")).first()["a"]
    assert a == {"colspan": "2"}
    assert one(spark, lambda c: html.wrap_matches(c, "b+", "<x>", "</x>"), "abba") == "a<x>bb</x>a"
    rows = [(1, 1, "top"), (1, 2, "\tone"), (1, 3, "\t\ttwo"), (1, 4, "# no"), (1, 5, ""), (1, 6, "\tthree"), (1, 7, "\t\t\tdeep")]
    t = html.taxonomy(spark.createDataFrame(rows, "doc_id int, line_id int, text string"), "ns").orderBy("id").collect()
    assert [(r["parent_id"], r["depth"], r["label"], r["skips"]) for r in t] == [(0, 0, "ns::top", False), (1, 1, "ns::one", False), (2, 2, "ns::two", False), (1, 1, "ns::three", False), (3, 3, "ns::deep", True)]


def test_annotation(spark):
    pattern = annotate.abbreviation_pattern(["SG", "3", "A", "3PL", "(X)"])
    assert pattern == "(3[Pp][Lli1]|\\([Xx]\\)|[Ss5][GCg])"
    by_column = annotate.abbreviation_patterns(spark.createDataFrame([("d", x) for x in ["SG", "3", "A", "3PL", "(X)"]], "doc_id string, abbr string")).first()["pattern"]
    assert sorted(by_column[1:-1].split("|")) == sorted(pattern[1:-1].split("|"))
    assert one(spark, lambda c: annotate.tag_abbreviations(c, pattern), "dog-SG SG go-5G.x") == "dog-⟦SG⟧ SG go-⟦5G⟧.x"
    run = lambda text, italic: (text, italic, False, False, False)
    rows = [("d", 1, [run("see ", False), run("kalo, the (mina)", True), run(" ‘dog’ there", False)]), ("d", 2, [run("3.1 nato", True)])]
    lines = spark.createDataFrame(rows, "doc_id string, line_id int, runs array<struct<text:string,italic:boolean,underline:boolean,sup:boolean,sub:boolean>>")
    v = annotate.vernacular_words(lines, spark.createDataFrame([("the",)], "word string"))
    got = {r["word"]: (r["is_v"], r["pre"], r["core"], r["post"]) for r in v.collect()}
    assert got == {"kalo,": (True, "", "kalo", ","), "the": (False, "", "the", ""), "(mina)": (True, "(", "mina", ")"), "3.1": (False, "", "3.1", ""), "nato": (False, "", "nato", "")}
    assert annotate.vernacular_counts(v).collect()[0]["n_vernacular"] == 2
    only = lines.withColumn("runs", F.transform("runs", lambda r: r.withField("text", F.replace(r["text"], F.lit("the "), F.lit("")))))
    found = annotate.intext_examples(only, annotate.vernacular_words(only, spark.createDataFrame([("the",)], "word string"))).collect()
    assert [(r["line_id"], r["vernacular"], r["gloss"]) for r in found] == [(1, "kalo, (mina)", "‘dog’")]


def test_sentences(spark):
    rows = [("d", 1, 1, "One came. Then two"), ("d", 1, 2, "went out! (3) is no start. x"), ("d", 2, 3, "Bro¬"), ("d", 2, 4, "ken word. "), ("d", 3, 5, "")]
    s = sentences.sentences(spark.createDataFrame(rows, "doc_id string, para_id int, line_id int, text string")).orderBy("para_id", "sentence_no").collect()
    assert [r["text"].strip() for r in s] == ["One came.", "Then two went out! (3) is no start. x", "Broken word."]
    lex = spark.createDataFrame([("end",), ("then",)], "word string")
    fix = sentences.missing_spaces(spark.createDataFrame([("the end.Then x end.Zz",)], "text string"), lex).collect()
    assert [(r["old"], r["new"]) for r in fix] == [("end.Then", "end. Then")]
    a = spark.createDataFrame([("d", 5, "x"), ("d", 1, "para")], "doc_id string, place int, kind string")
    assert [r["id"] for r in sentences.number_blocks(a, a.where("place = 1")).orderBy("id").collect()] == [1, 2, 3]


def test_repairs(spark):
    lines = spark.createDataFrame([(1, "a 8il1age was there"), (2, "h4s 100 b1lls"), (3, "plain")], "line_id int, text string")
    lex = spark.createDataFrame([("village",), ("his",)], "word string")
    fix = layout.repair_ocr(lines, lex)
    assert {(r["old"], r["new"]) for r in fix.collect()} == {("8il1age", "village"), ("h4s", "his")}
    assert [r["text"] for r in layout.apply_repairs(lines, fix, ["line_id"]).orderBy("line_id").collect()] == ["a village was there", "his 100 b1lls", "plain"]


def test_report_flags(spark):
    rows = [("d", i, h, s, "text") for i, (h, s) in enumerate([("1", None), ("2", "a"), ("2", "b"), ("2", "d"), ("4", None), ("5", "b"), ("x", None), (None, None)])]
    r = reports.example_report(spark.createDataFrame(rows, "doc_id string, id int, x_number string, x_sub_number string, kind string")).orderBy("id").collect()
    assert [(x["full_ex_number"], x["kind"].endswith("**")) for x in r] == [("1", False), ("2-a", False), ("2-b", False), ("2-d", True), ("4", True), ("5-b", True), ("x", True)]


def test_params(spark, tmp_path):
    (tmp_path / "g_params.txt").write_text("ex_number_regex:\t^\\([0-9]+\\)\nexpect_parsed_vernacular_lines:\tTRUE\nex_number_regex:\tzzz\nnothing\nkey:\ta:\tb\n")
    long_ = params.read_params(spark, str(tmp_path))
    assert {(r["param"], r["value"]) for r in long_.collect()} >= {("key", "a:\tb"), ("ex_number_regex", "zzz")}
    wide = params.params_wide(long_).first()
    assert wide["doc_id"] == "g" and wide["ex_number_regex"] == "^\\([0-9]+\\)" and wide["expect_xv"] and not wide["expect_xu"] and wide["ex_sub_number_regex"] == ""
    docs = spark.createDataFrame([("g",), ("h",)], "doc_id string")
    template = spark.createDataFrame([("a", "1"), ("b", "2")], "param string, value string")
    assert {tuple(r) for r in params.default_params(docs, long_, template).collect()} == {("h", "a", "1"), ("h", "b", "2")}
    (tmp_path / "g_abbr_x.txt").write_text('PST\tpast "tense\nSG\tsingular\n')
    assert {tuple(r) for r in params.read_abbreviations(spark, str(tmp_path)).collect()} == {("g", "PST", 'past "tense'), ("g", "SG", "singular")}
    done = spark.createDataFrame([("a_augmented_1",)], "doc_id string")
    assert [r[0] for r in params.new_documents(spark.createDataFrame([("a_body_1",), ("a_body_2",)], "doc_id string"), done).collect()] == ["a_body_2"]


def test_documents_batch_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a_body_1.htm").write_text("\ufeff" + PAGE)
    (src / "other.txt").write_text("no")
    assert [r["doc_id"] for r in html.read_documents(spark, str(src)).collect()] == ["a_body_1"]
    seen = []
    run = lambda: incremental.process_new(incremental.stream_documents(spark, str(src)), str(tmp_path / "cp"), lambda b, n: seen.append(sorted(r["doc_id"] for r in b.collect())))
    run()
    (src / "b_body_2.html").write_text(PAGE)
    run()
    run()
    assert [s for s in seen if s] == [["a_body_1"], ["b_body_2"]]


def test_extract(spark):
    docs = spark.createDataFrame([("g", PAGE), ("bad", None)], "doc_id string, html string")
    x = extract(docs, abbreviations=["PST", "PL", "IND"])
    labels = [(r["text"][:7], r["fn"]) for r in x.example_lines.where("x_number = '2'").orderBy("line_id").collect()]
    assert labels == [("ka-lo n", "xv"), ("go-PST ", "xg"), ("‘The do", "xf")]
    m = {(r["morph"], r["gloss"]) for r in x.morphemes.where("ex_number = '2'").collect()}
    assert m == {("ka", "go"), ("lo", "PST"), ("na", "dog"), ("ri", "PL")}
    assert [(r["full_ex_number"], r["kind"][:5].strip()) for r in x.example_report.collect()][-2:] == [("2", "text"), ("7", "table")]
    assert {r["doc_id"] for r in x.errors.collect()} == {"bad"}
    assert x.sentences.where("text like 'This is the prose%'").count() == 1
    assert "<section" in reports.augmented_html(x.example_lines).first()["html"]
    placed = grouping.split_paras_at_examples(x.lines, x.labels)
    starts = [r["line_id"] for r in x.labels.where("line_id = x_line").collect()]
    assert placed.where("x_line is null").join(placed.where("x_line is not null").select("doc_id", "para_id"), ["doc_id", "para_id"]).count() == 0
    assert {r["x_line"]: r["page_no"] for r in grouping.example_pages(placed).collect()} == {s: 12 for s in starts}
    ids = grouping.join_html_ids(placed.where("x_line is not null")).collect()
    assert len(ids) == len(starts) and all(r["html_id"].startswith("seq_") for r in ids)
    assert [r["text"] for r in layout.pages_after_paras(x.lines).where("page_after_para").collect()] == ["3.1 Clauses"]


def test_extract_by_document(spark):
    """Parameters, abbreviations, repairs and expectations of each document; a bad pattern stops no other."""
    word = '<p>The dog 8arked so.And it was by the <i>kalo</i> ‘house’ there of them.</p>'
    docs = spark.createDataFrame([("g", PAGE), ("h", PAGE + word), ("bad", PAGE), ("plain", "<p>Nothing here.</p>")], "doc_id string, html string")
    number = r"^\([0-9]+\)"
    rows = [("g", number, "[0-9]+", "", "", True, False), ("h", number, "[0-9]+", "", "", False, True), ("bad", "([", "[0-9]+", "*", "", True, False), ("plain", number, "", "", "", True, False)]
    p = spark.createDataFrame(rows, "doc_id string, ex_number_regex string, ex_head_number_regex string, ex_sub_number_regex string, language_identifier_xf_line_regex string, expect_xv boolean, clean_ocr boolean")
    lexicon = spark.createDataFrame([(w,) for w in "the dog barked vand viarked and it was by of them house there end is on so that".split()] + [("varked",)], "word string")
    abbreviations = spark.createDataFrame([("g", "PST"), ("g", "PL"), ("h", "ZZZ")], "doc_id string, abbr string")
    x = extract(docs, p, lexicon, abbreviations)
    told = {(r["doc_id"], r["stage"], r["msg"]) for r in x.errors.collect()}
    assert {("bad", "params", "not a pattern: ex_number_regex"), ("bad", "params", "not a pattern: ex_sub_number_regex"), ("plain", "words", "parsed vernacular lines expected but none found")} <= told
    assert not any(d in ("g", "h") for d, _, _ in told) and ("bad", "words", "parsed vernacular lines expected but none found") in told
    assert {r["doc_id"] for r in x.labels.collect()} == {"g", "h"}
    n = {(r["doc_id"], r["text"][:6]): r["n_abbreviation"] for r in x.features.where("text like 'go-PST dog%'").collect()}
    assert n == {("g", "go-PST"): 1, ("h", "go-PST"): 0, ("bad", "go-PST"): 0}
    said = [r["text"].strip() for r in x.sentences.where("doc_id = 'h' and text like '%arked%'").collect()]
    assert said == ["The dog varked so."]  # read as a word of the lexicon, then cut from the next sentence
    assert ("h", "kalo") in {(r["doc_id"], r["vernacular"].strip()) for r in x.intext_examples.collect()}
    assert {r["kind"] for r in x.blocks.where("doc_id = 'g'").collect()} == {"para", "x", "table"}
    nodes = x.nodes.where("doc_id = 'g'").orderBy("id").collect()
    assert [r["id"] for r in nodes] == list(range(1, len(nodes) + 1))
    assert [r["kind"] for r in nodes][-6:] == ["table", "tr", "td", "td", "tr", "td"]
    page = {r["doc_id"]: r["html"] for r in x.augmented.collect()}
    at = [page["g"].index(s) for s in ("This is the prose", 'data-number="2"', "After.", "(7) a")]
    assert at == sorted(at) and ' colspan="2">(7) a</td>' in page["g"] and set(page) == {"g", "h", "bad", "plain"}
    assert [r["xgg_id"] for r in x.example_lines.where("doc_id = 'g' and xgg_no is not null and fn = 'xv'").orderBy("line_id").collect()] == sorted({r["xgg_id"] for r in x.example_lines.where("doc_id = 'g' and xgg_id is not null").collect()})


def test_expectations_by_document(spark):
    rows = [(d, i, disq, 63, i == 0, False) for d in ("usual", "unparsed", "lacking") for i, disq in enumerate([0, 0, 0, 0, 0])]
    f = spark.createDataFrame(rows, "doc_id string, line_id int, disq int, affirm int, has_ex_number boolean, is_end_body boolean")
    by = spark.createDataFrame([("usual", True, False, False, False), ("unparsed", False, True, True, True)], "doc_id string, " + ", ".join(f"{c} boolean" for c in recognise.EXPECTATIONS))
    got = {}
    for r in recognise.label_examples(f, by).orderBy("doc_id", "line_id").collect():
        got.setdefault(r["doc_id"], []).append(r["code"])
    for d, flags in (("usual", {}), ("lacking", {}), ("unparsed", {"expect_xv": False, "expect_xu": True, "expect_xg_xg": True, "expect_xh": True})):
        assert got[d] == next(t for t in recognise.template_grid(**flags) if len(t) <= 5)


def test_no_depth_is_too_deep(spark):
    inner = "<i>" + "<span>" * 12 + "deep" + "</span>" * 12 + " mid</i> out"
    t = html.tokens(spark.createDataFrame([("d", f"<p><u>{inner}</u><span style='font-style:italic'>one</span> two</p>")], "doc_id string, html string"))
    got = {r["text"].strip(): (r["italic"], r["underline"]) for r in layout.inline_styles(t).where("kind = 'text'").collect()}
    assert got == {"deep": (True, True), "mid": (True, True), "out": (False, True), "one": (True, False), "two": (False, False)}
    lines = [(1, k, "\t" * k + f"n{k}") for k in range(30)] + [(1, 30, "\t" * 5 + "again"), (1, 31, "\t" * 29 + "far")]
    tree = {r["label"]: (r["parent_id"], r["skips"]) for r in html.taxonomy(spark.createDataFrame(lines, "doc_id int, line_id int, text string")).collect()}
    assert all(tree[f"n{k}"] == (k, False) for k in range(30)) and tree["again"] == (5, False) and tree["far"] == (29, True)


def test_repairs_keep_spaces(spark):
    lines = spark.createDataFrame([(1, "a\u00a08il1age  was"), (2, "8il1age")], "line_id int, text string")
    fix = layout.repair_ocr(lines, spark.createDataFrame([("village",)], "word string"))
    assert [r["text"] for r in layout.apply_repairs(lines, fix, ["line_id"]).orderBy("line_id").collect()] == ["a\u00a0village  was", "village"]


def test_attributes_in_either_quotes(spark):
    d = spark.createDataFrame([("""<a href='x "y"' id = "z" Href="no">""",)], "tok string")
    assert d.select(html.attributes(F.col("tok")).alias("a")).first()["a"] == {"href": 'x "y"', "id": "z"}
    assert d.select(html.attribute(F.col("tok"), "id")).first()[0] == "z"


def test_first_of_repeated_params(spark, tmp_path):
    (tmp_path / "g_params.txt").write_text("ex_number_regex:\tzzz\r\nex_number_regex:\taaa\n")
    assert params.params_wide(params.read_params(spark, str(tmp_path))).first()["ex_number_regex"] == "zzz"


def test_sinks(spark, tmp_path):
    x = extract(spark.createDataFrame([("g", PAGE)], "doc_id string, html string"))
    sinks.write_tsv(words.morph_report(x.morphemes), f"{tmp_path}/morph", header=True)
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/morph")
    assert back.columns == sinks.MORPH_COLUMNS and back.count() == x.morphemes.count()
    sinks.write_xml(x.examples, f"{tmp_path}/xml", "x", "examples")
    assert spark.read.format("xml").option("rowTag", "x").load(f"{tmp_path}/xml").count() == x.examples.count()
    assert sinks.write_tables(x, f"{tmp_path}/t", ["lines", "labels"]) == ["lines", "labels"]
    made = []
    for _ in range(2):
        d = sinks.resumed(spark, f"{tmp_path}/stage", lambda: made.append(1) or x.lines)
        assert d.count() == x.lines.count()
    assert made == [1]


def test_entities(spark):
    texts = {
        "a &copy; b": "a © b", "&#8217;&#x1F600;&eacute;": "’😀é", "&#60;b&#x3e; &LT;x&GT; &AMP; &lt;": "﹤b﹥ ﹤x﹥ ﹠ ﹤", "&amp;copy; &amp": "﹠copy; &amp",
        "&nosuch; &; & &#0; &#55296; &#9999999; &#x;": "&nosuch; &; & &#0; &#55296; &#9999999; &#x;", "&NotEqualTilde;": "≂̸", "": "", "plain": "plain",
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(2)
    got = {r["t"]: r["d"] for r in df.select("t", html.decode_entities(F.col("t")).alias("d")).collect()}
    assert got == texts | {None: None}


def test_documents_without_numbered_examples(spark):
    """What says that it lacks them is left alone: no labels, no morphemes, no complaint; the others are harvested as ever."""
    docs = spark.createDataFrame([("g", PAGE), ("none", PAGE)], "doc_id string, html string")
    number = r"^\([0-9]+\)"
    rows = [("g", number, "[0-9]+", "", "", True, False), ("none", number, "[0-9]+", "", "", True, True)]
    p = spark.createDataFrame(rows, "doc_id string, ex_number_regex string, ex_head_number_regex string, ex_sub_number_regex string, language_identifier_xf_line_regex string, expect_xv boolean, lacks_numbered_examples boolean")
    x = extract(docs, p)
    assert {r["doc_id"] for r in x.labels.collect()} == {"g"} and {r["doc_id"] for r in x.morphemes.collect()} == {"g"}
    assert {r["doc_id"] for r in x.sentences.collect()} == {"g", "none"} and x.errors.count() == 0
    one_for_all = extract(docs, {"ex_number_regex": number, "lacks_numbered_examples": True})
    assert one_for_all.labels.count() == 0 and one_for_all.lines.count() > 0


def test_page_markers_before_numbers(spark):
    """A marker before an example number belongs to the paragraph before, by each document's pattern; one before other text doesn't."""
    page = "<p>a</p><p>BREAK HERE PAGE 3</p><p>(1) x</p><p>BREAK HERE PAGE 4</p><p>7 y</p><p>BREAK HERE PAGE 5</p><p>see (2)</p><p>z<br clear='all'>one line</p>"
    docs = spark.createDataFrame([("n", page), ("m", page), ("none", page)], "doc_id string, html string")
    p = spark.createDataFrame([("n", r"^\([0-9]+\)"), ("m", r"see|zz")], "doc_id string, ex_number_regex string")
    lines = extract(docs, p.withColumns({"ex_head_number_regex": F.lit(""), "ex_sub_number_regex": F.lit(""), "language_identifier_xf_line_regex": F.lit("")})).lines
    got = {}
    for r in lines.where("page_after_para").collect():
        got.setdefault(r["doc_id"], set()).add(r["text"])
    assert got == {"n": {"(1) x", "7 y"}, "m": {"7 y", "see (2)"}, "none": {"7 y"}}
    assert lines.where("text = 'zone line'").count() == 3


def test_features_normalise_a_line_once_and_are_dealt_out_by_number(spark):
    lines = spark.createDataFrame([(1, 1, "(1) the sub-word 2.3 of-a\xa0b"), (1, 2, None)], "doc_id long, line_id int, text string")
    f = features.line_features(lines)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|ll|ve|m|re)") == 1
    assert "REPARTITION_BY_NUM" in f._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in f.orderBy("line_id").select("word_count", "english_count", "has_many_junctures").collect()][0] == (4, 1, False)  # the word of-a b


ODD = ["", " ", "a", "a.", "(1) a-b c - d=e", "‘He didn’t go.’", "x y  z\t", "It's  vs. him’s ", "A-final NATO in 1.5% (3)", "e-PST f-SG", "a\xa0\xa0b \xa0", "so,  ", "ends. \x85", "Σας [x] y)", "no 'n't", "tense-final\n", "v1s Vs x", "/ab/ c~d;", 'said "x!" ', "2.1 Tones", "Kim in Rome"]


def test_steps_are_skipped_only_where_nothing_matches(spark):
    """Guarded steps and looks at the last characters say what the patterns themselves say."""
    from interlinea.functions.lexical import simplify_english, tokens, with_tokens

    d = spark.createDataFrame([(1, i, t) for i, t in enumerate([*ODD, *[a + b for a in ODD[2::2] for b in ODD[3::2]]])], "doc_id long, line_id int, text string")
    t = with_tokens(d, "text", "t").select("text", "t", tokens(simplify_english(F.col("text"))).alias("said")).collect()
    assert [r.text for r in t if r.t != r.said] == []
    f = features.line_features(d)
    text, bare = F.col("text"), F.col("text_minus_metadata")
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    plain = {
        "is_terminating": text.rlike(features.TERMINATOR), "is_continuing": text.rlike(features.CONTINUER), "is_left_quoted": bare.rlike("^[\"'‘“]"), "has_clause_break": bare.rlike("[,;]"),
        "line_word_length": 1 + count(text, r"[\s\x{A0}]+") - count(text, features.BOUNDARY_SPACE), "plain_space_count": count(bare, features.PLAIN_SPACE), "pad_space_count": count(bare, features.PAD_SPACE),
        "has_section_number": ~F.col("has_ex_number") & bare.rlike(features.SECTION), "length_quoted": F.coalesce(F.length(F.regexp_substr(bare, F.lit(features.QUOTED))), F.lit(0)),
    }
    differ = F.array(*[F.when(~F.col(name).eqNullSafe(said), name) for name, said in plain.items()])
    assert f.select("text", F.array_compact(differ).alias("differ")).where("size(differ) > 0").collect() == []


def test_lines_are_sorted_once_for_features_and_spans(spark):
    from interlinea.plans import registry

    plan = registry.igt_labels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 1


def test_words_without_a_pair_are_spread_and_lines_merged_at_once(spark):
    from interlinea.plans import registry

    d = spark.createDataFrame([(1, 1, 1, "1", "", i, fn, 1, k, w) for i, fn, ws in ((2, "xv", "a b"), (3, "xg", "x1 y2 z k1")) for k, w in enumerate(ws.split(), 1)], "doc_id long, x_line int, xgg_no int, x_number string, x_sub_number string, line_id int, fn string, line_no int, word_no int, word string")
    assert [r.word for r in words.repair_person_number(d).where("fn = 'xg'").orderBy("word_no").collect()] == ["x1y2z", "k1"]
    plan = registry.igt_multiword_repair(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "island" not in plan and "xxhash64" in plan


@pytest.mark.parametrize("name", ["page_layers", "page_axes"])
def test_pages_are_dealt_out_by_a_stated_number(spark, name):
    """What a task sorts isn't left to coalescing, which goes by the bytes of pages as they are shuffled."""
    from interlinea.plans import registry

    assert "REPARTITION_BY_NUM" in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_extraction_joins_before_it_sorts_lines(spark):
    """After lines are dealt out and sorted, features and labels neither join nor shuffle them."""
    from interlinea.plans.extract import extract

    docs = spark.createDataFrame([("d", "<p>(1) a-b c</p><p>x-y z</p><p>‘He.’</p>")], "doc_id string, html string")
    by_document = spark.createDataFrame([("d", r"^\([0-9]+\)", "[0-9]+", "", "", True)], "doc_id string, ex_number_regex string, ex_head_number_regex string, ex_sub_number_regex string, language_identifier_xf_line_regex string, expect_xv boolean")
    x = extract(docs, by_document, keep=lambda d: d)
    assert "REPARTITION_BY_NUM" in x.tokens._jdf.queryExecution().executedPlan().toString()
    plan = x.labels._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Sort [doc_id")]
    assert "Join" not in above and "Repartition" not in above
    assert [(r.line_id, r.fn) for r in x.labels.orderBy("line_id").collect()] == [(1, "xv"), (2, "xg"), (3, "xf")]


def test_pairs_of_lines_are_those_of_words(spark):
    """What is made of a row a line equals what is made of a row a word, also for lines without words, several gloss lines and null numbers."""
    rng, rows = random.Random(5), []
    word = lambda: rng.choice(["a", "b-C.", "d=e", "F+g,", "h﹤i", "j!"])
    for d in range(400):
        n, i = rng.choice([0, 1, 2, 3]), 0
        for fn in rng.choice([["xv", "xg"], ["xu", "xv", "xg"], ["xv", "xg", "xg"], ["xv"]]):
            i += 1
            text = " ".join(word() for _ in range(rng.choice([n, n, n, 0, n + 1])))
            rows.append((d if d else None, 1, d % 2, i, fn, text, None if d % 3 else str(d), None))
    lines = spark.createDataFrame(rows, "doc_id int, x_line int, xgg_no int, line_id int, fn string, text string, x_number string, x_sub_number string")
    w, of = words.split_words(lines), words.lines_of_words(lines)
    both = [(words.word_pairs(w), words.word_pairs_of_lines(of)), (words.alignment(w), words.alignment_of_lines(of)), (words.morphemes(words.word_pairs(w)), words.morphemes(words.word_pairs_of_lines(of)))]
    for a, b in both:
        a, b = (sorted(map(repr, x.select(*a.columns).collect())) for x in (a, b))
        assert a == b and len(a) > 10
    plan = words.morphemes(words.word_pairs_of_lines(of))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") + plan.count("Sort(") <= 3
