"""HTML documents as ordered tokens: one row a tag or text, in document order, instead of a tree."""

from __future__ import annotations

import json
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOID = ["meta", "link", "br", "img", "hr", "input"]
#: Stripped before tokens are cut: their content isn't markup.
OPAQUE = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<!DOCTYPE[^>]*>"
#: Entities that stand for markup characters become their small forms, so that texts never hold markup.
ENTITIES = [("&lt;", "﹤"), ("&gt;", "﹥"), ("&amp;", "﹠"), ("&#13;", "\n"), ("&nbsp;", "\u00a0"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'")]
#: An entity, or what stands between entities.
ENTITY = "(&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&)"
#: A tag whose attributes may hold > in quotes; one with a quote that isn't closed; declarations; text; a < that begins no tag.
#: No alternative can be matched in two ways, so quantifiers needn't give back what they took.
TOKEN = r"""(</?[A-Za-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|</?[A-Za-z][^>]*+>|<[!?/][^>]*+>|[^<]++|<)"""

# Start tags that imply end tags: what they end, and what these end tags don't reach beyond.
_ROWS = ["tr", "td", "th"]
_GROUPS = ["thead", "tbody", "tfoot"]
IMPLIED = {
    "p": (["p"], ["td", "th", "table", "caption", "button"]),
    "li": (["li"], ["ul", "ol", "td", "th", "table"]),
    "dt": (["dt", "dd"], ["dl", "td", "th", "table"]),
    "dd": (["dt", "dd"], ["dl", "td", "th", "table"]),
    "option": (["option"], ["select", "td", "th", "table"]),
    "tr": (_ROWS, ["table", *_GROUPS]),
    "td": (["td", "th"], ["tr", "table", *_GROUPS]),
    "th": (["td", "th"], ["tr", "table", *_GROUPS]),
} | {g: ([*_GROUPS, *_ROWS], ["table"]) for g in _GROUPS}
#: An end tag doesn't reach beyond the cell it is in, unless it is one of a table, a row or a cell; those don't reach beyond the table.
ENDS_TABLE, ENDS_IN_TABLE, CELL = ["table", "html", "body"], [*_ROWS, *_GROUPS, "caption"], ["td", "th", "table", "caption"]


def read_documents(spark: SparkSession, path: str, pattern: str = "*_body_*.htm*") -> DataFrame:
    """grammars(doc_id, html): whole files; the id is the file's name without its ending."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.html?$", "").alias("doc_id"), F.regexp_replace("value", "^\ufeff", "").alias("html"))


def _named() -> Column:
    """All named entities that end in a semicolon, as a constant map; those of markup characters as in ENTITIES."""
    small = str.maketrans("<>&", "﹤﹥﹠")
    return F.from_json(F.lit(json.dumps({f"&{n}": to.translate(small) for n, to in html5.items() if n.endswith(";")})), "map<string,string>")


def _numbered(entity: Column) -> Column:
    """The character of a numeric entity; one that no character has stays as it is."""
    digits = F.regexp_extract(entity, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
    code = F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    small = F.when(code == 60, "﹤").when(code == 62, "﹥").when(code == 38, "﹠")
    return small.when((code < 1) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), entity).otherwise(char)


def decode_entities(text: Column) -> Column:
    """Entities as characters: the usual ones by replacement; others, named or numeric, only where an ampersand is left."""
    for entity, to in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(to))
    named = _named()
    one = lambda p: F.when(p.startswith("&#") & p.endswith(";"), _numbered(p)).when(p.startswith("&") & p.endswith(";"), F.coalesce(F.try_element_at(named, p), p)).otherwise(p)
    parts = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces() -> Column:
    """The tokens of html as they stand: an array of (tok, kind, name)."""
    cut = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), OPAQUE, ""), F.lit(TOKEN), F.lit(1))

    def of(tok: Column, name: Column) -> Column:
        kind = F.when(~tok.startswith("<") | (tok == "<"), "text").when((name == "") | name.isin(VOID) | (tok.endswith("/>") & ~tok.startswith("</")), "empty").when(tok.startswith("</"), "close").otherwise("open")
        return F.struct(tok.alias("tok"), kind.alias("kind"), name.alias("name"))

    name = lambda tok: F.when(tok.startswith("<"), F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))).otherwise("")
    return F.transform(cut, lambda tok: _let(name(tok), lambda n: of(tok, n)))


def with_cells(docs: DataFrame) -> DataFrame:
    """docs that have a cell of a table: no other one's tokens need be cut to find the cells."""
    return docs.where(F.regexp_replace(F.coalesce("html", F.lit("")), OPAQUE, "").rlike("(?i)<t[dh]"))


def _text(tok: Column) -> Column:
    """What a text token says; a < that began no tag becomes its small form, like its entity."""
    return F.when(tok == "<", "﹤").otherwise(decode_entities(tok))


def tokens(docs: DataFrame) -> DataFrame:
    """tokens(doc_id, ord, tok, kind, name, text): kind is open, close, empty or text; ord counts from 1.

    A < that begins no tag is a text token of its own."""
    t = docs.select("doc_id", F.posexplode(_pieces()).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("ord"), "p.tok", "p.kind", "p.name")
    return t.withColumn("text", F.when(F.col("kind") == "text", _text(F.col("tok"))))


def _repairs(kinds: Column, names: Column) -> Column:
    """Repairs (i, j, name) of the tokens of pages: end tags to put in before the i-th token, in the order j, or, where j is -1, that it goes.

    A walk over a page's tags with the stack of open elements. Texts don't take part, only repairs are gathered, and a page whose tags are right has none."""
    rules = {n: (frozenset(ends), frozenset(stops)) for n, (ends, stops) in IMPLIED.items()}
    none = (frozenset(), frozenset())
    tables, within, cell = frozenset(ENDS_TABLE), frozenset(ENDS_IN_TABLE), frozenset(CELL)

    def turn(stack: list[str], name: str, close: bool, i: int, out: list[tuple]) -> None:
        """The stack, the innermost last, after a tag, and the repairs before it."""
        if close and stack and stack[-1] == name:
            stack.pop()
            return
        ends, stops = (frozenset([name]), frozenset() if name in tables else frozenset(["table"]) if name in within else cell) if close else rules.get(name, none)
        gone = 0
        # A start tag ends the outermost of what it implies, an end tag the innermost of its name.
        for k, n in enumerate(reversed(stack) if ends else (), 1):
            if n in stops:
                break
            if n in ends:
                gone = k
                if close:
                    break
        if close and not gone:
            out.append((i, -1, None))
        out.extend((i, j, stack[-1 - j]) for j in range(gone - 1 if close else gone))
        del stack[len(stack) - gone :]
        if not close:
            stack.append(name)

    def page(tags: list[tuple[int, str, bool]], size: int) -> list[tuple]:
        stack, out = [], []
        for i, name, close in tags:
            turn(stack, name, close, i, out)
        return out + [(size, j, n) for j, n in enumerate(reversed(stack))]

    @F.arrow_udf("array<struct<i:int,j:int,name:string>>")
    def run(kinds: pa.Array, names: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(kinds).fill_null(0).to_pylist()
        kind, name = kinds.flatten(), names.flatten()
        is_tag = pc.is_in(kind, pa.array(["open", "close"]))
        place = np.flatnonzero(is_tag.to_numpy(zero_copy_only=False))
        tags, at, first, pages = list(zip(place.tolist(), name.filter(is_tag).to_pylist(), pc.equal(kind.filter(is_tag), "close").to_pylist())), 0, 0, []
        for size, end in zip(sizes, np.searchsorted(place, np.cumsum(sizes)).tolist()):
            pages.append(page([(i - first, n, c) for i, n, c in tags[at:end]], size))
            at, first = end, first + size
        flat = [r for p in pages for r in p]
        columns = [pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["i", "j", "name"]))

    return run(kinds, names)


def balanced(docs: DataFrame, deal: bool = False) -> DataFrame:
    """tokens() of documents whose tags are put right, with implied: true for an end tag that isn't there.

    Start tags end what can't hold them (a paragraph, an item, a cell, a row), end tags also end what is open inside, an end tag without
    a start goes, and what is open at the end is ended. Texts stay, in order; a page whose tags are right stays as it is. One
    pass over each page's own tokens, without a shuffle. deal: pages with their repairs are dealt out by document before they are exploded, since the
    walk, in Python, forgets how they were dealt; else windows by document would shuffle tokens."""
    d = docs.select("doc_id", _pieces().alias("pieces")).withColumn("repairs", _repairs(F.col("pieces.kind"), F.col("pieces.name")))
    d = dealt_out(d) if deal else d
    last = 1 << 30
    row = lambda i, j, tok, kind, name, implied: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), tok.alias("tok"), kind.alias("kind"), name.alias("name"), F.lit(implied).alias("implied"))
    own = F.transform("pieces", lambda p, i: row(i, F.lit(last), p["tok"], p["kind"], p["name"], False))
    put = F.transform("repairs", lambda r: row(r["i"], r["j"], F.concat(F.lit("</"), r["name"], F.lit(">")), F.lit("close"), r["name"], True))
    wrong = F.size("repairs") > 0
    d = d.select("doc_id", wrong.alias("wrong"), F.when(wrong, F.sort_array(F.concat(own, put))).otherwise(own).alias("m"))
    before = lambda i: F.get("m", i - 1)
    stays = lambda x, i: (x["j"] >= 0) & ~F.coalesce((before(i)["j"] == -1) & (before(i)["i"] == x["i"]), F.lit(False))
    t = d.select("doc_id", F.posexplode(F.when(F.col("wrong"), F.filter("m", stays)).otherwise(F.col("m"))).alias("o", "p")).select("doc_id", (F.col("o") + 1).alias("ord"), "p.tok", "p.kind", "p.name", "p.implied")
    return t.select("doc_id", "ord", "tok", "kind", "name", F.when(F.col("kind") == "text", _text(F.col("tok"))).alias("text"), "implied")


def dealt_out(docs: DataFrame) -> DataFrame:
    """docs by a stated number of partitions, which isn't coalesced: a page is few bytes as it stands, and many once it is tokens in several sorts, so
    what a task holds is settled here. Tokens keep this partitioning through all windows by document, and aren't shuffled."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def attributes(tok: Column) -> Column:
    """The attributes of a tag as a map; of a repeated one the first."""
    one = r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*')"""
    names = F.transform(F.regexp_extract_all(tok, F.lit(one), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(tok, F.lit(one), F.lit(2)), lambda v: F.substring(v, F.lit(2), F.length(v) - 2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(first)


def attribute(tok: Column, name: str) -> Column:
    """One attribute of a tag, or null."""
    return F.nullif(F.regexp_extract(tok, rf"""(?i)\b{name}\s*=\s*(["'])(.*?)\1""", 2), F.lit(""))


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def depth(names: list[str]) -> Column:
    """How many open elements of these names a token is in (its own opening included, its closing not)."""
    one = F.when(F.col("name").isin(names) & (F.col("kind") == "open"), 1).when(F.col("name").isin(names) & (F.col("kind") == "close"), -1).otherwise(0)
    return F.sum(one).over(_order()).cast("int")


def drop_elements(t: DataFrame, names: list[str]) -> DataFrame:
    """Without the elements of these names and all they hold."""
    d = t.withColumn("inside", depth(names))
    closes = F.col("name").isin(names) & (F.col("kind") == "close")
    return d.where((F.col("inside") <= 0) & ~closes & ~(F.col("name").isin(names) & (F.col("kind") == "empty"))).drop("inside")


def unwrap_elements(t: DataFrame, names: list[str]) -> DataFrame:
    """Without the tags of these names; what they hold stays."""
    return t.where(~(F.col("name").isin(names) & (F.col("kind") != "text")))


def wrap_matches(text: Column, pattern: str, opening: str, closing: str) -> Column:
    return F.regexp_replace(text, f"({pattern})", f"{opening}$1{closing}")


def count_descendants(t: DataFrame, name: str) -> DataFrame:
    """(doc_id, ord, n): for each opening tag, how many elements of a name are inside it. Matching ends are found by depth."""
    closed = F.coalesce(F.lag("kind").over(Window.partitionBy("doc_id").orderBy("ord")) == "close", F.lit(False))
    d = t.withColumn("step", (F.col("kind") == "open").cast("int") - closed.cast("int")).withColumn("level", F.sum("step").over(_order()))
    d = d.withColumn("hits", F.sum(((F.col("name") == name) & F.col("kind").isin("open", "empty")).cast("long")).over(_order()))
    level = Window.partitionBy("doc_id", "level").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(F.col("kind") == "close", F.col("hits")), ignorenulls=True).over(level)
    return d.withColumn("end", end).where("kind = 'open'").select("doc_id", "ord", "name", (F.coalesce("end", "hits") - F.col("hits")).alias("n"))


def number_in_order(t: DataFrame, names: list[str], prefix: str = "seq_", out: str = "html_id") -> DataFrame:
    """Consecutive ids, in document order, for the openings of these names."""
    hit = F.col("name").isin(names) & (F.col("kind") == "open")
    return t.withColumn(out, F.when(hit, F.concat(F.lit(prefix), F.sum(hit.cast("int")).over(_order()).cast("string"))))


def taxonomy(lines: DataFrame, namespace: str = "") -> DataFrame:
    """taxonomy(doc_id, id, parent_id, depth, label, skips) from tab-indented lines(doc_id, line_id, text).

    Lines that begin with # and blank ones are left out. A parent is the last line before that is one tab less
    deep; skips says that a line is more than one tab deeper than the one before. The root has id 0."""
    w = Window.partitionBy("doc_id").orderBy("line_id")
    d = lines.where(~F.trim("text").startswith("#") & (F.trim(F.replace("text", F.lit("\t"), F.lit(" "))) != ""))
    d = d.withColumn("depth", F.length(F.regexp_extract("text", "^(\t*)", 1)).cast("int")).withColumn("id", F.row_number().over(w))
    # A line stands among those of its own depth, for its children, and among those one less deep, to find its parent.
    each = d.withColumn("among", F.explode(F.array(F.col("depth"), F.col("depth") - 1))).withColumn("own", F.col("among") == F.col("depth"))
    level = Window.partitionBy("doc_id", "among").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = F.last(F.when(F.col("own"), F.col("id")), ignorenulls=True).over(level)
    d = d.withColumn("skips", F.col("depth") > F.coalesce(F.lag("depth").over(w), F.lit(-1)) + 1)
    parents = each.withColumn("parent_id", F.coalesce(up, F.lit(0))).where("NOT own").select(F.col("doc_id").alias("p_doc"), F.col("id").alias("p_id"), "parent_id")
    d = d.join(parents, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("id") == F.col("p_id")))
    label = F.concat(F.lit(f"{namespace}::" if namespace else ""), F.regexp_replace("text", "^\t+", ""))
    return d.withColumn("label", label).select("doc_id", "id", "parent_id", "depth", "label", "skips")
