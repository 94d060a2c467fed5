"""Rich notes (JSON) and Markdown, each from the other, by expressions and joins.

A note's blocks have a bounded depth each, so a note becomes Markdown in one
projection over its VARIANT, without a shuffle.  Markdown becomes a note line by
line: which lines belong together is found by windows over a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import diagrams
from skerry.functions.names import col
from skerry.functions.variants import is_object, member, once, string, whole_json
from skerry.sources.staging import written

# Members of a node, and of its attributes.
ID, ATTRS, CHILDREN, KIND, SPANS, TEXT, MARKS, MARK = "3", "4", "5", "6", "7", "8", "9", "2"

_NO_NODES = "array<variant>"


def _nodes(node: Column, name: str) -> Column:
    """The objects in a member that is a list."""
    listed = F.coalesce(member(node, name, _NO_NODES), F.array().cast(_NO_NODES))
    return F.filter(listed, is_object)


def _attr(node: Column, name: str) -> Column:
    """An attribute that is a string, or ''."""
    return F.coalesce(string(F.try_variant_get(node, f"$['{ATTRS}']['{name}']", "variant")), F.lit(""))


def _span(span: Column) -> Column:
    star = lambda mark: F.when(mark == "b", "**").when(mark == "i", "*").otherwise("")
    marks = F.transform(_nodes(span, MARKS), lambda m: once(F.coalesce(string(member(m, MARK)), F.lit("")), star))
    around = lambda text: F.aggregate(marks, text, lambda t, s: F.concat(s, t, s))
    return once(F.coalesce(string(member(span, TEXT)), F.lit("")), lambda text: F.when((text == "") | member(span, MARKS).isNull(), text).otherwise(around(text)))


def _spans(node: Column) -> Column:
    return F.array_join(F.transform(_nodes(node, SPANS), _span), "")


def _line(node: Column) -> Column:
    """Text of the first child's spans."""
    return F.coalesce(F.get(F.transform(_nodes(node, CHILDREN), _spans), F.lit(0)), F.lit(""))


def _inline(node: Column) -> Column:
    """Text of all children; link children become links."""

    def one(child: Column) -> Column:
        inner, target = member(child, CHILDREN), string(F.try_variant_get(child, f"$['{ATTRS}']['hf']", "variant"))
        link = (string(member(child, KIND)) == "li") & inner.isNotNull() & target.isNotNull()
        return F.when(member(child, SPANS).isNotNull() & inner.isNull(), _spans(child)).when(link, F.concat(F.lit("["), _line(child), F.lit("]("), target, F.lit(")"))).otherwise("")

    return F.array_join(F.transform(_nodes(node, CHILDREN), one), "")


def _code(node: Column) -> Column:
    return F.array_join(F.transform(_nodes(node, CHILDREN), lambda x: F.concat(_line(x), F.lit("\n"))), "")


def _fenced(language: Column, code: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), code, F.lit("```"))


def _heading(node: Column) -> Column:
    kind = _attr(node, "l")
    level = F.coalesce(F.nullif(F.regexp_extract(F.replace(kind, F.lit("h"), F.lit("")), "^[0-9]{1,4}", 0).try_cast("int"), F.lit(0)), F.lit(1))
    return once(_inline(node), lambda text: F.when((text == "") | (kind == ""), text).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)))


def _item(node: Column) -> Column:
    level = F.greatest(F.lit(1.0), F.coalesce(F.try_variant_get(node, f"$['{ATTRS}']['ll']", "double"), F.lit(1.0)))
    bullet = F.concat(F.repeat(F.lit("  "), F.least(level - 1, F.lit(1000.0)).cast("int")), F.lit("- "), _inline(node))
    return F.when(_attr(node, "lt") == "ordered", F.concat(F.lit("1. "), _inline(node))).otherwise(bullet)


def _table(node: Column) -> Column:
    def cell(node: Column) -> Column:
        lines = F.flatten(F.transform(F.slice(_nodes(node, CHILDREN), 1, 1), lambda x: F.slice(_nodes(x, CHILDREN), 1, 1)))
        first = F.flatten(F.transform(lines, lambda x: F.slice(_nodes(x, SPANS), 1, 1)))
        return F.coalesce(F.get(F.transform(first, lambda s: string(member(s, TEXT))), F.lit(0)), F.lit(" "))

    def row(node: Column, i: Column) -> Column:
        rule = lambda cells: F.when(i == 1, F.concat(F.repeat(F.lit("| -- "), F.size(cells)), F.lit("|\n"))).otherwise("")
        return once(F.transform(_nodes(node, CHILDREN), cell), lambda cells: F.concat(F.rtrim(F.concat(rule(cells), F.lit("| "), F.array_join(F.transform(cells, lambda c: F.concat(c, F.lit(" | "))), ""))), F.lit("\n")))

    return F.array_join(F.transform(_nodes(node, CHILDREN), row), "")


def _diagram(node: Column) -> Column:
    language = F.when(F.lower(_attr(node, "la")) == "mermaid", "mermaid").otherwise("plantuml")
    made = lambda code: F.concat(F.lit("```mermaid\n"), once(F.trim(code, F.lit(" \t\r\n")), diagrams.plantuml_to_mermaid), F.lit("\n```"))
    return once(_code(node), lambda code: F.when(code.contains(diagrams.SOURCE_MARK), made(code)).otherwise(_fenced(language, code)))


def _quote(node: Column) -> Column:
    return F.array_join(F.transform(_nodes(node, CHILDREN), lambda x: F.concat(F.lit("> "), F.replace(_inline(x), F.lit("\n"), F.lit("")), F.lit("\n"))), "")


def _block_text(node: Column) -> Column:
    """A block's Markdown by its kind."""
    by_kind = {
        "h": _heading(node), "l": _item(node), "t": _table(node), "q": _quote(node), "diagram": _diagram(node), "cd": _fenced(_attr(node, "la"), _code(node)), "la": _fenced(F.lit(""), _code(node)),
        "im": F.concat(F.lit("![]("), _attr(node, "u"), F.lit(")")), "a": F.concat(F.lit("["), _attr(node, "fn"), F.lit("]("), _attr(node, "re"), F.lit(")")),
    }

    def text(kind: Column) -> Column:
        out = F
        for k, made in by_kind.items():
            out = out.when(kind == k, made)
        return F.when(kind == "", _inline(node)).otherwise(out.otherwise(_inline(node)))

    return once(F.coalesce(string(member(node, KIND)), F.lit("")), text)


def note_to_markdown(note: Column | str) -> Column:
    """Rich-note JSON as Markdown: '' if it isn't such JSON, null for null.

    Blocks without text are left out; list items stand in lines below each other,
    other blocks have an empty line between them.
    """
    blocks = F.transform(_nodes(whole_json(col(note)), CHILDREN), lambda b: F.struct((F.coalesce(string(member(b, KIND)), F.lit("")) == "l").alias("item"), _block_text(b).alias("text")))

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("boolean")), F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p["item"]))
        # of no parts, the place before the first is left
        return F.zip_with(parts, before, lambda p, last: F.concat(F.when(last.isNull(), "").when(last & p["item"], "\n").otherwise("\n\n"), p["text"]))

    text = once(F.filter(blocks, lambda p: p["text"] != ""), lambda parts: F.array_join(joined(parts), ""))
    return F.when(col(note).isNotNull(), F.coalesce(text, F.lit("")))


# --- Markdown to notes -----------------------------------------------------------

_CUT, _RUN, _LINK = "﷐", "\x02", "\x03"  # a border that no text has, and marks that no JSON has
_TOKEN = r"(?s)\*{3}.+?\*{3}|\*{2}.+?\*{2}|\*.+?\*|\[[^\]]+\]\([^)]+\)"


def _string_json(name: str, text: Column) -> Column:
    """``"name":"text"`` of an object."""
    whole = F.to_json(F.struct(text.alias(name)))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _text_line(text: Column) -> Column:
    return F.concat(F.lit('{"2":"2","3":"","7":['), F.to_json(F.struct(text.alias(TEXT))), F.lit("]}"))


def _inline_nodes(text: Column) -> Column:
    """A line's nodes, comma-joined: runs of plain and marked text, and links."""
    plain = lambda t: ~t.contains("*") & ~t.contains("[")
    return once(text, lambda t: F.when(plain(t), _text_line(t)).otherwise(_marked_nodes(t)))


def _marked_nodes(text: Column) -> Column:

    def node(piece: Column) -> Column:
        within = lambda stars: F.substring(piece, F.lit(stars + 1), F.length(piece) - 2 * stars)
        span = lambda inner, marks: F.concat(F.lit(_RUN + "{"), _string_json(TEXT, inner), F.lit(',"9":[' + ",".join(f'{{"2":"{m}"}}' for m in marks) + "]}"))
        link = F.concat(F.lit(_LINK + '{"3":"","4":{'), _string_json("hf", F.regexp_extract(piece, r"(?s)^\[[^\]]+\]\((.+)\)$", 1)), F.lit('},"5":['), _text_line(F.regexp_extract(piece, r"(?s)^\[([^\]]+)\]\(", 1)), F.lit('],"6":"li"}'))
        starred = lambda stars: piece.rlike(rf"(?s)^\*{{{stars}}}.+\*{{{stars}}}$")
        return F.when(starred(3), span(within(3), "bi")).when(starred(2), span(within(2), "b")).when(starred(1), span(within(1), "i")).when(piece.rlike(r"(?s)^\[[^\]]+\]\([^)]+\)$"), link).otherwise(F.concat(F.lit(_RUN + "{"), _string_json(TEXT, piece), F.lit("}")))

    pieces = F.filter(F.split(F.regexp_replace(text, _TOKEN, f"{_CUT}$0{_CUT}"), _CUT), lambda p: p != "")
    flat = F.array_join(F.transform(F.when(text == "", F.array(F.lit(""))).otherwise(pieces), node), "")
    runs = F.regexp_replace(flat, f"((?:{_RUN}[^{_RUN}{_LINK}]*)+)", ',{"2":"2","3":"","7":[$1]}')
    spelled = F.replace(F.replace(F.replace(runs, F.lit("[" + _RUN), F.lit("[")), F.lit(_RUN), F.lit(",")), F.lit(_LINK), F.lit(","))
    return F.substring(spelled, F.lit(2), F.length(spelled))


def _element(kind: str | None = None, attrs: Column | None = None, children: Column | None = None) -> Column:
    parts = [F.lit('{"3":""')]
    parts += [] if attrs is None else [F.lit(',"4":{'), attrs, F.lit("}")]
    parts += [] if children is None else [F.lit(',"5":['), children, F.lit("]")]
    return F.concat(*parts, F.lit("}" if kind is None else f',"6":"{kind}"}}'))


def _single(line: Column) -> Column:
    """One line that belongs to no larger block."""
    heading, item, image = r"^(#{1,6})\s+(.+)$", r"^(\s*)([-*+]|\d+\.)\s+(.+)$", r"^!\[[^\]]*\]\(([^)]+)\)$"
    hashes, indent = F.length(F.regexp_extract(line, heading, 1)), F.regexp_extract(line, item, 1)
    tabs = F.length(indent) - F.length(F.replace(indent, F.lit("\t"), F.lit("")))
    level = F.floor((F.length(indent) - tabs) / 2) + tabs + 1
    order = F.when(F.regexp_extract(line, item, 2).rlike(r"\."), "ordered").otherwise("unordered")
    return (
        F.when(line.rlike(heading), _element("h", F.concat(F.lit('"l":"h'), hashes.cast("string"), F.lit('"')), _inline_nodes(F.regexp_extract(line, heading, 2))))
        .when(line.rlike(item), _element("l", F.concat(F.lit('"lt":"'), order, F.lit('","ll":'), level.cast("string")), _inline_nodes(F.regexp_extract(line, item, 3))))
        .when(line.rlike(image), _element("im", _string_json("u", F.regexp_extract(line, image, 1))))
        .otherwise(_element(None, None, _inline_nodes(F.when(line.rlike("^[-*_]{3,}$"), "---").otherwise(line))))
    )


def _listed(elements: Column) -> Column:
    return F.array_join(elements, ",")


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|"), lambda c: F.trim(c, F.lit(" \t\r\n")))


def _table_node(rows: Column) -> Column:
    """rows: the cells of each row, the first one's number being the width."""
    width = F.size(F.get(rows, F.lit(0)))
    cell = lambda t: _element("tc", None, _element(None, None, _text_line(t)))
    row = lambda r: _element("tr", None, _listed(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), cell)))
    numbers = lambda n, x: F.array_join(F.array_repeat(F.lit(x), n), ",")
    attrs = F.concat(F.lit('"version":1,"cw":['), numbers(width, "120"), F.lit('],"rh":['), numbers(F.size(rows), "40"), F.lit("]"))
    return _element("t", attrs, _listed(F.transform(rows, row)))


def line_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (line number), line, kind (code, quote, table, single), block (the number
    of its first line): how the lines of each document's Markdown belong together.
    A null text has one row, whose n, line and block are null.

    A fence closes at the next line with one.  Whether a line is inside is the
    parity of the opening fences since the last fence that can only close, which
    running sums tell.
    """
    lines = docs.select(F.col(key).alias("key"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("n", "line"))
    order = Window.partitionBy("key").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fence, opens = F.col("line").startswith("```"), F.col("line").rlike(r"^```(?:\w+\s*)?$")
    rows = lines.withColumn("_opens", opens).withColumn("_shuts", fence & ~opens).withColumn("_opened", F.sum(opens.cast("int")).over(order))
    rows = rows.withColumn("_base", F.coalesce(F.max(F.when(F.col("_shuts"), F.col("_opened"))).over(before), F.lit(0)))
    inside = (F.coalesce(F.sum(F.col("_opens").cast("int")).over(before), F.lit(0)) - F.col("_base")) % 2 == 1
    trimmed = F.trim("line", F.lit(" \t\r"))
    piped = trimmed.startswith("|") & trimmed.endswith("|")
    rows = rows.withColumn("_inside", inside).withColumn("_kind", F.when(F.col("_inside") | F.col("_opens"), "code").when(F.col("line").startswith(">"), "quote").when(piped, "piped").otherwise("single"))
    rows = rows.withColumn("_rule", (F.col("_kind") == "piped") & trimmed.rlike(r"^\|[\s\-:|]+\|$"))
    # a run of piped lines is a table from the first line that a rule follows; all by
    # windows of one order, so that lines are sorted once
    rows = rows.withColumn("_starts", F.lag("_kind", 1, "").over(order) != F.col("_kind")).withColumn("_headed", (F.col("_kind") == "piped") & F.lead("_rule", 1, False).over(order))
    latest = lambda where: F.max(F.when(F.col(where), F.col("n"))).over(order)
    rows = rows.withColumn("_table", F.coalesce(latest("_headed") >= latest("_starts"), F.lit(False)))
    kind = F.when(F.col("_table"), "table").when(F.col("_kind") == "piped", "single").otherwise(F.col("_kind"))
    rows = rows.withColumn("kind", kind)
    starts = F.when(F.col("kind") == "code", ~F.col("_inside")).when(F.col("kind") == "single", F.lit(True)).otherwise(F.lag("kind", 1, "").over(order) != F.col("kind"))
    rows = rows.withColumn("block", F.max(F.when(starts, F.col("n"))).over(order))
    return rows.select("key", "n", "line", "kind", "block")


def _whole_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, kind, lines, and of code its language and body."""
    blocks = line_blocks(docs, key, text).groupBy("key", "block", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    lines, first = F.col("lines"), F.get("lines", F.lit(0))
    language = F.trim(F.substring(first, F.lit(4), F.length(first)), F.lit(" \t\r"))
    # an opened block ends with its closing line, or with the document
    shut = (F.size(lines) > 1) & F.element_at(lines, -1).startswith("```")
    body = F.slice(lines, F.lit(2), F.size(lines) - 1 - shut.cast("int"))
    return blocks.withColumn("language", language).withColumn("body", F.when(F.size(body) > 0, body).otherwise(F.array(F.lit(""))))


def markdown_to_notes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, note: each document's Markdown as rich-note JSON (null for null); node ids
    are left empty, for the writer to fill.

    ``key`` tells documents apart.  Notes aren't joined to ``docs`` again: by a small
    file's size Spark would broadcast them all, however large they are.
    """
    coded = _whole_blocks(docs, key, text)
    # a filter on a generated column isn't moved to where the text would be made once for each mention
    charts = docs.select(key, F.explode(F.array(text)).alias(text)).where(F.col(text).rlike("(?i)```mermaid"))
    lines, first = F.col("lines"), F.get("lines", F.lit(0))
    is_chart = (F.col("kind") == "code") & (F.lower("language") == "mermaid")
    # blocks stay dealt by their document: a document's charts come to it in one row
    charts = written(_whole_blocks(charts, key, text).where(is_chart).select("key", "block", F.array_join("body", "\n").alias("code")), "charts")
    drawn = diagrams.mermaid_to_plantuml(charts.select(F.struct("key", "block").alias("id"), "code"), "id", "code")
    drawn = drawn.groupBy(F.col("id.key").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("id.block", "plantuml"))).alias("drawn"))
    coded = coded.join(drawn, "key", "left").withColumn("body", F.when(is_chart, F.split(F.try_element_at("drawn", "block"), "\n")).otherwise(F.col("body")))
    code = lambda kind: _listed(F.transform("body", lambda x: _element(kind, None, _text_line(x))))
    diagram = F.lower("language").isin("mermaid", "plantuml", "puml", "uml")
    quote = _listed(F.transform(lines, lambda x: _element(None, None, _inline_nodes(F.regexp_replace(x, r"^>\s*", "")))))
    ruled = lambda x: F.trim(x, F.lit(" \t\r")).rlike(r"^\|[\s\-:|]+\|$")
    # the header stays whatever it looks like
    cells = F.transform(F.concat(F.slice(lines, 1, 1), F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: ~ruled(x))), _cells)
    single = F.rtrim(first, F.lit(" \t\r\n\f\x0b"))
    node = (
        F.when((F.col("kind") == "code") & diagram, _element("diagram", F.lit('"la":"PlantUML"'), code("cl")))
        .when(F.col("kind") == "code", _element("cd", _string_json("la", F.col("language")), code(None)))
        .when(F.col("kind") == "quote", _element("q", None, quote))
        .when(F.col("kind") == "table", once(cells, _table_node))
        .when(single != "", _single(single))
    )
    nodes = coded.select("key", "block", node.alias("node")).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("block", "node")))), lambda x: x["node"]).alias("nodes"), (F.count("block") > 0).alias("_there"))
    note = F.concat(F.lit('{"2":"1","3":"","4":{"version":1,"incompatibleVersion":0,"fv":"0"},"5":['), F.array_join("nodes", ","), F.lit('],"title":"","__compress__":true}'))
    return nodes.select("key", F.when(F.col("_there"), note).alias("note"))
