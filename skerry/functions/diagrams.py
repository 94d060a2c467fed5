"""Flowcharts between two diagram languages: one way by statements that are joined
to charts again, the way back by an expression over a diagram's lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.names import col

# The mark of a converted diagram, directions, and arrows of both languages.
SOURCE_MARK = "' @source:mermaid"
DIRECTIONS = {"lr": "left to right direction", "rl": "right to left direction", "td": "top to bottom direction", "tb": "top to bottom direction", "bt": ""}
ARROWS = {"-.->": "..>", "-->": "-->", "---": "--", "==>": "==>", "~~~": "-[hidden]-"}
BACK = {"--": "---", "..": "-.-", "..>": "-.->", "==": "===", "==>": "==>", "-[hidden]->": "~~~", "-[hidden]-": "~~~", "-->": "-->"}
STYLES = {"text": "color", "line": "stroke"}

_BLANK = " \t\r\n\f\x0b"
_ARROW = "|".join(re.escape(a) for a in ARROWS)
_NAME = rf"""((?:(?!{_ARROW}|\(\("|\["|\("|\{{")\S)+)"""
_SHAPE = r"""(?:\(\("(.*?)"\)\)|\["(.*?)"\]|\("(.*?)"\)|\{"(.*?)"\})"""
_NODE = rf"{_NAME}{_SHAPE}?"
_EDGE = rf"^{_NODE}\s*(?:({_ARROW})(?:\|([^|]*)\|)?|-- (.*?)(-->|---))\s*{_NODE}$"
_LONE = rf"^{_NAME}{_SHAPE}$"


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def _shape_text(line: Column, pattern: str, first: int) -> Column:
    """The text of whichever of four shapes is there; null if all are empty."""
    return F.nullif(F.concat(*(F.regexp_extract(line, pattern, first + k) for k in range(4))), F.lit(""))


def mermaid_to_plantuml(charts: DataFrame, key: str, code: str) -> DataFrame:
    """key, plantuml: flowcharts in the other language; anything else as it is.

    A statement is an edge between two nodes or a node with a text.  A node's first
    text counts, its name without one; a name's last style counts.  Everything is
    grouped within a chart, so charts that are dealt by ``key`` aren't moved again.
    """
    whole = F.trim(F.col(code), F.lit(_BLANK))
    words = F.split(F.lower(F.trim(F.substring_index(whole, "\n", 1), F.lit(_BLANK))), r"\s+")
    direction = F.coalesce(_look_up(DIRECTIONS, F.get(words, F.lit(1))), F.lit(DIRECTIONS["td"]))
    rows = charts.select(F.col(key).alias("key"), F.col(code).alias("code"), F.get(words, F.lit(0)).isin("graph", "flowchart").alias("flow"), direction.alias("direction"), F.split(whole, "\n").alias("lines"))
    line = F.trim("line", F.lit(_BLANK))
    said = rows.where("flow").select("key", F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("n", "line")).select("key", "n", line.alias("line")).where(~F.col("line").startswith("%%"))
    style = r"(?i)^style\s+(\S+)\s+(.+)$"
    values = lambda name: F.regexp_extract("line", rf"(?i)^style\s+\S+\s+(?:.*,)?\s*{name}\s*:\s*#*([^,]*?)\s*(?:,|$)", 1)
    has = lambda name: F.col("line").rlike(rf"(?i)^style\s+\S+\s+(?:.*,)?\s*{name}\s*:")
    extra = [F.when(has(there), F.concat(F.lit(f";{here}:"), values(there))).otherwise("") for here, there in STYLES.items()]
    color = F.when(has("fill"), F.concat(F.lit(" #"), values("fill"), *extra)).otherwise("")
    styles = said.where(F.col("line").rlike(style)).select("key", "n", F.regexp_extract("line", style, 1).alias("name"), color.alias("color"))
    rest = said.where(~F.col("line").rlike(style))
    part = lambda k: F.regexp_extract("line", _EDGE, k)
    arrow = _look_up(ARROWS, F.when(part(6) != "", part(6)).otherwise(part(9)))
    edges = rest.where(F.col("line").rlike(_EDGE)).select("key", "n", part(1).alias("a"), _shape_text(F.col("line"), _EDGE, 2).alias("a_text"), arrow.alias("arrow"), F.trim(F.concat(part(7), part(8)), F.lit(_BLANK)).alias("text"), part(10).alias("b"), _shape_text(F.col("line"), _EDGE, 11).alias("b_text"))
    lone = rest.where(F.col("line").rlike(_LONE) & ~F.col("line").rlike(_EDGE)).select("key", "n", F.regexp_extract("line", _LONE, 1).alias("name"), F.coalesce(_shape_text(F.col("line"), _LONE, 2), F.lit("")).alias("text"))
    ends = edges.select("key", "n", F.posexplode(F.array(F.struct(F.col("a").alias("name"), F.coalesce("a_text", "a").alias("text")), F.struct(F.col("b").alias("name"), F.coalesce("b_text", "b").alias("text")))).alias("side", "e")).select("key", "n", "side", "e.*")
    place = F.struct("n", "side")
    told = ends.unionByName(lone.withColumn("side", F.lit(0))).unionByName(styles, allowMissingColumns=True)
    here = F.col("text").isNotNull()
    at, color = F.min(F.when(here, place)).alias("at"), F.max_by("color", F.when(F.col("color").isNotNull(), F.col("n"))).alias("color")
    nodes = told.groupBy("key", "name").agg(at, F.min_by("text", F.when(here, place)).alias("text"), color).where("at IS NOT NULL")
    box = F.concat(F.lit('rectangle "'), "text", F.lit('" as '), "name", F.coalesce("color", F.lit("")))
    boxes = nodes.select("key", F.lit(0).alias("group"), F.col("at.n").alias("n"), F.col("at.side").alias("side"), box.alias("line"))
    links = edges.select("key", F.lit(1).alias("group"), "n", F.lit(0).alias("side"), F.concat(F.concat_ws(" ", "a", "arrow", "b"), F.when(F.col("text") != "", F.concat(F.lit(" : "), "text")).otherwise("")).alias("line"))
    drawn = boxes.unionByName(links).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "n", "side", "line"))), lambda x: x["line"]).alias("drawn"))
    head = F.filter(F.array(F.lit(SOURCE_MARK), F.lit("@startuml"), F.col("direction")), lambda x: x != "")
    text = F.array_join(F.concat(head, F.coalesce("drawn", F.array().cast("array<string>")), F.array(F.lit("@enduml"))), "\n")
    return rows.join(drawn.hint("merge"), "key", "left").select(F.col("key").alias(key), F.when(F.col("flow"), text).otherwise(F.col("code")).alias("plantuml"))


def plantuml_to_mermaid(code: Column | str) -> Column:
    """Only for what :func:`mermaid_to_plantuml` made; anything else as it is."""
    lines = F.transform(F.split(col(code), "\n"), lambda s: F.trim(s, F.lit(_BLANK)))
    names = {text: short.upper() for short, text in DIRECTIONS.items() if text and short != "tb"}
    box, link = r'^rectangle "(.*?)" as (.*?)\s*(?: #(.*))?$', rf"^(\S+)\s+({'|'.join(re.escape(a) for a in sorted(BACK, key=len, reverse=True))})\s+(\S+)(?:\s+(.*))?$"
    picked = lambda pattern, show: F.transform(F.filter(lines, lambda s: s.rlike(pattern)), show)
    part = F.regexp_extract
    found = F.element_at(F.concat(F.array(F.lit("TD")), F.filter(F.transform(lines, lambda s: _look_up(names, F.lower(s))), lambda d: d.isNotNull())), -1)
    nodes = picked(box, lambda s: F.concat(F.lit("    "), part(s, box, 2), F.lit('["'), part(s, box, 1), F.lit('"]')))

    def edge(s: Column) -> Column:
        label = F.trim(F.regexp_replace(part(s, link, 4), "^:", ""), F.lit(_BLANK))
        return F.concat(F.lit("    "), part(s, link, 1), F.lit(" "), _look_up(BACK, part(s, link, 2)), F.when(label != "", F.concat(F.lit("|"), label, F.lit("|"))).otherwise(""), F.lit(" "), part(s, link, 3))

    def style(s: Column) -> Column:
        color = F.trim(part(s, box, 3), F.lit(_BLANK))
        more = [F.when(color.rlike(f";{here}:"), F.concat(F.lit(f",{there}:#"), part(color, f";{here}:([^;]*)", 1))).otherwise("") for here, there in STYLES.items()]
        return F.concat(F.lit("    style "), part(s, box, 2), F.lit(" fill:#"), F.substring_index(color, ";", 1), *more)

    colored = r'^rectangle "(.*?)" as (.*?) #.+$'
    edges = F.transform(F.filter(lines, lambda s: s.rlike(link) & ~s.rlike(box)), edge)
    text = F.array_join(F.concat(F.array(F.concat(F.lit("graph "), found)), nodes, edges, picked(colored, style)), "\n")
    return F.when(col(code).contains(SOURCE_MARK), text).otherwise(col(code))
