"""Text of JSON documents whose shape is not known, as column expressions over VARIANT.

Content is a tree of any depth. It is walked level by level inside the row: an aggregate over as many steps
as the text has child lists holds the lines found so far and the nodes still to open, each with its
place in the tree, and lines are sorted by place at the end. So a document never leaves its row:
there is no exchange, no limit on depth, and no code outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let, strip_ws

#: Labels of the lines under the title, with the keys they come from.
LABELS = {"制定机关：": "zdjgName", "公布日期：": "gbrq", "施行日期：": "sxrq", "法规类型：": "flxz"}

_STRING = r'"(?:[^"\\]|\\.)*"'
_LINES = "array<struct<place:array<int>,line:string>>"
_OPEN = "array<struct<place:array<int>,path:string,node:variant>>"


def _at(node: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, path, kind)


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def _plain(node: Column) -> Column:
    """A scalar as text; nothing for null, false, zero and what is missing; a container as JSON."""
    kind = _kind(node)
    number = node.try_cast("double")
    return F.when(node.isNull() | F.is_variant_null(node), "").when(kind == "STRING", _at(node, "$", "string")).when(
        kind == "BOOLEAN", F.when(_at(node, "$", "boolean"), "True").otherwise("")
    ).when(kind == "BIGINT", F.when(number == 0, "").otherwise(_at(node, "$", "string"))).when(
        F.startswith(kind, F.lit("DECIMAL")) | kind.isin("DOUBLE", "FLOAT"), F.when(number == 0, "").otherwise(number.cast("string"))
    ).when(F.to_json(node).isin("[]", "{}"), "").otherwise(F.to_json(node))


def _is_object(node: Column) -> Column:
    return F.startswith(_kind(node), F.lit("OBJECT"))


def _is_array(node: Column) -> Column:
    return F.startswith(_kind(node), F.lit("ARRAY"))


def content_lines(content: Column, steps: Column) -> Column:
    """The lines of a content tree in document order: paths of titles joined by `` / ``, and children that are text.

    ``steps`` is at least the depth of the tree.
    """

    def titled(place: Column, path: Column, node: Column) -> Column:
        title = strip_ws(_plain(_at(node, "$.title")))
        return let(title, lambda t: F.struct(place.alias("place"), F.when(t == "", path).when(path == "", t).otherwise(F.concat(path, F.lit(" / "), t)).alias("path"), node.alias("node"), (t != "").alias("titled")))

    def level(state: Column, _: Column) -> Column:
        opened = F.transform(F.filter(state["open"], lambda x: _is_object(x["node"])), lambda x: titled(x["place"], x["path"], x["node"]))

        def grown(nodes: Column) -> Column:
            titles = F.transform(F.filter(nodes, lambda x: x["titled"]), lambda x: F.struct(x["place"].alias("place"), x["path"].alias("line")))
            below = lambda x: _at(x["node"], "$.children")
            texts = F.transform(
                F.filter(nodes, lambda x: _kind(below(x)) == "STRING"),
                lambda x: F.struct(F.concat(x["place"], F.array(F.lit(0))).alias("place"), strip_ws(F.coalesce(_at(below(x), "$", "string"), F.lit(""))).alias("line")),
            )
            lists = F.filter(nodes, lambda x: _is_array(below(x)))
            children = F.flatten(
                F.transform(
                    lists,
                    lambda x: F.transform(
                        _at(x["node"], "$.children", "array<variant>"), lambda c, i: F.struct(F.concat(x["place"], F.array(i)).alias("place"), x["path"].alias("path"), c.alias("node"))
                    ),
                )
            )
            return F.struct(F.concat(state["lines"], titles, F.filter(texts, lambda x: x["line"] != "")).cast(_LINES).alias("lines"), children.cast(_OPEN).alias("open"))

        return F.when(F.size(state["open"]) == 0, state).otherwise(let(opened, grown))

    root = F.struct(F.array().cast("array<int>").alias("place"), F.lit("").alias("path"), content.alias("node"))
    begin = F.struct(F.array().cast(_LINES).alias("lines"), F.when(content.isNull(), F.array().cast(_OPEN)).otherwise(F.array(root).cast(_OPEN)).alias("open"))
    done = F.aggregate(F.sequence(F.lit(0), steps), begin, level)
    return F.transform(F.array_sort(done["lines"]), lambda x: x["line"])


def spaced_json(raw: Column) -> Column:
    """JSON text with a blank behind commas and colons and none elsewhere; strings and numbers as written."""
    parts = F.regexp_extract_all(raw, F.lit(_STRING + r'|[^\s",:]+|[,:]'), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), "")


def json_to_text(raw: Column) -> Column:
    """Title, labelled fields and content of a JSON document, a line each; null for what is no JSON.

    The document may lie under ``data``. What is no object is given back as JSON. Two equal keys in
    an object are no JSON here.
    """

    def told(v: Column) -> Column:
        payload = F.when(_is_object(v) & _at(v, "$.data").isNotNull(), _at(v, "$.data")).otherwise(v)

        def lines(p: Column) -> Column:
            fields = [F.concat(F.lit(label), _plain(_at(p, f"$.{key}"))) for label, key in LABELS.items()]
            steps = F.size(F.split(raw, '"children"'))
            head = F.transform(F.array(_plain(_at(p, "$.title")), *fields), strip_ws)
            every = F.concat(head, content_lines(_at(p, "$.content"), steps))
            return F.when(_is_object(p), F.array_join(F.filter(every, lambda x: x != ""), "\n")).otherwise(spaced_json(raw))

        return F.when(v.isNotNull(), let(payload, lines))

    # in a list of its own, as whatever follows a document is passed over otherwise
    alone = let(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>"), lambda v: F.when(F.size(v) == 1, v[0]))
    return let(alone, told)
