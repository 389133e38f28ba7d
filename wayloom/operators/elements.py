"""Pages as arrays of nodes, and the same nodes as a relational element table.

``parse_pages`` keeps a page in its row. ``elements`` flattens the nodes a caller asks for
into rows ``(key…, ord, end_ord, parent, parent_tag, tag, attrs, text)``; positions are token ordinals
and a node covers ``[ord, end_ord)``, so "inside" is a range test and "next" is an order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import html
from wayloom.functions.binding import let
from wayloom.session import spread

NODES = "nodes"
TEXTS = "txts"


def tokenise(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Replace the markup column by the arrays ``tags``, ``attrs`` and ``txts``.

    The steps are separate projections, so that a text that several of them read is not
    computed again by each.
    """
    shown = pages.withColumn(markup, html.visible(F.col(markup)))
    cut = shown.withColumns(html.token_parts(F.col(markup)))
    decoded = F.when(
        F.contains(F.col(markup), F.lit("&")),
        F.transform(F.col(TEXTS), html.decode_entities),
    ).otherwise(F.col(TEXTS))
    return cut.withColumns(
        {"tags": html.tag_names(F.col("tags"), F.col("attrs")), TEXTS: decoded}
    ).drop(markup)


def parse_pages(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Replace the markup column by ``nodes`` and ``txts``, both indexed by token ordinal."""
    tokens = tokenise(pages, markup)
    nested = tokens.withColumn("_spans", html.nesting(F.array_join("tags", " ")))
    node = lambda both, at: F.struct(
        at.alias("ord"),
        F.get(F.col("_spans"), at + F.size("tags")).alias("end"),
        F.get(F.col("_spans"), at).alias("parent"),
        F.get(F.col("tags"), F.get(F.col("_spans"), at)).alias("parent_tag"),
        both["tags"].alias("tag"),
        both["attrs"].alias("attrs"),
    )
    return nested.withColumn(NODES, F.transform(F.arrays_zip("tags", "attrs"), node)).drop(
        "tags", "attrs", "_spans"
    )


def node_text(node: Column) -> Column:
    """Text inside a node; costs no more than the node's own span."""
    return let(
        node,
        lambda n: F.array_join(F.slice(F.col(TEXTS), n["ord"] + 1, n["end"] - n["ord"]), ""),
    )


def inner_nodes(node: Column) -> Column:
    """Everything below a node, in document order."""
    return let(
        node,
        lambda n: F.slice(
            F.col(NODES), n["ord"] + 2, F.greatest(n["end"] - n["ord"] - 1, F.lit(0))
        ),
    )


def first_node(nodes: Column, test) -> Column:
    """First node that passes, NULL if none does."""
    return F.get(F.filter(nodes, test), F.lit(0))


def outermost(nodes: Column) -> Column:
    """Of nodes in document order, those that lie in no earlier one.

    One walk that keeps how far the nodes so far reach. Its cost grows with the square of the nodes
    kept, so give it the containers in question and not all nodes of a page.
    """
    start = F.struct(F.lit(-1).alias("reach"), F.filter(nodes, lambda n: F.lit(False)).alias("kept"))
    walked = F.aggregate(
        nodes,
        start,
        lambda done, n: F.when(n["ord"] < done["reach"], done).otherwise(
            F.struct(n["end"].alias("reach"), F.array_append(done["kept"], n).alias("kept"))
        ),
        lambda done: done["kept"],
    )
    return F.coalesce(walked, F.array())


def nodes_inside(outer, inner) -> Column:
    """Nodes of the page that pass ``inner`` and lie in one that passes ``outer``, each once.

    What lies in a node is a slice of the page's nodes, so nothing is shuffled or compared.
    """
    tops = outermost(F.filter(F.col(NODES), outer))
    return F.flatten(F.transform(tops, lambda top: F.filter(inner_nodes(top), inner)))


def nodes_before_next(test, following) -> Column:
    """``(node, next)``: every node that passes ``test`` and the first later one that passes
    ``following``, NULL if there is none.

    The page's nodes are cut at those that pass ``following``, and each piece is read once.
    """
    marks = F.filter(F.col(NODES), following)
    begins = F.concat(F.array(F.lit(0)), F.transform(marks, lambda n: n["ord"]))

    def piece(at: Column, begin: Column) -> Column:
        # From one mark up to the next: that one follows all of it, the first mark itself too.
        return let(
            F.get(marks, at),
            lambda mark: F.transform(
                F.filter(
                    F.slice(
                        F.col(NODES),
                        begin + 1,
                        F.greatest(F.coalesce(mark["ord"], F.size(NODES)) - begin, F.lit(0)),
                    ),
                    test,
                ),
                lambda n: F.struct(n.alias("node"), mark.alias("next")),
            ),
        )

    return F.flatten(F.transform(begins, lambda begin, at: piece(at, begin)))


def node_at(position: Column) -> Column:
    """Node with this ordinal; NULL for -1, the parent of top-level nodes."""
    return F.get(F.col(NODES), position)


def elements(
    pages: DataFrame,
    keys: Sequence[str],
    markup: str = "html",
    tags: Sequence[str] | None = None,
    with_text: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """One row per opening tag, limited to ``tags`` if given; no shuffle by key."""
    parsed = parse_pages(spread(pages.select(*keys, markup), partitions), markup)
    wanted = lambda n: (
        n["tag"].isin(*tags) if tags else ~F.startswith(n["tag"], F.lit("/"))
    )
    # All values are taken before the rows are split off: the generator copies whatever comes
    # with it into every row, and page-sized arrays must not be among it.
    found = F.transform(
        F.filter(F.col(NODES), wanted),
        lambda n: F.struct(
            n["ord"].alias("ord"),
            n["end"].alias("end_ord"),
            n["parent"].alias("parent"),
            n["parent_tag"].alias("parent_tag"),
            F.rtrim(n["tag"], F.lit("/")).alias("tag"),
            n["attrs"].alias("attrs"),
            *(
                [
                    F.array_join(
                        F.slice(F.col(TEXTS), n["ord"] + 1, n["end"] - n["ord"]), ""
                    ).alias("text")
                ]
                if with_text
                else []
            ),
        ),
    )
    return parsed.select(*keys, F.inline(found))


def find_next(
    table: DataFrame,
    keys: Sequence[str],
    of: Column,
    value: Column,
    name: str,
    order: str = "ord",
) -> DataFrame:
    """Add ``name``: ``value`` of the nearest later row of the page for which ``of`` holds.

    Walks each page backwards with a running frame, so it is linear in the page; a frame
    that reaches forward to the end would be read again for every row. A page is one
    document, which bounds the window partition.
    """
    backwards = (
        Window.partitionBy(*keys)
        .orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return table.withColumn(name, F.last(F.when(of, value), ignorenulls=True).over(backwards))


def mark_inside(
    table: DataFrame, keys: Sequence[str], outer: Column, name: str, order: str = "ord"
) -> DataFrame:
    """Add ``name``: whether the row lies inside an element for which ``outer`` holds.

    A running maximum of the ends of such elements so far: one pass, and the pages are parsed
    once, where a join of the table with itself would parse them twice.
    """
    before = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.max(F.when(outer, F.col("end_ord"))).over(before)
    return table.withColumn(name, F.coalesce(reach > F.col(order), F.lit(False)))


def inside(
    inner: DataFrame, outer: DataFrame, keys: Sequence[str], prefix: str = "outer_"
) -> DataFrame:
    """Pairs of an element and an element around it.

    The page keys are the equality part, so this is a hash or sort-merge join; the ordinal
    range only filters within a page.
    """
    renamed = outer.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        *[F.col(c).alias(f"{prefix}{c}") for c in outer.columns if c not in keys],
    )
    same_page = [F.col(k) == F.col(f"_{k}") for k in keys]
    within = (F.col("ord") > F.col(f"{prefix}ord")) & (F.col("ord") < F.col(f"{prefix}end_ord"))
    return inner.join(renamed, [*same_page, within], "inner").drop(*[f"_{k}" for k in keys])
