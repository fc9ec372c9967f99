"""Queries on parse trees: pre-order node arrays as columns, and node tables.

A subtree is the interval ``node_id <= d < subtree_end``, so descent is a range
predicate and never a recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(n: Column, what: str | int) -> Column:
    return n["symbol_id"] == what if isinstance(what, int) else n["name"] == what


def top_level(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["parent_id"] == -1)


def tree(nodes: Column) -> Column:
    """The single top-level node, null if there is not exactly one."""
    return F.when(F.size(top_level(nodes)) == 1, F.get(top_level(nodes), F.lit(0)))


def children(nodes: Column, of: Column) -> Column:
    return F.filter(nodes, lambda n: n["parent_id"] == of["node_id"])


def subtree(nodes: Column, of: Column) -> Column:
    """The node and everything below it, in pre-order."""
    return F.filter(nodes, lambda n: (n["node_id"] >= of["node_id"]) & (n["node_id"] < of["subtree_end"]))


def find_all(nodes: Column, what: str | int, within: Column | None = None) -> Column:
    """All nodes with a name or id, nested ones included, in pre-order."""
    found = F.filter(nodes, lambda n: _is(n, what))
    return found if within is None else F.filter(found, lambda n: (n["node_id"] >= within["node_id"]) & (n["node_id"] < within["subtree_end"]))


def find(nodes: Column, what: str | int, within: Column | None = None) -> Column:
    """The first such node, else null."""
    return F.get(find_all(nodes, what, within), F.lit(0))


def text_of(nodes: Column, of: Column | None = None) -> Column:
    """The text of the leaves that are left, in a node or in all."""
    inside = nodes if of is None else subtree(nodes, of)
    text = F.array_join(F.transform(F.filter(inside, lambda n: n["is_leaf"]), lambda n: n["text"]), "")
    return text if of is None else F.when(of.isNotNull(), text)


def source_text(parse_input: Column, of: Column) -> Column:
    """The text a node spans, with what the tree dropped."""
    return F.substring(parse_input, of["start"] + 1, of["end"] - of["start"])


def print_tree(nodes: Column) -> Column:
    """An indented dump, two spaces a level."""
    return F.array_join(F.transform(nodes, lambda n: F.concat(F.repeat(F.lit("  "), n["depth"]), n["name"], F.when(n["is_leaf"], F.concat(F.lit(': "'), n["text"], F.lit('"'))).otherwise(""))), "\n")


def debug_tree(nodes: Column) -> Column:
    """An indented dump with ids and spans, deleted and flattened rules marked."""
    mark = lambda n: F.when(n["flatten"] == "preserve", "").otherwise(F.concat(F.lit(" "), n["flatten"]))
    line = lambda n: F.concat(
        F.repeat(F.lit("  "), n["depth"]), n["name"], F.lit("#"), n["symbol_id"].cast("string"), F.lit(" ["), n["start"].cast("string"), F.lit(", "), n["end"].cast("string"), F.lit(")"), mark(n),
        F.when(n["is_leaf"], F.concat(F.lit(' "'), n["text"], F.lit('"'))).otherwise(""),
    )
    return F.array_join(F.transform(nodes, line), "\n")


def flattened(nodes: Column) -> Column:
    """A raw tree with its rules' shapes applied: deleted subtrees go, children of flattened nodes move up.

    parent_id of a kept node becomes its nearest kept ancestor; ids stay those of
    the raw tree, so intervals still hold.  One pass in pre-order, with the kept
    ancestors of the place it is at.
    """
    none = F.filter(nodes, lambda n: F.lit(False))
    ancestor = lambda n: F.struct(n["node_id"].alias("id"), n["subtree_end"].alias("end"))

    def step(at: Column, n: Column) -> Column:
        dead, delete = n["node_id"] < at["gone"], n["flatten"] == "delete"
        keep = ~dead & ~delete & ((n["flatten"] == "preserve") | n["is_leaf"])
        above = F.filter(at["above"], lambda a: a["end"] > n["node_id"])
        own = n.withField("parent_id", F.coalesce(F.get(above, F.size(above) - 1)["id"], F.lit(-1)))
        return F.struct(
            F.when(keep, F.array_append(at["kept"], own)).otherwise(at["kept"]).alias("kept"), F.when(keep, F.array_append(above, ancestor(n))).otherwise(above).alias("above"),
            F.when(~dead & delete, n["subtree_end"]).otherwise(at["gone"]).alias("gone"),
        )

    return F.aggregate(nodes, F.struct(none.alias("kept"), F.transform(none, ancestor).alias("above"), F.lit(0).alias("gone")), step, lambda at: at["kept"])


def node_table(df: DataFrame, key: str | list[str], nodes: Column) -> DataFrame:
    """One row for each node, keyed by the columns of ``key``."""
    keys = [key] if isinstance(key, str) else key
    return df.select(*keys, F.explode(nodes).alias("_n")).select(*keys, "_n.*")


def descendants(table: DataFrame, key: str | list[str], ancestor: str, what: str) -> DataFrame:
    """Pairs of ancestor and descendant nodes by name: an interval join inside each document."""
    keys = [key] if isinstance(key, str) else key
    a = table.where(F.col("name") == ancestor).select(*keys, F.col("node_id").alias("ancestor_id"), F.col("subtree_end").alias("ancestor_end"))
    d = table.where(F.col("name") == what)
    return d.join(a, keys).where("node_id > ancestor_id and node_id < ancestor_end").drop("ancestor_end")
