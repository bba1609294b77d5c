"""Parent-chain resolution by pointer doubling.

Only nodes that are somebody's parent (directories, keys with subkeys) take part in the
doubling; leaves are attached by one join at the end.  Each round is written to a scratch
table, so plans stay short and a lost executor repeats one round at most.  Rounds stop early
once every chain has ended.  Joins carry no broadcast hint: sizes decide, and the adaptive
planner splits directories that hold a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookups import HIVE_ROOTS
from ..functions.textcols import base_name, label
from ..session import materialize

SEP = "\\"


def _joined(names: Column) -> Column:
    return F.array_join(F.reverse(names), SEP)


def _open() -> Column:
    """Not ended and not yet round a loop."""
    return F.col("nxt").isNotNull() & (F.size(F.array_distinct("ids")) == F.size("ids"))


def _double(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Append to each open chain the chain of the node it stopped at."""
    done = nodes.filter(~_open())
    upper = nodes.select(*scope, F.col("node").alias("nxt"), F.col("ids").alias("u_ids"),
                         F.col("names").alias("u_names"), F.col("nxt").alias("u_nxt"),
                         F.col("complete").alias("u_complete"))
    empty_ids, empty_names = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    grown = (
        nodes.filter(_open())
        .join(upper, [*scope, "nxt"], "left")
        .select(*scope, "node",
                F.concat("ids", F.coalesce("u_ids", empty_ids)).alias("ids"),
                F.concat("names", F.coalesce("u_names", empty_names)).alias("names"),
                F.col("u_nxt").alias("nxt"),
                F.coalesce("u_complete", F.lit(False)).alias("complete"))
    )
    return done.unionByName(grown)


def resolve_chains(edges: DataFrame, scope: list[str], max_depth: int | None = None,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Root-to-leaf path of every node.

    ``edges``: ``scope`` columns, ``node``, ``label``, ``nxt`` (parent to continue at, null
    where the walk ends on purpose).  A chain is followed to its end, however long, and stops
    before the first repeated node; ``max_depth`` keeps only so many labels, counted from the
    leaf.  Result: ``scope``, ``node``, ``path``, ``depth`` and ``complete`` (the walk reached an
    intended end).  Columns of ``edges`` named in ``carry`` come along, so that a record needs no
    second join to meet its path; without them the result is a written table, for several uses.
    """
    parents = edges.filter(F.col("nxt").isNotNull()).select(*scope, F.col("nxt").alias("node")).distinct()
    state = materialize(
        edges.join(parents, [*scope, "node"], "left_semi").select(
            *scope, "node", F.array("node").alias("ids"), F.array("label").alias("names"), "nxt",
            F.col("nxt").isNull().alias("complete")),
        "chains")
    while not state.filter(_open()).isEmpty():
        state = materialize(_double(state, scope), "chains")

    # In a cycle everything after the first repeated node repeats too, so the distinct ids
    # are exactly the walked prefix.
    walked = F.size(F.array_distinct("ids"))
    looped = walked < F.size("ids")
    names = F.slice("names", F.lit(1), walked)
    inner = names if max_depth is None else F.slice(names, 1, max_depth - 1)
    upper = state.select(
        *scope, F.col("node").alias("nxt"),
        _joined(inner).alias("u_path"), F.size(inner).alias("u_depth"),
        (F.col("complete") & F.col("nxt").isNull()).alias("u_complete"),
        F.when(looped, F.col("ids")).alias("loop_ids"), F.when(looped, names).alias("loop_names"))

    # A node inside its own loop walks until just before it meets itself again.
    again = F.coalesce(F.array_position("loop_ids", F.col("node")), F.lit(0))
    own_loop = F.slice("loop_names", F.lit(1), (again - 1).cast("int"))
    above = F.when(again > 0, _joined(own_loop)).otherwise(F.col("u_path"))
    above_depth = F.when(again > 0, again.cast("int") - 1).otherwise(F.col("u_depth"))
    open_nodes = edges.filter(F.col("nxt").isNotNull()).join(upper, [*scope, "nxt"], "left").select(
        *scope, "node",
        F.concat_ws(SEP, F.when(above != "", above), "label").alias("path"),
        (F.coalesce(above_depth, F.lit(0)) + 1).alias("depth"),
        F.coalesce("u_complete", F.lit(False)).alias("complete"), *carry)
    ended = edges.filter(F.col("nxt").isNull()).select(
        *scope, "node", F.col("label").alias("path"), F.lit(1).alias("depth"), F.lit(True).alias("complete"), *carry)
    found = ended.unionByName(open_nodes)
    return found if carry else materialize(found, "paths")


def resolve_paths(edges: DataFrame, root: int = 5, scope: tuple[str, ...] = ("image_id",),
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """Volume path of every file-table entry.

    ``edges``: scope columns, ``entry``, ``name``, ``parent``.  Adds rows ``scope, entry,
    file_path`` such as ``\\Windows\\System32\\a.exe``; the root itself is ``\\``.  ``carry`` names
    columns that come along.
    """
    scope = list(scope)
    ends = (F.col("parent") == root) | (F.col("parent") == 0) | (F.col("parent") == F.col("entry"))
    walk = edges.filter(F.col("entry") != root).select(
        *scope, F.col("entry").alias("node"), F.col("name").alias("label"),
        F.when(~ends, F.col("parent")).alias("nxt"), *carry)
    chains = resolve_chains(walk, scope, carry=carry).select(
        *scope, F.col("node").alias("entry"), F.concat(F.lit(SEP), "path").alias("file_path"), *carry)
    top = edges.filter(F.col("entry") == root).select(*scope, "entry", F.lit(SEP).alias("file_path"), *carry)
    return chains.unionByName(top)


KEY_FLAG_ROOT = 0x04


def hive_root(hive_file) -> Column:
    """Registry prefix of a hive file name."""
    name = F.upper(F.substring_index(base_name(hive_file), "/", -1))
    return label(name, HIVE_ROOTS, F.concat(F.lit("HIVE["), name, F.lit("]")))


def registry_paths(keys: DataFrame, scope: tuple[str, ...] = ("hive_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Full key path of every registry key; columns of ``keys`` named in ``carry`` come along."""
    scope = list(scope)
    is_root = F.col("flags").bitwiseAND(F.lit(KEY_FLAG_ROOT)) != 0
    roots = keys.filter(is_root).select(*scope, F.col("rel_off").alias("parent_rel"), F.lit(True).alias("_top"))
    walk = (
        keys.filter(~is_root).join(roots, [*scope, "parent_rel"], "left")
        .select(*scope, F.col("rel_off").alias("node"), F.col("name").alias("label"),
                F.when(F.col("_top").isNull(), F.col("parent_rel")).alias("nxt"), F.col("hive_file").alias("_hive"), *carry)
    )
    below = resolve_chains(walk, scope, carry=("_hive", *carry)).select(
        *scope, F.col("node").alias("rel_off"), F.concat_ws(SEP, hive_root("_hive"), "path").alias("full_path"), *carry)
    top = keys.filter(is_root).select(*scope, "rel_off", hive_root("hive_file").alias("full_path"), *carry)
    return below.unionByName(top)


def shellbag_paths(nodes: DataFrame, items: DataFrame, scope: tuple[str, ...] = ("hive_id",)) -> DataFrame:
    """Folder path of every shell-bag node whose whole chain decodes."""
    scope = list(scope)
    decoded = items.filter(F.coalesce("item_name", F.lit("")) != "").select(
        *scope, F.col("node").alias("parent"), "slot", "item_name")
    roots = nodes.filter("is_root").select(*scope, F.col("node").alias("parent"), F.lit(True).alias("_top"))
    walk = (
        nodes.filter(~F.col("is_root")).join(decoded, [*scope, "parent", "slot"])
        .join(roots, [*scope, "parent"], "left")
        .select(*scope, "node", F.col("item_name").alias("label"),
                F.when(F.col("_top").isNull(), F.col("parent")).alias("nxt"))
    )
    return resolve_chains(walk, scope).filter("complete").select(*scope, "node", "path")
