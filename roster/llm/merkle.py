"""Merkle manifests of datasets: a hash tree for each group of rows, and one over the groups' roots.

Nodes of a level have a place in their group. The children of a parent are spread into one column for
each slot by conditional aggregates; the hash of the columns, joined, is the parent, and a child's
siblings are the columns without its own slot. A group's tree ends where one node is left, so groups
end at different levels; their last nodes, in the groups' order, are the leaves of the tree on top.

Places come from range exchanges (``ranks``), so a group of any size is built by many tasks, and all
joins are by (group, place). What a parent hands down is its path to the root: the siblings to the
left and to the right at each level, at most ``fanout`` digests for each of log(rows) levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.common import stored
from roster.llm.ranks import ranked, same

FANOUT = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<left: string, right: string>>"


def digest(value: Column) -> Column:
    """Lower-case hex sha256 of text."""
    return F.sha2(value.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value so that no two lists of values have the same text: ``-`` if null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row with these values."""
    return digest(F.concat(*[encoded(v) for v in values]))


def fold(start: Column, path: Column) -> Column:
    """The root that a digest gives with the siblings of a path."""
    return F.aggregate(path, start, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _slots(fanout: int) -> list[str]:
    return [f"_c{s}" for s in range(fanout)]


def _parents(nodes: DataFrame, group: str, fanout: int) -> DataFrame:
    """(group, _place, _size, _h) one level up, with the children's digests in a column for each slot."""
    slot = F.col("_place") % fanout
    spread = nodes.groupBy(
        group, F.floor(F.col("_place") / fanout).cast("long").alias("_place"), F.ceil(F.col("_size") / fanout).cast("long").alias("_size")
    ).agg(*[F.max(F.when(slot == s, F.col("_h"))).alias(c) for s, c in enumerate(_slots(fanout))])
    return spread.withColumn("_h", digest(F.concat_ws("", *_slots(fanout))))


def _handed_down(nodes: DataFrame, parents: DataFrame, group: str, fanout: int) -> DataFrame:
    """``nodes`` with the path to the root of each, from the slots and the paths of their parents."""
    slots = [f"_in{c}" for c in _slots(fanout)]  # nodes have slots of their own
    above = parents.select(
        F.col(group).alias("_group"), F.col("_place").alias("_parent"), F.col("_path").alias("_above"), "_subroot", "_root",
        *[F.col(c).alias(s) for c, s in zip(_slots(fanout), slots)],
    )
    own = F.col("_place") % fanout
    left = F.concat_ws("", *[F.when(own > s, F.col(c)) for s, c in enumerate(slots)])
    right = F.concat_ws("", *[F.when(own < s, F.col(c)) for s, c in enumerate(slots)])
    joined = nodes.withColumn("_up", F.floor(F.col("_place") / fanout).cast("long")).join(
        above, same([(group, "_group"), ("_up", "_parent")])
    )
    path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("_above"))
    return joined.select(*nodes.columns, path.alias("_path"), "_subroot", "_root")


def _levels(leaves: DataFrame, group: str, fanout: int) -> list[DataFrame]:
    """The leaves, and the tables of parents above them until every group has one node."""
    levels, size = [leaves], leaves.agg(F.max("_size")).first()[0] or 0
    while size > 1:
        levels.append(stored(_parents(levels[-1].filter("_size > 1"), group, fanout), "parents", wide=True))
        size = -(-size // fanout)
    return levels


def _paths(levels: list[DataFrame], tops: DataFrame, group: str, fanout: int) -> DataFrame:
    """The leaves with their paths. ``tops``: (group, _path, _subroot, _root) of each group's last node."""
    tops = tops.withColumnRenamed(group, "_of")
    down = None
    for nodes in reversed(levels):
        last = nodes.filter("_size = 1").join(tops, F.col(group).eqNullSafe(F.col("_of"))).drop("_of")
        if down is not None:
            last = last.unionByName(_handed_down(nodes.filter("_size > 1"), down, group, fanout))
        down = last
    return down


def _roots(levels: list[DataFrame], group: str) -> DataFrame:
    """(group, _h) of the last node of each group."""
    found = levels[0].filter("_size = 1").select(group, "_h")
    for nodes in levels[1:]:
        found = found.unionByName(nodes.filter("_size = 1").select(group, "_h"))
    return found


def proofs(leaves: DataFrame, group: str, key: str, hash: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """Each row of ``leaves`` with ``subroot`` (its group's), ``root`` (of all) and ``path``, from the leaf up.

    ``leaves`` has ``group``, ``key``, the digest in the column ``hash``, and any columns to carry along, other than
    ``subroot``, ``root``, ``path`` and names that start with an underscore. It should be a stored table. Leaves of a
    group ascend by key; a null key comes first, equal keys go by digest, and equal rows may take each other's places.
    A null group is one group, the first. Of a run's children a lone one still gets a parent; a group of one row has
    its leaf as subroot, and one group's subroot is the root. No rows give no rows.
    """
    if fanout < 2:
        raise ValueError("a parent needs at least two children")
    placed = stored(ranked(leaves, [key, hash], [group], "_place", "_size").withColumn("_h", F.col(hash)), "leaves", wide=True)
    levels = _levels(placed, group, fanout)
    # the tree on top has one group, and the subroots for leaves
    subroots = stored(_roots(levels, group).select(F.lit(0).alias("_all"), F.col(group).alias("_name"), "_h"), "subroots")
    upper = _levels(stored(ranked(subroots, ["_name"], ["_all"], "_place", "_size"), "groups"), "_all", fanout)
    root = _roots(upper, "_all").select("_all", F.array().cast(_PATH).alias("_path"), F.lit(None).cast("string").alias("_subroot"), F.col("_h").alias("_root"))
    tops = stored(
        _paths(upper, root, "_all", fanout).select(F.col("_name").alias(group), "_path", F.col("_h").alias("_subroot"), "_root"), "tops"
    )
    found = _paths(levels, tops, group, fanout)
    return found.select(*leaves.columns, F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))


MANIFEST = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, now) of every document, grouped by source and ordered by doc_id.

    ``now`` is the digest of the row as it is found later: with the ``changed`` columns where ``when`` holds, else the
    leaf itself; it plays no part in the tree. Only the columns of ``MANIFEST`` count, so others may have any name. Null
    columns have a mark of their own, unlike empty text. Repeated rows are leaves each.
    """
    columns = [F.col(c) for c in MANIFEST]
    now = F.lit(None).cast("string")
    if changed:
        now = F.when(when, leaf([changed.get(c, F.col(c)) for c in MANIFEST]))
    # texts are read once; from here on there are ids and digests
    leaves = stored(docs.select("doc_id", "source", leaf(columns).alias("leaf"), now.alias("now")), "digests", wide=True)
    found = proofs(leaves, "source", "doc_id")
    return found.select("doc_id", "leaf", "subroot", "root", "path", F.coalesce("now", "leaf").alias("now"))


def verified(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): ``folded_root`` is what the row as found
    later gives with its leaf's original siblings, and ``verified`` whether that is the root."""
    found = manifest(docs, changed, when).withColumn("folded_root", fold(F.col("now"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
