"""Op 12, a Merkle manifest of a dataset, with proofs by pointer jumping.

Every row is a leaf. The leaves of a group make a tree of runs of three, the groups' roots make one above them. A
node holds the segment of siblings on its way to an ancestor, at first its parent. A self-join puts the segment that
the ancestor holds behind it, which doubles the distance; after as many joins as the height has binary digits every
leaf has reached the root. A node is joined only while a leaf can still come to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BYTES_SQL, CRC32_SQL, cut, named, table
from .sharding import stored_address

#: Nodes of a run; levels that are built where a block of nodes meets.
RUN, BLOCK_LEVELS = 3, 4
WIDTH = RUN**BLOCK_LEVELS
#: Rows of a part of the order.
ROWS_TOGETHER = 100_000
_COUNTED = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_COUNTED, ("doc_id", "source", "lang", "n_chars", text))) + ")"
OP12_SQL = f"""WITH RECURSIVE docs AS (
  SELECT *, {_LEAF("text")} AS leaf, {_LEAF("replace(text, chr(10), '')")} AS stripped, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM documents
), leaves AS (
  SELECT doc_id, tree, leaf, CASE WHEN {CRC32_SQL.format(BYTES_SQL.format("CAST(doc_id AS VARCHAR)"))} % 2 = 0 THEN stripped ELSE leaf END AS shown,
    row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs
), inside AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3) FROM inside WHERE n > 1 GROUP BY tree, level, pos // 3
), subroots AS (SELECT tree, level AS height, digest FROM inside WHERE n = 1
), above AS (
  SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3) FROM above WHERE n > 1 GROUP BY level, pos // 3
), steps AS (
  SELECT id, level, coalesce(string_agg(digest, '' ORDER BY i.pos) FILTER (WHERE i.pos < place), '') AS before, coalesce(string_agg(digest, '' ORDER BY i.pos) FILTER (WHERE i.pos > place), '') AS after
  FROM (SELECT l.id, l.tree, k AS level, CAST(floor(l.pos / pow(3, k)) AS BIGINT) AS place FROM leaves l JOIN subroots USING (tree), range(height) r(k)) p JOIN inside i USING (tree, level) WHERE i.pos // 3 = place // 3 GROUP BY ALL
  UNION ALL SELECT id, height + level, coalesce(string_agg(digest, '' ORDER BY a.pos) FILTER (WHERE a.pos < place), ''), coalesce(string_agg(digest, '' ORDER BY a.pos) FILTER (WHERE a.pos > place), '')
  FROM (SELECT l.id, height, k AS level, CAST(floor(l.tree / pow(3, k)) AS BIGINT) AS place FROM leaves l JOIN subroots USING (tree), (SELECT unnest(range(max(level))) AS k FROM above)) p JOIN above a USING (level) WHERE a.pos // 3 = place // 3 GROUP BY id, height, level, place
), folds AS (
  SELECT id, 0 AS level, shown AS digest FROM leaves
  UNION ALL SELECT f.id, f.level + 1, sha256(before || digest || after) FROM folds f JOIN steps s ON s.id = f.id AND s.level = f.level
), folded AS (SELECT id, arg_max(digest, level) AS folded_root FROM folds GROUP BY id
), proofs AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY id)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM leaves JOIN folded USING (id) LEFT JOIN proofs USING (id) JOIN subroots s USING (tree), (SELECT digest FROM above WHERE n = 1) r"""
#: The number of the tree above the groups' trees, and the bits of a node's number below those of its level.
TOP, LEVEL_BITS = -1, 56


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def counted(value: Column) -> Column:
    """A value that no other can be taken for: ``-`` for null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""

    def step(below: Column, s: Column) -> Column:
        others, before = F.lower(F.hex(s["siblings"])), s["at"].cast("int") * 64
        return digest(F.substring(others, F.lit(1), before), below, F.substring(others, before + 1, F.lit(64 * RUN)))

    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """All siblings of a path as hex text, from the leaf's to those below the root, left to right."""
    return F.array_join(F.transform(path, lambda s: F.lower(F.hex(s["siblings"]))), "")


def _in_order(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """rows, sorted and written, with ``part`` and ``mid``: parts follow one another, and mid counts up without a gap inside one."""
    parts = max(1, math.ceil(n / ROWS_TOGETHER))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    return cut(sorted_, "sorted").withColumn("part", F.shiftrightunsigned("mid", 33))


def _numbered(leaves: DataFrame, group: str, key: str, leaf: str) -> tuple[DataFrame, int, int]:
    """(tree, at, n, row) of every leaf, how many trees there are, and the leaves of the largest.

    Rows that are equal in group, key and leaf come in any order, apart by where they are stored.
    """
    (group, key, leaf), columns = named(group, key, leaf), leaves.columns
    packed = leaves.select(F.struct(*named(*columns)).alias("row"), F.xxhash64(*stored_address()).alias("spread"), group.alias("g"), key.alias("k"), leaf.alias("l"))
    rows = _in_order(packed, leaves.count(), [F.asc_nulls_first("g"), F.asc_nulls_first("k"), F.asc("l"), F.asc("spread")]).select("row", "g", "mid", "part")
    counts = cut(rows.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first")), "counts")  # parts and groups, whatever the rows
    groups = counts.groupBy("g").agg(F.sum("n").alias("n"))
    told = groups.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("most")).first()
    trees = _in_order(groups.select(F.col("g").alias("of"), "n"), told["trees"], [F.asc_nulls_first("of")])
    ends = trees.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min("mid").alias("first"))  # a row for each part
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("part", "first", before.alias("before"))
    trees = trees.join(ends, "part").select("of", F.col("n").alias("all"), (F.col("before") + F.col("mid") - F.col("first")).alias("tree"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("g", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    begins = begins.join(trees, F.col("g").eqNullSafe(F.col("of"))).select(F.col("part").alias("in"), F.col("of"), "first", "before", "all", "tree")
    placed = rows.join(begins, (F.col("part") == F.col("in")) & F.col("g").eqNullSafe(F.col("of")))
    return placed.select("tree", (F.col("before") + F.col("mid") - F.col("first")).alias("at"), F.col("all").alias("n"), "row"), told["trees"], told["most"] or 0


def _node(level: Column | int, at: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(level.cast("long"), LEVEL_BITS) + at


def _height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // RUN), h + 1
    return h


def _links(nodes: DataFrame, most: int, leaf: str | None, top: bool) -> tuple[DataFrame, DataFrame]:
    """The links of all trees' nodes to their parents, and (tree, digest) of the trees' roots.

    nodes: (tree, at, n) and ``row`` with the leaf, or ``digest``. A block of nodes meets in one group, which builds
    the levels above it. The root of a group's tree is a leaf of the tree above.
    """
    kind = nodes.schema["row"].dataType.simpleString() if leaf else "int"
    links, roots, level = None, None, 0
    # as many levels as a block of n nodes has until one is left
    rise = F.when(F.col("n") > WIDTH, BLOCK_LEVELS).otherwise(sum((F.col("n") > RUN**k).cast("int") for k in range(BLOCK_LEVELS)))
    up = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(a, i * RUN + 1, F.lit(RUN)), ""), 256))
    while True:
        item = F.struct("at", *(["row"] if leaf and not level else ["digest"]))
        blocks = nodes.groupBy("tree", F.floor(F.col("at") / WIDTH).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item), lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1)).alias("items"))
        own = F.transform("items", lambda x: x["row"].getField(leaf) if leaf and not level else x["digest"])
        levels = F.aggregate(F.slice(F.array(*[F.lit(i) for i in range(BLOCK_LEVELS)]), F.lit(1), F.col("rise")), F.array(own), lambda done, _: F.concat(done, F.array(up(F.element_at(done, -1)))))
        built = cut(blocks.withColumn("rise", rise).withColumn("levels", levels), f"level-{level}")
        ends = F.col("n") <= WIDTH

        def emit(a: Column, j: Column) -> Column:
            """The links of the block's nodes of one level."""
            first = F.col("block") * F.element_at(F.array(*[F.lit(RUN ** (BLOCK_LEVELS - i)) for i in range(BLOCK_LEVELS + 1)]), j + 1)
            last = (F.col("n") <= WIDTH) & (j + 1 == F.col("rise"))

            def one(d: Column, i: Column) -> Column:
                place = i % RUN
                others = F.concat(F.slice(a, i - place + 1, place), F.slice(a, i + 2, F.lit(RUN - 1) - place))
                at, root = first + i, last if not top else F.lit(False)
                return F.struct(
                    (j + level).alias("level"), _node(j + level, at).alias("node"), F.when(root, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("to_tree"),
                    F.when(root, F.col("tree")).otherwise(_node(j + level + 1, F.floor(at / RUN))).alias("to_node"),
                    F.array(F.struct(place.cast("byte").alias("at"), F.unhex(F.array_join(others, "")).alias("siblings"))).alias("path"),
                    F.when(root, F.element_at(F.element_at(F.col("levels"), -1), 1)).alias("subroot"),
                    (F.when(j == 0, F.element_at("items", (i + 1).cast("int"))["row"]) if leaf and not level else F.lit(None).cast(kind)).alias("row"),
                )

            return F.transform(a, one)

        below = F.slice("levels", F.lit(1), F.col("rise"))
        here = built.select("tree", F.inline(F.flatten(F.transform(below, emit))))
        if leaf and not level:  # the leaf of a tree of one is that tree's root
            alone = built.where("n = 1").select(
                "tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(TOP).cast("long").alias("to_tree"), F.col("tree").alias("to_node"),
                F.array().cast("array<struct<at:tinyint,siblings:binary>>").alias("path"), F.element_at(F.element_at("levels", 1), 1).alias("subroot"), F.element_at("items", 1)["row"].alias("row"),
            )
            here = here.unionByName(alone)
        head = F.element_at(F.element_at("levels", -1), 1).alias("digest")
        links = here if links is None else links.unionByName(here)
        ended = built.where(ends).select("tree", head)
        roots = ended if roots is None else roots.unionByName(ended)
        if most <= WIDTH:
            return links, roots
        nodes = built.where(~ends).select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / WIDTH).alias("n"), head)
        most, level = -(-most // WIDTH), level + BLOCK_LEVELS


def merkle_proofs(leaves: DataFrame, group: str, key: str, leaf: str) -> DataFrame:
    """The columns of ``leaves`` with ``subroot``, ``root`` and ``path``, the siblings from the leaf to the root.

    ``leaves`` is read from files. The digests in ``leaf`` (hex text, not null) of a group ascend by key, null keys
    first, equal keys by leaf; the groups ascend bytewise, null first. Columns named subroot, root or path are
    replaced. An empty table gives no rows.
    """
    columns = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "path")]
    nodes, n_trees, most = _numbered(leaves.select(*named(*columns)), group, key, leaf)
    path_type = "array<struct<at:tinyint,siblings:binary>>"
    if not most:
        return leaves.select(*named(*columns), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), F.lit(None).cast(path_type).alias("path"))
    inside, subroots = _links(nodes, most, leaf, top=False)
    tops = cut(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("n"), "digest"), "subroots")
    above, roots = _links(tops, n_trees, None, top=True)
    root = roots.first()["digest"]
    height, distance = _height(most) + _height(n_trees), 1
    ended = (F.col("to_tree") == TOP) & (F.col("to_node") == _node(_height(n_trees), F.lit(0)))
    now = cut(inside.unionByName(above.withColumn("row", F.lit(None).cast(inside.schema["row"].dataType))), "links")
    while distance < height:
        of_top = F.col("tree") == TOP
        goes_on = now.where(of_top | (F.col("level") % (2 * distance) == 0))
        there = now.where(of_top | ((F.col("level") % distance == 0) & (F.col("level") > 0)))
        there = there.select(F.col("tree").alias("t"), F.col("node").alias("v"), F.col("to_tree").alias("next_tree"), F.col("to_node").alias("next_node"), F.col("path").alias("next_path"), F.col("subroot").alias("next_subroot"))
        met = goes_on.where(~ended).join(there, (F.col("to_tree") == F.col("t")) & (F.col("to_node") == F.col("v")))
        met = met.select("tree", "level", "node", F.col("next_tree").alias("to_tree"), F.col("next_node").alias("to_node"), F.concat("path", "next_path").alias("path"), F.coalesce("subroot", "next_subroot").alias("subroot"), "row")
        now = cut(met.unionByName(goes_on.where(ended)), "links", release=True)
        distance *= 2
    return now.where((F.col("tree") != TOP) & (F.col("level") == 0)).select("row.*", "subroot", F.lit(root).alias("root"), "path")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``: each document's leaf and proof, verified after tampering with the texts of even checksums.

    Nulls are values of their own. Equal rows are leaves each; rows of one doc_id ascend by leaf.
    """
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    leaf = lambda t: digest(*map(counted, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even & text.contains("\n"), leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = cut(docs.select("doc_id", "source", leaf(text).alias("leaf"), changed.alias("tampered")), "leaves")
    proved = merkle_proofs(leaves, "source", "doc_id", "leaf")
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
