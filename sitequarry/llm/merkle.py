"""Merkle dataset manifest with checkpoints: proofs recompute what lies between them.

Each row is a leaf, the sha256 of its fields. The leaves of a group (a source) are ranked by id and hashed in runs of `arity` until
one node, the subroot, remains; subroots, ranked by group, are hashed likewise to the root. Only every `every`-th level is stored: one row for
each aligned subtree, with its stored descendants (81 of them at most, by default). A proof needs the levels between as well: they are
regenerated from a subtree's stored descendants, give the siblings of each of them, and are dropped again. So a
subtree is a row, a proof is read from the top down, by one join a stored level, and a proof of some rows touches their subtrees only.

Ranks are sums on two levels: rows are range-partitioned by (group, id, leaf, row), and a partition adds to its own count the rows that
its first group has in partitions before it. A group of any size, and an id of any number of rows, is spread over many tasks. Texts are
hashed where they are read; digests alone are shuffled.

Defined results: a null field is "-"; null ids come first, as null groups do; rows of one id stand by their leaf, equal rows are leaves each; a row of a
group of its own is its own subroot, and has no siblings there; an empty table has no leaves, no root and no proofs; other columns are
ignored, whatever their names; digests are lowercase hex.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialised, shared_folder

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A field as it is hashed: "-" for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(df: DataFrame, fields=FIELDS, **instead: Column) -> Column:
    """The leaf of a row; instead: other values for some fields."""
    return digest(*[encoded(instead.get(f, df[f])) for f in fields])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, others) with idx, the rank in the group by `order` from 0, and size, the group's rows."""
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    placed = materialised(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    own = placed.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select(F.col("part").alias("p"), F.col("grp").alias("g"), (before - F.col("first")).alias("add"), F.sum("n").over(group).alias("size"))
    met = placed.join(own, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return met.select(*rows.columns, (F.col("at") + F.col("add")).alias("idx"), "size")


def parents(nodes: Column, arity: int) -> Column:
    """The next level: a digest for each run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * arity + 1, arity), ""), 256))


def regenerated(nodes: Column, alone: Column, arity: int, every: int) -> Column:
    """The levels of an aligned subtree from its stored descendants up to its root; where it is all of a tree, up to the one node that remains."""
    last = lambda levels: F.element_at(levels, -1)
    grow = lambda levels, _: F.when(alone & (F.size(last(levels)) == 1), levels).otherwise(F.concat(levels, F.array(parents(last(levels), arity))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(every)), F.array(nodes), grow)


def siblings(levels: Column, place: Column, arity: int, every: int) -> Column:
    """For each level below a subtree's root, what stands left and right of a descendant's ancestor in its run."""
    widths = F.array(*[F.lit(arity**k) for k in range(every)])

    def at(level: Column, k: Column) -> Column:
        own = F.floor(place / F.element_at(widths, k + 1)).cast("int")
        start = own - own % arity
        left, right = F.slice(level, start + 1, own - start), F.slice(level, own + 2, start + arity - 1 - own)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def folded(node: Column, path: Column) -> Column:
    """The root that a node and the siblings on its path give."""
    return F.aggregate(path, node, lambda own, p: F.sha2(F.concat(p["left"], own, p["right"]), 256))


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the crown over their subroots, lowest first; a row is an aligned subtree: grp, size (nodes of its level in the tree), block, members."""

    spark: SparkSession
    folder: str
    arity: int = 3
    every: int = 4
    groups: list[DataFrame] = field(default_factory=list)
    crown: list[DataFrame] = field(default_factory=list)

    @property
    def width(self) -> int:
        return self.arity**self.every

    def _levels(self, blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("levels", regenerated(F.transform("members", lambda m: m["node"]), F.col("size") <= self.width, self.arity, self.every))

    def _store(self, kind: str, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """The stored levels over nodes (grp, size, idx, node, others), and what remains of each tree: grp, node."""
        stored: list[DataFrame] = []
        others = [c for c in nodes.columns if c not in ("grp", "size", "idx")]
        while True:
            path = f"{self.folder}/{kind}-{len(stored)}"
            member = F.struct("idx", *others).alias("member")
            block = F.floor(F.col("idx") / self.width).alias("block")
            rows = nodes.select("grp", "size", block, member).groupBy("grp", "size", "block").agg(F.array_sort(F.collect_list("member")).alias("members"))
            rows.write.parquet(path)
            stored.append(self.spark.read.schema(rows.schema).parquet(path))
            most = stored[-1].agg(F.max("size")).first()[0] or 0
            up = self._levels(stored[-1])
            nodes = up.select("grp", F.ceil(F.col("size") / self.width).alias("size"), F.col("block").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
            others = ["node"]
            if most <= self.width:
                return stored, nodes.select("grp", "node")

    def root(self) -> DataFrame:
        """The root: one row, none for an empty table."""
        return self._levels(self.crown[-1]).select(F.element_at(F.element_at("levels", -1), 1).alias("root"))

    def subroots(self) -> DataFrame:
        """group, subroot."""
        return self.crown[0].select(F.explode("members").alias("m")).select("m.group", F.col("m.node").alias("subroot"))

    def _down(self, stored: list[DataFrame], paths: DataFrame, needed: list[DataFrame | None]) -> DataFrame:
        """From paths (grp, idx, path, others) of what remains of each tree to those of its lowest nodes, with their members."""
        for blocks, some in zip(reversed(stored), reversed(needed)):
            g, upper = F.col("grp"), paths.drop("member").withColumnsRenamed({"grp": "g", "path": "upper"})
            if some is not None:
                blocks = blocks.join(some.select(F.col("grp").alias("sg"), F.col("block").alias("sb")), g.eqNullSafe(F.col("sg")) & (F.col("block") == F.col("sb")), "left_semi")
            met = self._levels(blocks.join(upper, g.eqNullSafe(F.col("g")) & (F.col("block") == F.col("idx"))).drop("g", "idx"))
            each = met.select("*", F.posexplode("members").alias("place", "member"))
            own = F.concat(siblings(F.col("levels"), F.col("place"), self.arity, self.every), F.col("upper"))
            kept = [c for c in upper.columns if c not in ("g", "idx", "upper")]
            paths = each.select("grp", F.col("member.idx").alias("idx"), own.alias("path"), "member", *kept)
        return paths

    def _needed(self, stored: list[DataFrame], lowest: DataFrame) -> list[DataFrame]:
        """For each stored level the subtrees (grp, block) above `lowest`."""
        out = [lowest]
        for _ in stored[1:]:
            out.append(out[-1].select("grp", F.floor(F.col("block") / self.width).alias("block")).distinct())
        return out

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """group, member (struct: idx, node, id, carried columns), path (left and right siblings by level), subroot, root.

        wanted: a table with a column id; only its rows are proved, from their subtrees alone."""
        needed: list[DataFrame | None] = [None] * len(self.groups)
        if wanted is not None:
            ids = wanted.select(F.col("id").cast("long").alias("id")).distinct()
            hit = self.groups[0].select("grp", "block", F.explode("members.id").alias("own")).join(ids, F.col("own").eqNullSafe(F.col("id")), "left_semi")
            needed = [materialised(x) for x in self._needed(self.groups, hit.select("grp", "block").distinct())]
        path = "array<struct<left:string,right:string>>"
        top = self._levels(self.crown[-1]).select("grp", F.lit(0).cast("long").alias("idx"), F.array().cast(path).alias("path"), F.element_at(F.element_at("levels", -1), 1).alias("root"))
        crowned = self._down(self.crown, top, [None] * len(self.crown))
        starts = crowned.select(F.col("member.group").alias("grp"), F.lit(0).cast("long").alias("idx"), "path", "root", F.col("member.node").alias("subroot"))
        out = self._down(self.groups, starts, needed).select(F.col("grp").alias("group"), "member", "path", "subroot", "root")
        return out if wanted is None else out.join(ids, out["member.id"].eqNullSafe(ids["id"]), "left_semi")


def build(docs: DataFrame, *, group_col: str = "source", id_col: str = "doc_id", fields=FIELDS, carry: dict[str, Column] | None = None, arity: int = 3, every: int = 4, folder: str | None = None) -> Manifest:
    """The manifest of docs, stored in `folder`. carry: further columns of a leaf, kept with it."""
    import uuid

    spark = docs.sparkSession
    out = Manifest(spark, folder or f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}", arity, every)
    extra = [c.alias(k) for k, c in (carry or {}).items()]
    leaves = docs.select(docs[group_col].cast("string").alias("grp"), docs[id_col].cast("long").alias("id"), leaf_of(docs, fields).alias("node"), *extra, F.monotonically_increasing_id().alias("row"))
    out.groups, tops = out._store("groups", ranked(materialised(leaves), ["id", "node", "row"]).drop("row"))
    subroots = tops.select(F.lit(0).alias("grp"), F.col("grp").alias("group"), "node")
    out.crown, _ = out._store("crown", ranked(subroots, ["group"]))
    spark.createDataFrame([(arity, every, len(out.groups), len(out.crown))], "arity int, every int, groups int, crown int").coalesce(1).write.parquet(f"{out.folder}/about")
    return out


def opened(spark: SparkSession, folder: str) -> Manifest:
    """A manifest that build() has stored."""
    about = spark.read.parquet(f"{folder}/about").first()
    read = lambda kind, n: [spark.read.parquet(f"{folder}/{kind}-{k}") for k in range(n)]
    return Manifest(spark, folder, about.arity, about.every, read("groups", about.groups), read("crown", about.crown))


def tamper_check(docs: DataFrame, tampered: Column, changed: Column, *, arity: int = 3, every: int = 4) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row proved, where `tampered` is true with `changed` as its text."""
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_of(docs, text=changed))
    proofs = build(docs, carry={"other": F.nullif(other, leaf_of(docs))}, arity=arity, every=every).proofs()
    found = proofs.select(
        F.col("member.id").alias("doc_id"), F.col("member.node").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("member.other", "member.node"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
