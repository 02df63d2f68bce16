"""A store of atoms: lookups, upserts with merge rules, deletes, all over the tables nodes and links."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.handles import md5
from ..runtime import stored, stored_together
from ..sources.expressions import LINKS, NODES, as_links

REPLACE, THROW, SKIP = "replace", "throw_if_exists", "skip_if_exists"


@dataclass(frozen=True)
class Store:
    nodes: DataFrame
    links: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        return Store(spark.createDataFrame([], NODES), spark.createDataFrame([], LINKS))

    # Reading

    def get(self, handles: list[str]) -> tuple[DataFrame, DataFrame]:
        return self.nodes.where(F.col("handle").isin(handles)), self.links.where(F.col("handle").isin(handles))

    def exist(self, handles: DataFrame) -> DataFrame:
        """Those of handles (handle) that the store holds."""
        return handles.join(self.nodes.select("handle").unionByName(self.links.select("handle")), "handle", "left_semi")

    def is_empty(self) -> bool:
        return not self.nodes.limit(1).count() and not self.links.limit(1).count()

    def matching(self, kind: str | None = None, name: str | None = None, key: list[str | None] | None = None, composite_type: list[str] | None = None, is_toplevel: bool | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes by type and name and links by type, targets (None for any) and composite type; what isn't given matches all.

        A name asks for nodes alone; targets or a composite type (type handles) for links alone.
        """
        nodes, links = self.nodes, self.links
        if kind is not None:
            nodes, links = nodes.where(F.col("type") == kind), links.where(F.col("type") == kind)
        if is_toplevel is not None:
            nodes, links = nodes.where(F.col("is_toplevel") == is_toplevel), links.where(F.col("is_toplevel") == is_toplevel)
        if name is not None:
            nodes, links = nodes.where(F.col("name") == name), links.limit(0)
        if key is not None:
            nodes = nodes.limit(0)
            links = links.where(F.col("arity") == len(key))
            for i, h in enumerate(key):
                if h is not None:
                    links = links.where((F.col(f"t{i}") if i < 4 else F.get("targets", F.lit(i))) == h)
        if composite_type is not None:
            nodes = nodes.limit(0)
            wanted = self.composite_types().where(F.col("composite_type") == F.array(*[F.lit(t) for t in composite_type])).select("handle")
            links = links.join(wanted, "handle", "left_semi")
        return nodes, links

    def targets(self, handle: str) -> DataFrame:
        return self.links.where(F.col("handle") == handle).select("targets")

    def incoming(self, handles: DataFrame) -> DataFrame:
        """target, handle: the links that hold each of handles (handle) at any position."""
        held = self.links.select("handle", F.explode(F.array_distinct("targets")).alias("target"))
        return held.join(handles.select(F.col("handle").alias("target")).distinct(), "target", "left_semi")

    def match(self, key: list[str | None], kind: str = "Expression", is_toplevel: bool | None = None) -> DataFrame:
        """Links of a type by their targets, None for any."""
        df = self.links.where((F.col("type") == kind) & (F.col("arity") == len(key)))
        for i, h in enumerate(key):
            if h is not None:
                df = df.where((F.col(f"t{i}") if i < 4 else F.get("targets", F.lit(i))) == h)
        return df if is_toplevel is None else df.where(F.col("is_toplevel") == is_toplevel)

    def counts(self) -> DataFrame:
        n, m = self.nodes.agg(F.count(F.lit(1)).alias("nodes")), self.links.agg(F.count(F.lit(1)).alias("links"))
        return n.crossJoin(m).withColumn("atoms", F.col("nodes") + F.col("links"))  # one row each

    def all_atoms(self) -> DataFrame:
        return self.nodes.select("handle", "type", "name", F.lit(None).cast("array<string>").alias("targets")).unionByName(self.links.select("handle", "type", F.lit(None).cast("string").alias("name"), "targets"))

    def reachable(self, roots: DataFrame, skip_heads: bool = False, max_depth: int = 32) -> DataFrame:
        """root, handle: the nodes under each of roots (handle), a join a level; skip_heads leaves out nodes that head a link."""
        held = self.links.select(F.col("handle").alias("at"), F.posexplode("targets").alias("pos", "next"))
        is_node = self.nodes.select(F.col("handle").alias("next"), F.lit(True).alias("leaf"))
        front = roots.select(F.col("handle").alias("root"), F.col("handle").alias("at"))
        found = front.join(self.nodes.select(F.col("handle").alias("at")), "at", "left_semi").select("root", F.col("at").alias("handle"))
        for _ in range(max_depth):
            step = stored(front.join(held, "at").join(is_node, "next", "left").select("root", "next", "pos", F.coalesce("leaf", F.lit(False)).alias("leaf")), "reach")
            leaves = step.where("leaf and pos > 0" if skip_heads else "leaf")
            found = found.unionByName(leaves.select("root", F.col("next").alias("handle")))
            front = step.where("not leaf").select("root", F.col("next").alias("at")).distinct()
            if not front.limit(1).count():
                return found.distinct()
        raise ValueError("links are nested too deeply")

    def composite_types(self) -> DataFrame:
        """handle, composite_type, composite_type_hash of every link, from the innermost outwards."""
        done = stored(self.nodes.select("handle", F.md5("type").alias("h")), "types")
        out, hashes = [], [done]
        left = self.links.select("handle", "type", "targets")
        while left.limit(1).count():
            parts = left.select("handle", "type", F.size("targets").alias("n"), F.posexplode("targets").alias("pos", "target")).join(done.withColumnRenamed("handle", "target"), "target")
            whole = parts.groupBy("handle", "type", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("parts")).where(F.size("parts") == F.col("n"))
            now = stored(whole.select("handle", F.concat(F.array(F.md5("type")), F.transform("parts", lambda p: p["h"])).alias("composite_type")).withColumn("composite_type_hash", F.md5(F.array_join("composite_type", " "))), "types")
            if not now.limit(1).count():
                raise ValueError("links have targets that the store doesn't hold")
            out.append(now)
            hashes.append(stored(now.select("handle", F.col("composite_type_hash").alias("h")), "types"))
            done = stored_together(hashes)
            left = stored(left.join(now, "handle", "left_anti"), "types")
        if not out:
            return self.links.select("handle", F.array("type").alias("composite_type"), F.col("type").alias("composite_type_hash")).limit(0)
        return stored_together(out)

    # Writing: a new store each time

    def add_nodes(self, new: DataFrame, rule: str = REPLACE, merge: Callable[[Column, Column], Column] | None = None) -> Store:
        return replace(self, nodes=_upserted(self.nodes, new, rule, merge))

    def add_links(self, new: DataFrame, rule: str = REPLACE, check_targets: bool = False, merge: Callable[[Column, Column], Column] | None = None) -> Store:
        """new: handle, type, targets, is_toplevel, expr."""
        if check_targets and self.missing_targets(new).limit(1).count():
            raise ValueError("a link has a target that the store doesn't hold")
        return replace(self, links=_upserted(self.links, as_links(new), rule, merge))

    def missing_targets(self, new: DataFrame) -> DataFrame:
        known = self.nodes.select("handle").unionByName(self.links.select("handle")).unionByName(new.select("handle"))
        return new.select(F.explode("targets").alias("handle")).distinct().join(known, "handle", "left_anti")

    def delete(self, handles: DataFrame, with_incoming: bool = False, with_targets: bool = False) -> Store:
        """Without handles (handle). An atom with incoming links is refused unless with_incoming, which takes those links too,
        and theirs. with_targets also takes targets that no link holds any more, downwards."""
        gone = stored(handles.select("handle").distinct(), "gone")
        if not with_incoming:
            blocked = self.incoming(gone).join(gone, "handle", "left_anti").select(F.col("target").alias("handle")).distinct()
            gone = stored(gone.join(blocked, "handle", "left_anti"), "gone")
        front, parts = gone, [gone]
        while with_incoming:
            front = stored(self.incoming(front).select("handle").distinct().join(gone, "handle", "left_anti"), "gone")
            if not front.limit(1).count():
                break
            parts.append(front)
            gone = stored_together(parts)
        front = gone
        while with_targets:
            kept = self.links.join(gone, "handle", "left_anti")
            below = self.links.join(front, "handle", "left_semi").select(F.explode("targets").alias("handle")).distinct()
            held = kept.select(F.explode("targets").alias("handle")).distinct()
            front = stored(below.join(held, "handle", "left_anti").join(gone, "handle", "left_anti"), "gone")
            if not front.limit(1).count():
                break
            parts.append(front)
            gone = stored_together(parts)
        return Store(self.nodes.join(gone, "handle", "left_anti"), self.links.join(gone, "handle", "left_anti"))

    def re_clustered(self, path: str, files: int, schema: tuple[int, ...] = (0, 1)) -> Store:
        """The tables written anew, links by the targets at schema's positions (0 to 3), so that filters on the first skip files."""
        spark = self.nodes.sparkSession
        if not schema or any(not 0 <= i < 4 for i in schema):
            raise ValueError("an index is over some of the first four targets")
        by = [f"t{i}" for i in schema]
        self.nodes.repartitionByRange(files, "handle").sortWithinPartitions("handle").write.mode("overwrite").parquet(f"{path}/nodes")
        self.links.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/links")
        return Store(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/links"))

    def permitted(self, patterns: list[list[str | None]], kind: str = "Expression") -> Store:
        """The part that a reader may see: links that match one of the patterns."""
        seen = self.links.limit(0)
        for p in patterns:
            seen = seen.unionByName(self.match(p, kind))
        return replace(self, links=seen.dropDuplicates(["handle"]))


def _upserted(old: DataFrame, new: DataFrame, rule: str, merge: Callable[[Column, Column], Column] | None) -> DataFrame:
    """By handle. merge(old, new) gives the kept struct from the structs of both."""
    columns = old.columns
    new = new.select(columns).dropDuplicates(["handle"])
    if merge is not None:
        a, b = old.select("handle", F.struct(*columns).alias("a")), new.select("handle", F.struct(*columns).alias("b"))
        both = a.join(b, "handle", "full").select(F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(merge(F.col("a"), F.col("b"))).alias("x"))
        return both.select("x.*")
    if rule == THROW and new.join(old, "handle", "left_semi").limit(1).count():
        raise ValueError("an atom exists already")
    if rule == SKIP:
        return old.unionByName(new.join(old, "handle", "left_anti"))
    return old.join(new, "handle", "left_anti").unionByName(new)


def type_handle(kind: str) -> str:
    return md5(kind)


def federated(stores: list[Store]) -> Store:
    """The union of stores; of atoms that several hold, that of the first."""

    def first(tables: list[DataFrame]) -> DataFrame:
        columns = tables[0].columns
        ranked = None
        for i, t in enumerate(tables):
            t = t.select("handle", F.struct(F.lit(i).alias("i"), F.struct(*columns).alias("row")).alias("r"))
            ranked = t if ranked is None else ranked.unionByName(t)
        return ranked.groupBy("handle").agg(F.min_by("r", F.col("r.i")).alias("r")).select("r.row.*")

    return Store(first([s.nodes for s in stores]), first([s.links for s in stores]))


@dataclass(frozen=True)
class Peer:
    """A remote store in layers: what was written here, then what was saved or fetched, then the remote itself."""

    remote: Store
    writable: bool = True
    written: Store | None = None
    local: Store | None = None

    def store(self) -> Store:
        return federated([s for s in (self.written, self.local, self.remote) if s is not None])

    def added(self, new: Store, rule: str = REPLACE) -> Peer:
        """new in the layer of writes; a read-only peer stays as it is."""
        if not self.writable:
            return self
        if rule == SKIP:
            known = self.store()
            new = Store(new.nodes.join(known.nodes.select("handle"), "handle", "left_anti"), new.links.join(known.links.select("handle"), "handle", "left_anti"))
        elif rule == THROW and self.store().exist(new.nodes.select("handle").unionByName(new.links.select("handle"))).limit(1).count():
            raise ValueError("an atom exists already")
        return replace(self, written=new if self.written is None else federated([new, self.written]))

    def fetched(self, key: list[str | None], kind: str = "Expression") -> Peer:
        """The remote's links of a pattern, and the nodes that they hold, kept near."""
        links = stored(self.remote.match(key, kind), "fetched")
        nodes = stored(self.remote.nodes.join(links.select(F.explode("targets").alias("handle")).distinct(), "handle", "left_semi"), "fetched")
        near = Store(nodes, links)
        return replace(self, local=near if self.local is None else federated([near, self.local]))

    def flushed(self) -> Peer:
        """What was written moves to the local layer, as tables."""
        if self.written is None:
            return self
        both = federated([self.written] + ([self.local] if self.local is not None else []))
        return replace(self, written=None, local=Store(stored(both.nodes, "local"), stored(both.links, "local")))

    def released(self) -> Peer:
        """Without what was fetched or saved; writes are kept."""
        return replace(self, local=None)


@dataclass(frozen=True)
class Federation:
    """Several peers read as one store, the first that holds an atom counts; writes go to every writable peer."""

    peers: tuple[Peer, ...]

    def store(self) -> Store:
        return federated([p.store() for p in self.peers])

    def added(self, new: Store, rule: str = REPLACE) -> Federation:
        return replace(self, peers=tuple(p.added(new, rule) for p in self.peers))

    def deleted(self, handles: DataFrame, with_incoming: bool = False, with_targets: bool = False) -> Federation:
        """Without handles at every writable peer."""

        def without(s: Store | None) -> Store | None:
            return None if s is None else s.delete(handles, with_incoming, with_targets)

        return replace(self, peers=tuple(replace(p, remote=without(p.remote), written=without(p.written), local=without(p.local)) if p.writable else p for p in self.peers))
