"""Streams of expressions into a log of what they add and delete, and the store that a log describes.

A micro-batch writes one folder, nodes and links together, a row per atom; a repeated batch replaces its folder, and the
stream reads nothing that it wrote. An atom is there if it was added at or after its last delete, and toplevel if a toplevel
addition was. A deleted atom that a link holds stays, no longer toplevel, until no link does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..runtime import stored
from ..sources.expressions import as_links, atom_rows

ADD, DELETE = "add_atoms", "delete_atoms"
EVENTS = "handle string, type string, name string, targets array<string>, expr string, added long, topped long, deleted long"


def events_of(lines: DataFrame) -> DataFrame:
    """EVENTS of lines: value and, where given, command (ADD of an expression or DELETE of handles) and seq, their order."""
    seq = F.col("seq") if "seq" in lines.columns else F.lit(0)
    command = F.coalesce(F.col("command"), F.lit(ADD)) if "command" in lines.columns else F.lit(ADD)
    known = F.when(command.isin(ADD, DELETE), command).otherwise(F.raise_error(F.concat(F.lit("unknown command: "), command)))
    rows = lines.select("value", F.coalesce(seq, F.lit(0)).cast("long").alias("seq"), known.alias("command"))
    added = atom_rows(rows.where(F.col("command") == ADD), order="seq").groupBy("handle").agg(
        F.first("type").alias("type"), F.first("name", True).alias("name"), F.first("targets", True).alias("targets"), F.first("expr").alias("expr"),
        F.max("seq").alias("added"), F.max(F.when(F.col("is_toplevel"), F.col("seq"))).alias("topped"),
    )
    if "command" not in lines.columns:
        return added.withColumn("deleted", F.lit(None).cast("long"))
    handles = rows.where(F.col("command") == DELETE).select(F.explode(F.split(F.trim("value"), "\\s+")).alias("handle"), "seq")
    return added.join(handles.groupBy("handle").agg(F.max("seq").alias("deleted")), "handle", "full")


def ingest(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """lines: a stream as events_of() takes it, logged at path."""

    def add(batch: DataFrame, epoch: int) -> None:
        events_of(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The events of all batches that were written to their end."""
    ends = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = ends.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(ends)
    folders = [f.getPath().getParent().toString() for f in found]
    if not folders:
        return spark.createDataFrame([], f"{EVENTS}, batch long")
    return spark.read.option("basePath", path).schema(f"{EVENTS}, batch long").parquet(*folders)


def _state(events: DataFrame) -> DataFrame:
    """handle, type, name, targets, expr, is_toplevel of the atoms that are there after all events."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("batch", F.col(c).alias("seq")))).alias(c)
    whole = [F.first(c, True).alias(c) for c in ("type", "name", "targets", "expr")]
    since = lambda c: F.col(c).isNotNull() & (F.col("deleted").isNull() | (F.col(c) >= F.col("deleted")))
    atoms = events.groupBy("handle").agg(*whole, last("added"), last("topped"), last("deleted")).where(F.col("added").isNotNull())
    atoms = stored(atoms.select("handle", "type", "name", "targets", "expr", since("topped").alias("is_toplevel"), since("added").alias("there")), "atoms")
    kept, gone = atoms.where("there"), atoms.where("not there")
    front = kept
    while gone.limit(1).count():
        held = front.select(F.explode("targets").alias("handle")).distinct()
        front = stored(gone.join(held, "handle", "left_semi"), "atoms")
        if not front.limit(1).count():
            break
        kept, gone = kept.unionByName(front), stored(gone.join(front, "handle", "left_anti"), "atoms")
    return kept.drop("there")


def ingested(spark: SparkSession, path: str) -> Store:
    """What the log at path describes."""
    atoms = _state(_log(spark, path))
    return Store(atoms.where("name is not null").select("handle", "type", "name", "is_toplevel"), as_links(atoms.where("targets is not null")))


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """Writes the state of the log at path as one batch, numbered as its last, to the log at to, on which the stream can go on."""
    events = _log(spark, path)
    batch = events.agg(F.max("batch")).first()[0]
    if batch is not None:
        now = _state(events).withColumns({"added": F.lit(0).cast("long"), "topped": F.when(F.col("is_toplevel"), F.lit(0)).cast("long"), "deleted": F.lit(None).cast("long")})
        now.drop("is_toplevel").write.mode("overwrite").parquet(f"{to}/batch={batch}")
