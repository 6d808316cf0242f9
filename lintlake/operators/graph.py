"""Cycles of a directed graph given as a distributed edge list.

Strongly connected components are found from all nodes as pivots at once. In every round each node gets the greatest
label of those that reach it and of those that it reaches; where the two are equal, the node is on a cycle with the one
of that label. Edges between nodes whose two labels differ lie on no cycle and go, as do edges at nodes without one in or
out; labels are then dealt anew. Labels spread along the edges and along pointers that double their reach at each step,
to the neighbour with the greatest label at first, so a ring or chain takes a number of steps in the order of the
logarithm of its length. Each step writes a table: plans stay short, and lost executors cost one step.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; where none is set, a temporary one if all runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lintlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and nothing of its plan stays with later ones
    (a checkpoint keeps what Catalyst inferred, which doubles at every step of a loop). Spark removes it when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lintlake-graph/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(df: DataFrame) -> None:
    """Delete a written step that no later one reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _label(node: str, salt: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(salt)).alias("h"), F.col(node).alias("id"))


def _spread(edges: DataFrame, salt: int) -> DataFrame:
    """``node, fl, bl``: the greatest label that reaches a node of ``edges`` (s, t), and the greatest that it reaches; its own counts."""
    none = F.lit(None)
    into = edges.select(F.col("t").alias("node"), _label("s", salt).alias("f"), none.cast("struct<h: long, id: long>").alias("b"))
    out = edges.select(F.col("s").alias("node"), none.cast("struct<h: long, id: long>").alias("f"), _label("t", salt).alias("b"))
    near = into.union(out).groupBy("node").agg(F.max("f").alias("f"), F.max("b").alias("b"))
    state = near.select("node", F.greatest(_label("node", salt), "f").alias("fl"), F.greatest(_label("node", salt), "b").alias("bl"), F.coalesce("f.id", "node").alias("fj"), F.coalesce("b.id", "node").alias("bj"))
    state = cut(state)
    while True:
        said = lambda name, of: state.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in of))
        forward = edges.join(said("s", ["fl"]), "s").select(F.col("t").alias("node"), F.col("s_fl").alias("fl"))
        backward = edges.join(said("t", ["bl"]), "t").select(F.col("s").alias("node"), F.col("t_bl").alias("bl"))
        jumped = state.join(said("fj", ["fl", "fj"]), "fj").join(said("bj", ["bl", "bj"]), "bj")
        own = jumped.select("node", F.greatest("fl", "fj_fl").alias("fl"), F.greatest("bl", "bj_bl").alias("bl"), F.col("fj_fj").alias("fj"), F.col("bj_bj").alias("bj"), F.col("fl").alias("was_fl"), F.col("bl").alias("was_bl"))
        met = own.unionByName(forward, True).unionByName(backward, True).groupBy("node").agg(*(F.max(c).alias(c) for c in ("fl", "bl", "fj", "bj", "was_fl", "was_bl")))
        before, state = state, cut(met.select("node", "fl", "bl", "fj", "bj", ((F.col("fl") != F.col("was_fl")) | (F.col("bl") != F.col("was_bl"))).alias("new")))
        _forget(before)
        if state.where("new").isEmpty():
            return state.select("node", "fl", "bl")


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, scc`` of every node on a cycle of more than one node; scc is the least node of its component."""
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())  # read three times
    names = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("id", F.monotonically_increasing_id()))
    ends = lambda old, new: names.select(F.col("node").alias(old), F.col("id").alias(new))
    left = cut(edges.join(ends("src", "s"), "src").join(ends("dst", "t"), "dst").select("s", "t"))
    found, salt = [], 0
    while not left.isEmpty():
        labels = _spread(left, salt)
        found.append(labels.where("fl = bl").select(F.col("node").alias("id"), F.col("fl.id").alias("root")))
        open_ = labels.where("fl <> bl")
        of = lambda end: open_.select(F.col("node").alias(end), F.col("fl").alias(f"{end}_fl"), F.col("bl").alias(f"{end}_bl"))  # noqa: B023, E731
        kept = left.join(of("s"), "s").join(of("t"), "t").where("s_fl = t_fl AND s_bl = t_bl").select("s", "t")
        into, out = kept.select(F.col("t").alias("s")).distinct(), kept.select(F.col("s").alias("t")).distinct()
        before, left = left, cut(kept.join(into, "s", "left_semi").join(out, "t", "left_semi"))
        _forget(before)
        salt += 1
    if not found:
        return names.select("node", F.col("node").alias("scc")).where("false")
    named = reduce(DataFrame.union, found).join(names, "id")
    sizes = named.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("scc")).where("n > 1")
    return named.join(sizes, "root").select("node", "scc")


def cycle_issues(members: DataFrame) -> DataFrame:
    """One issue for each component, at its first file."""
    n = F.count("*").cast("long")
    grouped = members.groupBy("scc").agg(n.alias("n"))
    return grouped.select(F.col("scc").alias("file"), F.lit(None).cast("long").alias("line"), F.when(F.col("n") > 3, "high").otherwise("medium").alias("severity"), F.concat(F.lit("Circular dependency — "), F.col("n").cast("string"), F.lit(" files")).alias("title"))


def _inner(edges: DataFrame, members: DataFrame) -> DataFrame:
    a, b = members.select(F.col("node").alias("src"), "scc"), members.select(F.col("node").alias("dst"), F.col("scc").alias("other"))
    return edges.join(a, "src").join(b, "dst").where("scc = other").select("scc", "src", "dst")


def cycle_breaks(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``scc, break_at``: the first file of each component with the fewest imports from within."""
    degree = _inner(edges, members).groupBy("scc", F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return degree.groupBy("scc").agg(F.min(F.struct("n", "node")).alias("least")).select("scc", F.col("least.node").alias("break_at"))


def walk(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """From the node met most as a target (of equals the least), each time on to the least target not yet met; edges are sorted."""
    n = int(max(s.max(), t.max())) + 1
    begin = np.searchsorted(s, np.arange(n + 1)).tolist()
    seen, now = bytearray(n), int(np.argmax(np.bincount(t, minlength=n)))
    chain = array("i", [now])
    seen[now] = 1
    while True:
        after = next((x for x in t[begin[now] : begin[now + 1]].tolist() if not seen[x]), -1)
        if after < 0:
            return np.frombuffer(chain, np.int32)
        seen[after] = 1
        chain.append(after)
        now = after


#: Places of a chain in a row batch.
_BATCH = 1 << 16


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``scc, place, code`` of the chain of each component, from its edges in order; one component is held at a time, as two numbers an edge."""
    scc, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        chain = walk(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(chain), _BATCH):
            part = chain[at : at + _BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([scc] * len(part), pa.string()), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["scc", "place", "code"])

    for batch in batches:
        names, s, t = batch["scc"], batch["s"].to_numpy(), batch["t"].to_numpy()
        same = np.r_[True, pc.not_equal(names.slice(1), names.slice(0, max(len(names) - 1, 0))).to_numpy(zero_copy_only=False)][: len(names)]
        edges = [*np.flatnonzero(same).tolist(), len(names)]
        for a, b in zip(edges, edges[1:], strict=False):
            name = names[a].as_py()
            if name != scc and held:
                yield from close()
                held = []
            scc = name
            held.append((s[a:b].copy(), t[a:b].copy()))
    if held:
        yield from close()


def cycle_chains(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``scc, chain``: from the file imported most, each time on to the first file not yet met.

    Which file comes next depends on all before it (the first path in the order of names is complete for P), so a
    component is walked in one task, over its edges sorted by Spark and held as pairs of numbers; components side by side.
    """
    coded = cut(members.withColumn("code", F.row_number().over(Window.partitionBy("scc").orderBy("node")) - 1))
    a, b = coded.select(F.col("node").alias("src"), "scc", F.col("code").alias("s")), coded.select(F.col("node").alias("dst"), F.col("scc").alias("other"), F.col("code").alias("t"))
    inner = edges.join(a, "src").join(b, "dst").where("scc = other AND s <> t").select("scc", "s", "t").distinct()
    walked = inner.repartition("scc").sortWithinPartitions("scc", "s", "t").mapInArrow(_chains, "scc string, place long, code int")
    named = walked.join(coded, ["scc", "code"]).select("scc", "place", F.regexp_replace("node", "^.*/", "").alias("name"))
    listed = named.groupBy("scc").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    return listed.select("scc", F.array_join(F.concat("names", F.slice("names", 1, 1)), " → ").alias("chain"))
