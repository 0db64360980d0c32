"""Shared helpers: tables, intermediate files in the shared folder, byte tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A-Z to a-z in UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = local_folder()
    return folder


@cache
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The files outlive a lost executor, end the lineage, and let Spark know the size before it plans the
    next join, so that only a side below its broadcast threshold is broadcast and skewed partitions of a
    join can be split.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.cut_path = path
    return read


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames from :func:`cut` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text is a part of its own."""
    sizes = np.diff(offsets_of(batch.column(column)))
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def offsets_of(array: pa.Array) -> np.ndarray:
    """Offsets of a string or binary array into its data buffer."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one piece and the offsets of each text in it; a null has no bytes."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(array)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(array: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes; a null as none."""
    data, offsets = bytes_of(array)
    whole = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield whole[a:b]


def map_arrow(
    df: DataFrame, per_slice: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str, limit: int = 1 << 20
) -> DataFrame:
    """``mapInArrow`` over parts of bounded text size. ``column`` is the text that bounds a part."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                yield per_slice(part)

    return df.mapInArrow(run, schema)


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all their columns, for whose texts ``keep`` says so.

    Only texts go to Python and only verdicts come back; the other columns stay where they are.
    """

    @F.arrow_udf("boolean")
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.cast(pa.string())], ["text"])
            found = [np.zeros(0, bool), *(keep(part.column(0)) for part in slices(plain, "text"))]
            yield pa.array(np.concatenate(found), pa.bool_())

    return docs.where(verdict(F.col("text").cast("string")))


class Forest:
    """Union-find over integers; ``edges`` spans what was joined."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def spanning(edges: DataFrame, keep: int = 1_000_000) -> DataFrame:
    """Within each partition, drop edges ``(a, b)`` that earlier ones already imply.

    The forest is emitted and started anew whenever it spans ``keep`` edges, which bounds its memory.
    """

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.edges) >= keep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[k] for e in forest.edges], pa.int64()) for k in (0, 1)], ["a", "b"]
                )
                forest = Forest()
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[k] for e in forest.edges], pa.int64()) for k in (0, 1)], ["a", "b"]
        )

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the edges ``(a, b)``, the component named by its smallest node.

    Every round takes the smallest label among the neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the longest chain. Each round is written to the shared
    folder; only the number of changed rows reaches the driver. Empty edges give an empty frame.

    The edges are read once: :func:`spanning` may keep others when it runs again, and a node of only one
    of the two forests would be lost. The joins are told to merge, as the files of a few large components are
    small beside the rows that a broadcast would hold.
    """
    spark = edges.sparkSession
    ways = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("ab", "ba")]
    both = cut(edges.select(F.inline(F.array(*ways))).where("u <> v").distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.hint("merge").join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hung = cut(
            labels.hint("merge").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")),
            "labels",
        )
        jumped = cut(
            hung.hint("merge").join(hung.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select(
                "node", "was", F.col("next").alias("label")
            ),
            "labels",
        )
        done = jumped.where("was <> label").isEmpty()
        discard(labels, hung)
        if done:
            discard(both)
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped
