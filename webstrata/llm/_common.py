"""Shared helpers of the text operators: Arrow slices of bounded size, fold hashes, shared folders."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of an Arrow function works on; a longer single text forms a slice of its own.
SLICE_BYTES = 1 << 21


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes together (at least one row each)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a slice; null counts as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def map_slices(
    docs: DataFrame, text_col: str, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE_BYTES
) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``fn`` turns a slice into the rows of ``schema``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, limit):
                yield fn(part)
        give_back()

    return docs.mapInArrow(run, schema)


def give_back() -> None:
    """At a task's end: hand free memory of a Python worker back to the system, as workers are kept and used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class Held(dict):
    """A table of a Python worker, emptied when its keys hold more than ``limit`` bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.bytes = limit, 0

    def room(self) -> None:
        if self.bytes > self.limit:
            self.clear()
            self.bytes = 0


def free_name(taken: list[str], name: str) -> str:
    """The name with as many underscores before it as keep it apart from those taken, whatever the case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def schema_of(frame: DataFrame, *names: str) -> str:
    """The named columns as a schema text."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names]).schema.fields)


#: Keys sent to all tasks at most, when a few keys hold many rows each.
HEAVY_KEYS = 20_000


def join_counts(rows: DataFrame, counts: DataFrame, key: str, number: str, total: int) -> DataFrame:
    """rows joined with one row of counts for each key, ``number`` being the key's rows of ``total``: frequent keys are sent to all
    tasks (each holds more than a ``HEAVY_KEYS``-th of the rows, which bounds them), the others meet by shuffle."""
    least = max(1000, -(-total // HEAVY_KEYS))
    heavy = F.broadcast(counts.where(F.col(number) > least))
    rest = rows.join(heavy.select(key), key, "left_anti").join(counts.where(F.col(number) <= least), key)
    return rows.join(heavy, key).unionByName(rest)


def whole_groups(batches, keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold complete groups, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            last = {k: batch.column(k)[-1] for k in keys}
            same = np.ones(batch.num_rows, bool)
            for k in keys:
                same &= pc.equal(batch.column(k), last[k]).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held, n = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: the fold that a document belongs to."""
    return F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str) else id_col) % folds


def sample_share(rows: int, bound: int) -> float:
    """The share of rows that keeps an expected ``bound`` of them."""
    return min(1.0, bound / rows) if rows else 1.0


def hashed_share(id_col: str, share: float, seed: int = 17) -> Column:
    """True for about ``share`` of the ids, chosen by a hash of the id alone, so that any partitioning gives the same rows."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else F.lit(True)


def _local_master(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and everything runs in one process (tests), a temporary folder is taken and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not _local_master(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="webstrata-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, *, name: str = "table") -> DataFrame:
    """Compute once and cut the lineage: the rows lie as Parquet in the shared folder, so a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def model_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def runs(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs with these lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


#: Bytes of a text after ASCII lower-casing: digits, a-z and every byte of a non-ASCII character stay, the rest become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def stretches(raw: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes, cut at spaces: no word is broken, and one long text needs no long list of words."""
    at = 0
    while len(raw) - at > limit:
        to = raw.rfind(b" ", at, at + limit)
        if to <= at:
            to = raw.find(b" ", at + limit)
            if to < 0:
                break
        yield raw[at:to]
        at = to
    yield raw[at:] if at else raw


#: Bits of a table of hashed keys: 16 MB, whatever the number of keys. More keys let more strangers pass, never fewer members.
SLOT_BITS = 27


def bit_table(slots: DataFrame, name: str, bits: int = SLOT_BITS) -> np.ndarray:
    """The bits at the given slots (0 to 2**bits - 1), gathered as bitmaps of 4 KB: at most 2**bits bits reach the driver."""
    maps = slots.where(F.col(name).isNotNull()).groupBy(F.expr(f"{name} div 32768").alias("part")).agg(F.expr(f"bitmap_construct_agg({name} % 32768)").alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps.toLocalIterator():
        out[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def in_table(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the bit of each slot is set."""
    return (table[slots >> slots.dtype.type(3)] >> (slots & slots.dtype.type(7)).astype(np.uint8)) & 1 == 1


def top_rows(rows: DataFrame, group: str, order: list[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group with their rank; a large group is first cut down in 64 parts."""
    from pyspark.sql import Window

    salt, names = free_name(rows.columns, "salt"), rows.columns
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in names]), F.lit(64)))
    few = salted.withColumn(rank, F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))).where(F.col(rank) <= most)
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= most).select(*names, rank)
