"""Shared helpers: shared work folder, train/held-out fold, spanning joins."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import Scratch, materialise, release_memory  # noqa: F401

#: A key that holds more than one row in so many counts as hot: fewer keys than this can.
HOT_SHARE = 1000
#: Bytes of text that a worker takes at a time; all it holds is a multiple of that, or of one longer text.
SLICE_BYTES = 1 << 21
#: Bytes of an Arrow batch on its way to a worker: a slice, with room for the row that goes over.
BATCH_BYTES = SLICE_BYTES // 8 * 7
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPACES = " \n\t\r\x0b\x0c"


def spread_join(rows: DataFrame, dims: DataFrame, on: list[str], held: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``dims`` that their key has; ``held`` counts the rows of each key.

    Hot keys (over one row in ``HOT_SHARE``: fewer keys than that) are broadcast, and their rows stay where they are. All
    other rows meet by a shuffle in which no key holds more than that share. ``dims`` is read for its counts first.
    """
    total, most = dims.agg(F.sum(held), F.max(held)).first()
    if not total or most * HOT_SHARE <= total:
        return rows.join(dims, on, how)
    is_hot = F.col(held) * HOT_SHARE > total
    hot = F.broadcast(dims.where(is_hot).withColumn("__hot", F.lit(True)))
    cold = dims.where(~is_hot)
    met = rows.join(hot, on, "left")
    near = met.where("__hot").drop("__hot")
    far = met.where("__hot is null").select(*[F.col(f"`{c}`") for c in rows.columns])
    return near.unionByName(far.join(cold, on, how))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves remainder 2 on division by 4; null ids: False."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def salted_join(rows: DataFrame, dims: DataFrame, on: str, scratch: Scratch, per_salt: int = 2000) -> DataFrame:
    """``rows`` with the one row of ``dims`` that their key has, however large that row is.

    A key of many rows is dealt to several tasks, ``per_salt`` rows each, and its row of ``dims`` is copied to them.
    """
    counts = scratch.table(rows.groupBy(on).agg(F.count(F.lit(1)).alias("__held")).withColumn("__salts", F.ceil(F.col("__held") / per_salt).cast("int")), "salts")
    dealt = spread_join(rows, counts, [on], "__held").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.col("__salts")).cast("int"))
    copies = dims.join(counts, on).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__held", "__salts")
    return dealt.drop("__held", "__salts").join(copies, [on, "__salt"]).drop("__salt")


def hash_share(hashed: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def cut_text(text: str, size: int) -> list[str]:
    """A long text in parts of about ``size`` characters, cut where an ASCII white space stands."""
    parts, at = [], 0
    while len(text) - at > size:
        stop = max(text.rfind(c, at, at + size) for c in _SPACES)
        if stop <= at:
            ahead = [x for x in (text.find(c, at + size) for c in _SPACES) if x >= 0]
            if not ahead:
                break
            stop = min(ahead)
        parts.append(text[at:stop])
        at = stop
    return [*parts, text[at:]]


def row_slices(texts: pa.Array, size: int) -> Iterator[range]:
    """Ranges of rows whose texts take ``size`` bytes together, or of one row."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, row = np.cumsum(sizes), 0
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] - sizes[row] + size, side="right")))
        yield range(row, stop)
        row = stop


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Executors get this package as a zip file, once per Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_trackloom_shipped", False):
        package = Path(__file__).parents[1]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='trackloom-')}/{package.name}", "zip", package.parent, package.name))
        context._trackloom_shipped = True


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` by a function of this package.

    Batches are bounded by their bytes, not just by Spark's count of rows (10,000 of any length), unless the session has a bound
    of its own. What a worker has freed goes back to the system after each batch: workers stay for later computations.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: run(_releasing(batches)), schema)


def _releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch
        del batch
        release_memory()


def bitmap(rows: DataFrame, bit: Column) -> DataFrame:
    """(word, bitmap): a bitmap of the non-negative numbers ``bit``; as large as their bound, whatever the row count."""
    at = bit + 1  # the bitmap functions count from 1
    return rows.groupBy(F.bitmap_bucket_number(at).alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def probe_bitmap(rows: DataFrame, bit: Column, words: DataFrame) -> DataFrame:
    """``rows`` with a column ``in_bitmap``. ``words`` is broadcast: 4 KB for each 32768 numbers of its bound.

    Its bytes go out as 64-bit numbers, 8 of them each, first byte highest: a row then costs a look-up and a shift.
    """
    names = rows.columns
    at = bit + 1
    probe = rows.select(*[F.col(f"`{c}`") for c in names], F.bitmap_bucket_number(at).alias("word"), F.bitmap_bit_position(at).alias("bit_at"))
    eight = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda k: F.conv(F.hex(F.substring("bitmap", 8 * k + 1, F.lit(8))), 16, -10).cast("long"))
    number = F.get("bitmap", F.shiftright(F.col("bit_at"), 6).cast("int"))
    hit = F.getbit(number, F.col("bit_at").bitwiseXOR(F.lit(56)).bitwiseAND(F.lit(63)).cast("int")) == 1
    return probe.join(F.broadcast(words.select("word", eight.alias("bitmap"))), "word", "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce(hit, F.lit(False)).alias("in_bitmap"))


def map_text(df: DataFrame, make: Callable[[], Callable[[list], dict]], added: str, *, text_col: str = "text", where: str | None = None) -> DataFrame:
    """``df`` with columns computed from its texts, batch by batch; rows and their other columns pass unchanged.

    ``make`` runs once per task and returns a function from a list of texts (null: None) to a dict
    of columns. ``added`` is their DDL; a clashing column of ``df`` gives way to the added one. ``where``
    names an added boolean column: only rows where it holds go on, without that column.
    """
    new = T.StructType.fromDDL(added)
    fresh = [f.name for f in new if f.name != where]
    old = [c for c in df.columns if c not in new.names]
    schema = T.StructType([df.schema[c] for c in old] + [new[n] for n in fresh])
    kept = list(dict.fromkeys([*old, text_col]))
    at, from_old = kept.index(text_col), [kept.index(c) for c in old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        f = make()
        types = {x.name: to_arrow_type(x.dataType) for x in new}
        for batch in batches:
            for rows in row_slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(rows.start, len(rows))
                got = f(part.column(at).to_pylist())
                columns = [part.column(i) for i in from_old] + [pa.array(got[n], types[n]) for n in fresh]
                out = pa.RecordBatch.from_arrays(columns, names=[*old, *fresh])
                yield out.filter(pa.array(got[where], pa.bool_())) if where else out

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept]), run, schema)
