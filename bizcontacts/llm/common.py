"""Shared helpers: tables, scratch folders on shared storage, held-out split, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 500
TOKENIZER_FOLDER = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; ``/opt/tokenizers`` where the package is not importable."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_FOLDER, name)
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for rows no model may learn from: crc32 of the id as text, mod 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they can import it."""
    import shutil

    import bizcontacts

    sc = spark.sparkContext
    if not getattr(sc, "_bizcontacts_sent", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(bizcontacts.__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="run-"), "bizcontacts_package")
        sc.addPyFile(shutil.make_archive(archive, "zip", root, "bizcontacts"))
        sc._bizcontacts_sent = True


class Scratch:
    """Intermediate tables in the folder that driver and executors share.

    A table written here cuts the lineage and survives the loss of executors. ``drop`` removes a
    table that a later one has replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="run-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """Apply ``function`` to slices of each Arrow batch; it returns columns by name, or nothing.

    Slices of ``ROWS_AT_ONCE`` rows keep the Python objects of long texts from piling up.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = function(batch.slice(at, ROWS_AT_ONCE))
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


class WordHasher:
    """64-bit hashes of the words between ASCII white space, A-Z lowered, in numpy.

    A word's hash is the sum of a random number per byte times a power of an odd base. Sums over
    all words come from one running sum, since odd powers can be divided out again.
    """

    PIECE = 1 << 20

    def __init__(self):
        rng = np.random.default_rng(20)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.byte[65:91] = self.byte[97:123]
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self.space = space
        base = 0x9E3779B97F4A7C15
        self.power, self.back = np.ones(0, np.uint64), np.ones(0, np.uint64)
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), 1 << 14)
            ones = np.ones(n, np.uint64)
            self.power = np.cumprod(np.concatenate([ones[:1], np.full(n - 1, self.base)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([ones[:1], np.full(n - 1, self.inverse)]), dtype=np.uint64)
        return self.power, self.back

    def piece(self, b: np.ndarray) -> np.ndarray:
        power, back = self.tables(len(b))
        gap = np.ones(len(b) + 2, bool)
        gap[1:-1] = self.space[b]
        start = np.flatnonzero(gap[:-2] & ~gap[1:-1])
        end = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.byte[b] * power[:len(b)], out=run[1:])
        h = (run[end] - run[start]) * back[start]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def __call__(self, text: str | None) -> np.ndarray:
        """Hashes in the order of the words; empty for null and for texts without words."""
        if not text:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) <= self.PIECE:
            return self.piece(data)
        out, at = [], 0
        while at < len(data):  # a long text in pieces that end at white space
            stop = min(at + self.PIECE, len(data))
            if stop < len(data):
                cut = np.flatnonzero(self.space[data[at:stop]])
                if len(cut):
                    stop = at + int(cut[-1]) + 1
                else:  # one word longer than a piece
                    ahead = np.flatnonzero(self.space[data[stop:]])
                    stop = stop + int(ahead[0]) + 1 if len(ahead) else len(data)
            out.append(self.piece(data[at:stop]))
            at = stop
        return np.concatenate(out)


word_hashes = WordHasher()
