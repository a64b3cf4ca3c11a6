"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names. In local mode (tests) a temporary one is chosen where none is named; elsewhere
    that is an error, as a folder of one machine is lost with it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: survives lost executors, and is computed once."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as a compressed Parquet table in the shared checkpoint folder, for columns that are wide or many."""
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As ``checkpointed``, and the number of rows. They are not observed while they are written: a session with an Observation
    cannot be serialized, and models of Spark ML hold their session."""
    done = checkpointed(df)
    return done, done.count()


#: Rows of small columns that one task takes in a step that is repeated many times.
ROWS_A_TASK = 200_000


def compact(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """As ``checkpointed``, in as few partitions as the number of rows asks for: a step over a small table then writes few
    shuffle files, whatever the session's number of partitions."""
    done, rows = counted(df)
    return done.coalesce(rows // rows_a_task + 1)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def crc_mod(id_col: str, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller slices, so that a worker holds few long texts as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_built: dict[str, tuple[str, int, object]] = {}


def new_key() -> str:
    """A name for what workers build from one broadcast."""
    return uuid.uuid4().hex


def built_once(kind: str, key: str, make: Callable[[], object]) -> object:
    """In a worker: what ``make`` builds, kept until another ``key`` of the same kind is asked for, or anything by another stage. Workers outlive
    stages, so what an earlier one built would else lie beside all that later ones build."""
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    held = _built.pop(kind, None)
    gone = [k for k, (_, of, _) in _built.items() if of != stage]
    for k in gone:
        del _built[k]
    if held is not None and held[0] != key:
        held, gone = None, [kind]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _built[kind] = (key, stage, make() if held is None else held[2])
    return _built[kind][2]
