"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters A-Z only; every other character keeps its case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that end a word of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` become a
#: blank and A-Z become a-z: ``data.translate(WORD_BYTES).split()`` are the words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package: from the driver's path where all is
    one machine, else from an archive of it that every executor fetches."""
    root = Path(__file__).resolve().parents[2]
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) not in known:
        env["PYTHONPATH"] = os.pathsep.join([str(root), *filter(None, known)])
        if not local(spark):
            packed = Path(tempfile.mkdtemp(), "lexiflow.zip")
            with zipfile.ZipFile(packed, "w") as out:
                for f in sorted((root / "lexiflow").rglob("*.py")):
                    out.write(f, f.relative_to(root))
            spark.sparkContext.addPyFile(str(packed))


def local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master) is not None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where driver and executors are one process (tests, local mode) may it
    be unset: a folder on this machine is used then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.gettempdir(), "lexiflow-checkpoints").as_uri()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder by Hadoop's file system, which knows every store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


#: Tables written inside the ``temporary`` blocks that this thread has open, the innermost last.
_LOCAL = threading.local()


def _open() -> list[list[str]]:
    if not hasattr(_LOCAL, "blocks"):
        _LOCAL.blocks = []
    return _LOCAL.blocks


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not the stages before.
    The table is deleted with the innermost ``temporary`` block around this
    call, and otherwise when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    if _open():
        _open()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables written inside are deleted at its end, but for paths given to the
    function that it yields: the block around it owns those."""
    _open().append([])
    kept: list[str] = []
    try:
        yield lambda *paths: kept.extend(paths)
    finally:
        mine = _open().pop()
        for path in mine:
            if path not in kept:
                delete(spark, path)
        if _open():
            _open()[-1].extend(p for p in mine if p in kept)


_SCANS = re.compile(r"[\s:+|-]*(Project|Filter|Relation|SubqueryAlias|LogicalRelation|View)\b")


def stable(df: DataFrame) -> DataFrame:
    """``df`` with rows in the same order each time it is computed.

    That holds for a scan of files with columns chosen and rows filtered, so
    row numbers (monotonically_increasing_id) of two computations agree, also
    after a lost executor. Anything else, such as a shuffle whose order may
    follow the columns read, is written once and read back.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if df.inputFiles() and all(_SCANS.match(x) for x in plan.splitlines() if x.strip()):
        return df
    return written(df, "rows")[0]


def unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def words_at_blanks(data: bytes) -> list[bytes]:
    """A-Z lower-cased, then words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    return data.lower().split()


