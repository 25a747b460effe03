"""Session helpers: builder for local runs, shared scratch folder, reliable checkpoints."""
import tempfile
import threading
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="8", app="fleetsieve", memory="16g"):
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fleetsieve-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the written files survive lost executors and end the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written between stages."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_setting, _held = threading.Lock(), {}


@contextmanager
def released(spark: SparkSession):
    """Plans that are begun and end inside leave no shuffle files, which else stay beside those of later plans until the
    driver's collector finds them. Spark below 4.1 keeps them. The setting is the session's: threads share it."""
    key = id(spark)
    with _setting:
        count, before = _held.get(key, (0, spark.conf.get(CLEAN, "false")))
        _held[key] = count + 1, before
        spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        with _setting:
            count, before = _held.pop(key)
            if count > 1:
                _held[key] = count - 1, before
            else:
                spark.conf.set(CLEAN, before)


def written(df: DataFrame, name: str = "table", release: bool = False) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: evaluated once, it survives lost executors, and
    joins know its real size, so only what is below Spark's limit is broadcast. With ``release``, for tables of
    many rows, the shuffle files of its plan go once it is written."""
    folder = scratch(df.sparkSession, name)
    with released(df.sparkSession) if release else nullcontext():
        df.select("*").write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
