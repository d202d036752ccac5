"""Session helpers."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "deltascope", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Plans here are built from thousands of column calls; call-site capture would dominate building them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the session names, else (one machine only) a new one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="deltascope-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def stored(frame: DataFrame) -> DataFrame:
    """The rows written once to the checkpoint folder, for results that are read several times."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def stored_columns(frame: DataFrame) -> DataFrame:
    """The rows written once to a new folder below the checkpoint folder, column by column.

    Takes a fraction of the disk of `stored` where columns hold few values, and only the columns that are used are
    read again. Partitions of the result are not those of the frame.
    """
    spark = frame.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/columns-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)
