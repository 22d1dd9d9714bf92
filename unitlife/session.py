"""Session settings for local runs, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "unitlife", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder in the warehouse, which a cluster
    shares as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages").rstrip("/")


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote, wherever Spark keeps it."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def publish_folder(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a finished folder; False (and nothing changed) if ``to`` is taken."""
    files, folder = _folder(spark, path)
    target = _folder(spark, to)[1]
    if files.exists(target):
        return False
    done = files.rename(folder, target)
    inside = _folder(spark, f"{to}/{folder.getName()}")[1]
    if done and files.exists(inside):  # another one came first, and the rename went into it
        files.delete(inside, True)
        return False
    return done


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPENING = "spark.sql.files.openCostInBytes"
OPEN_COST = 1 << 18


def group_listings(spark: SparkSession) -> None:
    """From now on the session lists folders by four tasks a core at most, many folders each. By default every folder is a
    task of its own, up to 10,000, which takes longer than the listing where each holds one file. A stream lists by its session's
    setting while it runs, so the setting stays.

    Opening a file counts as reading ``OPEN_COST`` bytes, so that a task reads hundreds of small files. By Spark's default of 4 MB it
    reads 32, and costs about as much as these. A cost that the session was given is kept."""
    if spark.conf.get(OPENING, None) is None:
        spark.conf.set(OPENING, str(OPEN_COST))
    most = 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LISTING)) > most:
        spark.conf.set(LISTING, str(most))


def use_checkpoints(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
