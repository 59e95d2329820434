"""Tile images drawn from the events table: one event is one 8 by 8 tile, 1024 events are one image of 256 by 256 pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_TILES, COLUMNS, SIDE = 1024, 32, 8
GREY = 0xFF808080
GROUPS = ["click", "error", "purchase", "signup", "view"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    group = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("event_type")) - 1
    return events.select(
        F.expr(f"event_id div {IMAGE_TILES}").alias("image_id"),
        (F.col("event_id") % IMAGE_TILES).cast("int").alias("seq"),
        (F.col("user_id") % 5).cast("int").alias("k"),
        group.cast("int").alias("g"),
        (F.expr("user_id div 5") % 2).cast("int").alias("fh"),
        (F.second("ts") % 2).cast("int").alias("fv"),
    )


def _index(p: Column) -> Column:
    px, py = p % SIDE, F.shiftright(p, 3)
    sx, sy = F.when(F.col("fh") == 1, 7 - px).otherwise(px), F.when(F.col("fv") == 1, 7 - py).otherwise(py)
    return (sx * (F.col("k") + 3) + sy * sy * (F.col("k") + 1) + sx * sy) % 7


def _pixel(m: Column) -> Column:
    g = F.col("g")
    rgb = (g * 48 + m * 16) % 256 + 256 * ((g * 24 + m * 64) % 256) + 65536 * ((200 - g * 32 - m * 8) % 256)
    return F.when((m == 0) | (m > 3), F.lit(GREY)).otherwise(rgb.cast("long") + 0xFF000000)


def event_tiles(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(image_id, seq, tx, ty, rgba): tiles with their 64 colours, row by row, in ``parts`` partitions or as planning sees fit.

    Pixels follow from four small fields, so the hundred tiles that there can be are drawn once.
    """
    part = lambda by, of: (F.expr(f"id div {by}") % of).cast("int")
    drawn = spark.range(100).select(part(20, 5).alias("k"), part(4, 5).alias("g"), part(2, 2).alias("fh"), part(1, 2).alias("fv"))
    drawn = drawn.withColumn("rgba", F.transform(F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), _index), _pixel))
    # one file is one task; tiles are dealt out before the work on their pixels
    rows = _events(spark, sf_dir).repartition(*([parts] if parts else []), "image_id", "seq").join(F.broadcast(drawn), ["k", "g", "fh", "fv"])
    return rows.select("image_id", "seq", (F.col("seq") % COLUMNS).alias("tx"), F.expr(f"seq div {COLUMNS}").cast("int").alias("ty"), "rgba")


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, rgba): the same images as pixels.

    The number of partitions is given, as adaptive planning goes by the bytes of the narrow rows
    of events and puts so many in a task that sorting their pixels spills.
    """
    rows = event_tiles(spark, sf_dir, int(spark.conf.get("spark.sql.shuffle.partitions"))).select("image_id", "tx", "ty", F.posexplode("rgba").alias("p", "rgba"))
    return rows.select("image_id", (F.col("tx") * SIDE + F.col("p") % SIDE).alias("x"), (F.col("ty") * SIDE + F.expr(f"p div {SIDE}")).cast("int").alias("y"), "rgba")
