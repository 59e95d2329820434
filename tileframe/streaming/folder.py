"""Converting images as they arrive in a folder: each micro-batch runs the batch conversion on its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import Options, convert, convert_tiles, native, sliced_images
from ..sources.png import decoded, pixels, whole

FILES = "path string, modificationTime timestamp, length long, content binary"


def convert_folder(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options, map_width: int, map_height: int) -> StreamingQuery:
    """Convert the PNG files that ``path`` has or gets; native forms are appended to the Parquet folder ``out``.

    An image needs nothing from other batches, so there is no state. A batch that is run
    again writes to its own folder anew, so no image comes twice.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.png").load(path)

    def batch(rows: DataFrame, number: int) -> None:
        images = rows.select("path", decoded("content").alias("image"))
        if options.no_remap:
            done = convert(pixels(images), options, whole(images))
        else:
            done = convert_tiles(sliced_images(whole(images), options), options)
        found = native(done, options, map_width, map_height)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
