"""Image, frame and mask tables that Spark derives from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from frameops.operators.lattice import lattice
from frameops.session import wide

SUFFIX = """CASE {id} % 8 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.webm' WHEN 3 THEN '.gif'
 WHEN 4 THEN '.mkv' WHEN 5 THEN '.txt' WHEN 6 THEN '' ELSE '.tar.MP4' END"""


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; its schema is looked up once, since every look costs a job."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def color_strings(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_id",
        """CASE p_partkey % 10 WHEN 0 THEN printf('#%06X', (p_partkey*7919) % 16777216)
           WHEN 1 THEN printf('%06x', (p_partkey*104729) % 16777216)
           WHEN 2 THEN CAST(1000000+(p_partkey*7919) % 15000000 AS STRING) WHEN 3 THEN CAST((p_partkey*31) % 1000000 AS STRING)
           WHEN 4 THEN CAST(16777216+p_partkey AS STRING) WHEN 5 THEN p_brand WHEN 6 THEN '  #FfF ' WHEN 7 THEN ''
           WHEN 8 THEN CAST(-1-p_partkey AS STRING) END AS color_text""",
        "(p_partkey*7919) % 20000000 - 1000000 AS color_int",
    )


def images(spark, sf_dir):
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS image_id", "CAST(s_nationkey AS BIGINT) AS batch_id", "24 AS width", "20 AS height"
    )


def pixels(spark, sf_dir):
    return lattice(images(spark, sf_dir), "width", "height").selectExpr(
        "batch_id", "image_id", "y", "x",
        "CAST((image_id*37 + x*11 + y*5) % 256 AS INT) AS r",
        "CAST((image_id*53 + x*3 + y*y) % 256 AS INT) AS g",
        "CAST((image_id*71 + x*y) % 256 AS INT) AS b",
    )


def packed_images(spark, sf_dir):
    """The same images as byte strings: lines from the top, blue, green, red."""
    pixel = "lpad(hex({}), 2, '0')".format
    code = ", ".join(pixel(c) for c in (
        "(image_id*71 + (i % 24)*(i div 24)) % 256",
        "(image_id*53 + (i % 24)*3 + (i div 24)*(i div 24)) % 256",
        "(image_id*37 + (i % 24)*11 + (i div 24)*5) % 256",
    ))
    # dealt out first: spelling out an image takes a thousand times as long as reading its row
    return images(spark, sf_dir).repartition(wide(spark), "image_id").selectExpr(
        "batch_id", "image_id", "height", "width", "3 AS nChannels",
        f"unhex(array_join(transform(sequence(0, width*height - 1), i -> concat({code})), '')) AS data",
    )


def mask_pixels(spark, sf_dir):
    """One mask per image of a batch; some batches have only empty masks, some none at all."""
    masks = images(spark, sf_dir).filter("batch_id % 7 <> 1").withColumnRenamed("image_id", "mask_idx")
    return lattice(masks, "width", "height").withColumn(
        "v", F.expr("(batch_id*31 + mask_idx*17 + x*7 + y*13) % 101")
    ).selectExpr(
        "batch_id", "mask_idx", "y", "x",
        """CASE WHEN batch_id % 7 = 0 OR x < 3 + batch_id % 5 OR x > 15 OR y < 2 OR y > 12 THEN CAST(0 AS DOUBLE)
           WHEN v >= 95 THEN CAST(v AS DOUBLE) / 100 ELSE CAST(v % 51 AS DOUBLE) / 100 END AS m""",
    )


def resize_targets(spark, sf_dir):
    return images(spark, sf_dir).selectExpr(
        "image_id", "CASE image_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 24 END AS target_width",
        "CASE image_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 16 WHEN 2 THEN 24 ELSE 8 END AS target_height",
    )


def media_files_of(customers: DataFrame) -> DataFrame:
    return customers.filter("c_custkey % 9 <> 0").selectExpr(
        "c_custkey AS file_id",
        f"concat('clip_', CAST(c_custkey AS STRING), {SUFFIX.format(id='c_custkey')}) AS name",
        "(1700000000 + c_custkey*60)*1000 + (c_custkey*50) % 1000 AS mtime_ms",
    )


def media_files(spark, sf_dir):
    return media_files_of(read(spark, sf_dir, "customer"))


def media_requests(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id", "concat('clip_', CAST(c_custkey AS STRING), '.mp4') AS name"
    )


def _position(events: DataFrame) -> DataFrame:
    """Rank of each event among its user's, counted per hour first so that no user is one sorted group."""
    hourly = events.withColumn("hour", F.unix_date(F.to_date("ts")) * 24 + F.hour("ts"))
    line = Window.partitionBy("user_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    before = hourly.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", "hour", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id")
    ranked = hourly.withColumn("rank", F.row_number().over(within))
    return ranked.join(before, ["user_id", "hour"]).withColumn(
        "frame_index", (F.col("before") + F.col("rank") - 1).cast("bigint")
    )


def frames(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return _position(events).selectExpr(
        "user_id AS video_id", "frame_index", "event_id % 211 <> 0 AS readable",
        "concat(CAST(user_id AS STRING), '_', CAST(event_id AS STRING)) AS payload_text",
        "64 + CAST(event_id % 5 AS INT) AS probe_width", "48 + CAST(event_id % 3 AS INT) AS probe_height",
    )


def videos(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total_frames")).selectExpr(
        "user_id AS video_id", "total_frames",
        """CASE WHEN user_id % 11 = 0 THEN CAST(0 AS DOUBLE) WHEN user_id % 5 = 0 THEN CAST(24 AS DOUBLE)
           WHEN user_id % 5 = 1 THEN CAST(25 AS DOUBLE) WHEN user_id % 5 = 2 THEN CAST(2997 AS DOUBLE)/100
           WHEN user_id % 5 = 3 THEN CAST(30 AS DOUBLE) ELSE CAST(60 AS DOUBLE) END AS original_fps""",
        "CAST(CASE WHEN user_id % 13 = 0 THEN 0 ELSE 320 + (user_id % 7)*160 END AS INT) AS width",
        "CAST(CASE WHEN user_id % 13 = 0 THEN 0 ELSE 180 + (user_id % 5)*90 END AS INT) AS height",
    )


def sized_pixels(spark, sf_dir):
    """Pixels that carry the size of their image, as a decoder gives them."""
    return pixels(spark, sf_dir).selectExpr("*", "24 AS width", "20 AS height")


def video_params(spark, sf_dir):
    """Load parameters of most videos; the others are loaded with defaults."""
    return read(spark, sf_dir, "events").filter("user_id % 17 <> 3").select("user_id").distinct().selectExpr(
        "user_id AS video_id", "CAST(CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 24 ELSE 10 END AS INT) AS framerate",
        "CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 250 END AS INT) AS custom_width",
        "CAST(CASE WHEN user_id % 2 = 0 THEN 0 ELSE 131 END AS INT) AS custom_height",
        "(user_id % 4)*5 AS frame_load_cap", "user_id % 7 AS skip_first_frames", "1 + user_id % 3 AS select_every_nth",
        """CASE user_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '-4' WHEN 2 THEN '500' WHEN 3 THEN CAST(NULL AS STRING)
           ELSE '32' END AS max_preview_text""",
    )


def raw_params(spark, sf_dir):
    """Load parameters as a request carries them: texts, some of them unusable."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        "CASE event_id % 5 WHEN 0 THEN ' 24 ' WHEN 1 THEN '+12' WHEN 2 THEN '2.5' WHEN 3 THEN '-3' ELSE CAST(NULL AS STRING) END AS framerate",
        "CAST(event_id % 4000 - 100 AS STRING) AS custom_width",
        "CASE event_id % 3 WHEN 0 THEN '1_080' WHEN 1 THEN '_7' ELSE '0720' END AS custom_height",
        "CASE event_id % 4 WHEN 0 THEN '' ELSE CAST(event_id AS STRING) END AS frame_load_cap",
        "CAST(-event_id AS STRING) AS skip_first_frames",
        "CASE event_id % 2 WHEN 0 THEN '0' ELSE CAST(event_id % 9 AS STRING) END AS select_every_nth",
        "CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '-4' WHEN 2 THEN '500' WHEN 3 THEN CAST(NULL AS STRING) ELSE '32' END AS max_preview_frames",
    )


def frame_requests(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id", "user_id AS video_id", "event_id % 97 - 7 AS n"
    )


def playback_probes(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS probe_id", "user_id AS video_id", "CAST((event_id*37) % 100000 AS DOUBLE) AS at_ms"
    )


def polygons(spark, sf_dir):
    return read(spark, sf_dir, "supplier").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4)))).selectExpr(
        "s_suppkey AS poly_id", "seq * seq * (1 + s_suppkey % 3) AS seq",
        "CAST(CASE seq WHEN 0 THEN 12 WHEN 1 THEN 18 WHEN 2 THEN 2 WHEN 3 THEN 22 ELSE 6 END + s_suppkey % 3 AS DOUBLE) + 0.3125D AS px",
        "CAST(CASE seq WHEN 0 THEN 1 WHEN 1 THEN 17 WHEN 2 THEN 7 WHEN 3 THEN 6 ELSE 18 END AS DOUBLE) + 0.1875D AS py",
    )


def polygon_frames(spark, sf_dir):
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS poly_id", "24 AS width", "20 AS height")


def mask_events_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "ts", "CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 89 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS node_id",
        "CASE WHEN event_id % 6 = 0 THEN CAST(NULL AS STRING) ELSE concat('clip_', CAST(user_id % 40 AS STRING), '.mp4') END AS video",
        "CASE event_type WHEN 'error' THEN 'clear' WHEN 'click' THEN 'set' WHEN 'purchase' THEN 'set' ELSE 'param' END AS op",
        """CASE WHEN event_type NOT IN ('click','purchase') THEN CAST(NULL AS STRING) WHEN event_id % 19 = 0 THEN '{}'
           WHEN event_id % 19 = 1 THEN '{"x":5,"width":40}'
           ELSE concat('{"x":', CAST(event_id % 700 - 50 AS STRING), ',"y":', CAST(event_id % 400 - 20 AS STRING),
                       '.75,"width":', CAST(event_id % 300 AS STRING), ',"height":', CAST(event_id % 211 AS STRING), '}') END AS payload""",
    )


def mask_events(spark, sf_dir):
    return mask_events_of(read(spark, sf_dir, "events"))


def named_videos(spark, sf_dir):
    """Videos with the file they come from and the node that loads them."""
    return read(spark, sf_dir, "events").select("user_id").distinct().selectExpr(
        "user_id AS video_id", f"concat('clip_', CAST(user_id AS STRING), {SUFFIX.format(id='user_id')}) AS name",
        "CAST(user_id AS STRING) AS node_id",
    )


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The given table as a stream of its files."""
    schema = read(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
