"""Column layout of the tables the operators take and return."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_int, _long, _double, _text, _flag = (
    T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(),
)

REGION = _schema(x=_long, y=_long, width=_long, height=_long)
IMAGES = _schema(image_id=_long, batch_id=_long, width=_int, height=_int)
PIXELS = _schema(batch_id=_long, image_id=_long, y=_int, x=_int, r=_int, g=_int, b=_int)
MASK_PIXELS = _schema(batch_id=_long, mask_idx=_long, y=_int, x=_int, m=_double)
MEDIA_FILES = _schema(name=_text, length=_long, mtime_ms=_long)
VIDEOS = _schema(video_id=_long, total_frames=_long, original_fps=_double, width=_int, height=_int)
VIDEO_PARAMS = _schema(
    video_id=_long, framerate=_int, custom_width=_int, custom_height=_int,
    frame_load_cap=_long, skip_first_frames=_long, select_every_nth=_long,
)
FRAMES = _schema(video_id=_long, frame_index=_long, readable=_flag)
POLYGONS = _schema(poly_id=_long, seq=_int, px=_double, py=_double)
MASK_EVENTS = _schema(
    event_id=_long, ts=T.TimestampNTZType(), node_id=_text, video=_text, op=_text, payload=_text,
)
