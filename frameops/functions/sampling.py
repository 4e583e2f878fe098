"""Frame-sampling arithmetic as column expressions."""

from pyspark.sql import Column, functions as F

# Preview size by default and at most, frame-size multiple, playback limits in ms.
PREVIEW_DEFAULT, PREVIEW_MAX = 48, 120
SIZE_MULTIPLE = 8
IDLE_MS, SHORTEST_MS = 100.0, 16.0


def _to_multiple(size: Column, multiple: int) -> Column:
    return (F.floor(size.cast("double") / multiple + F.lit(0.5)) * multiple).cast("int")


def target_size(width: Column, height: Column, custom_width: Column, custom_height: Column,
                multiple: int = SIZE_MULTIPLE) -> tuple[Column, Column]:
    """Output size of a video: one custom side keeps the aspect, both sides win, none keeps the source."""
    def scaled(side: Column, custom: Column, other: Column) -> Column:
        return (side.cast("double") * (custom.cast("double") / F.nullif(other.cast("double"), F.lit(0.0)))).cast("int")

    no_width, no_height = custom_width == 0, custom_height == 0
    wide = (
        F.when(no_width & no_height, width)
        .when(no_height, custom_width)
        .when(no_width, scaled(width, custom_height, height))
        .otherwise(custom_width)
    )
    high = (
        F.when(no_width & no_height, height)
        .when(no_height, scaled(height, custom_width, width))
        .when(no_width, custom_height)
        .otherwise(custom_height)
    )
    return _to_multiple(wide, multiple), _to_multiple(high, multiple)


def frame_step(original_fps: Column, framerate: Column) -> Column:
    """Source frames per wanted frame, rounded half to even, at least 1."""
    ratio = original_fps / F.nullif(framerate.cast("double"), F.lit(0.0))
    return F.when(
        (framerate != 0) & (original_fps > 0), F.greatest(F.lit(1).cast("bigint"), F.rint(ratio).cast("bigint"))
    ).otherwise(F.lit(1).cast("bigint"))


def at_least_one(value: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), value.cast("bigint"))


def effective_fps(original_fps: Column, framerate: Column, every_nth: Column) -> Column:
    base = F.when(framerate != 0, framerate.cast("double")).otherwise(
        original_fps.cast("bigint").cast("double")
    )
    return base / at_least_one(every_nth).cast("double")


def frame_duration_ms(fps: Column) -> Column:
    return F.when(fps > 0, F.lit(1000.0) / F.nullif(fps, F.lit(0.0))).otherwise(F.lit(IDLE_MS))


def playback_ms(fps: Column) -> Column:
    return F.greatest(frame_duration_ms(fps), F.lit(SHORTEST_MS))


def padded_length(count: Column) -> Column:
    """Smallest 1 + 4k that holds ``count`` frames."""
    count = count.cast("bigint")
    return F.when(count <= 1, F.lit(1).cast("bigint")).otherwise(
        F.lit(1) + F.ceil((count - 1).cast("double") / 4).cast("bigint") * 4
    )
