"""Metadata of images: a map<string, string> column from item names to values, one for what was loaded and one for saving.

An item of a frame has the frame's number in its name. Physical sizes of pixels are kept in micrometres. All are expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.color import col

#: Names of the items for the physical size of a pixel.
SIZE_X, SIZE_Y = "PhysicalPixelSizeX", "PhysicalPixelSizeY"
#: By unit, the number that a size in micrometres divides for a resolution, or by which sizes are divided.
UNITS = {"dpi": 25400.0, "dpcm": 1e4, "dpm": 1e6}


def item_name(name: str, frame: int = 0) -> str:
    """Items of the first frame are named as they are, those of others `name/frame`."""
    return f"{name}/{frame}" if frame else name


def empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def set_item(items, name: str, value, frame: int = 0) -> Column:
    """The map with an item set or replaced; a null map counts as empty."""
    new, held = F.lit(item_name(name, frame)), F.coalesce(col(items), empty())
    rest = F.map_filter(held, lambda k, _: k != new)
    return F.map_concat(rest, F.create_map(new, (value if isinstance(value, Column) else F.lit(value)).cast("string")))


def has_item(items, name: str, frame: int = 0) -> Column:
    return F.coalesce(F.map_contains_key(col(items), item_name(name, frame)), F.lit(False))


def item(items, name: str, frame: int = 0) -> Column:
    """The value as text, null if there is none."""
    return F.try_element_at(col(items), F.lit(item_name(name, frame)))


def for_saving(loaded, saving) -> Column:
    """Items for saving with all loaded ones, which win."""
    own, kept = F.coalesce(col(loaded), empty()), F.coalesce(col(saving), empty())
    return F.map_concat(F.map_filter(kept, lambda k, _: ~F.map_contains_key(own, k)), own)


def in_unit(size, unit: str) -> Column:
    """Micrometres a pixel as a resolution, and back by the same; `um` leaves them as they are."""
    return col(size) if unit == "um" else F.lit(UNITS[unit]) / col(size)


def set_pixel_size(items, x, y, unit: str = "um", frame: int = 0) -> Column:
    return set_item(set_item(items, SIZE_X, in_unit(x, unit), frame), SIZE_Y, in_unit(y, unit), frame)


def pixel_size(items, unit: str = "um", frame: int = 0) -> tuple[Column, Column]:
    """(across, down) in the unit; a missing one is that of the other side; both null without any."""
    x, y = (F.nullif(item(items, n, frame).try_cast("double"), F.lit(0.0)) for n in (SIZE_X, SIZE_Y))
    return in_unit(F.coalesce(x, y), unit), in_unit(F.coalesce(y, x), unit)
