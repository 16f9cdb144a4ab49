from terrace.functions.scalars import (
    blank_to_null,
    clock_text,
    date_key,
    mean,
    percent,
    tolerant,
    utc_wall_clock,
)

__all__ = ["blank_to_null", "clock_text", "date_key", "mean", "percent", "tolerant", "utc_wall_clock"]
