"""Stream controls from message headers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechframes.functions.text import strip

# fixed values: names and limits that senders and workers share
OUTPUTS = ("realtime", "refined", "final")
DEFAULT_TRACKS = ("whisperx",)
WINDOW_LIMITS = (10.0, 600.0)
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def header_value(headers: Column, name: str) -> Column:
    """The first value under the name, whatever its case; null if absent, '' if empty. Bytes that are no UTF-8 are left out."""
    first = F.try_element_at(F.filter(headers, lambda h: F.lower(h["key"]) == name.lower()), F.lit(1))
    mark = F.lit("\U0010ffff")  # no character; stands for a replacement character that was sent as such
    sent = F.replace(F.coalesce(first["value"].cast("string"), F.lit("")), F.lit("\ufffd"), mark)
    text = F.replace(F.replace(F.make_valid_utf8(sent), F.lit("\ufffd"), F.lit("")), mark, F.lit("\ufffd"))
    return F.when(first.isNotNull(), strip(text))


def csv_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda t: strip(t)), lambda t: t != "")


def lenient_bool(text: Column, default: bool) -> Column:
    known = F.lower(strip(text))
    return F.when(known.isin("1", "true", "yes", "y", "on"), True).when(known.isin("0", "false", "no", "n", "off"), False).otherwise(default)


def wanted_outputs(text: Column) -> Column:
    """Outputs asked for: all if the header is absent, none if it is empty; unknown names are ignored."""
    asked = F.array_intersect(F.transform(csv_tokens(text), F.lower), F.array(*map(F.lit, OUTPUTS)))
    return F.when(text.isNull(), F.array(*map(F.lit, OUTPUTS))).otherwise(asked)


def tracks(text: Column, default: tuple[str, ...] = DEFAULT_TRACKS) -> Column:
    """Tracks in the order given, case kept; the default if the header is absent, none if it is empty."""
    return F.when(text.isNull(), F.array(*map(F.lit, default))).otherwise(csv_tokens(text))


def stream_controls(outputs: Column, store: Column, final_tracks: Column, refinement_tracks: Column | None = None) -> Column:
    asked = wanted_outputs(outputs)
    flags = [F.array_contains(asked, o).alias(f"want_{o}") for o in OUTPUTS]
    refined = tracks(refinement_tracks if refinement_tracks is not None else F.lit(None).cast("string"))
    return F.struct(*flags, lenient_bool(store, True).alias("store_recording"), tracks(final_tracks).alias("final_tracks"), refined.alias("refinement_tracks"))


def clamped_window(text: Column, default: float, least: float = WINDOW_LIMITS[0], most: float = WINDOW_LIMITS[1]) -> Column:
    """Seconds within the limits; the default if absent, not a number, or infinite."""
    number = F.when(strip(text).rlike(NUMBER), strip(text))  # a cast alone would take 10d
    value = number.try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(usable, F.least(F.greatest(value, F.lit(least)), F.lit(most))).otherwise(F.lit(default))


def effective_realtime(window: Column, overlap: Column, emit: Column, base: tuple[float, float, float]) -> Column:
    """Override sanitising: window over 0.1, overlap in [0, window), emit over 0 and at most the window; else the base value."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    w = F.when(fine(window) & (window > 0.1), window).otherwise(F.lit(base[0]))
    o = F.when(fine(overlap) & (overlap >= 0) & (overlap < w), overlap).otherwise(F.lit(base[1]))
    e = F.when(fine(emit) & (emit > 0), F.least(emit, w)).otherwise(F.lit(base[2]))
    return F.struct(w.alias("window_s"), o.alias("overlap_s"), e.alias("emit_s"))


def routed(controls: Column, output: str, track: str | None = None) -> Column:
    """Whether a row goes to an output and track."""
    wanted = controls[f"want_{output}"]
    if track is None:
        return wanted
    return wanted & F.array_contains(controls["final_tracks" if output == "final" else "refinement_tracks"], track)


def unsafe_policy(controls: Column) -> Column:
    """Several final tracks without keeping the recording: the first to finish would delete it."""
    return (F.size(controls["final_tracks"]) > 1) & ~controls["store_recording"]


def upsert_header(headers: Column, name: str, value: Column) -> Column:
    """The header under this name replaced (whatever its case), at the end."""
    return F.concat(F.filter(headers, lambda h: F.lower(h["key"]) != name.lower()), F.array(F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))))
