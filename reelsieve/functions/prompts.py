"""Prompts for a model as Column expressions: frames in order of time, by scene, sounds, text found, lists to choose from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(x: Column) -> Column:
    return F.format_string("%.1fs", x.cast("double"))


def frame_lines(frames: Column, deltas: bool = True) -> Column:
    """A line a frame of an array of (ts, label) in order: its number, time, the time since the one before, and its label."""

    def line(f: Column, i: Column) -> Column:
        since = F.when(i > 0, F.concat(F.lit(" (Δ"), seconds(f["ts"] - F.get(frames, i - 1)["ts"]), F.lit(")"))).otherwise("")
        label = F.coalesce(F.concat(F.lit(" ["), f["label"], F.lit("]")), F.lit(""))
        return F.concat(F.lit("Frame "), (i + 1).cast("string"), F.lit(" @ "), seconds(f["ts"]), since if deltas else F.lit(""), label)

    return F.array_join(F.transform(frames, line), "\n")


def scene_block(number: Column, start: Column, end: Column, frames: Column) -> Column:
    """A scene's heading and a line for each of its frames (ts, label)."""
    head = F.concat(F.lit("--- SCENE "), number.cast("string"), F.lit(" ("), seconds(start), F.lit(" - "), seconds(end), F.lit(") ---"))
    label = lambda f: F.coalesce(F.concat(F.lit(" ["), f["label"], F.lit("]")), F.lit(""))
    lines = F.transform(frames, lambda f: F.concat(F.lit("  Frame @ "), seconds(f["ts"]), label(f)))
    return F.array_join(F.concat(F.array(head), lines), "\n")


def audio_lines(segments: Column, mood: Column, phrases: Column, most: int = 10) -> Column:
    """The first spoken segments (start, end, text), the mood, and the key phrases (text, ts), each if there are any."""
    said = F.transform(F.slice(segments, 1, most), lambda s: F.concat(F.lit("- ["), seconds(s["start"]), F.lit("-"), seconds(s["end"]), F.lit(']: "'), s["text"], F.lit('"')))
    keys = F.transform(phrases, lambda p: F.concat(F.lit('- "'), p["text"], F.lit('" at '), seconds(p["ts"])))
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")))
    return F.concat_ws("\n", part("Spoken:", said), F.concat(F.lit("Mood: "), mood), part("Key phrases:", keys))


def numbered(words: Sequence[str], head: str) -> str:
    """A list to choose from by number."""
    return "\n".join([head, *[f"{i}. {w}" for i, w in enumerate(words, 1)]])


def text_found(results: Column) -> Column:
    """What was found of text, for frames (ts, has_text, regions, coverage) that have any; empty without one."""
    having = F.filter(results, lambda r: r["has_text"])
    line = lambda r: F.concat(F.lit("  Frame @ "), seconds(r["ts"]), F.lit(": "), r["regions"].cast("string"), F.lit(" text regions, "), F.format_string("%.1f%%", (r["coverage"] * 100).cast("double")), F.lit(" coverage\n"))
    return F.when(F.size(having) > 0, F.concat(F.lit("TEXT DETECTION (OCR Pre-Processing):\n"), F.array_join(F.transform(having, line), ""))).otherwise("")


def prompt(duration: Column, count: Column, *parts: Column | str) -> Column:
    """A whole prompt: what is shown, then the parts, empty ones left out, then the demand for JSON only."""
    head = F.concat(F.lit("A video of "), F.format_string("%.1f", duration.cast("double")), F.lit(" seconds in "), count.cast("string"), F.lit(" frames in order of time."))
    body = [F.nullif(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts]
    return F.concat_ws("\n\n", head, *body, F.lit("Answer with valid JSON only."))
