"""Scalar text functions as Spark columns; every one stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.constants import EMOTIONS, RETAINED_SPEAKERS

#: Characters that count as white space at the ends of a string.
_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
_PAIRS = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))


def stripped_of(text: Column, blank: str) -> Column:
    """Without characters of a class at both ends."""
    return F.regexp_replace(text, f"^{blank}+|{blank}+$", "")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return stripped_of(text, _BLANK)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{_BLANK}+", " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{_BLANK}+", "")


def words(text: Column) -> Column:
    """Blank-separated words."""
    return F.array_remove(F.split(text, f"{_BLANK}+", -1), "")


def word_tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def is_speakable(text: Column) -> Column:
    """Whether there is a letter or digit of any script."""
    return text.rlike(r"[\p{L}\p{N}]")


def is_voiced(speaker: Column) -> Column:
    """Whether the speaker's text is narrated at all."""
    return ~speaker.isin(*RETAINED_SPEAKERS)


def normalize_tts_text(text: Column) -> Column:
    """Without leading dashes and spaces; unchanged if nothing else is there."""
    left = F.regexp_replace(text, r"^[\s\-\x{2010}-\x{2015}\x{2212}]+", "")
    return F.when(left == "", text).otherwise(left)


def strip_wrapping_quotes(text: Column) -> Column:
    """The inside of a text in a matching pair of quotes; any other text unchanged."""
    s = stripped(text)
    inner = F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))
    paired = reduce(lambda a, b: a | b, (s.startswith(a) & s.endswith(b) for a, b in _PAIRS))
    return F.when((F.length(s) >= 2) & paired, stripped(inner)).otherwise(text)


def strip_boundary_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\"'“”‘’]+|[\s\"'“”‘’]+$", "")


def is_mixed_quote(text: Column) -> Column:
    """Whether a text holds quoted speech and words outside it."""
    quoted = r"\"[^\"]*\"|“[^”]*”"
    return text.rlike(quoted) & F.regexp_replace(text, quoted, "").rlike(r"[\p{L}\p{N}_]")


def truncate(text: Column, size: int = 80) -> Column:
    line = stripped(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size - 3), F.lit("..."))).otherwise(line)


def filename_base(index: Column, title: Column) -> Column:
    safe = F.replace(stripped(F.regexp_replace(title, r"[<>:\"/\\|?*\x00-\x1f]", "_")), F.lit(" "), F.lit("_"))
    return F.format_string("%02d_%s", index, F.substring(safe, 1, 50))


def book_slug(title: Column) -> Column:
    kept = F.lower(stripped(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")))
    slug = F.regexp_replace(kept, r"[\s_]+", "-")
    return F.when(slug == "", "untitled").otherwise(slug)


def safe_title(title: Column) -> Column:
    return F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")


def safe_label(label: Column) -> Column:
    return F.substring(F.regexp_replace(label, r"[^\p{L}\p{N}_-]", "_"), 1, 64)


def escape_metadata(text: Column) -> Column:
    """Escapes in a fixed order, so that the backslashes of the first three are escaped again by the fourth."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("\\" + c)), ("=", ";", "#", "\\", "\n"), text)


def escape_markup(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def normalize_name(name: Column) -> Column:
    """A speaker label as it is compared: no closing marks, single spaces, lower case."""
    return F.lower(collapsed(F.regexp_replace(stripped(name), r"[.,;:]+$", "")))


def without_thinking(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?s)<(think|reasoning)>.*?</\1>", ""))


def thinking(text: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<(think|reasoning)>(.*?)</\1>"), F.lit(2)), stripped), "\n")


def _clock_parts(seconds: Column) -> tuple[Column, Column, Column, Column]:
    # half-even rounding to whole milliseconds
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000


def format_ts(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", *_clock_parts(seconds))


def clock(seconds: Column) -> Column:
    """H:MM:SS.mmm."""
    return F.format_string("%d:%02d:%02d.%03d", *_clock_parts(seconds))


def parse_time(text: Column) -> Column:
    """Seconds of `SS(.f)` or `M:SS(.f)`; null for anything else."""
    form = r"^(?:(\d+):)?(\d+(?:\.\d+)?)$"
    minutes = F.regexp_extract(text, form, 1)
    seconds = F.regexp_extract(text, form, 2).try_cast("double")
    return F.when(text.rlike(form), F.coalesce(F.nullif(minutes, F.lit("")).cast("double"), F.lit(0.0)) * 60 + seconds)


def resolve_emotion(instruction: Column) -> Column:
    """The style an instruction names: itself, else the first that contains it or is contained in it, else neutral."""
    low = F.lower(stripped(F.coalesce(instruction, F.lit(""))))
    named = F.when(low.isin(*EMOTIONS), low).otherwise(F.try_element_at(F.filter(F.array(*map(F.lit, EMOTIONS)), lambda e: F.contains(low, e) | F.contains(e, low)), F.lit(1)))
    return F.when(low == "", "neutral").otherwise(F.coalesce(named, F.lit("neutral")))


def valid_instruction(instruction: Column) -> Column:
    """The instruction if it is empty or a known style, else neutral."""
    return F.when((instruction != "") & ~instruction.isin(*EMOTIONS), "neutral").otherwise(instruction)


def chapter_range(spec: Column) -> Column:
    """"1-5,7" as an array, duplicates and order kept; a reversed range is empty."""

    def part(p: Column) -> Column:
        ends = F.split(p, "-", 2)
        low, high = F.trim(ends[0]).try_cast("int"), F.trim(F.get(ends, F.lit(1))).try_cast("int")
        span = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.when(p.contains("-"), span).otherwise(F.array(F.trim(p).try_cast("int")))

    return F.flatten(F.transform(F.split(spec, ","), part))


def shortest_label(name: Column, aliases: Column) -> Column:
    """The shortest of a name and its aliases of two characters or more; the earlier of equals."""
    labels = F.filter(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: F.length(x) >= 2)
    ranked = F.sort_array(F.transform(labels, lambda x, i: F.named_struct(F.lit("n"), F.length(x), F.lit("i"), i, F.lit("label"), x)))
    return F.coalesce(F.try_element_at(ranked, F.lit(1))["label"], name)


def focused_context(source: Column, needle: Column, before: int, after: int) -> Column:
    """A source around the first occurrence of a needle (white space at its ends aside): from `before` lines above to behind the `after`-th line end below.

    A needle that does not occur literally is looked for with all white space as one space; its place is counted in the source
    so written, which is near enough for a window of lines. Empty where source or needle is null or empty, or neither occurs.
    """
    wanted = stripped(needle)
    exact = F.instr(source, wanted)
    loose = F.instr(F.regexp_replace(source, r"\s+", " "), F.regexp_replace(wanted, r"\s+", " "))
    at = F.when(exact > 0, exact).otherwise(loose)
    above = F.split(F.substring(source, F.lit(1), at - 1), "\n", -1)
    head = F.array_join(F.slice(above, F.greatest(F.size(above) - before, F.lit(1)), F.lit(before + 1)), "\n")
    # a text that begins with a line end keeps it where the window reaches that far
    head = F.when((F.size(above) == before + 2) & (F.get(above, F.lit(0)) == ""), F.concat(F.lit("\n"), head)).otherwise(head)
    said = F.substring(source, at, F.length(wanted))
    below = F.split(F.substring(source, at + F.length(wanted), F.length(source)), "\n", -1)
    tail = F.when(F.size(below) <= after, F.array_join(below, "\n")).otherwise(F.concat(F.array_join(F.slice(below, 1, after), "\n"), F.lit("\n" if after else "")))
    known = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(needle, F.lit("")) != "")
    return F.when(known & (at > 0), F.concat(head, said, tail)).otherwise("")
