"""Parsers and formats for logs, reports and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = r"-turn-(\d+)$"


def model_name(entry: Column) -> Column:
    return F.regexp_replace(entry, TURN, "")


def turn_number(entry: Column) -> Column:
    """The turn at the end of an entry's name, or null."""
    found = F.regexp_extract(entry, TURN, 1)
    return F.when(found == "", None).otherwise(found).cast("int")


def turn_label(entry: Column) -> Column:
    turn = turn_number(entry)
    return F.when(turn.isNull(), entry).otherwise(F.format_string("%s (Turn %d)", model_name(entry), turn))


def run_number(path: Column) -> Column:
    """The number in the name of a run's file, or null."""
    found = F.regexp_extract(path, r"_(\d+)\.[^./]*$", 1)
    return F.when(found == "", None).otherwise(found).cast("int")


def run_file(number: Column) -> Column:
    return F.format_string("benchmark_%03d.json", number)


def sanitised(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("-"))


def without_trailing_slash(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def truncated(text: Column, limit: int = 102_400, notice: str = "\n... [truncated]") -> Column:
    """At most ``limit`` bytes on a character boundary, with a notice where something was cut."""
    cut = F.substring(F.encode(text, "utf-8"), 1, limit)
    # A character that the limit splits leaves one to three bytes; the longest valid prefix drops them.
    prefix = F.coalesce(*[F.when(F.is_valid_utf8(part), part.cast("string")) for part in (F.substring(cut, 1, limit - k) for k in range(4))])
    return F.when(F.octet_length(text) > limit, F.concat(prefix, F.lit(notice))).otherwise(text)


def pretty_json(raw: Column) -> Column:
    """Parsed and written again, each member on a line of its own, two blanks a level; the text as it came when it isn't JSON."""
    compact = F.to_json(F.try_parse_json(raw))
    # strings, brackets, commas, colons and other values; a string is one part whatever is in it
    parts = F.regexp_extract_all(compact, F.lit(r'("(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^\[\]{}:,"]+)'), 1)
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def add(state: Column, part: Column) -> Column:
        opens, closes = part.isin("{", "["), part.isin("}", "]")
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        # an empty object or array stays on its line
        lead = F.when(closes & state["open"], F.lit("")).when(closes, line(depth)).when(state["open"], line(state["depth"])).otherwise(F.lit(""))
        tail = F.when(part == ":", F.lit(" ")).when(part == ",", line(depth)).otherwise(F.lit(""))
        return F.struct(F.concat(state["text"], lead, part, tail).alias("text"), depth.cast("int").alias("depth"), opens.alias("open"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit(False).alias("open"))
    return F.coalesce(F.when(compact.isNotNull(), F.aggregate(parts, start, add)["text"]), raw)


def utc_now() -> Column:
    """The time of the query in UTC, as RFC 3339 has it. Differs from run to run."""
    return rfc3339(F.current_timestamp())


def rfc3339(at: Column) -> Column:
    """A time in UTC with microseconds and offset."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def profile_percentage(line: Column) -> Column:
    found = F.regexp_extract(line, r"^\s*([0-9]+(?:\.[0-9]+)?)%", 1)
    return F.when(found == "", None).otherwise(found).cast("double")


def profile_function(line: Column) -> Column:
    """The symbol after ``[.] ``, or else after ``[k] ``."""
    user, kernel = F.regexp_extract(line, r"\[\.\] (.*)$", 1), F.regexp_extract(line, r"\[k\] (.*)$", 1)
    return F.trim(F.when(F.contains(line, F.lit("[.] ")), user).otherwise(kernel))


def file_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def seconds_between(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(begin)) / F.lit(1_000_000.0)
