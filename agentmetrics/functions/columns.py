"""Column expressions: opaque references, instants, path rules, small maths.

Everything here is built from Spark functions, so it stays inside generated
code; none of it runs Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return any_of([value.startswith(p) for p in prefixes])


def strip(value: Column) -> Column:
    """Trim all white space, as opposed to spaces only."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


# -- references ---------------------------------------------------------------

def salted(salt: str, value: Column, prefix: str, digits: int) -> Column:
    digest = F.sha2(F.concat(F.lit(salt + "|"), value), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, digits))


def project_ref(salt: str, path: Column) -> Column:
    return salted(salt, path, "p_", 16)


def repo_ref(salt: str, root: Column) -> Column:
    return salted(salt, root, "r_", 16)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def top_dir(path: Column) -> Column:
    """First directory of a path; ``<root>`` where there is none."""
    relative = F.ltrim(forward_slashes(path), F.lit("/"))
    return F.when(F.contains(relative, F.lit("/")),
                  F.split_part(relative, F.lit("/"), F.lit(1))).otherwise(F.lit("<root>"))


def file_ref(salt: str, path: Column) -> Column:
    return salted(salt, forward_slashes(path), "f_", 12)


def top_dir_ref(salt: str, path: Column) -> Column:
    return salted(salt, F.concat(F.lit("dir:"), top_dir(path)), "f_", 12)


# -- instants -------------------------------------------------------------------

def instant(text: Column) -> Column:
    """ISO text, or a number of epoch seconds or milliseconds (above 1e11), to a UTC
    instant in whole milliseconds; bad text is null. Numbers are cut at milliseconds
    after they are rounded to microseconds, so that 1.001 seconds stay 1.001."""
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text).try_cast("timestamp")
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text).try_cast("double")
    micros = F.round(F.when(number > 1e11, number / 1000).otherwise(number) * 1e6).try_cast("long")
    return F.date_trunc("millisecond", F.coalesce(dated, F.timestamp_micros(micros)))


def epoch_instant(number: Column) -> Column:
    """Epoch seconds or milliseconds (above 1e11) to an instant."""
    number = number.cast("double")
    millis = F.when(number > 1e11, number).otherwise(number * 1000)
    return F.timestamp_millis(F.floor(millis).cast("long"))


def iso_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def ms_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, never negative, null if either is.

    The seconds pass through a double and are cut, not rounded, so that a
    difference such as 1.001 s gives the same 1000 the logs' own tools give.
    """
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    whole = (seconds * 1000).cast("long")
    return F.when(whole < 0, F.lit(0).cast("long")).otherwise(whole)


# -- languages and paths ------------------------------------------------------------

def language_of_extension(extension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in fixed.EXTENSION_LANGUAGE.items() for x in kv])
    bare = blank_to_null(F.lower(F.ltrim(extension, F.lit("."))))
    return F.coalesce(F.try_element_at(known, bare), bare)


def language_of_path(path: Column) -> Column:
    """Language by the file suffix alone; null without a suffix."""
    return language_of_extension(
        blank_to_null(F.regexp_extract(path, r"[^/]\.([^./]+)/*$", 1)))


def path_extension(path: Column) -> Column:
    name = _file_name(path)
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"([^.]*)$", 1))


def _lower_path(path: Column) -> Column:
    return F.lower(forward_slashes(path))


def _file_name(path: Column) -> Column:
    return F.regexp_extract(_lower_path(path), r"([^/]*)$", 1)


def is_test_path(path: Column) -> Column:
    name = _file_name(path)
    return (_lower_path(path).rlike(fixed.TEST_DIR_PATTERN)
            | name.rlike(fixed.TEST_NAME_PATTERN)
            | name.endswith(fixed.TEST_NAME_SUFFIX))


def is_docs_path(path: Column) -> Column:
    return (F.coalesce(path_extension(path).isin(fixed.DOCS_EXTENSIONS), F.lit(False))
            | _lower_path(path).rlike(fixed.DOCS_DIR_PATTERN))


def is_agent_config_path(path: Column) -> Column:
    lowered = _lower_path(path)
    inside = any_of([F.contains(lowered, F.lit(m)) for m in fixed.AGENT_PATH_MARKERS])
    return inside | _file_name(path).isin(fixed.AGENT_NAMES)


def is_config_path(path: Column) -> Column:
    shaped = (F.coalesce(path_extension(path).isin(fixed.CONFIG_EXTENSIONS), F.lit(False))
              | _file_name(path).isin(fixed.CONFIG_NAMES)
              | _lower_path(path).rlike(fixed.CONFIG_DIR_PATTERN))
    return ~is_docs_path(path) & ~is_agent_config_path(path) & shaped


def path_flag_columns(path: Column) -> list[Column]:
    return [is_test_path(path).alias("is_test_path"),
            is_docs_path(path).alias("is_docs_path"),
            is_config_path(path).alias("is_config_path"),
            is_agent_config_path(path).alias("is_agent_config_path")]


def display_name(cwd: Column, in_repo: Column, eval_marker: str) -> Column:
    """Short project name: eval runs and loose folders share one name each."""
    trimmed = F.rtrim(cwd, F.lit("/"))
    last = blank_to_null(F.regexp_extract(trimmed, r"([^/]*)$", 1))
    return (F.when(F.contains(cwd, F.lit(eval_marker)), F.lit("eval-harness runs"))
            .when(~in_repo, F.lit("scratch / no repo"))
            .otherwise(F.coalesce(last, cwd)))


# -- tools ------------------------------------------------------------------------------

def tool_family(name: Column) -> Column:
    browser = any_of([F.contains(F.lower(name), F.lit(m)) | name.startswith(m)
                      for m in fixed.BROWSER_MARKERS])
    return (F.when(browser, F.lit("browser"))
            .when(name.isin(fixed.WEB_TOOLS), F.lit("web"))
            .when(name.isin(fixed.READ_TOOLS), F.lit("read"))
            .when(name.isin(fixed.EDIT_TOOLS), F.lit("edit"))
            .when(name.isin(fixed.SHELL_TOOLS), F.lit("shell"))
            .otherwise(F.lit("other")))


# -- maths --------------------------------------------------------------------------------

def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double; null when the bottom is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of a reported figure."""
    return F.bround(value, digits)


def wilson(successes: Column, n: Column, upper: bool, z: float = 1.959963984540054) -> Column:
    """One bound of the Wilson score interval."""
    p = ratio(successes, n)
    z2 = z * z
    centre = p + z2 / 2 / n
    spread = F.sqrt(p * (1 - p) / n + F.lit(z2 / 4) / n / n) * z
    return ((centre + spread) if upper else (centre - spread)) / (1 + F.lit(z2) / n)
