"""Path column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffixes (case-sensitive) and names the re-encoder looks at.
REENCODE_SUFFIXES = (".c", ".h", ".cpp", ".s", ".S", ".jp", ".txt")
REENCODE_NAMES = ("Makefile",)
COMMENT_SUFFIXES = (".c", ".h")

# Suffixes that make a file source code.
CODE_SUFFIXES = (".c", ".h", ".cpp", ".hpp", ".java", ".js", ".py", ".rs", ".go")

NO_EXTENSION = "(no extension)"
ARCHIVE_SUFFIX = ",v"


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last slash; the empty string at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def suffix(path: Column) -> Column:
    """Last dot-part of the name as ``pathlib`` sees it: none for ``.name`` or ``name.``."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)\z", 1)


def extension(path: Column) -> Column:
    found = F.lower(suffix(path))
    return F.when(found == "", F.lit(NO_EXTENSION)).otherwise(found)


def has_suffix(path: Column, suffixes: tuple[str, ...], names: tuple[str, ...] = ()) -> Column:
    name = basename(path)
    test = F.lit(False)
    for end in suffixes:
        test = test | name.endswith(end)
    return test | name.isin(*names) if names else test


def is_code_file(path: Column) -> Column:
    return has_suffix(F.lower(path), CODE_SUFFIXES)


def is_archive(path: Column) -> Column:
    return path.endswith(ARCHIVE_SUFFIX)


def archive_target(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - len(ARCHIVE_SUFFIX))


def is_safe_request(path: Column) -> Column:
    """False for a path that could leave the root."""
    return ~path.contains("..") & ~path.startswith("/")


def sanitise(path: Column) -> Column:
    """Put ``?`` for what cannot be written as UTF-8."""
    return F.when(F.is_valid_utf8(path), path).otherwise(
        F.replace(F.make_valid_utf8(path), F.lit("\ufffd"), F.lit("?"))
    )


def prefixes(path: Column) -> Column:
    """``a``, ``a/b``, ... up to the path itself."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
