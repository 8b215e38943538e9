"""Rules that pick a tool or language for a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import paths as px

# Key, name, extensions (none: every file).
TOOLS = (
    ("extract_sjis", "Extract Shift-JIS Text", ()),
    ("file_info", "File Info", ()),
    ("auto_translate_sentence", "Translate (Global/Sentence)", ()),
    ("auto_translate_line", "Translate (Line-by-Line)", ()),
    ("format_code", "Format C Code", (".c", ".h")),
    ("open_vscode", "Open Folder in VS Code", ()),
)

# Language of each extension.
LANGUAGES = {
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".java": "java", ".js": "javascript",
    ".py": "python", ".rs": "rust", ".go": "go", ".s": "gas", ".md": "markdown", ".html": "html",
    ".css": "css", ".json": "json", ".sh": "bash", ".ts": "typescript", ".xml": "xml", ".txt": "text",
}
OTHER_LANGUAGE = "text"


def tools_available(files: DataFrame, tools=TOOLS) -> DataFrame:
    """``file_id, tool, name`` for each tool that takes the file.

    The registry is an array literal: each row picks from it, so nothing is joined.
    """
    lowered = F.lower("path")
    fits = F.array_compact(
        F.array(
            *[
                F.when(
                    px.has_suffix(lowered, extensions) if extensions else F.lit(True),
                    F.struct(F.lit(key).alias("tool"), F.lit(name).alias("name")),
                )
                for key, name, extensions in tools
            ]
        )
    )
    return files.select("file_id", F.explode(fits).alias("t")).select("file_id", "t.*")


def language(path: Column) -> Column:
    pairs = [F.lit(part) for pair in LANGUAGES.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[px.extension(path)], F.lit(OTHER_LANGUAGE))
