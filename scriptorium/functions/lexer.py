"""Comments, string literals and sentences of one text, found without leaving its row.

Everything here is a narrow expression: the text is cut by regular expressions
into arrays which the caller explodes, so no shuffle and no window is needed to
know where a segment stands.  Line numbers come from marks put in front of each
line before the cut (:func:`scriptorium.functions.text.number_lines`).

All repetitions are possessive: a backtracking group loop over one very long
literal would exhaust the JVM stack.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scriptorium.functions import text as tx

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+["\\]?+'
_CHAR = r"'[^'\\]*+(?:\\.[^'\\]*+)*+['\\]?+"
_LINE_COMMENT = r"//[^\n]*+"
_BLOCK_COMMENT = r"/\*[^*]*+(?:\*++[^*/][^*]*+)*+(?:\*++/?+)?+"
_SLASH = r"/(?![/*])"

# The same three constructs, for those that stay within their line.
_STRING_INLINE = r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"'
_CHAR_INLINE = r"'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+'"
_BLOCK_INLINE = r"/\*[^*\n]*+(?:\*++[^*/\n][^*\n]*+)*+\*++/"

STRING, SINGLE, BLOCK, CODE = "string_literal", "comment_single", "comment_block", "code"


def _code(char_literals: bool) -> str:
    if char_literals:
        return rf"""(?:[^"'/]++|{_SLASH}|{_CHAR})++"""
    return rf"""(?:[^"/]++|{_SLASH})++"""


def _token_pattern(char_literals: bool) -> str:
    return rf"(?s){_STRING}|{_LINE_COMMENT}|{_BLOCK_COMMENT}|{_code(char_literals)}"


def _line_group_pattern(char_literals: bool) -> str:
    """Leading code, then comments and literals that all start on one line.

    Only the last of them may span lines, so the group ends there.
    """
    if char_literals:
        code_inline = rf"""(?:[^"'/\n]++|{_SLASH}|{_CHAR_INLINE})"""
    else:
        code_inline = rf"""(?:[^"/\n]++|{_SLASH})"""
    inline = rf"(?:{_STRING_INLINE}|{_LINE_COMMENT}|{_BLOCK_INLINE}|{code_inline})"
    last = rf"(?:{_STRING}|{_BLOCK_COMMENT})"
    code = _code(char_literals)
    return rf"(?s){code}{inline}*+{last}?+|{inline}++{last}?+|{last}"


def tokens(text: Column, char_literals: bool = True) -> Column:
    """The whole text as an array of code, literal and comment pieces; neighbouring code is one piece."""
    return F.regexp_extract_all(text, F.lit(_token_pattern(char_literals)), F.lit(0))


def token_type(token: Column) -> Column:
    return (
        F.when(token.startswith('"'), STRING)
        .when(token.startswith("//"), SINGLE)
        .when(token.startswith("/*"), BLOCK)
        .otherwise(CODE)
    )


def is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def block_body(token: Column) -> Column:
    """Between the markers; an unterminated block keeps all its text."""
    closed = token.endswith("*/") & (F.length(token) >= 4)
    return F.substring(token, F.lit(3), F.length(token) - F.when(closed, 4).otherwise(2))


def _string_body(token: Column) -> Column:
    return F.regexp_extract(token, r'(?s)^"([^"\\]*+(?:\\.[^"\\]*+)*+)', 1)


def inner(token: Column) -> Column:
    """What stands inside a literal or comment; null for code."""
    return (
        F.when(token.startswith('"'), _string_body(token))
        .when(token.startswith("//"), tx.strip(F.substring(token, F.lit(3), F.length(token))))
        .when(token.startswith("/*"), tx.strip(block_body(token)))
    )


def is_translation(token: Column) -> Column:
    """A comment that an earlier run has added."""
    return is_comment(token) & F.lower(inner(token)).startswith("translated:")


def already_translated(pieces: Column, index: Column) -> Column:
    """Whether the next piece that is not blank code is a translation comment."""
    following = F.get(pieces, index + 1)
    blank_code = (token_type(following) == CODE) & (tx.strip(following) == "")
    return F.coalesce(
        F.when(blank_code, is_translation(F.get(pieces, index + 2))).otherwise(is_translation(following)),
        F.lit(False),
    )


# -- segments with their line -------------------------------------------------

def line_groups(text: Column, char_literals: bool = True) -> Column:
    """Array of groups of pieces of the numbered text; see :func:`_line_group_pattern`."""
    numbered = F.concat(F.lit("\n"), tx.number_lines(text))
    return F.regexp_extract_all(numbered, F.lit(_line_group_pattern(char_literals)), F.lit(0))


def segments(groups: Column, char_literals: bool = True, indent: bool = False) -> Column:
    """Literals and comments of :func:`line_groups` with their start line.

    Returns ``array<struct<line, type, raw>>`` in text order; ``indent`` adds the
    ``indentation`` of comments: their line up to them, with all but tabs as spaces.

    ``groups`` must be a stored column: it is indexed once per group.
    """
    # Each step names what the next one reads more than once: a lambda argument is
    # computed once, a repeated sub-expression inside a lambda is not.
    cut = F.transform(
        groups,
        lambda group, g: F.struct(
            F.get(groups, g - 1).alias("before"), tokens(group, char_literals).alias("pieces")
        ),
    )
    # Groups of nothing but code go early; there are many in plain text.
    found = F.filter(cut, lambda c: (F.size(c["pieces"]) > 1) | (token_type(c["pieces"][0]) != CODE))
    headed = F.transform(
        found,
        lambda c: F.struct(
            c["before"].alias("before"),
            F.when(token_type(c["pieces"][0]) == CODE, c["pieces"][0]).otherwise("").alias("head"),
            c["pieces"].alias("pieces"),
        ),
    )
    # A group starts a line, or goes on behind what the one before it ended with.
    led = F.transform(
        headed,
        lambda h: F.struct(
            F.when(h["head"].contains("\n"), F.substring_index(h["head"], "\n", -1))
            .otherwise(F.concat(F.substring_index(h["before"], "\n", -1), h["head"]))
            .alias("lead"),
            (h["head"] != "").alias("headed"),
            h["pieces"].alias("pieces"),
        ),
    )

    def of_group(group: Column) -> Column:
        def of_piece(piece: Column, p: Column) -> Column:
            fields = [
                F.substring_index(group["lead"], ":", 1).cast("int").alias("line"),
                token_type(piece).alias("type"),
                F.when(piece.contains("\n"), tx.unnumber_lines(piece)).otherwise(piece).alias("raw"),
            ]
            if indent:
                first = F.when(group["headed"], 2).otherwise(1)
                on_line = F.concat(
                    F.substring(group["lead"], F.instr(group["lead"], ":") + 1, F.length(group["lead"])),
                    F.array_join(F.slice(group["pieces"], first, p - first + 1), ""),
                )
                fields.append(
                    F.when(is_comment(piece), F.regexp_replace(on_line, "[^\t]", " ")).alias("indentation")
                )
            return F.struct(*fields)

        return F.filter(F.transform(group["pieces"], of_piece), lambda s: s["type"] != CODE)

    return F.flatten(F.transform(led, of_group))


# -- plain text ---------------------------------------------------------------


def stripped_lines(text: Column) -> Column:
    """``array<struct<line, text>>`` of the lines, stripped; blank ones are left out."""
    return F.filter(
        F.transform(
            F.split(text, "\n"), lambda line, i: F.struct((i + 1).alias("line"), tx.strip(line).alias("text"))
        ),
        lambda item: item["text"] != "",
    )


def sentences(text: Column) -> Column:
    """``array<struct<line, text>>``: lines joined up to a blank line or a sentence end.

    The line is the one the sentence starts on.
    """
    mark = r"^[0-9]++:"
    open_line = rf"{mark}[^\n]++(?<![{tx.SENTENCE_END}])(?:\n|\z)"
    end_line = rf"{mark}[^\n]++(?<=[{tx.SENTENCE_END}])(?:\n|\z)"
    pattern = rf"(?dm)(?:{open_line})++(?:{end_line})?+|{end_line}"
    runs = F.regexp_extract_all(tx.number_lines(text, tx.strip), F.lit(pattern), F.lit(0))
    return F.transform(
        runs,
        lambda run: F.struct(
            F.regexp_extract(run, "^([0-9]++):", 1).cast("int").alias("line"),
            F.replace(
                F.regexp_replace(F.rtrim(run, F.lit("\n")), r"(?dm)^[0-9]++:", ""), F.lit("\n"), F.lit(" ")
            ).alias("text"),
        ),
    )
