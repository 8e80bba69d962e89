"""Column expressions over node text: links, line format, search words, notation tokens."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------
POINTER = r"[A-Za-z][A-Za-z0-9._-]*"
BARE_TEMPLATE = "{pointer}"
LINE_PREFIX = "- pgx:"
NOTATION_FENCE = "pgx-traversal"
EMBED_HEADING = "### Traversal expression"


@dataclass(frozen=True)
class ReferenceProfile:
    """How link destinations and legacy visible markers are spelled in a corpus."""

    profile_key: str = "pgx-default"
    namespace_prefix: str = "pgx"
    pointer_pattern: str = POINTER
    visible_open: str = "⟦"
    visible_close: str = "⟧"
    uri_template: str = BARE_TEMPLATE
    require_target: bool = True
    resolver_status: str = "resolved"

    @property
    def is_bare(self) -> bool:
        return self.uri_template == BARE_TEMPLATE

    @property
    def prefix(self) -> str:
        return self.uri_template.split("{pointer}")[0]

    @property
    def suffix(self) -> str:
        return self.uri_template.split("{pointer}")[1]

    @property
    def marker_pattern(self) -> str:
        return rf"\Q{self.visible_open}{self.namespace_prefix}:\E({self.pointer_pattern})\Q{self.visible_close}\E"

    def marker(self, pointer: Column) -> Column:
        return F.concat(F.lit(f"{self.visible_open}{self.namespace_prefix}:"), pointer, F.lit(self.visible_close))


# ---- Markdown scan ----------------------------------------------------------------
# One left-to-right pass; every alternative consumes what it recognises, so a link inside
# a fence, an indented block or a code span is never reached. Repeated groups are
# possessive, which keeps the matcher iterative on long texts.
_LINE_START = r"(?<![^\n])"
_BACKTICK_FENCE = _LINE_START + r" {0,3}(`{3,})[^`\n]*(?:\z|\n(?:.*?\n)?? {0,3}\1`*[ \t]*(?![^\n])|\n.*\z)"
_TILDE_FENCE = _LINE_START + r" {0,3}(~{3,})[^\n]*(?:\z|\n(?:.*?\n)?? {0,3}\2~*[ \t]*(?![^\n])|\n.*\z)"
_INDENTED = r"(?:(?<=\n\n)|\A)(?: {4}|\t)[^\n]*(?:\n(?: {4}|\t)[^\n]*)*+"
_ESCAPE = r"\\[\\`*_{}\[\]()#+.!~|<>-]"
_CODE_SPAN = r"(?<!`)(`+)(?!`).+?(?<!`)\3(?!`)|`+"
_AUTOLINK = r"<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*>"
_ANCHOR = r"(?:[^\[\]\\`]|\\.|`[^`\n]*`|\[(?:[^\[\]\\`])*+\])*+"
_TARGET = r"\([ \n]*(?:<[^<>\n]*>|[^\s()<>]*(?:\([^\s()<>]*\)[^\s()<>]*)*+)(?:[ \n]+(?:\"[^\"]*\"|'[^']*'))?[ \n]*\)"
LINK = rf"!?\[{_ANCHOR}\]{_TARGET}"
_PLAIN = r"(?:[^\\`<!\[\n]|\n(?! {0,3}(?:```|~~~)|\n(?: {4}|\t)))++"
MARKDOWN_SCAN = "(?s)" + "|".join(
    [_BACKTICK_FENCE, _TILDE_FENCE, _INDENTED, _ESCAPE, _CODE_SPAN, _AUTOLINK, LINK, _PLAIN, "."]
)
LINK_PARTS = rf"(?s)^\[({_ANCHOR})\]\([ \n]*(<[^<>\n]*>|[^\s()<>]*(?:\([^\s()<>]*\)[^\s()<>]*)*+)"
# Inline markup changes the rendered anchor, so its source span cannot be found again.
ANCHOR_MARKUP = r"(?s)`|\\[\\`*_{}\[\]()#+.!~|<>-]|\*[^*\s][^*]*\*|(?<![\p{L}\p{N}])_[^_\s][^_]*_(?![\p{L}\p{N}])|&#?\w+;"


def markdown_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKDOWN_SCAN), F.lit(0))


def _rendered_anchor(raw: Column) -> Column:
    plain = F.regexp_replace(raw, r"`([^`]*)`", "$1")
    plain = F.regexp_replace(plain, r"\\([\\`*_{}\[\]()#+.!~|<>-])", "$1")
    return F.regexp_replace(plain, r"(\*{1,2})([^*\s](?:[^*]*[^*\s])?)\1", "$2")


def markdown_links(text: Column) -> Column:
    """Links of a text in order: array of (anchor, href, source).

    ``source`` is the plain spelling ``[anchor](href)`` that must occur in the text.
    """
    links = F.filter(markdown_tokens(text), lambda t: t.startswith("[") & t.rlike(LINK_PARTS))

    def parts(token: Column) -> Column:
        href = F.regexp_replace(F.regexp_extract(token, LINK_PARTS, 2), r"^<(.*)>$", "$1")
        anchor = _rendered_anchor(F.regexp_extract(token, LINK_PARTS, 1))
        return F.struct(anchor.alias("anchor"), href.alias("href"),
                        F.concat(F.lit("["), anchor, F.lit("]("), href, F.lit(")")).alias("source"))

    return F.transform(links, parts)


def locate_from(needle: Column, text: Column, start: Column) -> Column:
    """0-based position of ``needle`` at or after 0-based ``start``; -1 if absent."""
    return F.call_function("locate", needle, text, start + 1) - 1


# Characters of code and escapes that are no markup, and noncharacters that stand for them while markup is dropped.
_LITERAL, _MASKED = "*#", "\ufdd0\ufdd1"


def visible_text(text: Column) -> Column:
    """Text a reader sees: link destinations and code marks dropped; code and fence bodies kept as they are."""
    def literal(code: Column) -> Column:
        return F.translate(code, _LITERAL, _MASKED)

    def shown(token: Column) -> Column:
        link = F.regexp_extract(token, LINK_PARTS, 1)
        image = F.regexp_extract(F.substr(token, F.lit(2)), LINK_PARTS, 1)
        return (F.when(token.startswith("[") & token.rlike(LINK_PARTS), _rendered_anchor(link))
                 .when(token.startswith("![") & F.substr(token, F.lit(2)).rlike(LINK_PARTS), image)
                 .when(token.rlike(r"(?s)^ {0,3}(`{3,}|~{3,})"),
                       literal(F.regexp_replace(F.regexp_replace(token, r"(?s)^ {0,3}(?:`{3,}|~{3,})[^\n]*\n?", ""),
                                                r"(?s)\n? {0,3}(?:`{3,}|~{3,})[ \t]*$", "")))
                 .when(token.rlike(r"(?s)^`+.*`+$") & (F.length(token) > 1), literal(F.regexp_replace(token, r"^`+|`+$", "")))
                 .when(token.rlike(r"^\\."), literal(F.substr(token, F.lit(2))))
                 .otherwise(token))

    joined = F.array_join(F.transform(markdown_tokens(text), shown), "")
    unquoted = F.regexp_replace(joined, r"(?m)^ {0,3}#{1,6} +", "")
    plain = F.regexp_replace(unquoted, r"(\*{1,2})([^*\s](?:[^*\n]*[^*\s])?)\1", "$2")
    return F.translate(F.trim(F.regexp_replace(plain, r"\n{2,}", "\n")), _MASKED, _LITERAL)


# ---- node line format -------------------------------------------------------------
def escape_field(value: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def unescape_field(value: Column) -> Column:
    """Inverse of :func:`escape_field` for fields already known to be well escaped."""
    atoms = F.regexp_extract_all(value, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(atoms, lambda a:
        F.when(a == "\\n", "\n").when(a == "\\r", "\r")
         .when(a.startswith("\\"), F.substr(a, F.lit(2))).otherwise(a)), "")


def node_line(pointer: Column, title: Column, description: Column, data_one: Column) -> Column:
    fields = [escape_field(c) for c in (pointer, title, description, data_one)]
    return F.concat(F.lit(LINE_PREFIX + " || "), F.concat_ws(" || ", *fields), F.lit(" ||"))


# ---- search words -----------------------------------------------------------------
def _accents() -> tuple[str, str]:
    """Every small Latin letter that consists of a letter and marks, with that letter; then the marks, which are left out."""
    letters = {}
    for code in range(0x80, 0x2000):
        letter = chr(code)
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and letter == letter.lower() and unicodedata.name(letter, "").startswith("LATIN"):
            letters[letter] = base
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(letters.values())


# The search index ignores marks on Latin letters, whether they are one character with it or stand behind it.
ACCENTED, UNACCENTED = _accents()
WORD = r"[\p{L}\p{N}]+"
MARKED_WORD = r"[\p{L}\p{N}][\p{L}\p{N}\u0300-\u036f]*+"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, UNACCENTED)


def words(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


# ---- notation ---------------------------------------------------------------------
NOTATION_BLOCK = rf"(?s)(?<![^\n])```{NOTATION_FENCE}[ \t]*\n(.*?)\n```(?![^\n`])"
NOTATION_TOKEN = r"[()\[\]:]|[^()\[\]:]+"


def notation_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NOTATION_BLOCK), F.lit(1))


def notation_source(notation: Column) -> Column:
    """Notation without blanks."""
    return F.regexp_replace(notation, r"\s+", "")


def embedded_block(notation: Column, read: Column) -> Column:
    block = F.concat(F.lit(f"{EMBED_HEADING}\n\n```{NOTATION_FENCE}\n"), notation, F.lit("\n```"))
    return F.when(F.coalesce(F.length(read), F.lit(0)) > 0, F.concat(block, F.lit("\n\nRead: "), read)).otherwise(block)
