"""Removing comments from Java sources, in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A block comment (slashes hide its end on its first line), a line comment, other text.
_PIECE = r"/\*[^\n]*?(?:\*/|(?://[^\n]*)?(?:\n[\s\S]*?(?:\*/|\z)|\z))|//[^\n]*|[^/]+|/"


def without_comments(text: Column) -> Column:
    """A source without comments; strings aren't told from code, so slashes in them begin comments too.

    Line comments vanish. A block within a line becomes as many spaces; of a longer one the inner lines keep their
    length as spaces, and what follows its end moves to the line's beginning.
    """

    def plain(piece: Column) -> Column:
        lines = F.split(piece, "\n")
        inner = F.transform(lines, lambda x, k: F.when((k == 0) | ((k == F.size(lines) - 1) & F.endswith(piece, F.lit("*/"))), "").otherwise(F.repeat(F.lit(" "), F.length(x))))
        block = F.when(F.contains(piece, F.lit("\n")), F.array_join(inner, "\n")).when(F.endswith(piece, F.lit("*/")), F.repeat(F.lit(" "), F.length(piece))).otherwise("")
        return F.when(F.startswith(piece, F.lit("/*")), block).when(F.startswith(piece, F.lit("//")), "").otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), 0), plain), "")
