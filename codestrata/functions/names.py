"""Column functions on names, signatures, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space as one space, trimmed, and none inside round and angle brackets."""
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    for pattern, to in ((r"\( +", "("), (r" +\)", ")"), (r"< +", "<"), (r" +>", ">")):
        text = F.regexp_replace(text, pattern, to)
    return text


def escape_text(text: Column) -> Column:
    """Backslashes, double quotes, line breaks and tabs escaped; null becomes ''."""
    text = F.coalesce(text, F.lit(""))
    for char, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(char), F.lit(to))
    return text


def strip_source_prefix(name: Column) -> Column:
    """A dotted name without the leading source directory."""
    return F.regexp_replace(name, r"^src\.main\.java\.", "")


def package_of_path(path: Column, root: str = "") -> Column:
    """The dotted class name that a path below `root` stands for; null paths stay null."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    if root:
        flat = F.when(F.startswith(flat, F.lit(root.rstrip("/") + "/")), F.substring(flat, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(F.lit(None))
    return strip_source_prefix(F.replace(F.regexp_replace(flat, r"\.java$", ""), F.lit("/"), F.lit(".")))


def simple_method_name(signature: Column) -> Column:
    """The part of a signature before its bracket, behind the last dot."""
    return F.substring_index(F.substring_index(signature, "(", 1), ".", -1)


def simple_name(name: Column) -> Column:
    """The last segment of a dotted name; null for a wildcard."""
    last = F.substring_index(name, ".", -1)
    return F.when(last != "*", last)


def full_name(*parts: Column) -> Column:
    """Package, enclosing classes and name, joined by dots; null and empty parts are left out."""
    return F.concat_ws(".", *[F.nullif(p, F.lit("")) for p in parts])


def adjust_name(found: Column, type_name: Column) -> Column:
    """A found class name whose last segment is made the type's name, unless it is `var`, dotted or already last."""
    keep = (type_name == "var") | type_name.contains(".") | (F.substring_index(found, ".", -1) == type_name)
    package = F.regexp_replace(found, r"\.[^.]*$", "")
    return F.when(keep | ~found.contains("."), found).otherwise(F.concat_ws(".", package, type_name))


def merge_paths(outer: Column, inner: Column) -> Column:
    """Two path parts with one slash between; either alone if the other is empty."""
    outer, inner = F.coalesce(outer, F.lit("")), F.coalesce(inner, F.lit(""))
    both = F.concat(F.regexp_replace(outer, "/+$", ""), F.lit("/"), F.regexp_replace(inner, "^/+", ""))
    return F.when(outer == "", inner).when(inner == "", outer).otherwise(both)


def text_hash(text: Column) -> Column:
    """The SHA-256 of a text, as chunks carry it; null stays null."""
    return F.sha2(text, 256)


def hashed_id(*parts: Column) -> Column:
    """A non-negative 64-bit id out of columns, the same at every run."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def node_key(class_name: Column, method_name: Column) -> Column:
    """`class.method`, or the class alone."""
    return F.when(method_name.isNotNull(), F.concat(class_name, F.lit("."), method_name)).otherwise(class_name)


def declaring_class(hover: Column) -> Column:
    """The class before `.method(` in a hover signature; null if there is none."""
    found = F.regexp_extract(hover, r"^(?:@[\w.]+(?:\([^)]*\))?\s+)*(?:[\w.$]+(?:<[^<>]*>)?(?:\[\])*\s+)*([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\.[A-Za-z_$][\w$]*\(", 1)
    return F.nullif(found, F.lit(""))


def text_of_line(text: Column, line: Column) -> Column:
    """Line number `line`, from 0, of a text; null beyond its end."""
    return F.get(F.split(text, "\n"), line)


def path_of_uri(uri: Column) -> Column:
    """The path of a file URI, decoded and with '/'; other texts stay, null stays null."""
    path = F.replace(F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"^file://", ""), r"\+", "%2B")), F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(uri, F.lit("file://")), F.regexp_replace(path, r"^/(?=[A-Za-z]:/)", "")).otherwise(uri)


def position_of(text: Column, index: Column) -> Column:
    """Line and column, from 0, of a character's index in a text."""
    before = F.substr(text, F.lit(1), index)
    return F.struct((F.size(F.split(before, "\n")) - 1).alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("column"))


def index_of(text: Column, line: Column, column: Column) -> Column:
    """The character's index of a line and column, from 0; null beyond the last line."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), line), F.lit(0), lambda n, x: n + F.length(x) + 1)
    return F.when(line < F.size(lines), before + column)


def relative_path(path: Column, root: str) -> Column:
    """A path below `root` without it, with '/'; null for paths elsewhere."""
    flat, base = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(flat, F.lit(base)), F.substring(flat, len(base) + 1, 1 << 30))


def as_list(value: Column) -> Column:
    """An array without nulls: of a null nothing, of a single value itself."""
    return F.filter(F.array(value), lambda x: x.isNotNull())


def hover_text(answer: Column) -> Column:
    """The text of a hover answer in JSON: of its contents' value, of the first of a list, or the plain text; null without one."""
    paths = ("$.contents.value", "$.contents[0].value", "$.contents[0]", "$.contents")
    return F.coalesce(*[F.get_json_object(answer, p) for p in paths])


def after_insert(line: Column, column: Column, text: Column) -> Column:
    """Line and column, from 0, behind a text that is put in at a place."""
    breaks, last = F.size(F.split(text, "\n")) - 1, F.length(F.substring_index(text, "\n", -1))
    return F.struct((line + breaks).alias("line"), F.when(breaks > 0, last).otherwise(column + last).alias("column"))
