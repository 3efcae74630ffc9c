"""Files that nobody wrote by hand: generated, minified or obfuscated, third-party copies, data stored as code.

Comments before the first declaration, comments after the last one, and annotations of the first type are searched by
one multi-pattern automaton; string literals and comments inside the code never are. A sentence that says who or what
made the file is a notice, unless it denies it or only wishes for it. Path rules know directories of generated and
vendored files, lockfiles and suffixes. A project's own code lies under its package root, so a directory named
`vendor` inside that root says nothing, while a foreign package, a relocated one inside the root, or another holder's
copyright does. The body tells minified and obfuscated code, data, and code that repeats one line with other numbers.

Rows are judged where they are read; only findings are shuffled. A file is a (project_id, branch, file_path) and is
found if any of its rows is. Nulls: a null path is no file; null or empty content leaves the path to decide; a null or
unknown project has no package root, so its packages aren't foreign. Repeated rows give one file; empty tables none;
other columns pass unused. Texts of any length are read whole. `projects` is a small fixed table and is broadcast.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: words of notices, in lower case; `_phrases` puts them together
STRONG = ["generated", "auto-generated", "autogenerated", "machine-generated", "generiert", "erzeugt", "généré", "générée", "engendré"]
STRONG_TAILS = ["by", "from", "with", "using", "via", "on", "at", "automatically", "code", "file", "source", "sources", "class", "content", "mit", "von", "aus", "durch", "par", "avec", "depuis", "automatiquement", "automatisch"]
WEAK = ["written", "produced", "created", "made", "emitted", "compiled", "derived", "assembled", "built", "output", "product", "erstellt", "geschrieben", "produit", "créé", "écrit"]
WEAK_TAILS = ["by", "from", "of", "with", "using", "von", "mit", "aus", "par", "avec"]
ADVERBS = ["automatically", "automatisch", "machine", "auto"]
MARKERS = ["@generated", "auto-generated", "autogenerated", "auto generated", "machine-generated", "machine-made"]
MACHINES = ["tool", "tools", "generator", "compiler", "build", "script", "plugin", "processor", "machine", "wizard", "template", "schema", "grammar", "idl", "werkzeug", "übersetzer", "outil", "compilateur"]
HANDS_OFF = [
    "do not edit", "don't edit", "do not modify by hand", "do not change by hand", "do not modify manually", "do not edit manually", "not be edited", "not be modified by hand", "not be changed by hand", "never edit", "regenerate instead", "regenerate it instead",
    "nicht bearbeiten", "nicht ändern", "nicht von hand ändern", "nicht von hand bearbeiten", "nicht manuell ändern", "ne pas modifier", "ne pas éditer",
]
EDITS, FATES = ["changes", "edits", "modifications", "änderungen"], ["will be lost", "are lost", "get lost", "will be overwritten", "are overwritten", "get overwritten", "gehen verloren", "werden überschrieben"]
VERBS, SOURCES = ["edit", "change", "modify", "update"], ["the idl", "the schema", "the grammar", "the template", "the source instead", "the definition instead", "the model instead"]
COPIED = ["upstream", "verbatim", "vendored", "third-party", "third party", "unmodified copy", "unchanged copy", "release archive", "unverändert übernommen", "copie conforme"]
COPIED_VERSIONS = ["copied from", "taken from", "imported from", "borrowed from", "local copy", "bundled copy", "bundled from", "copie locale", "copié de", "übernommen aus", "kopiert aus"]
DENIALS = ["not generated", "no longer generated", "never generated", "isn't generated", "previously generated", "formerly generated", "originally generated", "was generated", "replaces the", "replaced the", "used to be", "edit freely", "kept by hand", "written by hand", "maintained by hand", "by hand since", "todo", "fixme", "one day", "should be generated", "could be generated", "will be generated", "nicht mehr erzeugt", "nicht generiert", "nicht erzeugt", "non généré"]
# fixed values: directories and names
VENDOR_DIRECTORIES = {"vendor", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "extern", "contrib", "libs", "lib", "deps", "node_modules", "bower_components", "jspm_packages", "site-packages"}
GENERATED_DIRECTORIES = {"generated", "generated-sources", "generated-test-sources", "gen", "src-gen", "src_gen", "autogen", "auto-generated", "build", "target", "dist", "out", "obj", "__generated__"}
RELOCATED = {"shaded", "relocated", "repackaged", "shadow"}
DOMAINS = {"com", "org", "net", "io", "de", "fr", "eu", "edu", "gov", "dev", "javax", "jakarta", "uk"}
LOCKFILES = {"package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "go.sum", "uv.lock", "packages.lock.json", "gradle.lockfile"}
SUFFIXES = re.compile(r"\.min\.(?:m?js|css)$|\.(?:js|css)\.map$|\.pb\.go$|_pb2(?:_grpc)?\.pyi?$|\.g\.dart$|\.designer\.cs$|\.generated\.\w+$|\.g\.cs$", re.I)

_COPYRIGHT = re.compile(r"(?:copyright|©)\s*(?:\(c\)|©)?\s*(?:\d{4}(?:\s*[-,]\s*\d{4})*,?\s*)?(?:by\s+)?([^\n*]+)", re.I)
_SOURCE_ROOT = re.compile(r"(?:^|/)src/(?:main|test|it)/(?:java|kotlin|scala|groovy)/(.*)$")
_HEX_LINE = re.compile(r"^(?:[0-9a-f]{6,16}[:\s]\s*)?(?:[0-9a-f]{2,8}[ \t]+){7,}[0-9a-f]{2,8}\b", re.I | re.M)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[LlFfDd]?(?![\w.])")
_WORD = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*")
_BLOB = re.compile(r"[A-Za-z0-9+/=]{40,}")
_NUMBERS = re.compile(r"\d+")
_VERSION = re.compile(r"\d+\.\d+")
_NO_DIGITS = {ord(c): None for c in "0123456789"}
_CODE_LANGUAGES = {"java", "js", "mjs", "ts", "kt", "scala", "groovy", "py", "c", "cc", "cpp", "h", "cs", "go", "rb", "php", "css"}


# what may stand before the first declaration, and the comments among it, by family of languages
_SLASHES, _DASHES, _HASHES, _ANGLES = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"--[^\n]*|/\*.*?(?:\*/|\Z)", r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)", r"<!--.*?(?:-->|\Z)"
_OTHER = r"(?P<package>package\s+(?P<name>[\w.]+)\s*;?)|(?P<import>import\b[^;\n]*;?|using\b[^;\n]*;|\"use strict\";?|<\?xml[^>]*>|<!doctype[^>]*>)|(?P<note>@(?!interface\b)[A-Za-z_][\w.]*)|(?P<modifier>(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp|export|internal|open|data)\b)"
# fixed values: languages whose comments don't begin with slashes
_FAMILIES = {"sql": _DASHES, "lua": _DASHES, "py": _HASHES, "rb": _HASHES, "sh": _HASHES, "yml": _HASHES, "yaml": _HASHES, "toml": _HASHES, "properties": _HASHES, "cfg": _HASHES, "ini": _HASHES, "xml": _ANGLES, "html": _ANGLES, "xhtml": _ANGLES, "svg": _ANGLES}
_TYPE = re.compile(r"(?:class|interface|enum|record|struct|trait|object|@interface)\b")
_GENERATED_NOTE = re.compile(r"@(?:[\w.]*\.)?(?:Auto)?Generated(?:Code|By|File|Class|Source)?(?![\w.])")
_BRACKETS = re.compile(r'"(?:[^"\\\n]|\\.)*"|[()]')


@functools.cache
def _pieces(extension: str) -> tuple[re.Pattern, re.Pattern]:
    comment = _FAMILIES.get(extension, _SLASHES)
    return re.compile(rf"\s+|(?P<comment>{comment})|{_OTHER}", re.S | re.I), re.compile(rf"(?:{comment})\s*", re.S)


def _closed(text: str, at: int) -> int:
    """Behind the round brackets that open at `at`, if any do."""
    if text[at : at + 1] != "(":
        return at
    depth = 0
    for m in _BRACKETS.finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m.group(), 0)
        if depth == 0:
            return m.end()
    return len(text)


def _tail(text: str, comment: re.Pattern) -> str:
    """The comments a text ends with: whole lines that begin with a sign of comment, from the end up."""
    end = start = len(text)
    while start > 0:
        line_start = text.rfind("\n", 0, start - 1) + 1
        line = text[line_start:start].strip()
        if line.startswith(("//", "#", "--", "/*", "<!--")):
            end = line_start
        elif line and not line.startswith("*") and not line.endswith(("*/", "-->")):
            break
        start = line_start
    found, at = [], end
    while at < len(text) and (m := comment.match(text, at)):
        found.append(m.group())
        at = m.end()
    return "\n".join(found) if at == len(text) else ""


def outline(text: str, extension: str) -> tuple[str, str, list[str], str | None]:
    """Comments before the first declaration, comments at the end, annotations of the first type, and the package."""
    piece, comment = _pieces(extension)
    at, comments, notes, package = 0, [], [], None
    while m := piece.match(text, at):
        at = m.end()
        if m["comment"]:
            comments.append(m["comment"])
        elif m["package"]:
            package = package or m["name"]
        elif m["note"]:
            end = _closed(text, at)
            notes.append(text[m.start() : end])
            at = end
    last = _tail(text, comment) if at < len(text) else ""
    return "\n\n".join(comments), last, notes if _TYPE.match(text, at) else [], package


def _phrases() -> dict[str, set[str]]:
    """What each phrase is a sign of."""
    kinds = {
        "made": [f"{a} {b}" for a in STRONG for b in STRONG_TAILS] + [f"{a}{gap}{b}" for a in ADVERBS for b in STRONG + WEAK for gap in (" ", "-")] + [f"{b} {a}" for a in ADVERBS[:2] for b in WEAK] + MARKERS,
        "perhaps": [f"{a} {b}" for a in WEAK for b in WEAK_TAILS], "machine": MACHINES,
        "made off": HANDS_OFF + [f"{a} {b}" for a in EDITS for b in FATES] + [f"{a} {b}" for a in VERBS for b in SOURCES],
        "copied": COPIED, "copied version": COPIED_VERSIONS, "denied": DENIALS,
    }
    out: dict[str, set[str]] = {}
    for kind, phrases in kinds.items():
        for phrase in phrases:
            out.setdefault(phrase, set()).add(kind)
    return out


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, kinds in _phrases().items():
        found.add_word(phrase, (kinds, len(phrase)))
    found.make_automaton()
    return found


def _signs(sentence: str) -> set[str]:
    """Kinds of the phrases that stand in a sentence as whole words."""
    out: set[str] = set()
    for last, (kinds, size) in _automaton().iter(sentence):
        before, after = sentence[last - size : last - size + 1] if last >= size else "", sentence[last + 1 : last + 2]
        if not before.isalnum() and not after.isalnum():
            out |= kinds
    return out


def notice(text: str, owner: str | None) -> str | None:
    """What comments say of the file's origin: 'generated', 'third-party' or nothing."""
    if not text.strip():
        return None
    kind = None
    for sentence in re.split(r"(?<=[.;!?])\s+|\*/|-->|\n\s*\n", text):
        plain = " ".join(w for w in sentence.lower().split() if w.strip("/*#-"))
        signs = _signs(plain)
        if "denied" in signs:
            continue
        if "copied" in signs or "copied version" in signs and _VERSION.search(plain):
            return "third-party"
        if "made" in signs or "made off" in signs or {"perhaps", "machine"} <= signs:
            kind = "generated"
    if kind:
        return kind
    holder = _COPYRIGHT.search(text)
    if holder and owner:
        name = holder[1].strip().lower().removeprefix("the ").strip(" .")
        if name and owner.lower() not in name and name not in owner.lower():
            return "third-party"
    return None


def annotated(notes: list[str]) -> bool:
    """Whether an annotation of a type says that the type is generated."""
    return any(_GENERATED_NOTE.match(n) for n in notes)


def path_kind(path: str, class_name: str | None, package: str | None, root: str | None) -> str | None:
    """What a path (with '/') and the packages say of the file's origin."""
    parts = [p for p in path.lower().split("/") if p not in ("", ".")]
    if not parts:
        return None
    if parts[-1] in LOCKFILES:
        return "generated"
    if SUFFIXES.search(parts[-1]):
        return "minified" if ".min." in parts[-1] or parts[-1].endswith(".map") else "generated"
    own = root.lower().split(".") if root else None
    at = -1
    if own:
        at = next((k for k in range(len(parts) - len(own)) if parts[k : k + len(own)] == own), -1)
    outside = parts[:at] if at >= 0 else parts[:-1]
    m = _SOURCE_ROOT.search("/".join(parts))
    if m and at < 0:  # directories inside a package tree are packages, not places
        outside = parts[: len(parts) - len(m[1].split("/")) - 3]
    if any(p in GENERATED_DIRECTORIES for p in outside):
        return "generated"
    if at < 0 and any(p in VENDOR_DIRECTORIES for p in outside):
        return "third-party"
    if at >= 0:
        inside = parts[at + len(own) : -1]
        if any(a in RELOCATED and b in DOMAINS for a, b in zip(inside, inside[1:])):
            return "third-party"
    if own and parts[-1].rpartition(".")[2] in ("java", "kt", "scala", "groovy"):
        named = package or (class_name if class_name and "." in class_name else None)
        if at < 0 and named and not (named + ".").lower().startswith(root.lower() + ".") and named.split(".")[0].lower() in DOMAINS:
            return "third-party"
        if at < 0 and m and m[1].split("/")[0] in DOMAINS:
            return "third-party"
    return None


def _is_table(lines: list[str]) -> bool:
    """Whether lines are records of as many fields each, some of them numbers."""
    for mark in ";\t|,":
        fields = lines[0].count(mark)
        if fields >= 2 and sum(x.count(mark) == fields for x in lines) >= 0.9 * len(lines):
            cells = [c.strip() for x in lines for c in x.split(mark)]
            numbers = sum(bool(_NUMBER.fullmatch(c)) for c in cells)
            return numbers >= 0.25 * len(cells) and not any(c.endswith(("{", "}", ")")) for c in cells)
    return False


def shape_kind(text: str, extension: str) -> str | None:
    """What a body's shape says: 'data', 'minified', 'generated' or nothing."""
    size = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    longest = max(map(len, lines), default=0)
    digits = size - len(text.translate(_NO_DIGITS))
    if digits > 0.2 * size:
        if len(lines) >= 3 and sum(bool(_HEX_LINE.match(x)) for x in lines) >= 0.8 * len(lines):
            return "data"
        if len(lines) >= 5 and _is_table(lines):
            return "data"
    if extension != "json" and text.lstrip()[:1] in "[{" and longest > 300:
        try:
            json.loads(text)
            return "data"
        except (ValueError, RecursionError):
            pass
    if digits > 0.12 * size and extension in _CODE_LANGUAGES:
        numbers, words = len(_NUMBER.findall(text)), len(_WORD.findall(text))
        if numbers >= 40 and numbers > 3 * words:
            return "data"
    if longest >= 40 and sum(len(b) for b in _BLOB.findall(text) if not (b.isalpha() or b.isdigit())) > 0.6 * size:
        return "data"
    if digits > 0.1 * size and extension in _CODE_LANGUAGES:
        told = [x for x in lines if any(map(str.isalnum, x))]
        if len(told) >= 20 and len({_NUMBERS.sub("0", x.strip()) for x in told}) < 0.4 * len(told):
            return "generated"  # a table of states, steps or constants
    if longest > 200:
        if extension in _CODE_LANGUAGES and size / len(lines) > 150:
            words = _WORD.findall(text)
            short = sum(len(w) <= 2 for w in words)
            blanks = text.count(" ") + text.count("\n")
            if words and (short > 0.25 * len(words) or blanks < 0.06 * size):
                return "minified"
    return None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for project, branch, path, class_name, text, root, owner in zip(*(batch.column(n).to_pylist() for n in ("project_id", "branch", "file_path", "class_name", "content", "package_root", "owner"))):
            flat = path.replace("\\", "/")
            text = (text or "").replace("\r\n", "\n").removeprefix("\ufeff")
            extension = flat.rpartition(".")[2].lower()
            top, last, notes, package = outline(text, extension)
            kind = path_kind(flat, class_name, package, root) or ("generated" if annotated(notes) else notice(top, owner) or notice(last, None) or shape_kind(text, extension))
            if kind:
                rows.append((project, branch, path, kind))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["project_id", "branch", "file_path", "kind"])


def not_handwritten(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, branch, file_path, kind) of the files found, one row each; of several kinds the first by name."""
    owners = projects.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(F.max("package_root").alias("package_root"), F.max("owner").alias("owner"))
    rows = nodes.where(F.col("file_path").isNotNull()).select("project_id", "branch", "file_path", "class_name", "content").join(F.broadcast(owners), "project_id", "left")
    found = rows.mapInArrow(_judge, "project_id string, branch string, file_path string, kind string")
    return found.groupBy("project_id", "branch", "file_path").agg(F.min("kind").alias("kind"))


def handwritten(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(project_id, branch, file_path) of the files that aren't found."""
    files = nodes.where(F.col("file_path").isNotNull()).select("project_id", "branch", "file_path").distinct()
    same = files.project_id.eqNullSafe(found.project_id) & files.branch.eqNullSafe(found.branch) & (files.file_path == found.file_path)
    return files.join(found, same, "left_anti")
