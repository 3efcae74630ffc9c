"""Declarations, references and structure out of Java sources.

A tokenizer and a descent over declarations, not a full parser: bodies are read as token streams. In a source that is cut
off, merged with conflicts or otherwise broken, what is open is closed at the next declaration or the end of the text,
lines of conflict markers don't count, and only a member without a whole head is lost, or a class without a body.
Positions are those of characters, from 0. `extract` runs where files are read, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r'(?P<comment>//[^\n]*|/\*.*?\*/|/\*[^\n]*(?:\n[ \t]*\*[^\n]*)*|^(?:<{7}|\|{7}|={7}|>{7})(?![<|=>])[^\n]*)|(?P<literal>""".*?(?:"""|\Z)|"(?:[^"\\\n]|\\.)*(?:"|$)|\'(?:[^\'\\\n]|\\.)*\'|\.?\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\.\.\.|[-+*/%&|^!=<>]=|&&|\|\||\+\+|--|[^\s\w])',
    re.S | re.M,
)
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
RESERVED = MODIFIERS - {"default", "sealed"}
PRIMITIVE = frozenset("void boolean byte short char int long float double".split())
ACCESS = frozenset(("public", "protected", "private"))
TYPE_KINDS = frozenset(("class", "interface", "enum", "record"))
HANDLERS = frozenset(("ConstraintValidator",))
NO_CALL = frozenset("if for while switch catch synchronized return throw new super this assert try do else case".split())
CALL = "struct<receiver:string,name:string,type:string,arguments:int>"
METHOD = (
    f"struct<name:string,signature:string,return_type:string,parameters:array<string>,annotations:array<string>,calls:array<{CALL}>,field_access:array<string>,used_types:array<string>,body:string,shape:string,"
    "is_abstract:boolean,line:int,column_start:int,column_end:int>"
)
SCHEMA = (
    "file_id long, package string, kind string, class_name string, full_class_name string, parent_class string, is_nested boolean, is_abstract boolean, annotations array<string>, "
    f"supertypes array<string>, handles string, fields array<struct<name:string,type:string>>, used_types array<string>, imports map<string,string>, shape string, methods array<{METHOD}>"
)


class _Source:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "comment"]
        self.words = [w[1] for w in self.tokens] + [""] * 8  # none beyond the end, nor before the first
        self.classes: list[dict] = []
        self.stop = len(self.tokens)
        self.ends = self.braces()

    def word(self, k: int) -> str:
        try:
            return self.words[k]
        except IndexError:
            return ""

    def span(self, a: int, b: int) -> str:
        return self.text[self.tokens[a][2] : self.tokens[min(b, len(self.tokens)) - 1][3]] if a < b else ""

    def braces(self) -> dict[int, tuple[int, int]]:
        """Of each opening brace, where its inside ends and the place behind."""
        ends, open_ = {}, []
        for k, word in enumerate(self.words):
            if word == "{":
                open_.append(k)
            elif word == "}":
                if not open_:
                    return self.mended_braces()
                ends[open_.pop()] = (k, k + 1)
        return self.mended_braces() if open_ else ends

    def mended_braces(self) -> dict[int, tuple[int, int]]:
        """The same where braces don't match: blocks end where a member begins that can't be in them, bodies of types at a type that begins a line."""
        ends, open_, typed, constants, heading = {}, [], set(), set(), False  # typed: the braces around members; constants: those of enums before the first semicolon
        surplus = sum((w[1] == "}") - (w[1] == "{") for w in self.tokens)

        def close(at: int, types: bool) -> None:
            while open_ and (types or open_[-1] not in typed):
                ends[open_.pop()] = (at, at)

        for k, (_, word, at, _) in enumerate(self.tokens):
            if self.heads_type(k):
                start = self.back(k)
                at = self.tokens[start][2]
                if surplus < 0 and open_ and (at == 0 or self.text[at - 1] == "\n"):
                    close(start, True)
                heading = word
            elif word in ACCESS:
                close(self.back(k), False)
                constants.difference_update(open_[-1:])
            elif word == "{":
                start = None
                if not heading and not (open_ and open_[-1] in constants):
                    start = self.method_before(k)
                    if start is not None:
                        close(start, False)
                if heading or start is None and (open_ and open_[-1] in constants or self.is_anonymous(k)):
                    typed.add(k)
                    if heading == "enum":
                        constants.add(k)
                open_.append(k)
                heading = False
            elif word == ";":
                constants.difference_update(open_[-1:])
                heading = False
            elif word == "}" and open_:
                heading = False
                if surplus > 0 and len(open_) == 1 and open_[0] in typed and not self.type_follows(k + 1):
                    surplus -= 1
                    continue
                ends[open_.pop()] = (k, k + 1)
        close(len(self.tokens), True)
        return ends

    def heads_type(self, k: int) -> bool:
        word = self.word(k)
        return word in TYPE_KINDS and self.word(k - 1) != "." and k + 1 < len(self.tokens) and self.tokens[k + 1][0] == "name" and (word != "record" or self.word(k + 2) in ("(", "<"))

    def type_follows(self, k: int) -> bool:
        """Whether a type, or nothing, comes next after brackets that close."""
        while self.word(k) in ("}", ";"):
            k += 1
        while self.word(k) in MODIFIERS or self.word(k) == "@" and self.word(k + 1) != "interface":
            k = self.left_open(k) if self.word(k) == "@" else k + 1
        return self.word(k) in TYPE_KINDS or self.word(k) in ("@", "import", "")

    def left_open(self, k: int) -> int:
        """Behind an annotation, or behind its name if its bracket isn't closed."""
        try:
            return self.annotation(k)
        except ValueError:
            return k + 2

    def opening(self, k: int) -> int:
        """The bracket that the one at `k` closes, or -1."""
        left, right = {")": "(", ">": "<"}[self.word(k)], self.word(k)
        depth = 0
        while k >= 0 and self.word(k) not in (";", "{" if right == ">" else ";"):
            depth += (self.word(k) == right) - (self.word(k) == left)
            if depth == 0:
                return k
            k -= 1
        return -1

    def back(self, k: int) -> int:
        """The first of the modifiers and annotations before `k`."""
        while k > 0:
            j = k - 1
            if self.word(j) in MODIFIERS:
                k = j
                continue
            if self.word(j) == ")":
                j = self.opening(j) - 1
            while j > 1 and self.tokens[j][0] == "name" and self.word(j - 1) == ".":
                j -= 2
            if j < 1 or self.tokens[j][0] != "name" or self.word(j - 1) != "@":
                return k
            k = j - 1
        return k

    def called(self, k: int) -> tuple[int, int]:
        """Where the name before the round brackets closed at `k` begins and ends, without its type arguments; -1 if there is none."""
        end = self.opening(k) - 1 if self.word(k) == ")" else -1
        if self.word(end) == ">":
            end = self.opening(end) - 1
        if end < 0 or self.tokens[end][0] != "name" or self.word(end) in NO_CALL:
            return -1, -1
        first = end
        while first > 1 and self.word(first - 1) == ".":
            first -= 2
        return first, end

    def is_anonymous(self, k: int) -> bool:
        first, _ = self.called(k - 1)
        return first > 0 and self.word(first - 1) == "new"

    def method_before(self, k: int) -> int | None:
        """Where the method begins whose body opens at `k`."""
        j = k - 1
        while j > 0 and (self.tokens[j][0] == "name" and self.word(j) not in NO_CALL - {"throws"} or self.word(j) in (",", ".")):
            j -= 1
            if self.word(j + 1) == "throws":
                break
        if j < k - 1 and self.word(j + 1) != "throws":
            return None
        first, end = self.called(j)
        if first < 0 or first != end or self.word(first - 1) in ("new", "@", "->", "="):
            return None
        first -= 1
        while first >= 0 and (self.word(first) in ("[", "]", ".") or self.word(first) == ">" and self.opening(first) > 0 or self.tokens[first][0] == "name" and self.word(first) not in MODIFIERS | NO_CALL):
            first = (self.opening(first) if self.word(first) == ">" else first) - 1
        return self.back(first + 1)

    def skip(self, k: int, left: str, right: str) -> int:
        """The place behind the bracket that closes the one at `k`; braces inside are passed whole."""
        if left == "{":
            return self.ends[k][1]
        depth = 0
        while k < self.stop:
            word = self.word(k)
            if word == "}" or word == ";" and self.word(k - 2) != "&":  # in pages, &lt; may stand for a bracket
                break
            if word == "{":
                k = self.ends[k][1]
                continue
            depth += (word == left) - (word == right)
            k += 1
            if depth == 0:
                return k
        raise ValueError("unclosed bracket")

    def next_member(self, k: int) -> int:
        """Where reading goes on after the broken member that begins at `k`."""
        k += 1
        while k < self.stop and self.word(k) != "}":
            if self.word(k) in ("{", ";"):
                return self.ends[k][1] if self.word(k) == "{" else k + 1
            if self.word(k) in RESERVED - {"final", "synchronized"} or self.heads_type(k):
                return self.back(k)
            k += 1
        return k

    def read(self, k: int, outer: list[str]) -> int:
        """A declaration, or what is left of a broken one."""
        try:
            end = self.declaration(k, outer)
        except (ValueError, KeyError, IndexError):
            end = self.next_member(k)
        return max(end, k + 1)

    def shape(self, a: int, b: int) -> str:
        """Digest of the structure: names and literals are only kinds, modifiers and annotations don't count."""
        out, k, tokens = [], a, self.tokens
        while k < b:
            kind, word = tokens[k][0], tokens[k][1]
            if word == "@" and self.word(k + 1) != "interface":
                k = self.left_open(k)
                continue
            if word not in MODIFIERS:
                out.append("l" if kind == "literal" else word if kind == "op" or word in NO_CALL or word in TYPE_KINDS else "i")
            k += 1
        return hashlib.sha256(" ".join(out).encode()).hexdigest()

    def annotation(self, k: int) -> int:
        k += 2
        while self.word(k) == ".":
            k += 2
        return self.skip(k, "(", ")") if self.word(k) == "(" else k

    def modifiers(self, k: int) -> tuple[int, list[str], set[str]]:
        notes, words = [], set()
        while True:
            if self.word(k) == "@" and self.word(k + 1) != "interface":
                end = self.annotation(k)
                notes.append(self.span(k, end))
                k = end
            elif self.word(k) in MODIFIERS:
                words.add(self.word(k))
                k += 1
            elif self.word(k) == "non" and self.word(k + 1) == "-":
                k += 3
            else:
                return k, notes, words

    def types_in(self, a: int, b: int) -> list[str]:
        """Capitalised names among the tokens of a declaration, those of annotations and behind dots aside."""
        out = []
        for k in range(a, b):
            kind, word = self.tokens[k][:2]
            if kind == "name" and word[:1].isupper() and self.word(k - 1) not in (".", "@") and self.word(k + 1) != ".":
                out.append(word)
        return list(dict.fromkeys(out))

    def type_end(self, k: int) -> int:
        """Behind the type that begins at `k`, or `k` if none does."""
        if self.tokens[k][0] != "name" or self.word(k) in NO_CALL or self.word(k) in MODIFIERS:
            return k
        end = k + 1
        while True:
            if self.word(end) == "." and end + 1 < len(self.tokens) and self.tokens[end + 1][0] == "name":
                end += 2
            elif self.word(end) == "<":
                depth, at = 0, end
                while at < self.stop and (self.tokens[at][0] == "name" or self.word(at) in ("<", ">", ",", ".", "?", "&", "[", "]")):
                    depth += (self.word(at) == "<") - (self.word(at) == ">")
                    at += 1
                    if depth == 0:
                        break
                if depth:
                    return k
                end = at
            elif self.word(end) == "[" and self.word(end + 1) == "]":
                end += 2
            elif self.word(end) == "...":
                return end + 1
            else:
                return end

    def simple(self, a: int, b: int) -> str:
        """The last name of a type without its arguments, with `[]` where it is an array."""
        name, depth = "", 0
        for k in range(a, b):
            depth += (self.word(k) == "<") - (self.word(k) == ">")
            if depth == 0 and self.tokens[k][0] == "name":
                name = self.word(k)
        return name + "[]" * (self.word(b - 1) in ("]", "..."))

    def variables(self, a: int, b: int) -> Iterator[tuple[str, int, int]]:
        """Names that are declared among tokens, each with where its type begins and ends."""
        k = a
        while k < b - 1:
            if self.tokens[k][0] == "name" and self.word(k - 1) not in (".", "new", "@", "::"):
                end = self.type_end(k)
                if k < end < b and self.tokens[end][0] == "name" and self.word(end) not in NO_CALL and self.word(end) != "instanceof" and self.word(end + 1) in ("=", ";", ",", ":", ")", "[", "&&"):
                    yield self.word(end), k, end
                    k = end + 1
                    continue
            k += 1

    def arguments_of(self, k: int, b: int) -> int:
        """How many arguments stand in the round brackets that open at `k`."""
        depth, count = 0, 0
        for j in range(k, b):
            word = self.word(j)
            depth += (word in ("(", "[", "{")) - (word in (")", "]", "}"))
            if depth == 0:
                return count + (j > k + 1)
            count += depth == 1 and word == "," and not self.in_type(j)
        return count

    def in_type(self, k: int) -> bool:
        """Whether a comma parts type arguments: names and signs of types lead back to `<` behind a name, and on to `>`."""
        j = k - 1
        while self.tokens[j][0] == "name" or self.word(j) in (".", "?", ","):
            j -= 1
        after = k + 1
        while after < len(self.tokens) and (self.tokens[after][0] == "name" or self.word(after) in (".", "?", ",", "[", "]")):
            after += 1
        return self.word(j) == "<" and self.word(after) in (">", "<")

    def calls_in(self, a: int, b: int) -> list[tuple[str | None, str, int]]:
        """(receiver, name, arguments) of calls; the receiver is '' behind another call or bracket, null for the class's own."""
        out = []
        for k in range(a, b):
            word = self.words[k]
            if self.words[k + 1] == "(" and self.tokens[k][0] == "name" and word not in NO_CALL and self.word(k - 1) != "new":
                receiver = None
                if self.word(k - 1) == ".":
                    receiver = self.word(k - 2) if self.tokens[k - 2][0] == "name" and (self.word(k - 3) != "." or self.word(k - 4) == "this" or self.word(k - 2)[:1].isupper()) else ""
                out.append((receiver, word, self.arguments_of(k + 1, b)))
        return out

    def accesses(self, a: int, b: int) -> list[tuple[str, str]]:
        """(receiver, field) where a field of this, of a variable or of a class is read or written."""
        out = []
        for k in range(a + 2, b):
            if self.words[k - 1] == "." and self.tokens[k][0] == "name" and self.tokens[k - 2][0] == "name" and self.word(k - 3) != "." and self.word(k + 1) != "(" and self.word(k) not in ("class", "this", "super", "new"):
                out.append((self.word(k - 2), self.word(k)))
        return list(dict.fromkeys(out))

    def dotted(self, k: int) -> tuple[str, int]:
        """A name with dots and the place behind it and its semicolon, which may be missing."""
        end = k
        while self.word(end) == "." or end < len(self.tokens) and (self.tokens[end][0] == "name" or self.word(end) == "*") and (end == k or self.word(end - 1) == "."):
            end += 1
        return "".join(self.word(j) for j in range(k, end)), end + (self.word(end) == ";")

    def unit(self) -> None:
        self.package, self.imports, k = "", {}, 0
        try:
            start, _, _ = self.modifiers(0)
        except ValueError:
            start = 0
        if self.word(start) == "package":
            self.package, k = self.dotted(start + 1)
        while k < len(self.tokens):
            if self.word(k) == "import":
                name, k = self.dotted(k + 1 + (self.word(k + 1) == "static"))
                if not name.endswith("*"):
                    self.imports[name.rpartition(".")[2]] = name
            else:
                k = self.read(k, [])

    def declaration(self, k: int, outer: list[str]) -> int:
        start = k
        k, notes, words = self.modifiers(k)
        word = self.word(k)
        kind = "annotation" if word == "@" else word
        if kind in TYPE_KINDS and self.tokens[k + 1][0] == "name" or kind == "annotation":
            return self.type_declaration(start, k + (2 if word == "@" else 1), kind, notes, words, outer)
        if word == "{":
            return self.skip(k, "{", "}")
        if word in (";", "}") or not outer:
            return k + 1
        return self.member(k, notes, words)

    def type_declaration(self, start: int, k: int, kind: str, notes: list[str], words: set[str], outer: list[str]) -> int:
        name = self.word(k)
        head = k
        while self.word(k) != "{":
            k = self.skip(k, "(", ")") if self.word(k) == "(" else k + 1
            if self.word(k) in ("", "}") or self.heads_type(k) or k >= self.stop:
                raise ValueError("no body")
        stop, end = self.ends[k]
        supers, depth, listing, handles = [], 0, False, None
        for j in range(head + 1, k):
            w = self.word(j)
            depth += (w == "<") - (w == ">")
            if w in ("extends", "implements") and depth == 0:
                listing = True
            elif w == "permits":
                listing = False
            elif listing and depth == 0 and self.tokens[j][0] == "name" and self.word(j + 1) != ".":
                supers.append(w)
                if w in HANDLERS and self.word(j + 1) == "<":  # the first type argument is the annotation that it handles
                    handles = self.word(j + 2)
        scope = ".".join([self.package] * bool(self.package) + outer)
        own = {
            "kind": kind, "class_name": name, "full_class_name": f"{scope}.{name}" if scope else name, "parent_class": scope if outer else None, "is_nested": bool(outer), "is_abstract": "abstract" in words or kind == "interface",
            "annotations": notes, "supertypes": supers, "handles": handles, "shape": self.shape(start, end), "methods": [], "fields": [], "used_types": [],
        }
        self.classes.append(own)
        k += 1
        before, self.own, around, self.stop = getattr(self, "own", None), own, self.stop, stop
        if kind == "enum":
            while k < stop and self.word(k) != ";" and self.word(k) not in RESERVED:
                try:
                    k = self.skip(k, self.word(k), {"(": ")", "{": "}"}[self.word(k)]) if self.word(k) in ("(", "{") else k + 1
                except ValueError:
                    k += 1
            k += k < stop and self.word(k) == ";"
        while k < stop:
            self.own = own
            k = self.read(k, [*outer, name])
            self.stop = stop
        self.own, self.stop = before, around
        return end

    def member(self, k: int, notes: list[str], words: set[str]) -> int:
        start = k
        if self.word(k) == "<":
            k = self.skip(k, "<", ">")
        first, named = k, 0
        while k < self.stop and self.word(k) not in ("(", "=", ";", "{", "}"):
            if self.word(k) in RESERVED:
                break
            if self.word(k) == "@":
                k = self.annotation(k)
                continue
            if k > first and self.tokens[k][0] == "name" and self.word(k - 1) not in (".", ",") and not self.annotated(k):
                if named:  # a third word: a member begins here, or with its type
                    k = named if self.word(k + 1) == "(" and self.word(k) != self.own["class_name"] else k
                    break
                named = k
            k = self.skip(k, "<", ">") if self.word(k) == "<" else k + 1
        if self.word(k) != "(" or k >= self.stop:
            self.own["used_types"] += [t for t in self.types_in(first, k - 1) if t not in self.own["used_types"]]
            if named > first:
                self.own["fields"].append({"name": self.word(named), "type": self.simple(first, named)})
            return self.field_end(k)
        name, shut = self.word(k - 1), self.skip(k, "(", ")")
        if self.word(k - 2) == "." or self.word(first) in NO_CALL or name in NO_CALL:
            raise ValueError("a statement")
        body = shut
        while body < self.stop and self.word(body) not in ("{", ";", "}") and self.word(body) not in RESERVED:
            body += 1
        has_body = body < self.stop and self.word(body) == "{"
        shut_off = body < self.stop and self.word(body) == ";"
        end = self.ends[body][1] if has_body else body + shut_off
        if k - 1 > first:  # without a type before its name it is a constructor
            signature = name + re.sub(r"\s+([)>])", r"\1", re.sub(r"([(<])\s+", r"\1", " ".join(self.span(k, shut).split())))
            at = self.tokens[k - 1][2]
            column = at - self.text.rfind("\n", 0, at) - 1
            inside = (body + 1, self.ends[body][0]) if has_body else (end, end)
            given = list(self.variables(k + 1, shut))
            declared = list(self.variables(*inside))
            types = self.types_in(first, k - 1) + [t for _, i, j in (*given, *declared) for t in self.types_in(i, j)]
            self.own["methods"].append({
                "name": name, "signature": signature, "return_type": self.span(first, k - 1), "parameters": [self.simple(i, j) for _, i, j in given], "annotations": notes, "calls": self.calls_in(*inside),
                "field_access": self.accesses(*inside), "used_types": list(dict.fromkeys(types)), "body": self.span(*inside) if has_body else "", "shape": self.shape(start, end) if has_body else "",
                "is_abstract": shut_off or not has_body and "abstract" in words, "line": self.text.count("\n", 0, at), "column_start": column, "column_end": column + len(name),
                "variables": {n: self.simple(i, j) for n, i, j in (*given, *declared)},
            })
        return end

    def annotated(self, k: int) -> bool:
        """Whether an annotation stands right before `k`."""
        return self.back(k) < k and self.word(k - 1) not in MODIFIERS

    def field_end(self, k: int) -> int:
        """Behind the semicolon of a field, or where the next member begins if it has none."""
        free = True  # whether a name can't follow a name
        while k < self.stop and self.word(k) not in (";", "}") and self.word(k) not in RESERVED:
            word = self.word(k)
            free = free and word not in ("instanceof", "@")
            if free and self.tokens[k][0] == "name":
                kind, before = self.tokens[k - 1][:2]
                if kind == "literal" and before != "." or before == ")" and word in PRIMITIVE:
                    return k
                if kind == "name" and before not in ("new", "switch", "case", "final"):
                    return k - 1 if self.word(k - 2) == ")" else k
            if word in ("(", "{", "["):
                k = self.skip(k, word, {"(": ")", "{": "}", "[": "]"}[word])
            else:
                k += 1
        return k + (k < self.stop and self.word(k) == ";")


def _typed(classes: list[dict]) -> None:
    """Gives calls and field accesses the simple types of their receivers, as far as the file tells them."""
    by_name = {c["full_class_name"]: c for c in classes}
    for c in classes:
        fields, outer = {}, c
        while outer is not None:
            fields = {f["name"]: f["type"] for f in outer["fields"]} | fields
            outer = by_name.get(outer["parent_class"])
        for m in c["methods"]:
            known = fields | m.pop("variables") | {"this": c["class_name"]}
            type_of = lambda r: c["class_name"] if r is None else known.get(r, r if r[:1].isupper() else None)
            m["calls"] = [{"receiver": r, "name": n, "type": type_of(r), "arguments": k} for r, n, k in m["calls"]]
            m["field_access"] = [f"{t}.{f}" for r, f in m["field_access"] if (t := type_of(r))]


def facts(text: str | None) -> list[dict]:
    """Classes of a source with what they declare and refer to, as far as a broken one can be read."""
    if not text:
        return []
    source = _Source(text)
    source.unit()
    _typed(source.classes)
    return [{**c, "package": source.package, "imports": source.imports} for c in source.classes]


def extract(files: DataFrame) -> DataFrame:
    """Class rows of files (file_id, content)."""
    columns = [c.split()[0] for c in re.split(r", (?=\w+ (?:long|string|boolean|array|map))", SCHEMA)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, text in zip(frame["file_id"], frame["content"]):
                rows += [{"file_id": file_id, **c} for c in facts(text)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file_id", "content").mapInPandas(run, SCHEMA)
