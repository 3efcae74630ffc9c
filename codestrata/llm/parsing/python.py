"""Words of Python 3.13, with indents and the parts of f-strings."""

from __future__ import annotations

import keyword
import unicodedata

import regex

SOFT = ("match", "case", "type")
_NUMBER = regex.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][-+]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*"
)
_NAME = regex.compile(r"[\p{XID_Start}_][\p{XID_Continue}]*|[^\x00-\x7f]+")
_AFTER_NUMBER = regex.compile(r"(?:and|else|for|if|in|is|not|or)(?![\w])")
_OPERATOR = regex.compile(r"\.\.\.|\*\*=|//=|>>=|<<=|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:.;=!]")
_AUGMENTED = {"**=", "//=", ">>=", "<<=", "+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^="}
_PREFIX = regex.compile(r"(?i)(?:[rbuf]|br|rb|fr|rf)?(?:'''|\"\"\"|'|\")")
_SPACE = regex.compile(r"(?:[ \t\f]|\\(?:\r\n|\r|\n))+")
_BAD_ESCAPE = regex.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N(?!\{[^}]*\}))")
_BYTES_ESCAPE = regex.compile(r"\\x(?![0-9a-fA-F]{2})")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_SINGLE = {q: regex.compile(rf"(?:[^{q}\\\r\n]|\\(?:\r\n|[\s\S]))*{q}") for q in "'\""}
_TRIPLE = {q: regex.compile(rf"(?:[^{q}\\]|\\[\s\S]|{q}(?!{q}{q}))*{q * 3}") for q in "'\""}


class _Stop(Exception):
    def __init__(self, at: int):
        self.at = at


class _Reader:
    def __init__(self, text: str, terminals: dict[str, int]):
        self.text, self.t, self.out, self.places = text, terminals, [], []
        self.words = {w: terminals[w] for w in keyword.kwlist if w in terminals}
        self.dead = {w: -1 for w in keyword.kwlist if w not in terminals}
        self.name = terminals["NAME"]

    def put(self, kind, at: int) -> None:
        self.out.append(kind)
        self.places.append(at)

    def string(self, m) -> int:
        """Reads a string whose prefix and quote `m` matched; gives its end."""
        prefix, at = m.group().rstrip("'\"").lower(), m.end()
        quote = m.group()[len(prefix) :]
        if "f" in prefix:
            return self.fstring(m.start(), at, quote, "r" in prefix)
        body = (_SINGLE[quote] if len(quote) == 1 else _TRIPLE[quote[0]]).match(self.text, at)
        if body is None:
            raise _Stop(m.start())
        inside = body.group()[: -len(quote)]
        if "b" in prefix:
            if not inside.isascii() or ("r" not in prefix and _BYTES_ESCAPE.search(inside.replace("\\\\", "")) is not None):
                raise _Stop(m.start())
        elif "r" not in prefix and "\\" in inside:
            self.escapes(inside, m.start())
        self.put(self.t["BYTES" if "b" in prefix else "STRING"], m.start())
        return body.end()

    def escapes(self, inside: str, at: int) -> None:
        inside = inside.replace("\\\\", "")
        if _BAD_ESCAPE.search(inside):
            raise _Stop(at)
        for name in regex.findall(r"\\N\{([^}]*)\}", inside):
            try:
                unicodedata.lookup(name)
            except KeyError:
                raise _Stop(at) from None

    def fstring(self, start: int, at: int, quote: str, raw: bool) -> int:
        self.put(self.t["FSTART"], start)
        at = self.fbody(start, at, quote, raw, False)
        self.put(self.t["FEND"], at)
        return at + len(quote)

    def fbody(self, start: int, at: int, quote: str, raw: bool, spec: bool) -> int:
        """Reads text and replacement fields up to the quote (or, in a format spec, the closing brace)."""
        text, begin, end = self.text, at, len(self.text)

        def middle(to: int) -> None:
            if to > begin:
                if not raw and "\\" in text[begin:to]:
                    self.escapes(text[begin:to], start)
                self.put(self.t["FMIDDLE"], begin)

        while True:
            if at >= end:
                raise _Stop(start)
            if text.startswith(quote, at):
                middle(at)
                return at
            c = text[at]
            if c == "{":
                if not spec and text.startswith("{{", at):
                    at += 2
                    continue
                middle(at)
                at = begin = self.field(start, at, quote, raw)
            elif c == "}":
                if spec:
                    middle(at)
                    return at
                if not text.startswith("}}", at):
                    raise _Stop(at)
                at += 2
            elif c == "\\":
                if not raw and text.startswith("\\N{", at):
                    at = text.find("}", at) + 1 or end
                elif text[at + 1 : at + 2] in ("{", "}"):
                    at += 1
                else:
                    at += 2
            elif c in "\r\n" and len(quote) == 1:
                raise _Stop(start)
            else:
                at += 1

    def field(self, start: int, at: int, quote: str, raw: bool) -> int:
        """Reads `{expression}` with its conversion and format spec; gives the place behind it."""
        self.put(self.t["{"], at)
        at = self.code(at + 1, field=True)
        if self.text[at] == "!":
            self.put(self.t["!"], at)
            m = _NAME.match(self.text, at + 1)
            if m is None or m.group() not in ("s", "r", "a"):
                raise _Stop(at)
            self.put(self.name, m.start())
            at = _SPACE.match(self.text, m.end()).end() if _SPACE.match(self.text, m.end()) else m.end()
        if self.text[at : at + 1] == ":":
            self.put(self.t[":"], at)
            at = self.fbody(start, at + 1, quote, raw, True)
        if self.text[at : at + 1] != "}":
            raise _Stop(at)
        self.put(self.t["}"], at)
        return at + 1

    def code(self, at: int, field: bool = False) -> int:
        """Reads words to the end of the text or, in a replacement field, to what ends its expression."""
        text, end, t = self.text, len(self.text), self.t
        opened: list[tuple[str, int]] = []
        indents = [(0, 0)]
        fresh = not field  # at the start of a logical line
        while True:
            if fresh and not opened:
                column = alt = split = 0
                while at < end and (text[at] in " \t\f" or text[at] == "\\"):
                    if text[at] == "\\":  # an indent goes on in the next line; what stands before the first such place counts, if anything does
                        if text[at + 1 : at + 2] not in ("\r", "\n"):
                            break
                        split = split or column
                        at += 2 if text.startswith("\r\n", at + 1) else 1
                    elif text[at] == " ":
                        column, alt = column + 1, alt + 1
                    elif text[at] == "\t":
                        column, alt = (column // 8 + 1) * 8, alt + 1
                    else:
                        column = alt = 0
                    at += 1
                if at >= end or text[at] in "#\r\n":
                    if at < end and text[at] == "#":
                        at = self.eol(at)
                    if at >= end:
                        break
                    at += 2 if text.startswith("\r\n", at) else 1
                    continue
                if split:
                    column = alt = split
                fresh = False
                top = indents[-1]
                if column == top[0]:
                    if alt != top[1]:
                        raise _Stop(at)
                elif column > top[0]:
                    if alt <= top[1] or len(indents) >= 100:
                        raise _Stop(at)
                    indents.append((column, alt))
                    self.put(t["INDENT"], at)
                else:
                    while column < indents[-1][0]:
                        indents.pop()
                        self.put(t["DEDENT"], at)
                    if (column, alt) != indents[-1]:
                        raise _Stop(at)
            m = _SPACE.match(text, at)
            if m:
                at = m.end()
                if at >= end and m.group().rstrip("\r\n").endswith("\\"):
                    raise _Stop(at)
            if at >= end:
                break
            c = text[at]
            if c == "#":
                at = self.eol(at)
                continue
            if c in "\r\n":
                at2 = at + (2 if text.startswith("\r\n", at) else 1)
                if not opened and not field:
                    self.put(t["NEWLINE"], at)
                    fresh = True
                at = at2
                continue
            if field and not opened:
                if c in "}:" or (c == "!" and not text.startswith("!=", at)):
                    return at
            m = _PREFIX.match(text, at)
            if m:
                at = self.string(m)
                continue
            if c.isdecimal() and c.isascii() or (c == "." and text[at + 1 : at + 2].isdecimal() and text[at + 1] in "0123456789"):
                m = _NUMBER.match(text, at)
                if m is None:
                    raise _Stop(at)
                self.put(t["NUMBER"], at)
                at = m.end()
                nxt = text[at : at + 1]
                if nxt and (nxt.isalnum() or nxt == "_") and not _AFTER_NUMBER.match(text, at):
                    raise _Stop(at)
                continue
            m = _NAME.match(text, at)
            if m:
                word = m.group()
                if not word.isascii():
                    if not word.isidentifier():
                        raise _Stop(at)
                    word = unicodedata.normalize("NFKC", word)
                kind = self.words.get(word)
                if kind is None:
                    if word in self.dead:
                        kind = -1
                    elif word in SOFT:
                        kind = (t[word], self.name)
                    else:
                        kind = self.name
                self.put(kind, at)
                at = m.end()
                continue
            m = _OPERATOR.match(text, at)
            if m is None:
                raise _Stop(at)
            op = m.group()
            if op in _CLOSER:
                opened.append((op, at))
            elif op in ")]}":
                if not opened or _CLOSER[opened.pop()[0]] != op:
                    raise _Stop(at)
            elif op == ":=" and field and not opened:
                return at
            self.put(t["AUG"] if op in _AUGMENTED else t.get(op, -1), at)
            at = m.end()
        if opened or field:
            raise _Stop(opened[-1][1] if opened else at)
        if self.out and not fresh:
            self.put(t["NEWLINE"], end)
        for _ in indents[1:]:
            self.put(t["DEDENT"], end)
        return end

    def eol(self, at: int) -> int:
        m = regex.compile(r"[\r\n]").search(self.text, at)
        return m.start() if m else len(self.text)


def words(text: str, terminals: dict[str, int]) -> tuple[list, list[int], int | None]:
    """Terminals, their places, and the place of the first thing that is no word (None if there is none)."""
    reader = _Reader(text, terminals)
    shift = 1 if text.startswith("\ufeff") else 0
    if "\x00" in text:
        return [], [], text.index("\x00")
    try:
        reader.code(shift)
    except _Stop as stop:
        return reader.out, reader.places, stop.at
    reader.put(0, len(text))
    return reader.out, reader.places, None
