"""Words of YAML 1.1: indents and simple keys become words of their own, so that a context-free grammar can go on."""

from __future__ import annotations

import regex

_BREAK = "\n\r\x85\u2028\u2029"
_END = " \t\n\r\x85\u2028\u2029"
_PRINTABLE = regex.compile(r"[^\x09\x0A\x0D\x20-\x7E\x85\xA0-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
_DOUBLE_ESCAPE = regex.compile(r"\\(?:[0abt\tnvfre \"\\/N_LP]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|\r\n|[\n\r\x85\u2028\u2029])")
_NAME = regex.compile(r"[-\w]+")
_TAG = regex.compile(r"!<[^\s>]+>|![-\w]*!?[-;/?:@&=+$,_.!~*'()\[\]%#\w]*")


class _Stop(Exception):
    def __init__(self, at: int):
        self.at = at


class _Scanner:
    def __init__(self, text: str, terminals: dict[str, int]):
        self.s, self.t, self.n = text, terminals, len(text)
        self.at = 1 if text.startswith("\ufeff") else 0
        self.line, self.line_start = 0, self.at
        self.indent, self.indents, self.flow = -1, [], []
        self.out: list[list] = []
        self.key_ok = True
        self.keys: dict[int, tuple] = {}

    def peek(self, k: int = 0) -> str:
        return self.s[self.at + k] if self.at + k < self.n else "\0"

    def column(self) -> int:
        return self.at - self.line_start

    def put(self, kind: str, at: int | None = None) -> None:
        self.out.append([self.t[kind], self.at if at is None else at])

    def newline(self) -> bool:
        """Goes over a line break, if there is one here."""
        if self.at < self.n and self.s[self.at] in _BREAK:
            self.at += 2 if self.s.startswith("\r\n", self.at) else 1
            self.line, self.line_start = self.line + 1, self.at
            return True
        return False

    def run(self) -> None:
        while True:
            self.skip()
            self.drop_old_keys()
            self.unwind(self.column())
            if self.at >= self.n:
                self.unwind(-1)
                for key in list(self.keys):
                    self.drop(key)
                if self.flow:
                    raise _Stop(self.n)
                self.out.append([0, self.n])
                return
            c, nxt = self.peek(), self.peek(1)
            space = nxt in _END or nxt == "\0"
            start = self.column() == 0
            if c == "%" and start:
                self.directive()
            elif start and self.s.startswith(("---", "..."), self.at) and (self.peek(3) in _END or self.at + 3 >= self.n):
                if self.flow:
                    raise _Stop(self.at)
                self.unwind(-1)
                self.drop(0)
                self.key_ok = False
                self.put("DOCSTART" if c == "-" else "DOCEND")
                self.at += 3
            elif c in "[{":
                self.save()
                self.put(c)
                self.flow.append(c)
                self.key_ok = True
                self.at += 1
            elif c in "]}":
                if not self.flow:
                    raise _Stop(self.at)
                self.drop(len(self.flow))
                self.flow.pop()
                self.key_ok = False
                self.put(c)
                self.at += 1
            elif c == "," and self.flow:
                self.drop(len(self.flow))
                self.key_ok = True
                self.put(",")
                self.at += 1
            elif c == "-" and space:
                if self.flow:
                    raise _Stop(self.at)
                if not self.key_ok:
                    raise _Stop(self.at)
                if self.column() > self.indent:
                    self.indents.append(self.indent)
                    self.indent = self.column()
                    self.put("SEQSTART")
                self.drop(0)
                self.key_ok = True
                self.put("ENTRY")
                self.at += 1
            elif c == "?" and space:
                if not self.flow:
                    if not self.key_ok:
                        raise _Stop(self.at)
                    self.open_map(self.column(), len(self.out))
                self.drop(len(self.flow))
                self.key_ok = not self.flow
                self.put("KEY")
                self.at += 1
            elif c == ":" and (self.flow or space) and (space or nxt in ",[]{}" or self.after_json()):
                self.value()
            elif c in "*&":
                self.save()
                self.key_ok = False
                m = _NAME.match(self.s, self.at + 1)
                if m is None:
                    raise _Stop(self.at)
                end = self.s[m.end() : m.end() + 1]
                if end and end not in _END + "?:,]}%@`":
                    raise _Stop(m.end())
                self.put("ALIAS" if c == "*" else "ANCHOR")
                self.at = m.end()
            elif c == "!":
                self.save()
                self.key_ok = False
                m = _TAG.match(self.s, self.at)
                if self.peek(1) in _END:
                    end = self.at + 1
                else:
                    end = m.end()
                    while self.flow and self.s[end - 1] in ",]}":
                        end -= 1
                nxt = self.s[end : end + 1]
                if nxt and nxt not in _END and not (self.flow and nxt in ",]}"):
                    raise _Stop(end)
                self.put("TAG")
                self.at = end
            elif c in "|>" and not self.flow:
                self.block_scalar()
            elif c in "'\"":
                self.save()
                self.key_ok = False
                self.quoted(c)
            elif (c not in "\0 \t\r\n\x85\u2028\u2029-?:,[]{}#&*!|>'\"%@`") or (not space and (c == "-" or (c in "?:" and not self.flow))) or (c in "?" and self.flow and nxt not in _END + ",[]{}"):
                self.plain()
            else:
                raise _Stop(self.at)

    def after_json(self) -> bool:
        """In flow context a colon may follow a quoted scalar or a closing bracket at once."""
        return bool(self.flow) and self.at > 0 and self.s[self.at - 1] in "'\"]}"

    def skip(self) -> None:
        while True:
            while self.at < self.n and (self.s[self.at] == " " or (self.s[self.at] == "\t" and (self.flow or not self.key_ok))):
                self.at += 1
            if self.peek() == "\t" and self.s[self.line_start : self.at].strip() == "" and regex.match(r"[ \t]*(?:#|[\r\n]|$)", self.s[self.at : self.at + 200]):
                while self.peek() in " \t":
                    self.at += 1
            if self.peek() == "#":
                while self.at < self.n and self.s[self.at] not in _BREAK:
                    self.at += 1
            if not self.newline():
                return
            if not self.flow:
                self.key_ok = True

    def drop_old_keys(self) -> None:
        for level, key in list(self.keys.items()):
            if key[1] != self.line or self.at - key[2] > 1024:
                if key[3]:
                    raise _Stop(key[2])
                del self.keys[level]

    def drop(self, level: int) -> None:
        key = self.keys.pop(level, None)
        if key and key[3]:
            raise _Stop(key[2])

    def save(self) -> None:
        needed = not self.flow and self.indent == self.column()
        if self.key_ok:
            self.drop(len(self.flow))
            self.keys[len(self.flow)] = (len(self.out), self.line, self.at, needed, self.column())

    def unwind(self, column: int) -> None:
        if self.flow:
            return
        while self.indent > column:
            self.indent = self.indents.pop()
            self.put("BLOCKEND")

    def open_map(self, column: int, where: int) -> None:
        if self.indent < column:
            self.indents.append(self.indent)
            self.indent = column
            self.out.insert(where, [self.t["MAPSTART"], self.out[where][1] if where < len(self.out) else self.at])

    def value(self) -> None:
        key = self.keys.pop(len(self.flow), None)
        if key:
            self.out.insert(key[0], [self.t["KEY"], key[2]])
            if not self.flow:
                self.open_map(key[4], key[0])
            self.key_ok = False
        else:
            if not self.flow:
                if not self.key_ok:
                    raise _Stop(self.at)
                self.open_map(self.column(), len(self.out))
            self.key_ok = not self.flow
            self.drop(len(self.flow))
        self.put("VALUE")
        self.at += 1

    def directive(self) -> None:
        self.unwind(-1)
        self.drop(0)
        self.key_ok = False
        end = self.at
        while end < self.n and self.s[end] not in _BREAK:
            end += 1
        line = self.s[self.at : end]
        if regex.match(r"%(?:YAML|TAG)\b", line) and not regex.fullmatch(r"%YAML[ ]+1\.\d+[ \t]*(?:#.*)?|%TAG[ ]+![-\w]*!?[ ]+\S+[ \t]*(?:#.*)?", line):
            raise _Stop(self.at)
        self.put("DIRECTIVE")
        self.at = end

    def block_scalar(self) -> None:
        self.key_ok = True
        self.drop(len(self.flow))
        start = self.at
        m = regex.compile(r"[|>](?:[+-][1-9]?|[1-9][+-]?)?[ \t]*(?:(?<=[ \t])#[^\r\n\x85\u2028\u2029]*)?(?=[\r\n\x85\u2028\u2029]|\Z)").match(self.s, self.at)
        if m is None:
            raise _Stop(self.at)
        least = max(self.indent + 1, 1)
        given = regex.search(r"[1-9]", m.group().split("#")[0])
        self.at = m.end()
        self.newline()
        if given:
            indent = least + int(given.group()) - 1
        else:  # the widest of the leading blank lines, or the first line with text
            widest, mark = 0, (self.at, self.line, self.line_start)
            while True:
                while self.peek() == " ":
                    self.at += 1
                widest = max(widest, self.column())
                if not self.newline():
                    break
            indent = max(least, widest)
            self.at, self.line, self.line_start = mark
        while True:
            while self.column() < indent and self.peek() == " ":
                self.at += 1
            if self.newline():
                continue
            if self.at >= self.n or self.column() < indent:
                break
            while self.at < self.n and self.s[self.at] not in _BREAK:
                self.at += 1
        self.put("BLOCKSCALAR", start)

    def quoted(self, q: str) -> None:
        start = self.at
        self.at += 1
        while True:
            if self.at >= self.n:
                raise _Stop(start)
            c = self.s[self.at]
            if c == q:
                if q == "'" and self.peek(1) == "'":
                    self.at += 2
                    continue
                self.at += 1
                break
            if c == "\\" and q == '"':
                m = _DOUBLE_ESCAPE.match(self.s, self.at)
                if m is None:
                    raise _Stop(self.at)
                if m.group()[1] in _BREAK:
                    self.at += 1
                    self.newline()
                else:
                    self.at = m.end()
                continue
            if self.newline():
                if self.s.startswith(("---", "..."), self.at) and (self.peek(3) in _END or self.at + 3 >= self.n):
                    raise _Stop(self.at)
                continue
            self.at += 1
        self.put("SCALAR", start)

    def plain(self) -> None:
        self.save()
        self.key_ok = False
        start, s, indent = self.at, self.s, self.indent + 1
        while True:
            if self.peek() == "#" and self.at > start:
                break
            begin = self.at
            while self.at < self.n:
                c = s[self.at]
                nxt = s[self.at + 1] if self.at + 1 < self.n else " "
                if c in _END or (c == ":" and (nxt in _END or (self.flow and nxt in ",[]{}"))) or (self.flow and c in ",[]{}") or (self.flow and c == "?" and nxt in _END):
                    break
                self.at += 1
            if self.at == begin:
                break
            end = self.at
            while self.peek() in " \t":
                self.at += 1
            if self.peek() in _BREAK and self.at < self.n:
                self.newline()
                stop = False
                while True:
                    if s.startswith(("---", "..."), self.at) and self.column() == 0 and (self.peek(3) in _END or self.at + 3 >= self.n):
                        stop = True
                        break
                    while self.peek() == " ":
                        self.at += 1
                    if not self.newline():
                        break
                if not self.flow:
                    self.key_ok = True
                if stop or self.at >= self.n or self.peek() == "#" or (not self.flow and self.column() < indent):
                    break
                if self.peek() == "\t" and not self.flow:
                    while self.peek() in " \t":
                        self.at += 1
            elif self.at >= self.n or self.peek() == "#" or self.at == end:
                break
        self.put("SCALAR", start)


def words(text: str, terminals: dict[str, int]) -> tuple[list, list[int], int | None]:
    """Terminals, their places, and the place of the first thing that is no word (None if there is none)."""
    bad = _PRINTABLE.search(text, 1 if text.startswith("\ufeff") else 0)
    if bad:
        return [], [], bad.start()
    scanner = _Scanner(text, terminals)
    fault = None
    try:
        scanner.run()
    except _Stop as stop:
        fault = stop.at
    return [w for w, _ in scanner.out], [p for _, p in scanner.out], fault
