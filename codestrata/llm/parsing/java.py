"""Words of Java 17."""

from __future__ import annotations

import itertools
import re

import regex

from codestrata.llm.parsing.lr import Several

# fixed values: keywords of the Java language specification, chapter 3.9
KEYWORDS = """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for
goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch
synchronized this throw throws transient try void volatile while _ true false null""".split()
CONTEXTUAL = "record sealed permits yield open module requires transitive exports opens to uses provides with".split()

_WORD = regex.compile(
    r"""(?P<space>[ \t\f\r\n]+|//[^\r\n]*|/\*.*?\*/)
|(?P<non>non-sealed(?![\p{L}\p{N}_$]))
|(?P<id>[\p{L}\p{Nl}\p{Sc}\p{Pc}][\p{L}\p{Nl}\p{Sc}\p{Pc}\p{Mn}\p{Mc}\p{Nd}]*)
|(?P<float>(?:0[xX](?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?\.?|(?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?\.[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)[pP][+-]?\d(?:[\d_]*\d)?[fFdD]?
 |\d(?:[\d_]*\d)?\.(?:\d(?:[\d_]*\d)?)?(?:[eE][+-]?\d(?:[\d_]*\d)?)?[fFdD]?|\.\d(?:[\d_]*\d)?(?:[eE][+-]?\d(?:[\d_]*\d)?)?[fFdD]?
 |\d(?:[\d_]*\d)?(?:[eE][+-]?\d(?:[\d_]*\d)?[fFdD]?|[fFdD])))
|(?P<int>(?:0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?|0[bB][01](?:[01_]*[01])?|0[0-7_]*[0-7]|0|[1-9](?:[\d_]*\d)?)[lL]?)
|(?P<text>\"\"\"[ \t\f]*(?:\r\n|\r|\n)(?:[^\\"]|\\.|"(?!""))*\"\"\")
|(?P<string>"(?:[^"\\\r\n]|\\(?:[btnfrs"'\\]|[0-3]?[0-7]{1,2}))*")
|(?P<char>'(?:[^'\\\r\n]|\\(?:[btnfrs"'\\]|[0-3]?[0-7]{1,2}))')
|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|<=|==|!=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[(){}\[\];,.@=<!~?:+\-*/&|^%])
|(?P<gt>>)""",
    regex.VERBOSE | regex.DOTALL,
)
_ESCAPED = regex.compile(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})")


#: Pieces of a text, every character in one: space, strings, numbers with what hangs on them, names, signs.
_PIECE = re.compile(
    r"""[ \t\f\r\n]+|//[^\r\n]*|/\*.*?\*/
|non-sealed(?![\w$])
|\.?[0-9](?:(?<=0)[xX][0-9a-fA-F_.]*(?:[pP][+-]?)?[\w$.]*|(?:[eE][+-](?=[0-9])|[\w$]|\.(?!\.))*)
|[^\x00-\x23\x25-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f\x80-\xa0]+
|\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*'
|\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|<=|==|!=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|>+={0,2}|.""",
    re.VERBOSE | re.DOTALL,
)
BAD = -1  # no terminal: no stack goes on with it


class _Terminals(dict):
    """Memo from pieces to terminals: None for space, BAD for what is no word."""

    def __init__(self, terminals: dict[str, int]):
        super().__init__()
        self.terminals = terminals
        self.fixed = {w: terminals.get(w, BAD) for w in KEYWORDS}
        self.choice = {w: (terminals[w], terminals["ID"]) for w in CONTEXTUAL}
        self.kinds = {"id": terminals["ID"], "float": terminals["FLOAT"], "int": terminals["INT"], "text": terminals["STRING"], "string": terminals["STRING"], "char": terminals["CHAR"], "non": terminals["non-sealed"], "space": None}

    def __missing__(self, piece: str):
        found = self.judge(piece)
        if piece[0] not in "\"'/" and len(self) < 200_000:
            self[piece] = found
        return found

    def judge(self, piece: str):
        if piece[0] == ">":
            signs, equal = piece.rstrip("="), len(piece) - len(piece.rstrip("="))
            ends = [">_"] * (len(signs) - 1) + [">_" if equal else ">"] + ["=" * equal] * bool(equal)
            codes = [self.terminals[e] for e in ends]
            return codes[0] if len(codes) == 1 else Several(codes)
        m = _WORD.fullmatch(piece)
        if m is None:
            return BAD
        if m.lastgroup == "op":
            return self.terminals[piece]
        if m.lastgroup == "id" and piece in self.fixed:
            return self.fixed[piece]
        return self.choice.get(piece, self.kinds[m.lastgroup])


_memos: dict[int, _Terminals] = {}


class Places:
    """Places of the words among pieces, worked out when one is asked for."""

    def __init__(self, pieces: list[str], kinds: list):
        self.pieces, self.kinds, self.size = pieces, kinds, sum(k is not None for k in kinds) + 1

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, number: int) -> int:
        starts = itertools.accumulate(map(len, self.pieces), initial=0)
        return next(itertools.islice((at for at, kind in zip(starts, [*self.kinds, 0]) if kind is not None), number, None))


def words(text: str, terminals: dict[str, int]) -> tuple[list, Places, int | None]:
    """Terminals and their places; what is no word is BAD, so that the parser stops there."""
    if "\\u" in text:
        text = _ESCAPED.sub(lambda m: m[1] + chr(int(m[2], 16)), text)
    if text.endswith("\x1a"):
        text = text[:-1]
    memo = _memos.get(id(terminals))
    if memo is None or memo.terminals is not terminals:
        memo = _memos[id(terminals)] = _Terminals(terminals)
    pieces = _PIECE.findall(text)
    kinds = list(map(memo.__getitem__, pieces))
    out = [k for k in kinds if k is not None]
    out.append(0)
    return out, Places(pieces, kinds), None
