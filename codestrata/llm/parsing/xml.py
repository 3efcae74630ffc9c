"""Words of XML 1.0, with the constraints that make a document well-formed."""

from __future__ import annotations

import regex

_NAME = r"[:A-Z_a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C-\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF][-.:A-Z_a-z0-9\u00B7\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u037D\u037F-\u1FFF\u200C-\u200D\u203F-\u2040\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF]*"
_S = r"[ \t\r\n]"
_BAD = regex.compile(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
_WORD = regex.compile(
    rf"""(?P<comment><!--(?:(?!--).)*-->)|(?P<cdata><!\[CDATA\[.*?\]\]>)
|(?P<pi><\?(?P<target>{_NAME})(?:{_S}+(?:(?!\?>).)*)?\?>)
|(?P<close></(?P<closed>{_NAME}){_S}*>)
|(?P<tag><(?P<opened>{_NAME})(?P<attributes>(?:{_S}+{_NAME}{_S}*={_S}*(?:"[^<"]*"|'[^<']*'))*){_S}*(?P<empty>/?)>)
|(?P<space>{_S}+(?=<|\Z))|(?P<text>[^<]+)""",
    regex.DOTALL | regex.VERBOSE,
)
_DOCTYPE = regex.compile(rf"<!DOCTYPE{_S}+{_NAME}(?:{_S}+(?:SYSTEM{_S}+(?:\"[^\"]*\"|'[^']*')|PUBLIC{_S}+(?:\"[^\"]*\"|'[^']*'){_S}+(?:\"[^\"]*\"|'[^']*')))?{_S}*(?P<subset>\[(?:<!--.*?-->|<\?.*?\?>|\"[^\"]*\"|'[^']*'|[^\]\"'])*\]{_S}*)?>", regex.DOTALL)
_DECL = regex.compile(rf"<\?xml{_S}+version{_S}*={_S}*(?:\"1\.\d+\"|'1\.\d+')(?:{_S}+encoding{_S}*={_S}*(?:\"[A-Za-z][\w.\-]*\"|'[A-Za-z][\w.\-]*'))?(?:{_S}+standalone{_S}*={_S}*(?:\"(?:yes|no)\"|'(?:yes|no)'))?{_S}*\?>")
_ATTRIBUTE = regex.compile(rf"({_NAME}){_S}*={_S}*(\"[^\"]*\"|'[^']*')")
_REFERENCE = regex.compile(rf"&(?:({_NAME});|#(\d+);|#x([0-9a-fA-F]+);)?")
_ENTITY = regex.compile(rf"<!ENTITY{_S}+({_NAME})")
PREDEFINED = {"lt", "gt", "amp", "apos", "quot"}


def _reference_fault(text: str, known: set[str] | None) -> int | None:
    for m in _REFERENCE.finditer(text):
        name, dec, hexa = m.groups()
        if name is not None:
            if known is not None and name not in known:
                return m.start()
        elif dec or hexa:
            code = int(dec or hexa, 10 if dec else 16)
            if code > 0x10FFFF or _BAD.match(chr(code)):
                return m.start()
        else:
            return m.start()
    return None


def words(text: str, terminals: dict[str, int]) -> tuple[list, list[int], int | None]:
    """Terminals, their places, and the place of the first thing that is no word or breaks a constraint (None if none does)."""
    t, out, places, opened = terminals, [], [], []
    known: set[str] | None = PREDEFINED
    bad = _BAD.search(text)
    limit = bad.start() if bad else len(text)
    at = 1 if text.startswith("\ufeff") else 0
    m = _DECL.match(text, at)
    if m:
        out.append(t["DECL"])
        places.append(at)
        at = m.end()
    while at < limit:
        places.append(at)
        m = _DOCTYPE.match(text, at) if text.startswith("<!DOCTYPE", at) else _WORD.match(text, at)
        if m is None:
            return out, places, at
        if text.startswith("<!DOCTYPE", at):
            out.append(t["DOCTYPE"])
            subset = m["subset"] or ""
            # with an external subset or parameter entities an unknown name is no fault of well-formedness
            known = None if regex.search(r"SYSTEM|PUBLIC|%", m.group()) else PREDEFINED | set(_ENTITY.findall(subset))
        elif m["comment"] is not None:
            out.append(t["COMMENT"])
        elif m["cdata"] is not None:
            out.append(t["CDATA"])
        elif m["pi"] is not None:
            if m["target"].lower() == "xml":
                return out, places, at
            out.append(t["PI"])
        elif m["close"] is not None:
            if opened and opened[-1] != m["closed"]:
                return out, places, at
            if opened:
                opened.pop()
            out.append(t["CLOSE"])
        elif m["tag"] is not None:
            if m["attributes"]:
                names = set()
                for a in _ATTRIBUTE.finditer(m["attributes"]):
                    if a[1] in names or ("&" in a[2] and _reference_fault(a[2], known) is not None):
                        return out, places, at
                    names.add(a[1])
            if not m["empty"]:
                opened.append(m["opened"])
            out.append(t["EMPTY" if m["empty"] else "OPEN"])
        elif m["space"] is not None:
            out.append(t["SPACE"])
        else:
            body = m["text"]
            fault = _reference_fault(body, known) if "&" in body else None
            if fault is not None or "]]>" in body:
                return out, places, at + (fault or 0)
            out.append(t["TEXT"])
        at = m.end()
    if bad:
        places.append(limit)
        return out, places, limit
    places.append(at)
    out.append(0)
    return out, places, None
