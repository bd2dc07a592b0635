"""A mail as its reader sees it.

All text parts decoded, HTML tags and quote marks dropped. Damaged mail never
raises: what cannot be decoded is read as it stands.
"""

from __future__ import annotations

import binascii
import html
import re
from email.header import decode_header

_TYPE = re.compile(r"^content-type:[ \t]*((?:.*(?:\n[ \t].*)*))", re.I | re.M)
_CODED = re.compile(r"^content-transfer-encoding:[ \t\n]*([\w-]+)", re.I | re.M)
_SUBJECT = re.compile(r"^subject:[ \t]*((?:.*(?:\n[ \t].*)*))", re.I | re.M)
_BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"]*)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
_FIRST_BOUNDARY = re.compile(r"^--(\S.*)$", re.M)
_UNSEEN = re.compile(r"<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>", re.I | re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_LINE_END = re.compile(r"<br(?:\s[^<>]*)?/?>[ \t]*\n?", re.I)
_TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>")
#: At line starts: repeated > or |, each perhaps with up to three initials before it.
_QUOTE = re.compile(r"^[ \t]*(?:[A-Za-z]{0,3}[>|][ \t]?)+", re.M)
_ENCODED_GAP = re.compile(r"(\?=)\s+(=\?)")
_QP = re.compile(rb"=([0-9A-Fa-f]{2})|=[ \t]*\n")
_UU = re.compile(r"^begin [0-7]{3,4} (\S.*)\n((?:.*\n)*?)end[ \t]*$", re.M)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_BASE64_BODY = re.compile(r"\s*(?:[A-Za-z0-9+/]{60,78}\n)+[A-Za-z0-9+/]*={0,2}\s*\Z")
#: Runs of the characters that UTF-8 bytes turn into when they are read as Windows-1252.
_MISREAD = re.compile("[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{2,}")
_WORD = re.compile(r"[^\W_]+")


def _reread(run: re.Match) -> str:
    """The run as it was before a wrong charset, if it is such a run."""
    try:
        return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in run[0]).decode("utf-8")
    except UnicodeError:
        return run[0]


def _as_text(raw: bytes, head: str) -> str:
    """UTF-8 if it is, else the declared charset, else Latin-1: declared charsets are often wrong."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        named = _CHARSET.search(head)
        try:
            return raw.decode(named[1] if named else "latin-1")
        except (LookupError, UnicodeDecodeError):
            return raw.decode("latin-1")


def _from_base64(body: str) -> bytes:
    clean = _NOT_BASE64.sub("", body)
    return binascii.a2b_base64(clean[: len(clean) - (len(clean) % 4 == 1)] + "==="[: -len(clean) % 4] if len(clean) % 4 != 1 else clean[:-1])


def _decoded(head: str, body: str) -> str:
    found = _CODED.search(head)
    coding = found[1].lower() if found else ""
    if coding == "base64" or (not coding and _BASE64_BODY.match(body)):
        try:
            return _as_text(_from_base64(body), head).replace("\r\n", "\n")
        except (binascii.Error, ValueError):
            return body
    if coding == "quoted-printable":
        raw = _QP.sub(lambda m: bytes([int(m[1], 16)]) if m[1] else b"", body.encode("utf-8", "surrogatepass"))
        return _as_text(raw, head).replace("\r\n", "\n")
    return body


def _without_tags(text: str) -> str:
    text = _TAG.sub("\n", _LINE_END.sub("\n", _INLINE.sub("", _UNSEEN.sub("\n", text))))
    return html.unescape(text) if "&" in text else text


def _pieces(kind: str, body: str) -> list[tuple[str, str]] | None:
    """(head, body) of each piece of a multipart body; None if it has no boundary."""
    mark = _BOUNDARY.search(kind)
    mark = (mark[1] or mark[2]) if mark else None
    if not mark or f"--{mark}" not in body:
        first = _FIRST_BOUNDARY.search(body)
        mark = first[1].rstrip() if first else None
    if not mark:
        return None
    out = []
    for piece in f"\n{body}".split(f"\n--{mark}")[1:]:
        if piece.startswith("--"):
            break
        piece = piece.partition("\n")[2]
        inner, gap, rest = ("", "\n", piece[1:]) if piece.startswith("\n") else piece.partition("\n\n")
        if not gap and ":" not in inner.partition("\n")[0]:
            inner, rest = "", piece
        out.append((inner, rest))
    return out


def _parts(head: str, body: str) -> list[str]:
    """The texts of all parts, in order, however deep they are nested; each is shorter than what holds it."""
    out, todo = [], [(head, body)]
    while todo:
        head, body = todo.pop()
        found = _TYPE.search(head)
        kind = found[1] if found else ""
        low = kind[:24].lower()
        if low.startswith("multipart/"):
            pieces = _pieces(kind, body)
            if pieces is not None:
                todo += reversed(pieces)
                continue
        if low.startswith("message/rfc822"):
            inner, _, rest = _decoded(head, body).partition("\n\n")
            # a body that its coding did not shorten has no further head to read
            if len(inner) + len(rest) < len(head) + len(body):
                todo.append((inner, rest))
                continue
        if low and not low.startswith(("text/", "multipart/", "message/")):
            continue
        text = _decoded(head, body)
        if low.startswith("text/html") or text[:200].lstrip()[:6].lower() in ("<html>", "<!doct"):
            text = _without_tags(text)
        out.append(text)
    return out


def subject(head: str) -> str:
    """The decoded subject from a header block."""
    found = _SUBJECT.search(head)
    if not found:
        return ""
    if "=?" not in found[1]:
        return found[1]
    try:
        return "".join(_as_text(p, f"charset={c or ''}") if isinstance(p, bytes) else p for p, c in decode_header(_ENCODED_GAP.sub(r"\1\2", found[1])))
    except (binascii.Error, ValueError, LookupError):
        return found[1]


def view(text: str | None) -> list[str]:
    """Subject, then each text part in order. A null text has none."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    head, _, body = text.partition("\n\n")
    parts = _parts(head, body)
    parts = [p if p.isascii() else _MISREAD.sub(_reread, p) for p in (subject(head), *parts)]
    return [parts[0], *[_QUOTE.sub("", p) if ">" in p or "|" in p else p for p in parts[1:]]]


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())
