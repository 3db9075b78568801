"""Text of raw messages: subject and text parts, decoded."""

from __future__ import annotations

import binascii
import html
import re

_SUBJECT = re.compile(r"^subject:[ \t]*(.*(?:\n[ \t].*)*)", re.I | re.M)
_TYPE = re.compile(r"^content-type:[ \t]*([^;\s]*)", re.I | re.M)
_ENCODING = re.compile(r"^content-transfer-encoding:[ \t]*([^;\s]*)", re.I | re.M)
_BOUNDARY = re.compile(r"""\bboundary[ \t]*=[ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|([^\s;]+))""", re.I)
_CHARSET = re.compile(r"""\bcharset[ \t]*=[ \t]*["']?([\w.:-]+)""", re.I)
_WORD = re.compile(r"=\?([^?\s]*)\?([bBqQ])\?([^?]*)\?=")
_BETWEEN = re.compile(r"(\?=)[ \t\n]+(=\?)")
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|br|div|td|th|tr|table|li|ul|ol|h[1-6]|hr|blockquote|pre|body|html|head|title|dd|dt|dl)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_FIELD = re.compile(r"[!-9;-~]+:")
_LINE_END = re.compile(r"(--)?[ \t]*$\n?", re.M)
#: Levels of parts in parts; what is nested deeper is taken as text as it stands, so that nothing is left out.
DEPTH = 100
_NOT_B64 = re.compile(rb"[^A-Za-z0-9+/]")


def _text(data: bytes, charset: str) -> str:
    for name in (charset, "utf-8"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def _base64(body: str) -> bytes:
    data = _NOT_B64.sub(b"", body.partition("=")[0].encode("ascii", "ignore") if "=" in body else body.encode("ascii", "ignore"))
    if len(data) % 4 == 1:
        data = data[:-1]
    return binascii.a2b_base64(data + b"=" * (-len(data) % 4))


def _header_word(m: re.Match) -> str:
    charset, kind, body = m.groups()
    data = _base64(body) if kind in "bB" else binascii.a2b_qp(body.encode("utf-8", "replace"), header=True)
    return _text(data, charset.partition("*")[0] or "utf-8")


def header_text(value: str) -> str:
    """A header's value: folded lines joined, encoded words decoded."""
    if "=?" in value:
        value = _WORD.sub(_header_word, _BETWEEN.sub(r"\1\2", value))
    return re.sub(r"\n[ \t]+", " ", value)


def html_text(body: str) -> str:
    """Text of HTML: comments, scripts and tags removed (those of blocks and line breaks leave a blank), entities resolved."""
    body = _HIDDEN.sub(" ", body)
    return html.unescape(_TAG.sub("", _BLOCK.sub(" ", body)))


def _split(raw: str) -> tuple[str, str]:
    if raw.startswith("\n"):
        return "", raw[1:]
    head, blank, body = raw.partition("\n\n")
    if not _FIELD.match(head):
        return "", raw
    return head, body if blank else ""


def _pieces(body: str, mark: str) -> list[str | None]:
    """What re.split(rf"^{re.escape(mark)}(--)?[ \\t]*$\\n?", body, flags=re.M) gives; each message has its own mark, so a pattern of it would be compiled once a message."""
    out: list[str | None] = []
    begin, at = 0, body.find(mark)
    while at >= 0:
        line = _LINE_END.match(body, at + len(mark)) if not at or body[at - 1] == "\n" else None
        if line:
            out += [body[begin:at], line[1]]
            begin = line.end()
        at = body.find(mark, begin if line else at + 1)
    return [*out, body[begin:]]


def _part(head: str, body: str, out: list[str], depth: int) -> None:
    kind = _TYPE.search(head) if head else None
    kind = kind[1].lower() if kind else ""
    if depth >= DEPTH and (kind.startswith("multipart/") or kind == "message/rfc822"):
        out.append(body)
        return
    if kind.startswith("multipart/"):
        mark = _BOUNDARY.search(head)
        mark = (mark[1] or mark[2] or mark[3] or "") if mark else ""
        pieces = _pieces(body, f"--{mark}") if mark else []
        if len(pieces) < 3:
            out.append(body)
            return
        closed = None
        for end, piece in zip(pieces[1::2], pieces[2::2]):
            closed = end
            if not closed:
                _part(*_split(piece), out, depth + 1)
        return
    if kind == "message/rfc822":
        _message(body, out, depth + 1)
        return
    if kind and not kind.startswith("text"):
        return
    how = _ENCODING.search(head) if head else None
    how = how[1].lower() if how else ""
    if how in ("base64", "quoted-printable"):
        charset = _CHARSET.search(head)
        data = _base64(body) if how == "base64" else binascii.a2b_qp(body.encode("utf-8", "replace"))
        body = _text(data, charset[1] if charset else "utf-8")
    out.append(html_text(body) if kind == "text/html" else body)


def _message(raw: str, out: list[str], depth: int) -> None:
    head, body = _split(raw)
    subject = _SUBJECT.search(head)
    if subject:
        out.append(header_text(subject[1]))
    _part(head, body, out, depth)


def text_parts(raw: str | None) -> list[str]:
    """The subject, if any, and each text part of a raw message, with transfer encodings undone and HTML made text.

    Attachments that are no text are left out. A part without an end boundary goes to the end of the message; a multipart message
    without its boundary is one text; text without header fields is a body. Parts nested deeper than DEPTH are one text as they stand. Null and empty messages have no parts.
    """
    if not raw:
        return []
    if "\r" in raw:
        raw = raw.replace("\r\n", "\n")
    out: list[str] = []
    _message(raw, out, 0)
    return out
