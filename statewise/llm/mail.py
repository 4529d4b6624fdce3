"""Readable text of archived messages: parts decoded, markup and entities removed, attachments left out."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
import unicodedata
from collections.abc import Iterator

BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"\r\n]+)\"|([^\s;\"]+))", re.I)
DELIMITER = re.compile(r"^--(.+?)[ \t]*\r?$", re.M)
BLANK = re.compile(r"\r?\n[ \t]*\r?\n|\r\r")
TYPE = re.compile(r"^content-type\s*:\s*([\w.+-]+/[\w.+-]+)", re.I | re.M)
CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
CODING = re.compile(r"^content-transfer-encoding\s*:\s*([\w-]+)", re.I | re.M)
SPECIAL = re.compile(r"content-transfer-encoding\s*:\s*(?:base64|quoted-printable)|text/html|<html|<body|</p>|<br|<div|boundary\s*=", re.I)
HIDDEN = re.compile(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|ins|del|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)\b[^<>]*>", re.I)
MARKUP = re.compile(r"<(?:html|body|p|div|br)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[a-z][^<>]*>|<![^<>]*>", re.I)
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")


UNPACKED = re.compile(r"[^A-Za-z0-9+/]+")
FIELD = re.compile(r"[\w-]+\s*:")


def _decoded(raw: bytes, charset: str | None) -> str:
    for name in ("utf-8", charset, "cp1252"):
        try:
            if name:
                return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1")


def _plain(body: str) -> str:
    return html.unescape(TAG.sub(" ", INLINE.sub("", HIDDEN.sub(" ", body))))


def _part(head: str, body: str) -> str | None:
    kind = TYPE.search(head)
    kind = kind[1].lower() if kind else "text/plain"
    coding = CODING.search(head)
    coding = coding[1].lower() if coding else ""
    if not kind.startswith(("text/", "message/", "multipart/")):
        return None
    charset = CHARSET.search(head) if coding else None
    charset = charset[1] if charset else None
    if coding == "base64":
        packed = UNPACKED.sub("", body)
        try:
            body = _decoded(base64.b64decode(packed[: len(packed) - (len(packed) % 4 == 1)] + "=" * (-len(packed) % 4)), charset)
        except (binascii.Error, ValueError):
            return None
    elif coding == "quoted-printable":
        body = _decoded(quopri.decodestring(body.encode("utf-8", "surrogatepass")), charset)
    return _plain(body) if kind == "text/html" or MARKUP.search(body) else body


def texts(message: str) -> Iterator[str]:
    """The headers and every text part of a message, each as plain text; a message that is no mail is one text."""
    if not SPECIAL.search(message):
        yield message
        return
    marks = {a or b for a, b in BOUNDARY.findall(message)}
    pieces, at = [], 0
    for line in DELIMITER.finditer(message) if marks else ():
        if line[1] in marks or (line[1].endswith("--") and line[1][:-2] in marks):
            pieces.append(message[at : line.start()])
            at = line.end()
    pieces.append(message[at:])
    for k, piece in enumerate(pieces):
        piece = piece.lstrip("\r\n") if k else piece
        cut = BLANK.search(piece)
        head, body = (piece[: cut.start()], piece[cut.end() :]) if cut else (piece, "")
        if k and not FIELD.match(head):
            head, body = "", piece
        if k == 0 or not cut:
            yield head
        text = _part(head, body)
        if text:
            yield text


def folded(text: str) -> str:
    """Case, width and invisible characters removed."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).lower()


__all__ = ["folded", "texts"]
