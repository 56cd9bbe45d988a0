"""Decoding of raw emails: body parts as plain text, and the sender's own words.

Real mail breaks its own rules, so nothing here raises: a part without its end
boundary runs to the end of the mail, an unknown charset is read as Latin-1,
and base64 with errors gives what can be decoded.
"""

from __future__ import annotations

import binascii
import codecs
import html
import re
from typing import NamedTuple

_HEADER = re.compile(r"^(content-type|content-transfer-encoding|content-disposition):[ \t]*(.*(?:\n[ \t].*)*)", re.I | re.M)
_PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*(?:"([^"]*)"|([^\s;"]+))')
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK_TAG = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|body|html|pre|section|article|header|footer|dd|dt|dl)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<![^>]*>")
_QUOTE_OPEN = re.compile(r"<(/?)blockquote\b[^>]*>", re.I)
_BLANK_LINE = re.compile(r"\n[ \t]*\n")
_REPLY_MARK = re.compile(r"^[ \t]*[A-Za-z]{0,3}>")
_FORWARD = re.compile(r"^[ \t]*-{4,} ?(?:original message|forwarded message|forwarded by .*|urspr\S+ nachricht|weitergeleitete nachricht|message d'origine|message transf\S+|mensaje original|mensaje reenviado) ?-{4,}[ \t]*$", re.I | re.M)


class Part(NamedTuple):
    """A body part: decoded text before markup is taken away."""

    text: str
    is_html: bool
    attached: bool


def _params(value: str) -> dict[str, str]:
    return {k.lower(): a or b for k, a, b in _PARAM.findall(value)}


def _split_head(text: str) -> tuple[str, str]:
    if text.startswith("\n"):
        return "", text[1:]
    m = _BLANK_LINE.search(text)
    return (text[: m.start()], text[m.end():]) if m else (text, "")


def _charset_decode(raw: bytes, charset: str) -> str:
    try:
        codec = codecs.lookup(charset or "utf-8").name
        return raw.decode(codec)
    except (LookupError, UnicodeDecodeError):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1")


def _unbase64(body: str) -> bytes:
    kept = re.sub(r"[^A-Za-z0-9+/]", "", body)
    kept = kept[: len(kept) // 4 * 4] if len(kept) % 4 == 1 else kept
    try:
        return binascii.a2b_base64(kept + "=" * (-len(kept) % 4))
    except binascii.Error:
        return b""


def _transfer_decode(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        return _charset_decode(_unbase64(body), charset)
    if encoding == "quoted-printable":
        return _charset_decode(binascii.a2b_qp(body.encode("utf-8", "surrogatepass")), charset)
    return body


def parts(text: str | None, depth: int = 0) -> list[Part]:
    """All textual parts of a raw email, attached texts included, in order."""
    if not text:
        return []
    text = text.replace("\r\n", "\n") if "\r" in text else text
    head, body = _split_head(text)
    fields = {k.lower(): v for k, v in reversed(_HEADER.findall(head))}
    kind = fields.get("content-type", "text/plain")
    major = kind.split(";", 1)[0].strip().lower()
    params = _params(kind)
    if major.startswith("multipart/") and params.get("boundary") and depth < 20:
        found: list[Part] = []
        pieces = re.split(r"(?:\A|\n)--" + re.escape(params["boundary"]) + r"(--)?[ \t]*(?=\n|\Z)", body)
        for closed, piece in zip(pieces[1::2], pieces[2::2]):
            if closed:
                break
            found += parts(piece[1:] if piece.startswith("\n") else piece, depth + 1)
        return found or [Part(body, False, False)]
    encoding = fields.get("content-transfer-encoding", "").split(";")[0].strip().lower()
    attached = fields.get("content-disposition", "").strip().lower().startswith("attachment")
    if major == "message/rfc822" and depth < 20:
        return [p._replace(attached=True) for p in parts(_transfer_decode(body, encoding, params.get("charset", "")), depth + 1)]
    if major and not major.startswith("text/") and not major.startswith("multipart/"):
        return []
    decoded = _transfer_decode(body, encoding, params.get("charset", ""))
    return [Part(decoded, major == "text/html", attached)]


def strip_markup(text: str) -> str:
    """Text of an HTML part: blocks on lines of their own, entities undone."""
    text = _TAG.sub("", _BLOCK_TAG.sub("\n", _DROPPED.sub(" ", text)))
    return html.unescape(text) if "&" in text else text


def without_quotations(text: str) -> str:
    """An HTML part without its blockquotes, nested ones included."""
    out, depth, at = [], 0, 0
    for m in _QUOTE_OPEN.finditer(text):
        if depth == 0:
            out.append(text[at: m.start()])
        depth = max(0, depth - 1) if m[1] else depth + 1
        at = m.end()
    if depth == 0:
        out.append(text[at:])
    return " ".join(out)


def plain_parts(text: str | None) -> list[str]:
    """Every textual part without markup: what a reader of the mail can see."""
    return [strip_markup(p.text) if p.is_html else p.text for p in parts(text)]


def own_parts(text: str | None) -> list[str]:
    """The body parts without quoted and forwarded text and without attachments."""
    found = []
    for p in parts(text):
        if p.attached:
            continue
        t = strip_markup(without_quotations(p.text)) if p.is_html else p.text
        m = _FORWARD.search(t)
        if m:
            t = t[: m.start()]
        found.append("\n".join(line for line in t.split("\n") if not _REPLY_MARK.match(line)) if ">" in t else t)
    return found
