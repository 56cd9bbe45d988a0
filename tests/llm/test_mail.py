import base64
import quopri

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import mail


def part(kind, text, how="8bit", more=""):
    raw = text.encode()
    body = {"8bit": text, "base64": base64.encodebytes(raw).decode(), "quoted-printable": quopri.encodestring(raw).decode()}[how]
    return f"Content-Type: {kind}; charset=utf-8{more}\nContent-Transfer-Encoding: {how}\n\n{body}"


def multi(*parts, end=True):
    return 'From: a@b\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=_x"\n\npreamble\n--=_x\n' + "\n--=_x\n".join(parts) + ("\n--=_x--\nepilogue\n" if end else "\n")


def test_parts_and_encodings():
    t = multi(part("text/plain", "Grüße an alle", "quoted-printable"), part("text/html", "<p>caf&eacute;<br>x<b>y</b>z</p><style>q</style>", "base64"), part("application/octet-stream", "zzz", "base64"), part("text/plain", "in the file", "base64", '; name="a.txt"\nContent-Disposition: attachment'))
    assert [p.strip() for p in mail.plain_parts(t)] == ["Grüße an alle", "café\nxyz", "in the file"]
    assert [p.strip() for p in mail.own_parts(t)] == ["Grüße an alle", "café\nxyz"]


def test_missing_end_nested_and_odd_mails():
    assert [p.strip() for p in mail.plain_parts(multi(part("text/plain", "one"), part("text/plain", "two"), end=False))] == ["one", "two"]
    inner = multi(part("text/plain", "deep")).replace("=_x", "=_y").replace("From: a@b\n", "")
    assert [p.strip() for p in mail.plain_parts(multi(inner))] == ["deep"]
    assert mail.plain_parts(None) == [] and mail.plain_parts("") == []
    assert mail.plain_parts("no headers, no body") == [""]
    assert mail.plain_parts("A: b\n\nplain body") == ["plain body"]
    assert mail.plain_parts("Content-Type: text/plain; charset=what\nContent-Transfer-Encoding: base64\n\n4pyTIG9r\n!!") == ["✓ ok"]


def test_own_words():
    t = "A: b\n\nMy words\n> quoted\n >> deeper\nJD> marked\nmore\n\n----- Original Message -----\nFrom: x\n\nold words"
    own = mail.own_parts(t)[0]
    assert "My words" in own and "more" in own and all(x not in own for x in ("quoted", "deeper", "marked", "old words"))
    h = "Content-Type: text/html\n\n<p>new</p><blockquote>old <blockquote>older</blockquote> old</blockquote><p>end</p>"
    assert mail.own_parts(h)[0].split() == ["new", "end"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.sampled_from(["", 'Content-Type: multipart/mixed; boundary="b"\n\n--b\n', "Content-Transfer-Encoding: base64\n\n", "Content-Type: text/html\n\n<p", "Content-Transfer-Encoding: quoted-printable\n\n="]))
def test_nothing_raises(text, head):
    mail.plain_parts(head + text)
    mail.own_parts(head + text)
