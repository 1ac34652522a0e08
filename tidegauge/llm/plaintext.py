"""Texts reduced to the words they hold, whatever their case, punctuation, spacing, line prefixes, markup, escapes and character variants."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones, with the letters they are read as.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһкмнтвгп" + "αοερτικνυχη" + "ıɡﬀ",
    "aeopcyxijsdhkmhtbrn" + "aoeptikvuxn" + "igf",
)
_ESCAPED = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtfbv0\"'/\\])")
_PERCENT = re.compile(r"%([2-7][0-9A-Fa-f])")
#: A tag: with well-formed attributes over any number of lines, or whatever stands in angle brackets on one line; a comment.
TAG = re.compile(r"""</?[a-zA-Z][\w:.\-]*+(?>\s++[\w:@.\-]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+)*+\s*+/?>|<!--.*?-->|</?[a-zA-Z!][^<>\n]*>""", re.S)
# What log shippers and quoting put in front of a line: times, levels, components, comment and quote marks.
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_PREFIX = re.compile(
    rf"^[ \t]*(?:(?:(?:{_MONTHS})[ ]+\d{{1,2}}[ ]\d\d:\d\d:\d\d(?:[ ][\w.\-]+(?:\[\d+\])?:)?|\[?\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d[\w.,:+\-]*\]?)[ \t]*)?"
    r"(?:(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b[ \t]*)?(?:\[[\w.\-]+\][ \t]*)?(?:(?:\d+[ \t]*[:|]|[>|#*/;%+~\-]+)[ \t]+)*",
    re.M,
)
_PREFIX_FOLDED = re.compile(_PREFIX.pattern, re.M | re.I)
# A log record as a line of JSON or of key=value pairs, around the message it carries.
_FIELD = r'"[\w.\-]+"[ ]*:[ ]*(?:"(?:[^"\\\n]|\\.)*"|[\w.+\-]+)'
_ENVELOPE = re.compile(
    rf'^[ \t]*\{{[ ]*(?:{_FIELD}[ ]*,[ ]*)*"(?:msg|message|body|log|text)"[ ]*:[ ]*"|"(?:[ ]*,[ ]*{_FIELD})*[ ]*\}}[ \t]*$|^.*\blevel=\w+[ ]+msg="|"[ ]+trace=\w+[ ]*$',
    re.M | re.I,
)
_BROKEN = re.compile(r"(?<=\w)[-\u2010\u2011\u00ad][ \t]*\r?\n[ \t]*(?=\w)")
_LINE_ENDS = dict.fromkeys((0x85, 0x2028, 0x2029), 10)
_DASH = re.compile("[\u2012-\u2015\u2026/|]|--+")
_REST = re.compile(r"[^a-z0-9\s]+")


def words(text: str) -> list[str]:
    """The words of ``text`` in order, each reduced to lower-case Latin letters and digits; words without any are left out.

    Words cut by a hyphen at a line's end are joined. Letters with marks lose the marks; other scripts leave nothing behind."""
    t = text
    if "&" in t:
        t = html.unescape(t)
    if '":' in t or 'msg="' in t:
        t = _ENVELOPE.sub("", t)
    if "\\" in t:
        t = _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else "\n" if m[0][1] in "nr" else " ", t)
    if "%20" in t:
        t = _PERCENT.sub(lambda m: chr(int(m[1], 16)), t)
    if "<" in t:
        t = TAG.sub(lambda m: " " if m[0][1:3].lower() in ("br", "p>", "/p", "li", "/l", "td", "tr", "di", "/d") else "", t)
    plain = t.isascii()
    if not plain:
        t = unicodedata.normalize("NFKD", t.translate(_LINE_ENDS)).casefold().translate(LOOKALIKES)
    t = _BROKEN.sub("", (_PREFIX if plain else _PREFIX_FOLDED).sub("", t))
    return _REST.sub("", _DASH.sub(" ", t.lower())).split()
