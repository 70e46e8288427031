"""Prose of wiki markup: pieces of a text, and the sentences in them."""

from __future__ import annotations

import html
import re
import unicodedata

_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_LINES = re.compile(r"^[^\S\n]*(?:[|!=].*|\{\|.*|#\s*redirect.*)$", re.M | re.I)
_INLINE = re.compile(r"<!--.*?(?:-->|$)|<ref[^<>]*/>|<ref\b.*?</ref>|<[^<>]*>|\[\[[^\[\]|:]+:[^\[\]]*\]\]|https?://\S+|'{2,}", re.S)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}|\{\{\{[^{}]*\}\}\}")
_OPEN = re.compile(r"\{\{.*|^[^\S\n]*\}+", re.M)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]|\[\S+ ([^\[\]]*)\]")
_ASIDE = re.compile(r"[«“„]([^«»“”„]*)[»”“]|\([^()]*\)")
#: Letters of scripts without blanks between words (Han and Kana, Thai), and how many make up about a word.
HAN, THAI = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff", "\u0e00-\u0e7f"
_UNSPACED = ((re.compile(f"[{HAN}]"), 2), (re.compile(f"[{THAI}]"), 4))
_ANY_UNSPACED, _THAI = re.compile(f"[{HAN}{THAI}]"), re.compile(f"[{THAI}]")
_STOP = re.compile(r"[.!?…。！？]+")
_END = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]+")


def pieces(text: str) -> list[str]:
    """Pieces of `text`, parted by one or more blank lines (lines of white space); none is empty."""
    t = text.replace("\r\n", "\n").strip()
    return [p for p in _BLANK.split(t) if p.strip()]


def plain(piece: str) -> str:
    """`piece` without markup, tables, templates, notes and headings; entities and split accents joined."""
    t = piece
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    if "=" in t or "|" in t or "#" in t or "!" in t:
        t = _LINES.sub("", t)
    if "<" in t or "[[" in t or "''" in t or "//" in t:
        t = _INLINE.sub(" ", t)
    while "{{" in t:
        u = _TEMPLATE.sub(" ", t)
        if u == t:
            t = _OPEN.sub(" ", t)
            break
        t = u
    if "[" in t:
        t = _LINK.sub(lambda m: m[1] if m[1] is not None else m[2], t)
    return t


def is_sentence(s: str) -> bool:
    """Four words or more, not the same few over and over, and mostly letters.

    In scripts without blanks between words, two letters of Han or Kana or four of Thai count as a word.
    """
    words = [w for w in s.split() if len(w) > 1 and (w[0].isalpha() or w[1].isalpha())]
    if not s.isascii() and _ANY_UNSPACED.search(s):
        words = [w for w in words if not _ANY_UNSPACED.search(w)]
        for letters, n in _UNSPACED:
            run = "".join(letters.findall(s))
            words += [run[i : i + n] for i in range(0, len(run) - n + 1, n)]
    return len(words) >= 4 and 2 * len(set(words)) > len(words) and 2 * sum(map(len, words)) > len(s)


def sentences(piece: str) -> list[str]:
    """The sentences of prose in `piece`: runs that end in a full stop, question or exclamation mark.

    A quotation in guillemets or low quotes is a sentence of its own; it may be in another language
    than what surrounds it. Thai has no full stop: there a line's end ends a sentence too.
    """
    t = plain(piece)
    quoted: list[str] = []
    if any(c in t for c in "«“„("):
        def aside(m: re.Match) -> str:
            if m[1] is None:
                return " "
            if m[1].rstrip()[-1:] in ".!?…":
                quoted.append(m[1])
                return " "
            return m[1]

        t = _ASIDE.sub(aside, t)
    ended = _END.findall(t)
    if not t.isascii() and _THAI.search(t):
        ended += [x for x in (_STOP.split(line)[-1] for line in t.split("\n")) if _THAI.search(x)]
    return [s for s in (x.strip() for x in [*ended, *quoted]) if is_sentence(s)]
