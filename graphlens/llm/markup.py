"""Text, title and language of a web page, in time linear in its length whatever it leaves unclosed."""

from __future__ import annotations

import html
import re

_OPEN = re.compile(r"(?i)<(?:!--|(script|style|noscript|template)\b)")
_CLOSE = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
_BREAK = re.compile(r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|blockquote|pre|title)\b[^>]*|br\b[^>]*)>")
_TAG = re.compile(r"<[^>]*>")
_BLANK = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE, _TITLE_END = re.compile(r"(?i)<title[^>]*>"), re.compile(r"(?i)</title>")
_HTML = re.compile(r"(?i)<html\b[^>]*")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z-]+)")


def _without(page: str, opening: re.Pattern, put: str) -> str:
    """A page without what begins with ``opening`` and is closed; a kind that is not closed once is not looked for again."""
    out, at, pos, never = [], 0, 0, set()
    while m := opening.search(page, pos):
        kind, pos = (m[1] or "").lower() if m.re.groups else "", m.end()
        if kind in never:
            continue
        end = _CLOSE[kind].search(page, pos)
        if end is None:
            never.add(kind)
            if not m.re.groups or len(never) == len(_CLOSE):
                break
            continue
        out += [page[at : m.start()], put]
        at = pos = end.end()
    return "".join([*out, page[at:]])


def html_text(page: str) -> str:
    """The text of a page: scripts, styles and comments go, blocks become lines, entities become characters."""
    page = _without(page, _OPEN, " ")
    end = page.rfind(">") + 1  # no tag ends after that
    text = _TAG.sub("", _BREAK.sub("\n", page[:end])) + page[end:]
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip()


def title(page: str) -> str:
    """The text of the first title that is closed, or nothing."""
    end = page.rfind(">") + 1
    begin = _TITLE.search(page, 0, end)
    stop = _TITLE_END.search(page, begin.end(), end) if begin else None
    return html_text(page[begin.end() : stop.start()]) if stop else ""


def declared(page: str) -> str:
    """The language that the first html element declares, wherever it stands outside comments, in small letters; or nothing."""
    first = _HTML.search(_without(page, re.compile("<!--"), ""))
    lang = _LANG.search(first[0]) if first else None
    return lang[1].lower() if lang else ""
