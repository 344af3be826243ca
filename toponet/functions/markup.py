"""One pass over wiki markup with a stack of open marks."""

from __future__ import annotations

import re

#: Marks that open or close something, tags, and runs of quotes.
_MARK = re.compile(
    r"<!--|-->|<(?P<end>/?)(?P<tag>ref|blockquote)\b[^>]*?(?P<alone>/?)>|(?P<br><br\s*/?>)|(?P<other><[^>]+>)"
    r"|\{\||\|\}(?!\})|\{\{|\}\}|\[\[|\]\]|(?P<out>\[(?=https?://))|\]|(?P<quotes>'{2,})",
    re.I,
)
_OPENS = {"<!--": "comment", "{|": "table", "{{": "template", "[[": "link"}
_CLOSES = {"-->": "comment", "|}": "table", "}}": "template", "]]": "link", "]": "address"}
_FILE = re.compile(r"\s*(?:file|image):", re.I)


def _shown(kind: str, inside: str) -> str:
    """What a closed mark leaves: a link its label, anything else a blank."""
    if kind == "link" and not _FILE.match(inside):
        target, _, label = inside.partition("|")
        return label or target
    if kind == "address":
        return inside.partition(" ")[2] or " "
    return " "


def seen_text(text: str, addresses: bool = False, line_break: str = " ") -> str:
    """The text outside notes, quotes, tables, templates, files and comments, without tags and quote marks.

    Whatever is open is on a stack with its place in the output; closing it replaces what came
    since, at any depth. A mark that is never closed, or closes nothing, stays as it is, a tag
    becomes a blank. With ``addresses`` a bracketed address leaves its label too.
    """
    out: list[str] = []
    open_: list[tuple[str, int]] = []  # kind, place in ``out`` of the opening mark
    at = 0
    for m in _MARK.finditer(text):
        mark = m[0]
        inside_comment = bool(open_) and open_[-1][0] == "comment"
        if inside_comment and mark != "-->":
            continue
        out.append(text[at : m.start()])
        at = m.end()
        kind = _OPENS.get(mark) or (m["tag"] and not m["end"] and not m["alone"] and m["tag"].lower())
        if m["out"]:
            kind = "address" if addresses else None
        closes = _CLOSES.get(mark) or (m["tag"] and m["end"] and m["tag"].lower())
        if kind:
            open_.append((kind, len(out)))
            out.append(" " if m["tag"] else mark)
        elif closes and any(k == closes for k, _ in open_):
            while open_[-1][0] != closes:
                open_.pop()
            _, place = open_.pop()
            out[place:] = [_shown(closes, "".join(out[place + 1 :]))]
        elif m["br"]:
            out.append(line_break)
        elif m["tag"] or m["other"]:
            out.append(" ")
        elif not m["quotes"]:
            out.append(mark)
    out.append(text[at:])
    return "".join(out)


def prose(text: str | None) -> str:
    """Prose of a page: headings become sentences, blanks and blank lines are squeezed."""
    lines: list[str] = []
    for line in seen_text(text or "").split("\n"):
        title = line.strip()
        if title.startswith("==") and title.endswith("==") and title.strip("= \t"):
            lines += ["", title.strip("=").strip() + ".", ""]
        else:
            lines.append(re.sub(r"[ \t]+", " ", line))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(" \n")
