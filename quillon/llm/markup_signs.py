"""Signs of HTML, Markdown, wiki and LaTeX markup in a text, apart from the same characters in prose.

Prose uses many of these characters in their ordinary sense: amounts ($5), products (2 * 3), comparisons (x < 8),
placeholders ({x}), footnote numbers ([89]), issue numbers (#12), names with underscores, Windows paths, types
(List<String>), bullets and tab columns. Each pattern therefore asks for what only markup has.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

#: Element names of HTML.
ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas "
    "caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset "
    "figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd "
    "label legend li link main map mark math menu meta meter nav nobr noscript nowiki object ol optgroup option output p "
    "param picture pre progress q ref references rp rt ruby s samp script section select small source span strike strong "
    "style sub summary sup svg syntaxhighlight gallery table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_NAMES = "|".join(sorted(ELEMENTS.split(), key=len, reverse=True))
TAG = re.compile(rf"<(?:/\s*(?:{_NAMES})\s*>|(?:{_NAMES})(?:\s+[a-z][\w:-]*(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>]+))?)*\s*/?>)|<!--|<!DOCTYPE\b|<\?xml\b|<!\[CDATA\[", re.I)
#: A type parameter such as vector<a> looks like an element of one letter; it follows a name and has no end tag.
_TYPE = re.compile(r"\w<[abipqsu]>$", re.I)
REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
#: Substring without which the pattern can't match, and the pattern.
MARKDOWN = [
    (c, re.compile(p, re.M))
    for c, p in (
        ("#", r"^ {0,3}\#{1,6}[ \t]+\S"),  # heading
        ("```", r"^[ \t]*```[\w+-]*[ \t]*$"),  # fence
        ("~~~", r"^[ \t]*~~~[\w+-]*[ \t]*$"),
        ("\n===", r"^[^\n|<>\s][^\n]*\n={3,}[ \t]*$"),  # underlined heading
        ("\n---", r"^[^\n|<>\s][^\n]*\n-{3,}[ \t]*$"),
        (">", r"^ {0,3}>[ \t]+\S"),  # quotation
        ("-|", r"^\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?$"),  # rule below a table's head
        ("- |", r"^\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?$"),
        (":|", r"^\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?$"),
        ("---", r"\A---[ \t]*\n(?:[\w-]+:[^\n]*\n)+---[ \t]*$"),  # front matter
        ("**", r"(?<![\w*\\])\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*(?![\w*])"),  # strong
        ("__", r"(?<![\w_\\/.])__(?=[^\s_])[^_\n]+(?<=[^\s_])__(?![\w_(.])"),
        ("*", r"(?<![\w*\\])\*(?=[^\W\d_])[^*\n]*(?<=[\w.!?:,)])\*(?![\w*])"),  # emphasis
        ("_", r"(?<![\w_\\/.])_(?=[^\W\d_])[^_\n]*(?<=[^\W_])_(?![\w_(.])"),
        ("~~", r"~~(?=\S)[^~\n]+(?<=\S)~~"),
        ("`", r"(?<![\\`\w])`(?=[^`\s])[^`\n]*`(?![`\w])"),  # code
        ("](", r"!?\[[^\]\[\n]*\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)"),  # link, image
        ("][", r"!?\[[^\]\[\n]*\]\[[^\]\n]+\]"),
        ("[^", r"\[\^[^\]\s]+\]"),  # footnote
        ("]:", r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S"),  # link definition
        ("[ ]", r"^[ \t]*[-*+][ \t]\[ \][ \t]"),  # task
        ("[x]", r"^[ \t]*[-*+][ \t]\[x\][ \t]"),
    )
]
WIKI = [
    (c, re.compile(p, re.M))
    for c, p in (
        ("==", r"^(={2,6})[ \t]*[^=\s][^\n]*?\1[ \t]*$"),
        ("[[", r"\[\[[^\]\[\n]+\]\]"),
        ("{{", r"\{\{[^{}]+\}\}"),
        ("''", r"(?<!')'{2,3}(?=[^'\s])[^'\n]+(?:'[^'\n]+)*'{2,3}(?!')"),
        ("{|", r"^[ \t]*\{\|[^\n]*$"),
        ("|}", r"^[ \t]*\|\}[ \t]*$"),
        ("://", r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\]"),
        ("#R", r"^\#REDIRECT\b"),
        ("TOC__", r"__(?:NO)?TOC__"),
    )
]
LATEX = re.compile(
    r"(?<![\w:\\])\\(?:[a-zA-Z]+\*?(?:\[[^\]\n]*\])*\{|(?:begin|end|item|maketitle|tableofcontents|noindent|par|newpage|centering|hline|ldots|dots|quad|cdot|times|alpha|beta|gamma|delta|lambda|mu|pi|sigma|theta|omega|sum|int|prod|frac|sqrt|log|ln|cos|sin|exp|leq|geq|infty|left|right|textbf|emph)(?![A-Za-z]))"
    r"|\\\[(?:(?!\\\[).)+?\\\]|\\\((?:(?!\\\().)+?\\\)"
    r"|\$\$[^$]+\$\$"
    r"|(?<![\w$\\])\$(?=[^$\n]*[\\^_=+<>{}]|[A-Za-z]\$)(?!\d[\d.,]*[ ])[^\s$](?:[^$\n]*?[^\s$\\])?\$(?![\w$])",
    re.S,
)


def html_marks(text: str) -> tuple[list[re.Match], list[re.Match]]:
    """(tags, character references) of the text."""
    tags = []
    if "<" in text:
        lower = ""
        for m in TAG.finditer(text):
            if _TYPE.search(text[max(0, m.start() - 1) : m.end()]):
                lower = lower or text.lower()
                if f"</{m[0][1:-1].lower()}>" not in lower:
                    continue
            tags.append(m)
    return tags, [m for m in REFERENCE.finditer(text) if not m[1] or m[1] + ";" in html5] if "&" in text else []


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def is_data(text: str) -> bool:
    """JSON, also one value a line, holds no markup of its own; what only looks like it (a wiki page from [[File:...]] to {{stub}}) may."""
    if not re.match(r"\s*(?:\{\s*\"|\[\s*[{\"\[])", text) or text.rstrip()[-1:] not in ("}", "]"):
        return False
    return _parses(text) or all(_parses(line) for line in text.split("\n") if line.strip())


#: Constructs whose text is a link's.
_LINKS = ("](", "][", "[[", "://")


def constructs(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """Constructs of wiki, Markdown and LaTeX by kind: (position, characters, whether it is a link)."""
    if is_data(text):
        return {}
    out: dict[str, list[tuple[int, int, bool]]] = {}
    for kind, patterns in (("wiki", WIKI), ("markdown", MARKDOWN)):
        found = [(m.start(), m.end() - m.start(), c in _LINKS) for c, p in patterns if c in text for m in p.finditer(text)]
        if found:
            out[kind] = found
    if "\\" in text or "$" in text:
        found = [(m.start(), m.end() - m.start(), False) for m in LATEX.finditer(text)]
        if found:
            out["latex"] = found
    return out
