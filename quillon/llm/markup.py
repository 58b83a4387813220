"""Markup to clean text that keeps headings, lists, tables, code and formulas.

Every text is parsed into a tree: its HTML elements, and as further nodes its comments, stray tags, character references
and the constructs of Markdown, wiki and LaTeX. For every node the composite text density is computed (Sun, Song and Liao
2011): characters per tag, times a logarithm that falls with the share of characters and tags in links. A text whose tree
is but its root holds no markup. Each node's density sum is that of its children, where each run of a block's own text,
with its inline elements, counts as a child. In pages, the content is the node with the largest sum; the smallest density
on its path to the body is the threshold, and in every other subtree at or above it the node with the largest sum is
content too. The text of these subtrees is kept, in order. Texts that merely hold some tags lose these and nothing else.

Wiki, LaTeX and Markdown constructs are rewritten; code and formulas are set aside meanwhile. Clean text has `#` headings,
`- ` lists, ` | ` between cells, fenced code and `$`-delimited formulas.

Defined results: null texts give no row; texts without markup come out unchanged with no kinds and no nodes; empty texts
too. Neither nesting nor length of a construct is limited.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.markup_signs import TAG, constructs, html_marks

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("script style noscript template head nav iframe object".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_STOPS = frozenset("ul ol table tr td th div body section article dl blockquote".split())


#: How what is no element ends.
_UNTIL = {"<!--": "-->", "<![": "]]>", "<!d": ">", "<?x": ">"}


class Page(HTMLParser):
    """Nodes in document order: name, parent, and an event list to render from.

    tags: matches of TAG. marks: (position, characters, whether it is a link) of other constructs, which become nodes
    `#mark` and `#link` under the element that is open there. Unless the text as a whole is a page, a `<` that begins
    none of the tags is text."""

    def __init__(self, text: str, tags: list[re.Match], marks: list[tuple[int, int, bool]] = ()):
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.attrs = ["#root"], [-1], [{}]
        self.events: list[tuple] = []
        self.open = [0]
        first = tags[0] if tags else None
        self.whole = first is not None and (re.match(r"<(?!br\b|!\[)[a-z!]", first[0], re.I) is not None and not text[: first.start()].strip() or any(re.match(r"<(?:html|body|!doctype)\b", m[0], re.I) for m in tags))
        marks = iter(marks)
        mark = next(marks, None)
        at = 0
        for m in [*tags, None]:
            end = m.start() if m else len(text)
            if end < at:  # within a comment
                continue
            while mark and mark[0] < end:
                self._mark("#link" if mark[2] else "#mark", mark[1])
                mark = next(marks, None)
            gap = text[at:end]
            self.feed(gap if self.whole else gap.replace("<", "&lt;"))
            if m:
                at = m.end()
                until = _UNTIL.get(m[0][:4]) or _UNTIL.get(m[0][:3].lower())
                if until:
                    self._mark("#mark", 0)
                    stop = text.find(until, at)
                    if stop >= 0:
                        if until == "]]>":
                            self.feed(html.escape(text[at:stop]))
                        at = stop + len(until)
                else:
                    self.feed(m[0])
        self.close()
        while len(self.open) > 1:
            self._end()

    def _mark(self, name: str, chars: int) -> None:
        self.events.append(("mark", len(self.names), chars))
        self.names.append(name)
        self.parents.append(self.open[-1])
        self.attrs.append({})

    def _end(self) -> None:
        self.events.append(("end", self.open.pop(), ""))

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag) or ({"p"} if tag in _BLOCK else ())
        for i in range(len(self.open) - 1, 0, -1):
            name = self.names[self.open[i]]
            if name in ends:
                while len(self.open) > i:
                    self._end()
                break
            if name in _STOPS:
                break
        node = len(self.names)
        self.names.append(tag)
        self.parents.append(self.open[-1])
        self.attrs.append(dict(attrs) if tag == "img" else {})
        self.events.append(("start", node, ""))
        self.open.append(node)
        if tag in _VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._end()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.names[self.open[i]] == tag:
                while len(self.open) > i:
                    self._end()
                return
        self._mark("#mark", 0)

    def handle_data(self, data):
        self.events.append(("text", self.open[-1], data))


def composite_densities(page: Page) -> tuple[list[float], list[float]]:
    """(density, density sum) of every node."""
    n = len(page.names)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # text of a block between inner blocks: characters, in links, links
    run = [[0, 0, 0] for _ in range(n)]
    dropped, linked, block = [False] * n, [False] * n, list(range(n))
    for i in range(1, n):
        up, name = page.parents[i], page.names[i]
        dropped[i] = dropped[up] or name in _DROP
        linked[i] = linked[up] or name == "a"
        if name not in _BLOCK and name not in _DROP:
            block[i] = block[up]
    for kind, node, data in page.events:
        at = block[node]
        if kind == "text" and not dropped[node]:
            size = len(data.strip())
            chars[node] += size
            link_chars[node] += size if linked[node] else 0
            run[at][0] += size
            run[at][1] += size if linked[node] else 0
        elif kind == "mark":
            if page.names[node] == "#link" and not dropped[node]:
                link_chars[node] = data
                run[at][1] += data
                run[at][2] += 1
        elif kind == "start" and page.names[node] == "a":
            run[at][2] += 1
        elif at == node:  # a block begins or ends: so does a run of the text around it
            for x in (at, block[page.parents[at]] if at else 0):
                runs[x].append(tuple(run[x]))
                run[x] = [0, 0, 0]
    for x in range(n):
        runs[x].append(tuple(run[x]))
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = page.parents[i]
        if dropped[i]:
            continue
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (page.names[i] in ("a", "#link"))
    body = next((i for i, name in enumerate(page.names) if name == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)

    def dense(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        # base is at least 1; where it is 1 (no links at all) the logarithm is the natural one
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / math.log(max(base, math.e))

    density = [0.0 if dropped[i] else dense(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(n)]
    total = [0.0 if dropped[i] else sum(dense(c, 1 + links, lc, links) for c, lc, links in runs[i]) for i in range(n)]
    for i in range(1, n):
        if block[i] == i:  # inline elements belong to the text of their block
            total[block[page.parents[i]]] += density[i]
    return density, total


def content_nodes(page: Page) -> set[int]:
    """Roots of the subtrees that are content."""
    density, total = composite_densities(page)
    n = len(density)
    body = next((i for i, name in enumerate(page.names) if name == "body"), 0)
    if not any(total):
        return {body}
    best = list(range(n))  # of each subtree the node with the largest sum, the outer one in a tie
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        if total[best[i]] > total[best[up]]:
            best[up] = best[i]
    top = best[body]
    threshold, at = density[top], top
    while at not in (body, -1):
        at = page.parents[at]
        threshold = min(threshold, density[at])
    marked = set()
    inside = [False] * n
    for i in range(body, n):
        up = page.parents[i]
        inside[i] = (up >= 0 and inside[up]) or i in marked
        if not inside[i] and (i == body or density[i] >= threshold > 0):
            marked.add(best[i])
            inside[i] = best[i] == i
    return marked


def render(page: Page) -> str:
    content = content_nodes(page)
    out: list[str] = []
    depth, skip, pre = 0, 0, 0
    lists: list[list] = []

    def line(blank: bool = False) -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")
        if blank and out and not "".join(out[-2:]).endswith("\n\n"):
            out.append("\n")

    for kind, node, data in page.events:
        name = page.names[node]
        if kind == "mark":
            continue
        if kind == "start":
            depth += node in content
            skip += name in _DROP
            if not (depth or 0 in content) or skip:
                continue
            if name == "br":
                out.append("\n")
            elif name == "img":
                out.append((page.attrs[node].get("alt") or "").strip())
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                line(True)
                out.append("#" * int(name[1]) + " ")
            elif name in ("ul", "ol"):
                line(not lists)
                lists.append([name, 0])
            elif name == "li":
                line()
                if lists:
                    lists[-1][1] += 1
                out.append("  " * max(len(lists) - 1, 0) + (f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "))
            elif name == "pre":
                line(True)
                out.append("```\n")
                pre += 1
            elif name == "code" and not pre:
                out.append("`")
            elif name == "math":
                out.append("$")
            elif name in ("td", "th"):
                if out and not out[-1].endswith("\n"):
                    out.append(" | ")
            elif name == "tr":
                line()
            elif name in _BLOCK:
                line(name in ("p", "table", "div", "section", "article", "blockquote"))
        elif kind == "text":
            if (depth or 0 in content) and not skip:
                if pre:
                    out.append(data)
                else:
                    data = re.sub(r"[ \t]*\n[ \t]*(?:\n[ \t]*)+", "\x00", data)
                    data = re.sub(r"[ \t\r\n]+", " ", data).replace("\x00", "\n\n")
                    if out and out[-1].endswith(("\n", " ")):
                        data = data.lstrip(" ")
                    out.append(data)
        else:
            if (depth or 0 in content) and not skip:
                if name == "pre":
                    pre -= 1
                    line()
                    out.append("```\n")
                elif name == "code" and not pre:
                    out.append("`")
                elif name == "math":
                    out.append("$")
                elif name in ("ul", "ol") and lists:
                    lists.pop()
                    line(not lists)
                elif name in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "table", "blockquote"):
                    line(True)
                elif name in ("li", "tr", "div", "dt", "dd"):
                    line()
            depth -= node in content
            skip -= name in _DROP
    return "".join(out)


def _nested(text: str, begin: str, end: str, replace) -> str:
    """Replace balanced constructs, inner ones first; what isn't balanced stays. replace: (match of begin, inside)."""
    parts: list[list[str]] = [[]]
    heads: list[re.Match] = []
    at = 0
    for m in re.finditer(f"(?P<end>{end})|{begin}", text):
        parts[-1].append(text[at : m.start()])
        at = m.end()
        if not m["end"]:
            heads.append(m)
            parts.append([])
        elif heads:
            inside = "".join(parts.pop())
            parts[-1].append(replace(heads.pop(), inside))
        else:
            parts[-1].append(m[0])
    parts[-1].append(text[at:])
    while heads:
        inside = "".join(parts.pop())
        parts[-1].append(heads.pop()[0] + inside)
    return "".join(parts[0])


def from_html(text: str, keep) -> str:
    text = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "", text)
    text = re.sub(r"(?is)<(?:syntaxhighlight|source)\b[^>]*>(.*?)</(?:syntaxhighlight|source)\s*>", lambda m: keep("```\n" + m[1].strip("\n") + "\n```"), text)
    text = re.sub(r"(?is)<pre\b[^>]*>(.*?)</pre\s*>", lambda m: keep("```\n" + html.unescape(TAG.sub("", m[1])).strip("\n") + "\n```"), text)
    text = re.sub(r"(?is)<math\b[^>]*>(.*?)</math\s*>", lambda m: keep("$" + html.unescape(m[1]) + "$"), text)
    text = re.sub(r"(?is)<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", "", text)

    def tag(m: re.Match) -> str:
        name = re.sub(r"[^a-z0-9].*", "", m[0][1:].lower().lstrip("/ "), flags=re.S)
        if name == "br" or name in _BLOCK:
            return "\n"
        return "`" if name == "code" else ""

    text = TAG.sub(tag, text)
    return html.unescape(text)


def from_wiki(text: str, keep) -> str:
    text = re.sub(r"(?m)^(={1,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$", lambda m: "#" * max(1, len(m[1]) - 1) + " " + m[2], text)
    text = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría):[^\]\n]*\]\]\n?", "", text)
    text = re.sub(r"\[\[(?:[^\]\[|\n]*\|)*([^\]\[|\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]*([^\]\n]*)\]", r"\1", text)

    def template(_, inside: str) -> str:
        parts = [p.strip() for p in inside.split("|")[1:]]
        named = [p.split("=", 1) for p in parts if "=" in p]
        if named:
            return "\n".join(f"- {k.strip()}: {v.strip()}" for k, v in named)
        return parts[-1] if parts else ""

    text = _nested(text, r"\{\{(?!\{)", r"\}\}", template)
    text = re.sub(r"'{2,5}(?=\S)([^'\n]+(?:'[^'\n]+)*)'{2,5}", r"\1", text)

    def table(m: re.Match) -> str:
        rows: list[list[str]] = [[]]
        for x in m[0].split("\n")[1:-1]:
            x = x.strip()
            if x.startswith("|-"):
                rows.append([])
            elif x.startswith("|+"):
                rows.append([x[2:].strip()])
            elif x[:1] in ("|", "!"):
                rows[-1] += [c.strip() for c in re.split(r"\|\||!!", x[1:])]
        return "\n".join(" | ".join(r) for r in rows if r)

    text = re.sub(r"(?ms)^[ \t]*\{\|.*?^[ \t]*\|\}", table, text)
    text = re.sub(r"(?m)^[ \t]*(?:\{\||\|\}|\|-)[^\n]*\n?", "", text)
    return re.sub(r"__(?:NO)?TOC__\n?", "", text)


_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def from_latex(text: str, keep) -> str:
    start = re.search(r"\\begin\{document\}", text)
    if start:
        text = text[start.end() :]
    text = text.replace("\\end{document}", "")
    text = re.sub(r"(?s)\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(.*?)\n?\\end\{\1\*?\}", lambda m: keep("```\n" + m[2] + "\n```"), text)
    text = re.sub(r"(?s)\\begin\{(equation|align|gather|displaymath|math|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: keep("$$" + m[3].strip() + "$$"), text)
    text = re.sub(r"(?s)\\\[(.*?)\\\]|\$\$(.*?)\$\$", lambda m: keep("$$" + (m[1] or m[2] or "").strip() + "$$"), text)
    text = re.sub(r"(?s)\\\((.*?)\\\)", lambda m: keep("$" + m[1].strip() + "$"), text)
    text = re.sub(r"(?<![\w$\\])\$([^$\n]*[\\^_=+<>{}A-Za-z][^$\n]*)\$(?![\w$])", lambda m: keep(m[0]) if re.search(r"[\\^_=+{}]|^[A-Za-z]$", m[1]) else m[0], text)

    def tabular(m: re.Match) -> str:
        body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", m[1])
        return "\n".join(" | ".join(c.strip() for c in row.split("&")) for row in re.split(r"\\\\", body) if row.strip())

    text = re.sub(r"(?s)\\begin\{(?:tabular|array|longtable)\*?\}(?:\[[^\]]*\])?(?:\{[^\n]*\})?(.*?)\\end\{(?:tabular|array|longtable)\*?\}", tabular, text)
    text = re.sub(r"(?m)(?<!\\)%[^\n]*\n?" if start or "\\section" in text else r"(?m)^%[^\n]*\n", "", text)
    text = re.sub(r"[ \t]*\\(?:cite[a-z]*|label|ref|eqref|index|bibliography|bibliographystyle|includegraphics|usepackage|documentclass|vspace|hspace)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}", "", text.replace("~\\", "\\"))
    text = re.sub(r"\\(?:begin|end)\{[^}\n]*\}(?:\[[^\]\n]*\])?", "", text)
    text = re.sub(r"(?m)^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "- " + (m[1] + " " if m[1] else ""), text)
    def command(m: re.Match, inside: str) -> str:
        if not m["name"]:
            return "{" + inside + "}"
        if m["name"] in _HEADS:
            return "\n" + "#" * _HEADS[m["name"]] + " " + inside + "\n"
        return f" ({inside})" if m["name"] == "footnote" else inside

    text = _nested(text, r"\\(?P<name>[a-zA-Z]+)\*?(?:\[[^\]\n]*\])*\{|(?<!\\)\{", r"(?<!\\)\}", command)
    text = re.sub(r"(?<![\w:\\])\\(?:item|maketitle|tableofcontents|noindent|par|newpage|centering|hline|quad|left|right)(?![A-Za-z])[ \t]*", "", text)
    return re.sub(r"\\([%&#_{}$])", r"\1", text)


def from_markdown(text: str, keep) -> str:
    text = re.sub(r"\A---[ \t]*\n(?:[\w-]+:[^\n]*\n)+---[ \t]*\n?", "", text)
    text = re.sub(r"(?m)^([^\n|<>\s][^\n]*)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], text)
    text = re.sub(r"(?m)^( {0,3}\#{1,6}[ \t]+[^\n]*?)[ \t]+#+[ \t]*$", r"\1", text)
    text = re.sub(r"(?m)^ {0,3}\[[^\]\n]+\]:[ \t]+\S[^\n]*\n?", "", text)
    text = re.sub(r"\[\^[^\]\s]+\]", "", text)
    text = re.sub(r"!?\[([^\]\[\n]*)\](?:\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\]\n]+\])", r"\1", text)
    text = re.sub(r"(?m)^\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?\n?", "", text)
    text = re.sub(r"(?m)^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", text)
    text = re.sub(r"(?m)^( {0,3}>[ \t]?)+", "", text)
    text = re.sub(r"(?m)^([ \t]*[-*+][ \t])\[[ xX]\][ \t]", r"\1", text)
    text = re.sub(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]+)(?<=[^\s*])\1(?![\w*])", r"\2", text)
    text = re.sub(r"(?<![\w_\\/.])(_{1,3})(?=[^\s_])([^_\n]+)(?<=[^\s_])\1(?![\w_(.])", r"\2", text)
    return re.sub(r"~~(?=\S)([^~\n]+)(?<=\S)~~", r"\1", text)


_STEPS = {"html": from_html, "wiki": from_wiki, "latex": from_latex, "markdown": from_markdown}


def parse(text: str) -> tuple[Page | None, list[str]]:
    """(tree, kinds of markup); no tree if that were but a root."""
    tags, references = html_marks(text)
    others = constructs(text)
    found = ["html"] * bool(tags or references) + list(others)
    marks = sorted([(m.start(), 0, False) for m in references] + [x for xs in others.values() for x in xs])
    return (Page(text, tags, marks) if found else None), found


def analysed(text: str) -> tuple[str, list[str], int, float]:
    """(clean text, kinds of markup it held, nodes of its tree beside the root, density of the root)."""
    page, found = parse(text)
    if page is None:
        return text, found, 0, float(len(text))
    density = composite_densities(page)[0][0]
    kept: list[str] = []

    def keep(part: str) -> str:
        kept.append(part)
        return f"\x02{len(kept) - 1}\x03"

    out = text.replace("\x02", "").replace("\x03", "").replace("\r\n", "\n")
    fence = re.compile(r"(?ms)^[ \t]*(```|~~~)[^\n]*\n(.*?)^[ \t]*\1[ \t]*$")
    if "markdown" in found:
        out = fence.sub(lambda m: keep("```\n" + m[2] + "```"), out)
        out = re.sub(r"(?<![\\`\w])`(?=[^`\s])[^`\n]*`(?![`\w])", lambda m: keep(m[0]), out)
    for kind in _STEPS:
        if kind in found:
            out = render(Page(out, html_marks(out)[0])) if kind == "html" and page.whole else _STEPS[kind](out, keep)
            if kind == "html":
                out = fence.sub(lambda m: keep("```\n" + m[2] + "```"), out)
    out = re.sub(r"[ \t]+\n", "\n", out)
    out = re.sub(r"\n{3,}", "\n\n", out).strip("\n")

    def back(part: str) -> str:  # what is kept may hold what was kept before it
        return re.sub("\x02([0-9]+)\x03", lambda m: back(kept[int(m[1])]), part)

    return back(out), found, len(page.names) - 1, density


def clean(text: str) -> tuple[str, list[str]]:
    """(clean text, kinds of markup it held)."""
    return analysed(text)[:2]


def clean_texts(documents: DataFrame) -> DataFrame:
    """doc_id, kinds (of html, wiki, markdown, latex), nodes of the text's tree beside its root, density of the root
    (composite text density; characters where there is no markup), and the clean text, of every document."""
    names, types = ["doc_id", "kinds", "nodes", "density", "text"], [pa.list_(pa.string()), pa.int32(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [analysed(t) for t in b.column(1).to_pylist()]
            cols = [[k for _, k, _, _ in done], [n for _, _, n, _ in done], [d for _, _, _, d in done], [t for t, _, _, _ in done]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, kinds array<string>, nodes int, density double, text string")
