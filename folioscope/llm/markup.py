"""Markup residue in texts: HTML, Markdown, wiki and LaTeX become clean text that keeps its structure (problem 2).

HTML goes by consensus host paths. A first pass scores every container of a page (its own text, less what stands in links)
and keeps the page's best generalised path: the tags and classes from the root, without digits. Spark adds up the votes
per host; the second pass extracts each page again, by the paths that won at its host: of the sections of a page only those
on winning paths stay, and loose text, lists and tables that stand in no section. In a section that frames the whole page
boxes of mostly links go. Wiki, Markdown and LaTeX constructs are then rewritten.
The output marks structure the same way for all languages: "# " headings, "- " items, " | " between cells, fenced code, $formulas$.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import BROADCAST_ROWS, materialize

# Element names of HTML, and those of them that hold blocks or page furniture.
TAGS = "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav nowiki object ol option p pre q ref s samp script section select small source span strike strong style sub summary sup svg syntaxhighlight table tbody td textarea tfoot th thead title tr tt u ul var video gallery includeonly noinclude onlyinclude references wbr"
CONTAINERS = frozenset("article aside blockquote body center div dl footer form header html main nav ol p section table td ul".split())
FURNITURE = frozenset("nav footer aside form script style head iframe button select".split())
FLOW = frozenset("blockquote dl ol p table td ul".split())
VOID = frozenset("br hr img input link meta source wbr col".split())
NAMES = "|".join(sorted(TAGS.split(), key=len, reverse=True))
TAG = re.compile(rf"<(/?)({NAMES})(?=[\s/>])((?:\s+[^<>]*?)?)\s*(/?)>", re.I)
CUT_TAG = re.compile(rf"</?(?:{NAMES})(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s<>\"']+))+\s*/?\s*(?=$|\n)|</(?:{NAMES})(?=\s*$)", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^<>]*>|<\?xml[^<>]*\?>|<!\[CDATA\[.*?\]\]>", re.S | re.I)
UNSEEN = re.compile(r"<(script|style|head)\b[^<>]*>.*?</\1\s*>|" + COMMENT.pattern, re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
CLASS = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""", re.I)
MAYBE = re.compile(r"[<&\\\[`*_~$|]|^[ ]{0,3}(?:#{1,6}|>|=|-{2}|\{|!|:|;)|''|\{\{|\}\}|==", re.M)

FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[^\n`]*$", re.M)
FENCED = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[ ]*([\w+#.-]*)[^\n`]*\n(.*?)(?:^[ ]{0,3}\1[`~]*[ ]*$|\Z)", re.M | re.S)
ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
UNDERLINE = re.compile(r"\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*\r?$", re.M)
SETEXT = re.compile(r"^(?![ \t]*[-*|>#])([^\n]*\w[^\n]*)\r?\n[ ]{0,3}(={3,}|-{3,})[ \t]*\r?$", re.M)
RULE = re.compile(r"^[ ]{0,3}(?:(?:\*[ ]*){3,}|(?:_[ ]*){3,}|(?:-[ ]*){3,})$", re.M)
BAR_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)
BAR_ROW = re.compile(r"^[ \t]*\|(?![-}+|])[^\n]*\|[ \t]*$", re.M)
QUOTE = re.compile(r"^[ ]{0,3}>[ ]?(?=\S)", re.M)
TASK = re.compile(r"^([ \t]*[-*+][ \t]+)\[[ xX]\][ \t]+", re.M)
IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:[ \t]+[\"'][^\"'\n]*[\"'])?\)")
LINK = re.compile(r"\[([^\[\]\n]+)\]\([^()\s]+(?:[ \t]+[\"'][^\"'\n]*[\"'])?\)")
REF_LINK = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]+)\]")
REF_DEF = re.compile(r"^[ ]{0,3}\[(?!\^)[^\[\]\n]+\]:[ \t]*\S+.*$", re.M)
NOTE_DEF = re.compile(r"^[ ]{0,3}\[\^[^\[\]\s]+\]:[ \t]*", re.M)
NOTE = re.compile(r"\[\^[^\[\]\s]+\]")
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>", re.I)
STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*(?!\*)|(?<![\w_])__(?=[^\s_])([^\n]*?[^\s_])__(?![\w_])", re.M)
DELETED = re.compile(r"(?<!~)~~(?=[^\s~])([^\n]*?[^\s~])~~(?!~)")
EMPH = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])")
EMPH_LOW = re.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?!\w)")
LEFT_PAIR = re.compile(r"(?<![\w*])\*\*(?=\w)|(?<=\w|[.,;:!?])\*\*(?![\w*])|(?<![\w~])~~(?=\w)|(?<=[\w.,;:!?])~~(?!\w)|(?<![\w_])__(?=[A-Za-z])(?!\w+__\()|(?<=[A-Za-z.,;:!?])__(?![\w_])")
TICK = re.compile(r"(?<!`)(`{1,2})(?=[^`\s])([^`\n]*?[^`\s])\1(?!`)")
ESCAPE = re.compile(r"\\([*_#`\[\]~>])")

WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M)
WIKI_BOLD = re.compile(r"'{2,5}(?=\S)([^\n']*(?:'[^\n']+)*)'{2,5}")
WIKI_APOS = re.compile(r"(?<!')'{2,3}(?=\w)|(?<=[\w.,;:!?])'{2,3}(?!')")
WIKI_FILE = re.compile(r"\[\[(?:File|Image|Category|Media)\s*:[^\[\]]*\]\]", re.I)
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+?)\]\]")
WIKI_CUT = re.compile(r"\[\[|\]\](?!\])")
WIKI_CALL = re.compile(r"\{\{([^{}|\n]*)((?:\|[^{}]*)?)\}\}")
#: {{name}} without arguments is a placeholder of a template, not a call.
PLACEHOLDER = re.compile(r"\s*[a-z]+(?:[_.][a-z]+)*\s*")
WIKI_EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]*))?\]", re.I)
WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*$|^[ \t]*\|\}[ \t]*$|^[ \t]*\|-+[^\n|]*$|^[ \t]*\|\+[^\n]*$", re.M)
WIKI_CELL = re.compile(r"^[ \t]*[|!][ \t]*(?![-}+|])([^\n]*)$", re.M)
WIKI_ITEM = re.compile(r"^(?!#+[ \t])([*#:;]{2,})[ \t]*(?=\S)", re.M)
WIKI_WORD = re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|FORCETOC|INDEX)__|^#REDIRECT\b", re.M)

# LaTeX commands by what becomes of their argument.
TEX_HEAD = "part chapter section subsection subsubsection paragraph subparagraph title"
TEX_KEEP = "emph textbf textit texttt textsc textsf textrm textsl underline mbox text caption footnote footnotetext title author uppercase"
TEX_DROP = "label ref eqref pageref cite citep citet autoref cref index vspace hspace bibliography bibliographystyle includegraphics input include usepackage documentclass pagestyle thispagestyle"
TEX_BARE = "it bf tt sc em rm sf item maketitle noindent newpage clearpage centering hline par bigskip medskip smallskip hfill vfill tableofcontents ldots dots quad qquad LaTeX TeX small large Large tiny"
TEX_HEADING = re.compile(rf"\\({'|'.join(TEX_HEAD.split())})\*?\{{([^{{}}]*)\}}")
TEX_ARG = re.compile(rf"\\(?:{'|'.join(TEX_KEEP.split())})\*?\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}")
TEX_HREF = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}|\\url\{([^{}]*)\}")
TEX_GONE = re.compile(rf"~?\\(?:{'|'.join(TEX_DROP.split())})\*?(?:\[[^\]]*\])*\{{[^{{}}]*\}}")
TEX_ENV = re.compile(r"\\(begin|end)\{([a-zA-Z*]+)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
TEX_SWITCH = re.compile(r"\{\\(?:it|bf|tt|sc|em|rm|sf|small|large|Large|tiny)\b[ \t]*([^{}]*)\}")
TEX_WORD = re.compile(rf"(?<![\w:\\/])\\(?:{'|'.join(sorted(TEX_BARE.split(), key=len, reverse=True))})(?![A-Za-z\\])\*?[ \t]*")
TEX_ANY = re.compile(r"(?<![\w:\\/.])\\[a-zA-Z]{2,}\*?(?=\{|\[[^\]\n]*\]\{)")
#: A command of no known meaning and its last argument, which stays.
TEX_OWN = re.compile(r"(?<![\w:\\/.])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*\{([^{}]*)\}")
TEX_LINE = re.compile(r"(?<=\s)\\\\(?=\s|$)", re.M)
TEX_MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
TEX_FORMULA = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
TEX_CODE = re.compile(r"\\begin\{(verbatim|lstlisting|minted|alltt)\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?[ \t]*\n?(.*?)\n?\\end\{\1\*?\}", re.S)
TEX_TABLE = re.compile(r"\\begin\{(tabular[x*]?|longtable|array)\}(?:\[[^\]\n]*\])?(?:\{[^{}]*\})*(.*?)\\end\{\1\}", re.S)
TEX_INLINE = re.compile(r"(?<![\w\\$])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
#: LaTeX and wiki commands that keep an indented line from passing for code.
INDENTED = re.compile("|".join([TEX_HEADING.pattern, TEX_ARG.pattern, TEX_GONE.pattern, TEX_HREF.pattern, TEX_ENV.pattern, r"\\\((?=\S)[^\n]+?\\\)|\$\$[^\n$]+\$\$", r"(?<![\w\])])\[\[[A-Za-z][^\[\]\n]*\]\]", r"\{\{[A-Za-z][\w -]*\|[^{}\n]*\}\}"]))
FORMULA = re.compile(r"\\[a-zA-Z]+|[\^_]\{?\w|[A-Za-z]\s*[=<>+]\s*\S|^[A-Za-z]$|^[A-Za-z]\([A-Za-z, ]+\)$|[=+*/^]\s*[A-Za-z]\b")
MATH_WORD = re.compile(r"(?<![\w:\\/.])\\(?:alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|rho|sigma|tau|phi|omega|sum|int|prod|sqrt|frac|leq|geq|neq|times|cdot|infty|partial|approx)(?![A-Za-z\\])")


def generalised(name: str, attributes: str) -> str:
    """A path step: the tag and its first class or id, digits taken out."""
    m = CLASS.search(attributes)
    mark = re.sub(r"\d+", "", next(g for g in m.groups() if g is not None).split()[0]).strip("-_") if m and "".join(g or "" for g in m.groups()).strip() else ""
    return f"{name}.{mark}" if mark else name


#: Steps of a generalised path that count, from the container upwards.
STEPS = 16


def containers(text: str) -> list[tuple[str, int, int, float, float, bool]]:
    """(path, start, end, score, share of text in links, is a frame) of each container of a page. Unclosed ones end with the page.

    Text counts for the innermost container around it, that of paragraphs, lists and tables for the one they stand in; so a
    wrapper scores only for what it holds itself. A frame has no text of the page outside; html and body always are frames.
    The work grows with the length of the page, however deep it is nested."""
    page = UNSEEN.sub(lambda m: " " * len(m.group(0)), text)
    tags = list(TAG.finditer(page))
    inked = np.frombuffer(TAG.sub(lambda m: " " * len(m.group(0)), page).encode("utf-32-le", "replace"), np.uint32)
    ink = np.concatenate([[0], np.cumsum(~((inked == 32) | ((inked >= 9) & (inked <= 13)) | (inked == 0xA0)))])
    found, spans, open_names = [], [], Counter()
    link_from, link_to = [], []
    open_link: list[tuple[list, int]] = []
    anchor, last = None, 0

    def own(end: int) -> None:
        if spans and (piece := page[last:end]).strip():
            pieces = spans[-1][5][4]
            pieces.append(piece)
            if anchor is not None:
                open_link.append((pieces, len(pieces) - 1))

    for m in tags:
        own(m.start())
        last = m.end()
        closing, name, attributes, single = m.group(1), m.group(2).lower(), m.group(3), m.group(4)
        if name == "a":
            if not closing:
                anchor = m.end()
                open_link.clear()
            elif anchor is not None:
                link_from.append(anchor)
                link_to.append(m.start())
                anchor = None
                for pieces, k in open_link:
                    pieces[k] = ""
        if name not in CONTAINERS or single or name in VOID:
            continue
        if not closing:
            if name == "p" and spans and spans[-1][3] == "p":
                open_names["p"] -= 1
                spans.pop()[2] = m.start()
            step = generalised(name, attributes)
            path = (*(spans[-1][0] if spans else ())[1 - STEPS :], step)
            span = [path, m.end(), len(page), name, [], None]
            span[5] = spans[-1][5] if spans and name in FLOW else span  # whose own text it is
            open_names[name] += 1
            spans.append(span)
            found.append(span)
        elif open_names[name]:
            while spans:
                top = spans.pop()
                open_names[top[3]] -= 1
                top[2] = m.start()
                if top[3] == name:
                    break
    own(len(page))
    linked = np.concatenate([[0], np.cumsum(ink[link_to] - ink[link_from])]) if link_to else np.zeros(1)
    out = []
    for path, start, end, name, pieces, _ in found:
        size = int(ink[end] - ink[start])
        i, j = bisect_left(link_from, start), bisect_right(link_to, end)
        mine = " ".join(" ".join(pieces).split()) + " "
        score = len(mine) - 1 + 10.0 * mine.count(",") + 20 * mine.count(". ") if mine.strip() else 0.0
        out.append(("/".join(path), start, end, score, float(linked[j] - linked[i]) / max(1, size) if j > i else 0.0, name in ("html", "body") or size == int(ink[-1])))
    return out


def outside(boxes: list[tuple[str, int, int, float, float, bool]], winners: frozenset[str]) -> list[tuple[int, int]]:
    """Spans of what goes from a page that has winning boxes: sections that hold no winning box and lie in none; boxes of mostly
    links, and what lies in a frame of the page and is named as furniture. Of another winning box, only menus and sections of
    mostly links go; its lists stay."""
    won = sorted(((s, e, frame) for path, s, e, score, _, frame in boxes if path in winners and score > 0), key=lambda w: (w[0], -w[1]))
    out: list[tuple[int, int]] = []
    starts = [w[0] for w in won]
    stack: list[tuple[int, int, bool]] = []
    at = 0
    for path, s, e, _, linked, _ in sorted(boxes, key=lambda b: (b[1], -b[2])) if won else ():
        while at < len(won) and won[at][0] <= s and (won[at][0] < s or won[at][1] >= e):
            while stack and stack[-1][1] <= won[at][0]:
                stack.pop()
            stack.append(won[at])
            at += 1
        while stack and stack[-1][1] < e:
            stack.pop()
        i = bisect_left(starts, s)
        if i < len(won) and won[i][1] <= e:
            continue  # holds a winning box
        step = path.rsplit("/", 1)[-1]
        name = step.split(".")[0]
        if stack and not stack[-1][2]:
            gone = name == "nav" or linked > 0.5 and name not in FLOW
        elif stack:
            gone = linked > 0.5 or name in FURNITURE
        else:
            gone = linked > 0.5 or name not in FLOW
        if gone:
            out.append((s, e))
    return out


def html_text(text: str, winners: frozenset[str] | None) -> str:
    """The text of a page, by the winning paths of its host."""
    if winners:
        kept, at = [], 0
        for s, e in sorted(outside(containers(text), winners)):  # boxes may be nested: each cut is made once
            kept.append(text[at : max(at, s)])
            at = max(at, e)
        text = "".join(kept) + text[at:]
    text = re.sub(r"<(script|style)\b[^<>]*>.*?</\1\s*>", " ", text, flags=re.S | re.I)
    text = COMMENT.sub("", text)
    text = re.sub(r"<(pre|syntaxhighlight)\b[^<>]*>\s*(?:<code[^<>]*>)?\n?(.*?)\n?(?:</code>\s*)?</\1\s*>", lambda m: f"\n```\n{m.group(2)}\n```\n", text, flags=re.S | re.I)
    text = re.sub(r"<math\b[^<>]*>(.*?)</math\s*>", lambda m: f"${m.group(1)}$", text, flags=re.S | re.I)
    text = re.sub(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", lambda m: f"\n{'#' * int(m.group(1))} {m.group(2)}\n", text, flags=re.S | re.I)
    text = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", " | ", text, flags=re.I)
    text = re.sub(r"\s*<li\b[^<>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"<sup\b[^<>]*>(.*?)</sup\s*>", r"^\1", text, flags=re.I)
    text = re.sub(r"<sub\b[^<>]*>(.*?)</sub\s*>", r"_\1", text, flags=re.I)
    text = re.sub(r"<br\s*/?>|</tr\s*>|</(?:ul|ol|table|div|section)\s*>", "\n", text, flags=re.I)
    text = re.sub(r"</?p\b[^<>]*>|</?blockquote\b[^<>]*>", "\n\n", text, flags=re.I)
    return CUT_TAG.sub("", TAG.sub("", text))


def clean(text: str | None, winners: frozenset[str] | None = None) -> tuple[str | None, int, int, int, int]:
    """(clean text, number of HTML, Markdown, wiki and LaTeX constructs). Text without markup comes back as it is."""
    if not text or not MAYBE.search(text):
        return text, 0, 0, 0, 0
    if "\x00" in text:  # the mark of what is set aside; another character stands for it meanwhile
        seen = set(text + html.unescape(text))
        stand_in = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in seen)
        out, *n = clean(text.replace("\x00", stand_in), winners)
        return out.replace(stand_in, "\x00"), *n
    counts = {"html": 0, "md": 0, "wiki": 0, "tex": 0}
    kept: list[str] = []

    def sub(kind: str, pattern: re.Pattern, by, t: str) -> str:
        t, n = pattern.subn(by, t)
        counts[kind] += n
        return t

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    def call(m: re.Match) -> str:
        if not m.group(2) and PLACEHOLDER.fullmatch(m.group(1)):
            return m.group(0)
        counts["wiki"] += 1
        return ""

    t = sub("md", FENCED, lambda m: keep(f"```{m.group(2)}\n{m.group(3).rstrip()}\n```"), text)
    t = sub("md", FENCE, "", t)
    # a line that is indented like code is left alone, but for tags and commands in it
    t = re.sub(r"^(?: {4}|\t)(?![-*+•] |\d+[.)] )[^\n]*$", lambda m: m.group(0) if TAG.search(m.group(0)) or ENTITY.search(m.group(0)) or INDENTED.search(m.group(0)) else keep(m.group(0)), t, flags=re.M)
    n = len(TAG.findall(t)) + len(COMMENT.findall(t)) + len(CUT_TAG.findall(t))
    if n:
        counts["html"] += n
        t = html_text(t, winners)
        t = re.sub(r"^```\n.*?^```$", lambda m: keep(html.unescape(m.group(0))), t, flags=re.M | re.S)
    entities = sum(html.unescape(e) != e for e in ENTITY.findall(t))
    if entities:
        counts["html"] += entities
    if "\\begin" in t:
        t = sub("tex", TEX_CODE, lambda m: keep(f"```\n{m.group(2)}\n```"), t)
        t = sub("tex", TEX_FORMULA, lambda m: keep(f"${m.group(3).strip()}$"), t)
        t = sub("tex", TEX_TABLE, lambda m: "\n".join(" | ".join(c.strip() for c in re.split(r"(?<!\\)&", row)) for row in re.split(r"\\\\(?:\[[^\]\n]*\])?", re.sub(r"\\(?:[hc]line|toprule|midrule|bottomrule)(?:\{[^{}]*\})?", "", m.group(2))) if row.strip()), t)
    t = sub("tex", TEX_MATH, lambda m: keep(f"${next(g for g in m.groups() if g is not None).strip()}$"), t)
    t = TEX_INLINE.sub(lambda m: (counts.__setitem__("tex", counts["tex"] + 1) or keep(m.group(0))) if FORMULA.search(m.group(1)) else m.group(0), t)
    if "\\" in t:
        t = sub("tex", TEX_HEADING, lambda m: f"{'#' * (1 + TEX_HEAD.split().index(m.group(1)) % 6)} {m.group(2)}", t)
        for _ in range(3):
            t = sub("tex", TEX_ARG, r"\1", t)
        t = sub("tex", TEX_HREF, lambda m: m.group(1) or m.group(2), t)
        t = sub("tex", TEX_GONE, "", t)
        t = sub("tex", TEX_ENV, "", t)
        t = sub("tex", TEX_SWITCH, r"\1", t)
        t = re.sub(r"^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*", lambda m: counts.__setitem__("tex", counts["tex"] + 1) or "- ", t, flags=re.M)
        t = sub("tex", TEX_WORD, "", t)
        for _ in range(3):
            t = sub("tex", TEX_OWN, r"\1", t)
        t = sub("tex", TEX_ANY, "", t)
        t = sub("tex", MATH_WORD, lambda m: m.group(0), t)
        t = sub("tex", TEX_LINE, "", t)
        t = sub("md", ESCAPE, r"\1", t)
    if "[[" in t or "]]" in t:
        t = sub("wiki", WIKI_FILE, "", t)
        t = sub("wiki", WIKI_LINK, r"\1", t)
        t = sub("wiki", WIKI_CUT, "", t)
    if "{{" in t:
        t = WIKI_CALL.sub(call, t)
    t = sub("wiki", WIKI_EXTERNAL, lambda m: m.group(1) or "", t)
    t = sub("wiki", WIKI_WORD, "", t)
    if "''" in t:
        t = sub("wiki", WIKI_BOLD, r"\1", t)
        t = sub("wiki", WIKI_APOS, "", t)
    t = sub("wiki", WIKI_HEAD, lambda m: f"{'#' * (len(m.group(1)))} {m.group(2)}", t)
    tables = len(WIKI_TABLE.findall(t))
    if tables:
        counts["wiki"] += tables
        t = WIKI_CELL.sub(lambda m: re.sub(r"\s*(?:\|\||!!)\s*", " | ", m.group(1)), WIKI_TABLE.sub("", t))
    t = sub("wiki", WIKI_ITEM, lambda m: "  " * (len(m.group(1)) - 1) + "- ", t)
    t = sub("md", IMAGE, r"\1", t)
    t = sub("md", LINK, r"\1", t)
    t = sub("md", REF_LINK, r"\1", t) if REF_DEF.search(t) else t
    t = sub("md", REF_DEF, "", t)
    t = sub("md", NOTE_DEF, "", t)
    t = sub("md", NOTE, "", t)
    t = sub("md", AUTOLINK, r"\1", t)
    bars = len(BAR_RULE.findall(t)) + len(BAR_ROW.findall(t)) * (not tables)
    if bars:
        counts["md"] += bars
        t = BAR_ROW.sub(lambda m: " | ".join(c.strip() for c in m.group(0).strip().strip("|").split("|")), BAR_RULE.sub("", t))
    if UNDERLINE.search(t):
        t = sub("md", SETEXT, lambda m: f"{'#' if m.group(2)[0] == '=' else '##'} {m.group(1).strip()}", t)
    t = sub("md", TICK, r"\2", t)
    if "*" in t or "_" in t or "~" in t:
        t = sub("md", STRONG, lambda m: m.group(1) or m.group(2), t)
        t = sub("md", DELETED, r"\1", t)
        t = sub("md", EMPH, r"\1", t)
        t = sub("md", EMPH_LOW, r"\1", t)
        t = sub("md", LEFT_PAIR, "", t)
    t = sub("md", QUOTE, "", t)
    t = sub("md", TASK, r"\1", t)
    t = sub("md", RULE, "", t)
    counts["md"] += len(ATX.findall(t))
    if not any(counts.values()):
        return text, 0, 0, 0, 0
    t = html.unescape(t) if entities else t
    while "\x00" in t and kept:
        t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], t)
    t = re.sub(r"[ \t]+\n", "\n", t.replace("\r\n", "\n").replace("\xa0", " "))
    t = re.sub(r"\A(?:[ \t]*\n)+|\s+\Z", "", re.sub(r"\n{3,}", "\n\n", t))
    return t, counts["html"], counts["md"], counts["wiki"], counts["tex"]


def host_paths(df: DataFrame, host: str, text: str, share: float = 0.2) -> DataFrame:
    """host, paths: the generalised paths that won at least `share` of the votes of the best one. A vote is a page's best
    container, weighted by its score; votes are added up per host and path before anything is compared. A null host is a host."""
    rows = df.select(F.col(host).cast("string").alias("host"), F.col(text).alias("text")).filter(F.col("text").rlike(r"(?i)<(?:div|p|section|article|main|table|ul|ol|td|body)[\s>]"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple, float] = {}
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                boxes = containers(t)
                if boxes:
                    best = max(boxes, key=lambda b: (b[3], b[0]))
                    votes[h, best[0]] = votes.get((h, best[0]), 0.0) + best[3]
            if votes:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes]), pa.array(votes.values(), pa.float64())], ["host", "path", "v"])

    votes = rows.mapInArrow(score, "host string, path string, v double").groupBy("host", "path").agg(F.sum("v").alias("v"))
    best = votes.groupBy("host").agg(F.max("v").alias("top"))
    won = votes.withColumn("h", F.coalesce("host", F.lit(""))).join(best.select(F.coalesce("host", F.lit("")).alias("h"), "top"), "h").filter((F.col("v") > 0) & (F.col("v") >= share * F.col("top")))
    return won.groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("paths"))  # at most 1 / share paths by weight


def clean_markup(df: DataFrame, key: str = "chunk_id", text: str = "text", host: str = "source_domain") -> DataFrame:
    """Per row: the key, clean_text and how many html, markdown, wiki and latex constructs it held.

    Null text stays null with counts of 0; text without markup stays as it is; repeated rows give repeated rows; other
    columns are not carried. Hosts whose winning paths are too many to broadcast are joined by a shuffle instead."""
    winners = materialize(host_paths(df, host, text))
    known = winners.limit(BROADCAST_ROWS + 1).count()
    rows = df.select(F.col(key).alias("__key"), F.col(host).cast("string").alias("__host"), F.col(text).alias("__text"))
    small = {r.host: frozenset(r.paths) for r in winners.collect()} if known <= BROADCAST_ROWS else None
    if small is None:
        rows = rows.join(winners, F.col("__host").eqNullSafe(F.col("host")), "left").select("__key", "__host", "__text", "paths")
    shared = df.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            hosts, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            paths = [table.get(h) for h in hosts] if table is not None else [frozenset(p) if p else None for p in batch.column(3).to_pylist()]
            columns = list(zip(*(clean(t, p) for t, p in zip(texts, paths)))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["__key", "clean_text", "n_html", "n_markdown", "n_wiki", "n_latex"])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, clean_text string, n_html int, n_markdown int, n_wiki int, n_latex int").withColumnRenamed("__key", key)
