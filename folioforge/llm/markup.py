"""Problem 3: markup of other systems in text chunks to clean text (tag-path ratios)."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: Scale of the smoothing over the nodes in document order, and the share of the mean fused ratio from which a path is content.
SIGMA, THRESHOLD = 1.0, 0.15
#: Cheap test, on the JVM, of any sign that markup can begin with; texts without one are already clean.
MAYBE = r"</?[A-Za-z!]|\\[A-Za-z\[(]|`|\*\S|\[\[|\]\(|\{[{|]|~~|__|&#?\w{1,8};|''|(?:^|\n)[ \t]*(?:#{1,6}\s|>\s?\S|==|\|[-} :]|:?--)|\$[^$\n]*\$"

# Commands of LaTeX that stand without an argument in braces.
BARE = "item|par|noindent|newline|clearpage|newpage|maketitle|tableofcontents|centering|hline|toprule|midrule|bottomrule|leq|geq|times|cdot|alpha|beta|gamma|sum|int|infty|ldots|dots|quad"

# (kind, tag, pattern): what each construct is called in a tag path. Order: the first that matches at a place holds.
RULES = [
    ("html", "comment", r"<!--.*?(?:-->|$)"),
    ("wiki", "ref", r"<ref\b[^<>]*?(?:/>|>.*?</ref>)"),
    ("wiki", "switch", r"__[A-Z]{3,}__"),
    ("wiki", "file", r"\[\[(?:File|Image|Datei|Fichier|Archivo|Plik):[^\[\]\n]*\]\]"),
    ("wiki", "link", r"\[\[[^\[\]\n]+\]\]"),
    ("wiki", "template", r"\{\{[^{}]*\}\}"),
    ("wiki", "table", r"(?m:^\{\|[^\n]*$)|(?m:^\|[-}][^|\n]*$)"),
    ("wiki", "h", r"(?m:^(={2,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*$)"),
    ("wiki", "b", r"'''(?:[^'\n]|'(?!''))+'''|''(?:[^'\n]|'(?!'))+''"),
    ("markdown", "fence", r"(?m:^(?:```|~~~)[^\n`]*$)(?:.*?(?m:^(?:```|~~~)[ \t]*$))?"),
    ("markdown", "code", r"(?<!`)`[^`\n]+`(?!`)"),
    ("markdown", "image", r"!\[[^\[\]\n]*\]\([^()\n]*\)"),
    ("markdown", "a", r"(?<!\\)\[[^\[\]\n]+\]\((?:[^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\)"),
    ("markdown", "b", r"(?<!\*)\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?!\*)|(?<![\w_])__(?=[^\s_])[^_\n]+?(?<=\S)__(?![\w_])"),
    ("markdown", "del", r"~~(?=\S)[^~\n]+?(?<=\S)~~"),
    ("markdown", "i", r"(?<![\w*\\])\*(?=[^\s*])[^*\n]{1,120}?(?<=[^\s*])\*(?![\w*])"),
    ("markdown", "quote", r"(?m:^>[ \t]?(?=\S))"),
    ("markdown", "rule", r"(?m:^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$)"),
    ("markdown", "h", r"(?m:^#{1,6}[ \t]+(?=\S))"),
    ("latex", "math", r"\\\[.*?\\\]|\\\(.*?\\\)|\$\$[^$]+\$\$|\$(?=[^\s$])[^$\n]*?[\\^_{][^$\n]*?\$"),
    ("latex", "env", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\[\]\n]*\])?"),
    ("latex", "h", r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{[^{}]*\}"),
    ("latex", "cite", r"~?\\(?:cite[a-z]*|ref|label|eqref|pageref|vspace|hspace|input|usepackage|documentclass)\*?(?:\[[^\[\]\n]*\])?\{[^{}\n]*\}"),
    ("latex", "command", r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?\{(?:[^{}]|\{[^{}]*\})*\}"),
    ("latex", "bare", r"(?<![\w:\\])\\(?:" + BARE + r")(?![A-Za-z])"),
    ("html", "tag", r"</?[A-Za-z][A-Za-z0-9]{0,14}(?:[ \t\n][^<>]*)?/?>"),
    ("html", "entity", r"&(?:[A-Za-z]{2,8}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
]
_lead = re.compile(r"(?m)^[ \t]+(?=[|{=`~>#:-])")
_scan = re.compile(r"(?=[<\\`*\[{|~_$&!'=#>:-])(?:" + "|".join(f"(?P<r{i}>{p.replace(chr(92) + '1', '(?P=eq)').replace('(={2,6})', '(?P<eq>={2,6})')})" for i, (_, _, p) in enumerate(RULES)) + ")", re.S)
#: HTML tags that hold or open a block, and tags whose content is never text.
BLOCK = frozenset("p div section article main body header footer aside nav ul ol li table tr td th h1 h2 h3 h4 h5 h6 pre blockquote br hr dl dt dd figure".split())
VOID = frozenset("br hr img input meta link wbr col".split())
NOTEXT = frozenset("script style noscript template svg".split())
#: Paths with one of these steps keep their text whatever their ratio: they are the structure that must stay.
STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 h li item code pre fence math td th quote".split())
_punct = re.compile(r"[.,;:!?…·]")
_latex_comment = re.compile(r"(?<![\\\d~])[ \t]%[ \t]*[A-Za-z]+[ \t]*$", re.M)


def own_heading(line: str, heading: str | None) -> bool:
    s = line.strip()
    return s.startswith("#") and heading is not None and s.lstrip("#").strip().lower() == heading.strip().lower()


#: Tags deeper than this are read, but the text in them stands on the path down to here.
DEEPEST = 200


def parse(text: str, heading: str | None = None) -> tuple[set[str], list[tuple[tuple[str, ...], str]]]:
    """Kinds of markup in a text, and its nodes (tag path, text) in document order. Separators of blocks are nodes with the path ('br',).

    A line of `#` signs that names `heading` is the chunk's own and no markup; where no heading is given, that is the first line; an empty one says that the chunk has none."""
    kinds: set[str] = set()
    nodes: list[tuple[tuple[str, ...], str]] = []
    stack: list[str] = []
    if "&lt;" in text and re.search(r"&lt;/?[A-Za-z][^&<>]{0,80}&gt;", text):
        kinds.add("html")  # markup that was escaped once more
        text = re.sub(r"&lt;(/?[A-Za-z][^&<>]{0,80})&gt;", r"<\1>", text)
    text = _lead.sub("", text)
    first = len(text) - len(text.lstrip())
    pos = 0

    def put(path: tuple[str, ...], s: str) -> None:
        if s:
            nodes.append((path, s))

    def inner(path: tuple[str, ...], s: str) -> None:
        k, ns = parse_inline(s)
        kinds.update(k)
        nodes.extend((path + p, x) for p, x in ns)

    def here() -> tuple[str, ...]:
        return ("body", *stack)

    for m in _scan.finditer(text):
        i = int(m.lastgroup[1:]) if m.lastgroup and m.lastgroup[0] == "r" else next(int(k[1:]) for k, v in m.groupdict().items() if v is not None and k[0] == "r")
        kind, tag, _ = RULES[i]
        s = m.group()
        if kind == "markdown" and tag == "h":
            line = text[m.start() : (text.find("\n", m.start()) + 1 or len(text) + 1) - 1]
            if (heading is None and m.start() <= first) or own_heading(line, heading):
                continue
        put(here(), text[pos : m.start()])
        pos = m.end()
        kinds.add(kind)
        if tag == "tag":
            name = re.match(r"</?([A-Za-z0-9]+)", s).group(1).lower()
            if name in BLOCK:
                put(("br",), "\n")
            if s[1] == "/":
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif name not in VOID and not s.endswith("/>") and len(stack) < DEEPEST:
                if name in ("p", "li") and name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
                stack.append(name)
            if name == "li" and s[1] != "/":
                put((*here(), "mark"), "- ")
            elif re.fullmatch(r"h[1-6]", name) and s[1] != "/":
                put((*here(), "mark"), "#" * int(name[1]) + " ")
        elif tag == "entity":
            put(here(), html.unescape(s).replace("\xa0", " "))
        elif tag == "link":
            put((*here(), "a"), s[2:-2].rsplit("|", 1)[-1])
        elif tag == "a":
            inner((*here(), "a"), s[1 : s.rindex("](")])
        elif tag == "image":
            put((*here(), "figure"), s[2 : s.rindex("](")])
        elif tag == "file":
            put((*here(), "figure"), s[2:-2].rsplit("|", 1)[-1] if "|" in s else "")
        elif tag == "b" and kind == "wiki":
            inner((*here(), "b"), s.strip("'"))
        elif tag in ("b", "del", "i"):
            c = s.strip("*_~")
            inner((*here(), tag), c)
        elif tag == "h" and kind == "wiki":
            level = len(m.group("eq"))
            put(("br",), "\n")
            put((*here(), f"h{level}"), "#" * level + " " + s.strip().strip("=").strip())
            put(("br",), "\n")
        elif tag == "h" and kind == "markdown":
            put((*here(), "h"), s)
        elif tag == "h":
            level = 1 + s.count("sub") + (1 if "section" in s[:16] else 0)
            put(("br",), "\n")
            put((*here(), f"h{level}"), "#" * level + " " + s[s.index("{") + 1 : -1])
            put(("br",), "\n")
        elif tag in ("fence", "code", "math"):
            put((*here(), tag), s)
        elif tag == "command":
            name = re.match(r"\\([A-Za-z]+)", s).group(1)
            arg = s[s.index("{") + 1 : -1]
            inner((*here(), name), f" ({arg})" if name == "footnote" else arg)
        elif tag == "bare":
            put((*here(), "item"), "- " if s == "\\item" else s if s[1:] in ("leq", "geq", "times", "cdot") else "")
        elif tag == "table" and s.lstrip().startswith("|-"):
            put(("br",), "\n")
        elif tag == "quote":
            put((*here(), "quote"), "")
    put(here(), text[pos:])
    if "latex" in kinds:
        nodes = [(p, x if p[0] == "br" or {"fence", "code", "math"} & set(p) else _latex_comment.sub("", x)) for p, x in nodes]
    return kinds, nodes


def parse_inline(s: str) -> tuple[set[str], list[tuple[tuple[str, ...], str]]]:
    k, ns = parse(s + " ") if any(c in s for c in "<&\\[*`'{") else (set(), [(("body",), s + " ")])
    if ns:
        ns[-1] = (ns[-1][0], ns[-1][1][:-1])
    return k, [(p[1:], x) for p, x in ns if p[0] != "br"]


def select(nodes: list[tuple[tuple[str, ...], str]]) -> list[bool]:
    """Whether each node is content: text length and punctuation are added up for each tag path, divided by its number of nodes,
    smoothed over the nodes in document order, fused by their product, and held against a threshold."""
    length, punct, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for p, x in nodes:
        length[p] += len(x.strip())
        punct[p] += len(_punct.findall(x))
        count[p] += 1
    fused = [math.log1p(length[p] / count[p]) * (1 + punct[p] / count[p]) for p, _ in nodes]
    n, kernel = len(fused), [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(4)]
    smooth = []
    for i in range(n):
        num = den = 0.0
        for d in range(-3, 4):
            if 0 <= i + d < n:
                num += kernel[abs(d)] * fused[i + d]
                den += kernel[abs(d)]
        smooth.append(num / den)
    least = THRESHOLD * sum(smooth) / max(1, n)
    return [p[0] == "br" or bool(STRUCTURE & set(p)) or (s >= least and not NOTEXT & set(p)) for (p, _), s in zip(nodes, smooth)]


def clean(text: str | None, heading: str | None = None) -> tuple[list[str], str | None]:
    """Kinds of markup in a text (sorted), and its clean text. Null stays null; a text without markup is returned as it is."""
    if not text:
        return [], text
    kinds, nodes = parse(text, heading)
    if not kinds:
        return [], text
    out = "".join(x for (_, x), ok in zip(nodes, select(nodes)) if ok)
    out = re.sub(r"[ \t]+(?=\n)|(?<=\n)[ \t]+(?=\S)(?![-•#|])", "", out)
    return sorted(kinds), re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", out)).strip("\n")


def cleaned(chunks: DataFrame) -> DataFrame:
    """Text chunks with markup in text or content: id, kinds (array), clean (of the chunk's effective text).

    Both columns are read whole. Null and blank columns have no markup; chunks without any give no row (their text is clean
    already); rows delivered again under one id give equal rows.
    """
    own = text_chunks(chunks).select("id", "text", "content", "body", F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("")).alias("heading"))
    maybe = own.where(F.col("text").rlike(MAYBE) | (F.col("content").rlike(MAYBE) & ~F.col("content").eqNullSafe(F.col("text"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, content, body, heading in zip(pdf["id"], pdf["text"], pdf["content"], pdf["body"], pdf["heading"]):
                kinds, c = clean(body, heading)
                for other in {text, content} - {body, None}:
                    kinds = sorted({*kinds, *parse(other, heading)[0]})
                if kinds:
                    out.append((i, kinds, c))
            yield pd.DataFrame(out, columns=["id", "kinds", "clean"])

    return maybe.mapInPandas(run, "id string, kinds array<string>, clean string")


def found(chunks: DataFrame) -> DataFrame:
    """Each kind of markup of each text chunk: id, kind."""
    return cleaned(chunks).select("id", F.explode("kinds").alias("kind")).distinct()
