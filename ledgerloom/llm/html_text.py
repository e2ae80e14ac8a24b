"""Operator 9: layout-aware text of web pages.

``parse`` builds a tree from tags, with the tags that HTML leaves out: what
cannot stand in a head (a tag or words) ends it, a block closes an open
paragraph, a list item or table part closes the one before it, an end tag that
nothing matches or that would close a block from inside a line is ignored, and
what is open at the end is closed.  A start tag looks for what it implies only
as far as the nearest container (list, table, cell, ...).  ``render`` walks the
tree and writes what a reader sees:

- nothing of scripts, styles, templates, the head, comments, fallbacks, or elements
  that are hidden (``hidden``, ``display:none``, a ``dialog`` or the inside of
  ``details`` without ``open``; not ``aria-hidden``, which hides from screen
  readers alone);
- nothing that stands in ``visibility:hidden``, but parts of it that are
  ``visibility:visible``;
- of a drawing its labels, of a formula its signs, of a ``select`` the selected
  options, or its first one (all of a list box), of ``input`` its label or value;
- white space runs as one space, but as it stands in ``pre``, ``textarea`` and
  ``white-space:pre``;
- block elements on lines of their own, with an empty line around paragraphs,
  headings, lists, tables, quotations and ``pre``;
- list items with ``- ``, or their number, indented by their depth;
- table rows as lines, or as many as their tallest cell has, cells padded to the
  width of their column, two spaces between them; cells that reach over columns or
  rows keep those places free.  A table with a cell of more than ``TALL`` lines lays
  out a page and no data: its cells follow each other as blocks.

Styles come from ``style`` attributes and from rules of ``style`` elements whose
selector is one element, by name, class or id; of several the most specific one counts,
then the last.  Only ``display``, ``visibility`` and ``white-space`` are read.

Indentation ends at ``DEEPEST`` places.  Padding is bounded by the text: a cell far
longer than others of its column does not widen it, and a table whose padding would
still outweigh its text gets none.

Both are loops over their own stacks, so depth is bounded by memory alone.

Cases: null or empty markup gives an empty text; text without tags is one
block; unclosed comments, tags and scripts reach to the end; rows with equal
ids are rendered one by one; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("script style template head title noscript iframe noembed noframes object audio video canvas datalist meta link annotation annotation-xml rp progress meter".split())
#: What may stand in a head.
HEAD = frozenset("html head base link meta title style script noscript noframes template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VERBATIM = frozenset("pre textarea xmp listing".split())
LISTS = frozenset("ul ol menu dir".split())
#: Parts of a drawing that are not drawn where they stand.
UNDRAWN = frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
SPACED = HEADINGS | frozenset("p ul ol dl table blockquote pre xmp listing figure hr".split())
BLOCKS = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tr".split()
)
CELLS = frozenset(("td", "th"))
GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: What a start tag closes, and the containers beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": (CELLS, {"tr", "table"}),
    "th": (CELLS, {"tr", "table"}),
    "tr": ({"tr"}, {"table"} | GROUPS),
    **{group: (GROUPS | {"caption", "colgroup"}, {"table"}) for group in GROUPS},
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Inputs whose value is not shown as text.
NO_VALUE = frozenset("hidden password checkbox radio file image color range".split())
#: What ``display`` makes a block, or keeps in the line.
AS_BLOCK = frozenset("block list-item flex grid table flow-root".split())
IN_LINE = frozenset("inline inline-block inline-flex inline-grid inline-table contents".split())
AS_IT_STANDS = frozenset("pre pre-wrap break-spaces".split())
DEEPEST = 40  #: Places of the deepest indentation
TALL = 4  #: Lines of the tallest cell of a data table
#: An end tag does not close what stands outside of these, and neither does a block an open paragraph.
SCOPES = frozenset({"table", "td", "th", "caption", "html", "template", "object", "button"})

_TOKEN = re.compile(
    r"<!--(?P<comment>-?>|.*?(?:--!?>|\Z))|<!\[(?P<literal>CDATA)\[|<[!?](?P<declaration>[^>]*)(?:>|\Z)|</(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|</(?P<odd>>|[^A-Za-z][^>]*(?:>|\Z))"
    # A quotation mark holds a value together only behind an equals sign.
    r"|<(?P<start>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)*+)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes = name, attributes
        self.children: list[Element | str] = []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


class _Stack:
    """Open elements, with the places of each name, so that a look back does not walk the stack."""

    def __init__(self, root: Element) -> None:
        self.elements = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]  #: Places of open blocks

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.elements))
        if element.name in BLOCKS:
            self.blocks.append(len(self.elements))
        self.elements.append(element)

    def _last(self, names: frozenset[str] | set[str]) -> int:
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def close(self, names: frozenset[str] | set[str], stops: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of these names, if no stop is open inside of it."""
        at = self._last(names)
        if at and at > self._last(stops - names):
            self._cut(at)

    def close_inline(self, name: str) -> None:
        """Close the innermost open element of this name, if no block is open inside of it."""
        at = self._last({name})
        if at > self.blocks[-1] and at > self._last(SCOPES):
            self._cut(at)

    def _cut(self, at: int) -> None:
        while len(self.elements) > at:
            name = self.elements.pop().name
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()


def parse(markup: str) -> Element:
    markup = markup.replace("\r\n", "\n").replace("\r", "\n")
    root = Element("#root", {})
    stack = _Stack(root)
    template = frozenset(("template",))
    at, end = 0, len(markup)
    while at < end:
        token = _TOKEN.match(markup, at)
        kind, at = token.lastgroup, token.end()
        if kind == "literal":
            if stack.places.get("svg") or stack.places.get("math"):
                close = markup.find("]]>", at)
                stack.elements[-1].children.append(markup[at : close if close >= 0 else end])
                at = close + 3 if close >= 0 else end
            else:  # a comment elsewhere, which the first > ends
                at = (markup.find(">", at) + 1) or end
        elif kind == "text":
            if stack.elements[-1].name == "head" and token["text"].strip():
                stack.close({"head"}, template)
            stack.elements[-1].children.append(html.unescape(token["text"]))
        elif kind == "end":
            name = token["end"].lower()
            if name in HEADINGS:
                stack.close(HEADINGS, SCOPES)
            elif name in ("table", "html"):
                stack.close({name}, frozenset(("html",)))
            elif name in ("br", "p") and not stack.places.get(name):
                stack.elements[-1].children.append(Element(name, {}))
            elif name in BLOCKS or name in SCOPES or name in ("head", "select", "datalist"):
                stack.close({name}, SCOPES)
            else:
                stack.close_inline(name)
        elif token["start"]:
            name = token["start"].lower()
            if name not in HEAD:
                stack.close({"head"}, template)
            if name in BLOCKS and name not in ("body", "html"):
                stack.close({"p"}, SCOPES)
            if name in HEADINGS and stack.elements[-1].name in HEADINGS:
                stack.close(HEADINGS, SCOPES)
            if name in CLOSES:
                stack.close(*CLOSES[name])
            element = Element(name, _attributes(token["attributes"] or ""))
            stack.elements[-1].children.append(element)
            if name in VERBATIM and markup.startswith("\n", at):
                at += 1  # a line break right behind the tag does not count
            if name in RAW:
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(markup, at)
                inside = markup[at : closing.start() if closing else end]
                element.children.append(html.unescape(inside) if name in ("textarea", "title") else inside)
                at = closing.end() if closing else end
            elif name not in VOID:
                stack.push(element)
    return root


def _declarations(source: str) -> dict[str, str]:
    """Of repeated ones the last."""
    parts = (part.partition(":") for part in source.lower().split(";"))
    return {name.strip(): value.replace("!important", "").strip() for name, _, value in parts}


def _css_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that stand under no condition."""
    at = 0
    while (begin := sheet.find("{", at)) >= 0:
        selectors = sheet[at:begin].rpartition(";")[2].strip()
        depth, at = 1, sheet.find("}", begin) + 1 or len(sheet)
        if selectors.startswith("@"):
            for brace in re.compile(r"[{}]").finditer(sheet, begin + 1):
                depth += 1 if brace[0] == "{" else -1
                if not depth:
                    break
            at = brace.end() if not depth else len(sheet)
        else:
            yield selectors, sheet[begin + 1 : at - 1]


_SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][A-Za-z_-][\w-]*)*)")
_READ = ("display", "visibility", "white-space")


class Styles:
    """Rules of a page's style elements, found by id, class or name."""

    def __init__(self, root: Element) -> None:
        self.rules: dict[str, list[tuple]] = {}
        self.n_rules = 0
        work, sheets = [root], []
        while work:
            node = work.pop()
            if node.name == "style":
                sheets.append("".join(child for child in node.children if isinstance(child, str)))
            work.extend(child for child in reversed(node.children) if isinstance(child, Element) and child.name != "template")
        for sheet in sheets:
            self._add(re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.DOTALL))

    def _add(self, sheet: str) -> None:
        for selectors, body in _css_rules(sheet):
            read = {name: value for name, value in _declarations(body).items() if name in _READ}
            for selector in selectors.split(",") if read else ():
                found = _SELECTOR.fullmatch(selector.strip())
                if not found or not selector.strip():
                    continue
                marks = re.findall(r"[.#][^.#]+", found[2])
                ids, classes = [m[1:] for m in marks if m[0] == "#"], [m[1:] for m in marks if m[0] == "."]
                name = found[1] if found[1] != "*" else None
                key = f"#{ids[0]}" if ids else f".{classes[0]}" if classes else name or "*"
                self.n_rules += 1
                order = (len(ids), len(classes), name is not None, self.n_rules)
                self.rules.setdefault(key, []).append((order, name, ids, classes, read))

    def of(self, element: Element) -> dict[str, str]:
        a = element.attributes
        own = _declarations(a["style"]) if "style" in a else {}
        if not self.rules:
            return own
        classes = set(a.get("class", "").split())
        keys = [element.name, "*", f"#{a.get('id')}", *(f".{c}" for c in classes)]
        met = [rule for key in keys for rule in self.rules.get(key, ()) if rule[1] in (None, element.name) and all(i == a.get("id") for i in rule[2]) and classes.issuperset(rule[3])]
        out: dict[str, str] = {}
        for rule in sorted(met, key=lambda rule: rule[0]):
            out |= rule[4]
        return out | own


def hidden(element: Element, style: dict[str, str]) -> bool:
    """Whether an element takes no place, and nothing in it is seen."""
    if element.name in UNSEEN or (element.name == "dialog" and "open" not in element.attributes):
        return True
    display = style.get("display")
    return display == "none" or ("hidden" in element.attributes and not display)


def _unfolded(details: Element) -> list[Element | str]:
    """What is seen of ``details``: its summary, and all the rest if it is open."""
    if "open" in details.attributes:
        return details.children
    return [child for child in details.children if isinstance(child, Element) and child.name == "summary"][:1]


def _shown(select: Element, styles: Styles) -> list[Element | str]:
    """The options that a select shows: all of a list box, else the last selected one, or the first that is not disabled."""
    options: list[Element] = []
    off: set[int] = set()
    work = [(child, False) for child in reversed(select.children)]
    while work:
        node, disabled = work.pop()
        if isinstance(node, str):
            continue
        disabled = disabled or "disabled" in node.attributes
        if node.name == "option":
            if not hidden(node, styles.of(node)) or "selected" in node.attributes:
                options.append(node)
                if disabled:
                    off.add(id(node))
        elif not hidden(node, styles.of(node)):
            work.extend((child, disabled) for child in reversed(node.children))
    size = select.attributes.get("size", "").strip()
    if "multiple" in select.attributes or (size.isdecimal() and int(size) > 1):
        return [option for option in options if not hidden(option, styles.of(option))]
    chosen = [option for option in options if "selected" in option.attributes][-1:] or [option for option in options if id(option) not in off][:1]
    return [part for option in chosen for part in ([option.attributes["label"]] if option.attributes.get("label") else option.children)]


class _Writer:
    """Lines of text, as they grow."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = self.marker = ""
        self.space = False  #: A space is due before the next text
        self.gap = False  #: An empty line is due before the next text

    def text(self, value: str) -> None:
        words = _SPACES.sub(" ", value)
        if words.startswith(" "):
            self.space = True
        words_ = words.strip(" ")
        if words_:
            self._begin()
            if self.space and self.line[-1:] and not self.line[-1].endswith(" "):
                self.line.append(" ")
            self.line.append(words_)
            self.space = words.endswith(" ")

    def _begin(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line.append(self.marker or self.indent)
            self.marker = ""
            self.space = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def verbatim(self, value: str) -> None:
        first, *rest = value.split("\n")
        if first:
            self._begin()
            self.line.append(first)
        for line in rest:
            self._begin()
            self.lines.append("".join(self.line).rstrip())
            self.line = [self.indent + line] if line else []
            if not line:
                self.line = [self.indent]
        if rest and not "".join(self.line).strip():
            self.line = []

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _number(value: str, most: int) -> int:
    return min(int(value), most) if value.isascii() and value.isdecimal() and len(value) < 9 else 1


Cell = tuple[list[str], int, int]  #: Its lines, and the columns and rows that it takes (0 rows: to the group's end)


def _placed(rows: list[tuple[int, list[Cell]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Cells with their first column and the one behind their last. ``rows``: their group, and their cells."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    above: list[tuple[int, int, float]] = []  # columns that cells of earlier rows take, and for how many rows more
    group = None
    for of, cells in rows:
        if of != group:
            above, group = [], of
        taken, at, new, line = sorted(above), 0, [], []
        for lines, across, down in cells:
            while taken and taken[0][0] <= at:
                at = max(at, taken.pop(0)[1])
            line.append((at, at + across, lines))
            if down != 1:
                new.append((at, at + across, down - 1 if down else float("inf")))
            at += across
        above = [(lo, hi, left - 1) for lo, hi, left in above if left > 1] + new
        placed.append(line)
    return placed


def _width(text: str) -> int:
    """Places that a text takes; wide characters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _aligned(rows: list[tuple[int, list[Cell]]]) -> list[str]:
    """Lines of a table. Columns in which no cell begins take no room, and neither do rows without text."""
    placed = [line for line in _placed(rows) if any(lines for _, _, lines in line)]
    columns = sorted({first for line in placed for first, _, _ in line})
    index = {column: i for i, column in enumerate(columns)}
    lengths: list[list[int]] = [[] for _ in columns]
    wide = []
    for line in placed:
        for first, behind, lines in line:
            i, length = index[first], max(map(_width, lines), default=0)
            if i + 1 == len(columns) or columns[i + 1] >= behind:
                lengths[i].append(length)
            else:
                wide.append((i, bisect.bisect_left(columns, behind), length))
    widths = []
    for own in lengths:
        most = max(40, 4 * sum(own) // max(1, len(own)))  # a cell of more runs over, and does not widen the column
        widths.append(max((n for n in own if n <= most), default=0))
    for i, j, length in wide:  # what does not fit in the columns it reaches over widens the last one
        need = length - sum(widths[i:j]) - 2 * (j - i - 1)
        widths[j - 1] += need if 0 < need <= 40 else 0
    starts = [0, *itertools.accumulate(width + 2 for width in widths)]
    text = sum(len(x) for line in placed for _, _, lines in line for x in lines)
    padded = sum(starts[index[line[-1][0]]] * max(len(lines) for _, _, lines in line) for line in placed)
    if padded > 4 * text + 60 * len(placed):  # few rows have many more columns than the others
        starts = [0] * len(starts)
    out = []
    for line in placed:
        for n in range(max(len(lines) for _, _, lines in line)):
            parts, at = [], 0
            for first, _, lines in line:
                start = max(starts[index[first]], at + 2 if at else 0)
                if n < len(lines) and lines[n]:
                    parts += [" " * (start - at), lines[n]]
                    at = start + _width(lines[n])
            out.append("".join(parts).rstrip())
    return out


def _cell_lines(text: str) -> list[str]:
    """The lines of a cell without empty ones at either end."""
    lines = text.split("\n")
    filled = [i for i, line in enumerate(lines) if line.strip()]
    return lines[filled[0] : filled[-1] + 1] if filled else []


def _table_lines(rows: list[tuple[int, list[Cell]]]) -> list[str]:
    if all(len(lines) <= TALL for _, cells in rows for lines, _, _ in cells):
        return _aligned([(group, [([line for line in lines if line.strip()], across, down) for lines, across, down in cells]) for group, cells in rows])
    out: list[str] = []
    for _, cells in rows:
        for lines, _, _ in cells:
            if lines:
                out += ["", *lines] if out else lines
    return out


def render(root: Element) -> str:
    """The visible text of a tree."""
    styles = Styles(root)
    writers = [_Writer()]
    tables: list[dict] = []
    lists: list[list] = []  # [next number or None, indent outside, step]
    visible, verbatim, blocks, indents = [True], [False], [], []
    drawings = 0
    work: list[tuple[Element | str, bool]] = [(root, True)]
    while work:
        node, entering = work.pop()
        out = writers[-1]
        if isinstance(node, str):
            if visible[-1]:
                (out.verbatim if verbatim[-1] else out.text)(node)
            continue
        name, a = node.name, node.attributes
        if entering:
            style = styles.of(node) if "style" in a or styles.rules else {}
            if hidden(node, style) or (drawings and name in UNDRAWN):
                continue
            shown = style.get("visibility")
            visible.append(visible[-1] if shown in (None, "inherit") else shown not in ("hidden", "collapse"))
            if name == "svg":
                drawings += 1
            if name in ("br", "input"):
                kind = a.get("type", "").strip().lower()
                if name == "br":
                    if not out.line and out.lines and out.lines[-1]:
                        out.gap = True
                    out.end_line()
                elif visible[-1] and kind not in NO_VALUE:
                    out.text(a.get("value", ""))
                elif visible[-1] and kind == "image":
                    out.text(a.get("alt", ""))
                visible.pop()
                continue
            space = style.get("white-space")
            verbatim.append(True if space in AS_IT_STANDS or (space is None and name in VERBATIM) else verbatim[-1] if space in (None, "inherit") else False)
            display = style.get("display", "")
            blocks.append(display in AS_BLOCK or (name in BLOCKS and (display not in IN_LINE or name in ("tr", "li"))))
            if blocks[-1]:
                out.block(name in SPACED and not (name in ("ul", "ol") and lists))
            if name in LISTS:
                step = -1 if "reversed" in a else 1
                first = sum(isinstance(child, Element) and child.name == "li" for child in node.children) if step < 0 else 1
                start = a.get("start", "")
                lists.append([int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else first, out.indent, step] if name == "ol" else [None, out.indent, 0])
            elif name == "li":
                value = a.get("value", "")
                if lists and lists[-1][0] is not None and re.fullmatch(r"-?[0-9]{1,9}", value):
                    lists[-1][0] = int(value)
                number = lists[-1][0] if lists else None
                mark = "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1][0] += lists[-1][2]
                outside = lists[-1][1] if lists else out.indent
                out.marker, out.indent = outside + mark, (outside + " " * len(mark))[:DEEPEST]
            elif name in ("dd", "blockquote"):
                indents.append(out.indent)
                out.indent = (out.indent + "  ")[:DEEPEST]
            elif name == "table":
                tables.append({"rows": [], "group": 0, "lists": lists})
                lists = []
                writers.append(_Writer())
            elif name in GROUPS and tables:
                tables[-1]["group"] += 1
            elif name == "tr" and tables:
                tables[-1]["rows"].append((tables[-1]["group"], []))
            elif name in CELLS and tables:
                writers.append(_Writer())
            work.append((node, False))
            inside = _shown(node, styles) if name == "select" else _unfolded(node) if name == "details" else node.children
            work.extend((child, True) for child in reversed(inside))
            continue
        visible.pop()
        verbatim.pop()
        block = blocks.pop()
        if name == "svg":
            drawings -= 1
        if name in CELLS and tables:
            cell = _cell_lines(writers.pop().result())
            if not tables[-1]["rows"]:
                tables[-1]["rows"].append((tables[-1]["group"], []))
            tables[-1]["rows"][-1][1].append((cell, max(1, _number(a.get("colspan", "1").strip(), 1000)), _number(a.get("rowspan", "1").strip(), 65_534)))
            continue
        if name == "table":
            around = writers.pop().result()  # captions, and text that stands between cells
            table = tables.pop()
            out, lists = writers[-1], table["lists"]
            for line in [*(around.split("\n") if around else []), *_table_lines(table["rows"])]:
                out.verbatim(line)
                if line:
                    out.end_line()
                elif out.lines and out.lines[-1]:
                    out.gap = True
        elif name in LISTS:
            lists.pop()
        elif name == "li":
            out.end_line()
            out.marker, out.indent = "", lists[-1][1] if lists else ""
        elif name in ("dd", "blockquote"):
            out.end_line()
            out.indent = indents.pop()
        if name in GROUPS and tables:
            tables[-1]["group"] += 1
        if block:
            out.block(name in SPACED and not (name in ("ul", "ol") and lists))
    return writers[0].result()


def page_text(markup: str) -> str:
    return render(parse(markup))


def rendered(pages: DataFrame) -> DataFrame:
    """``page_id`` and the visible ``text`` of every row, with its number of characters and lines."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(markup.as_py() or "") for markup in batch.column(1)]
            counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *counts], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select(pages["page_id"].cast("long"), pages["html"]).mapInArrow(each, "page_id long, text string, n_chars long, n_lines long")
