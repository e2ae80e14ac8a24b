"""Rendering of pages against pages whose text is known, as they are generated, and with the tags that HTML may leave out left out."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from ledgerloom.llm import html_text

OMITTED = {"p", "li", "td", "tr", "dd"}


class Page:
    """Writes a random page and, beside it, the lines of text that a reader sees."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.lines: list[str] = []
        self.line: list[str] = []
        self.n = 0

    def words(self, seen: bool) -> str:
        found = []
        for _ in range(self.rng.randint(1, 4)):
            self.n += 1
            found.append(f"w{self.n}")
        if seen:
            self.line += found
        return " ".join(found) + " "

    def end(self) -> None:
        if self.line:
            self.lines.append(" ".join(self.line))
        self.line = []

    def inline(self, depth: int, seen: bool) -> str:
        out = self.words(seen)
        for _ in range(self.rng.randint(0, 2) if depth else 0):
            kind = self.rng.choice(["b", "hidden", "comment", "script", "button", "visible", "math"])
            if kind == "b":
                out += f"<b class='a>b'>{self.inline(depth - 1, seen)}</b> "
            elif kind == "hidden":
                out += f"<span {self.rng.choice(['hidden', 'style=display:none', 'style=' + chr(34) + 'color:red; DISPLAY : none' + chr(34)])}>{self.inline(depth - 1, False)}</span> "
            elif kind == "visible":
                out += f"<span style='visibility:hidden'>{self.words(False)}<i style='visibility:visible'>{self.words(seen)}</i></span> "
            elif kind == "comment":
                out += self.rng.choice(["<!-- <p>no -->", "<!-->", "<!--->", "<?no>", "</>"])
            elif kind == "script":
                out += "<script>if (a</b/.test(c)) '<p>no</p>'</script>"
            else:
                name = "mi" if kind == "math" else "button"
                out += f"<{name} don't x=y>{self.words(seen)}</{name}> "
        return out + self.words(seen)

    def closed(self, name: str) -> str:
        return "" if name in OMITTED and self.rng.random() < 0.6 else f"</{name}>"

    def block(self, depth: int, seen: bool) -> str:
        kind = self.rng.choice(["p", "div", "section", "ul", "table", "h2", "hidden"] if depth else ["p", "h2"])
        self.end()
        if kind in ("p", "h2"):
            out = f"<{kind}>{self.inline(2, seen)}"
            self.end()
            return out + self.closed(kind) if kind == "h2" else out + (self.closed(kind) if depth else "</p>")
        if kind in ("div", "section"):
            return f"<{kind}>{self.blocks(depth - 1, seen)}</{kind}>"
        if kind == "hidden":
            return f"<div hidden>{self.blocks(depth - 1, False)}</div>"
        out = f"<{kind}>"
        for _ in range(self.rng.randint(1, 3)):
            if kind == "ul":
                out += f"<li>{self.inline(1, seen)}{self.closed('li')}"
            else:
                out += "<tr>" + "".join(f"<td>{self.inline(1, seen)}{self.closed('td')}" for _ in range(2)) + self.closed("tr")
            self.end()
        return out + f"</{kind}>"

    def blocks(self, depth: int, seen: bool) -> str:
        out = "".join(self.block(depth, seen) for _ in range(self.rng.randint(1, 3)))
        self.end()
        return out

    def page(self) -> str:
        head = self.rng.choice(["<html><head><title>no</title></head><body>", "<head><meta charset=utf-8><title>no</title>", "<title>no</title><style>no{}</style><body>", "<html lang=en><head><link rel=x href=y>", "<head><noscript><img></noscript></head>"])
        return head + self.blocks(3, True) + self.rng.choice(["</body></html>", "</body>", ""])


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages_give_their_lines(seed):
    page = Page(seed)
    markup = page.page()
    got = [" ".join(line.replace("- ", "", 1).split()) if line.lstrip().startswith("- ") else " ".join(line.split()) for line in html_text.page_text(markup).split("\n")]
    assert [line for line in got if line] == page.lines


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<html><head><title>T</title><p>Hello world", "Hello world"),
        ("<head><meta charset=x><div>a</div>", "a"),
        ("<head>words<p>b", "words\n\nb"),
        ("<p don't>hi", "hi"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td colspan=2>over both<td>D</table>", "A  B\n   C\nover both  D"),
        ("<table><tbody><tr><td rowspan=0>A<td>B<tr><td>C<tbody><tr><td>D</table>", "A  B\n   C\nD"),
        ("<ol><li value=5>a<li>b</ol><ol reversed><li>a<li>b</ol>", "5. a\n6. b\n\n2. a\n1. b"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>x</details>", "s\nt\nx"),
        ("<b><p>x</b>y</p>z", "xy\n\nz"),
        ("<pre>\na\r\nb</pre>", "a\nb"),
        ("<input type=submit value=Go> <input type=hidden value=no>", "Go"),
        ("<p hidden style='display:block'>a<p style='display:none;display:inline'>b", "a\n\nb"),
    ],
)
def test_odd_markup(markup, text):
    assert html_text.page_text(markup) == text


def test_wide_and_long_tables_stay_small():
    markup = "<table>" + "<tr><td colspan=1000 rowspan=65534>a<td>b" * 200 + "</table>"
    assert len(html_text.page_text(markup)) < 200 * 2000


def test_clashing_columns_and_long_pages(spark):
    long = "<div>word " * 30_000
    table = spark.createDataFrame([(1, long, "x", "y"), (1, "<head><p>t", None, "z"), (None, None, "x", None)], "page_id long, html string, text string, n_chars string")
    got = Counter((r["page_id"], r["n_chars"], r["n_lines"]) for r in html_text.rendered(table).collect())
    assert got == Counter([(1, 30_000 * 5 - 1, 30_000), (1, 1, 1), (None, 0, 0)])


def test_text_grows_with_the_page_and_not_with_rows_times_columns():
    rows = "<tr><td>a<td>b" * 10_000
    pages = [
        f"<table><tr><td>{'word ' * 200_000}<td>b{rows}</table>",
        f"<table><tr>{'<td>cell' * 2000}{'<tr><td colspan=1000>x<td colspan=999>y<td>z' * 3000}</table>",
        "<blockquote>" * 3000 + "x<br>" * 10_000,
        "<ul><li>a" * 3000 + "<br>x" * 10_000,
        "<table><tr><td>" * 400 + "x" + "<tr><td><td>y</table><td>z" * 400,
        "<style>" + "a" * 1_000_000 + "</style>x",
        "<style>" + "@media x{" * 50_000 + "</style>x",
        "<style>" + "".join(f".c{i},.d{i}{{display:none}}" for i in range(20_000)) + "</style>" + "<p class='c5 x'>no<p class=y>yes" * 5000,
        "<![CDATA[" * 50_000 + "x",
        "<div style='white-space:pre'>" + "a\n" * 100_000,
    ]
    for page in pages:
        assert len(html_text.page_text(page)) <= 10 * len(page)
    lines = html_text.page_text(pages[0]).split("\n")
    assert len(lines) == 10_001 and lines[1:] == ["a  b"] * 10_000 and lines[0].endswith("word  b")


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<table><tr><td><h1>Title</h1><p>one<p>two<ul><li>x<li>y</ul><td>side</table>", "Title\n\none\n\ntwo\n\n- x\n- y\n\nside"),
        ("<table><tr><td>a<br>bb<td>1<tr><td>c<td>2<br>3</table>", "a   1\nbb\nc   2\n    3"),
        ("<table><tr><td>out<td><table><tr><td>a<td>b<tr><td>cc<td>d</table><tr><td>o<td>p</table>", "out  a   b\n     cc  d\no    p"),
        ("<table><tr><td>日本<td>x<tr><td>abcd<td>y<tr><td>é<td>z</table>", "日本  x\nabcd  y\né     z"),
        ("<style>.x{display:none} p.y,#z{visibility:hidden}</style><p class='a x'>no<p class=y>no<div class=y>yes</div><i id=z>no</i>", "yes"),
        ("<style>b{display:none}/*.k{display:none}*/b.k{display:inline}@media print{i{display:none}}</style><b>no</b><b class=k>yes</b> <i>too</i>", "yes too"),
        ("<style>@import 'x';span{display:block}div{display:inline}</style>a<span>b</span>c<div>d</div>", "a\nb\ncd"),
        ("<style>.c{white-space:pre}</style><div class=c>a  b\n c</div><pre style='white-space:normal'>x\n  y</pre>", "a  b\n c\n\nx y"),
        ("<svg><text><![CDATA[a <b> c]]></text></svg> <![CDATA[no]]> d", "a <b> c d"),
        ("<progress value=1>no</progress><meter>no</meter>x", "x"),
        ("<input value=typed> <input type=password value=no> <input type=image alt=pic>", "typed pic"),
        ("<ul><li>a<table><tr><td>1<td>2</table><li>b</ul>", "- a\n\n  1  2\n\n- b"),
        ("<table><tr><td><ul><li>a<li>b</ul><td>c</table>", "- a  c\n- b"),
        ("<blockquote>q<blockquote>r</blockquote></blockquote>s", "  q\n\n    r\n\ns"),
    ],
)
def test_layout_within_tables_and_styles_of_the_page(markup, text):
    assert html_text.page_text(markup) == text


@pytest.mark.parametrize("seed", range(20))
def test_generated_tables_and_lists_stand_where_they_should(seed):
    """Alignment, indentation and empty lines, character by character."""
    rng = random.Random(seed)
    blocks, want = [], []

    def text():
        return " ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))

    def items(depth, indent):
        out, lines = "", []
        numbered, n = rng.random() < 0.5, rng.randint(1, 3)
        for i in range(n):
            own, mark = text(), f"{i + 1}. " if numbered else "- "
            lines.append(indent + mark + own)
            out += f"<li>{own}"
            if depth and rng.random() < 0.4:
                inner, more = items(depth - 1, indent + " " * len(mark))
                out += inner
                lines += more
        name = "ol" if numbered else "ul"
        return f"<{name}>{out}</{name}>", lines

    for _ in range(4):
        kind = rng.choice(["p", "table", "list", "quote", "div"])
        if kind == "table":
            grid = [[text() if rng.random() < 0.8 else "" for _ in range(3)] for _ in range(rng.randint(1, 5))]
            grid = [row for row in grid if any(row)] or [["x", "", ""]]
            widths = [max(len(row[i]) for row in grid) for i in range(3)]
            blocks.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in grid) + "</table>")
            lines = ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in grid]
        elif kind == "list":
            markup, lines = items(2, "")
            blocks.append(markup)
        else:
            lines = [text()]
            blocks.append({"p": f"<p>{lines[0]}", "quote": f"<blockquote>{lines[0]}</blockquote>", "div": f"<h2>{lines[0]}</h2>"}[kind])
            lines = ["  " + lines[0]] if kind == "quote" else lines
        want += ([""] if want else []) + lines
    assert html_text.page_text("".join(blocks)).split("\n") == want
