"""Text of HTML pages by layout-aware rendering.

A page is scanned into tags and texts, a builder keeps the stack of open elements (end tags
that HTML implies are supplied, stray ones ignored), and a renderer follows it: it leaves out
what is not visible and writes blocks on lines of their own, paragraphs with a blank line
around them, lists with their marks and depth, and tables with aligned columns.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)|[^<]++|<", re.DOTALL)
#: The rest of a tag, by which quotes still have a partner in the page.
_REST = {q: re.compile("(?:" + "|".join([f"[^>{''.join(q)}]++", *(f"{c}[^{c}]*+{c}" for c in q)]) + ")*+") for q in ("", '"', "'", "\"'")}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_CSS_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|<!--|-->", re.DOTALL)
_CSS_PART = re.compile(r"([^{};]*)([{};]|\Z)")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?<![\w-])(display|visibility|content-visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.IGNORECASE)
#: Levels to which lists are indented and tables in tables aligned, columns that spans may take, and
#: the width to which columns are padded: beyond these, text is kept but not laid out.
DEEPEST, WIDEST_SPAN, WIDEST_COLUMN = 30, 200, 200
#: Characters of padding that a page's tables may have for each character of the page, and besides.
MOST_PADDING, LEAST_PADDING = 8, 20_000

# Names and nesting rules of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas svg math datalist".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp table ul ol dl figure".split())
BLOCK = PARAGRAPH | frozenset(
    "html body address article aside center details dialog dd div dir dt fieldset figcaption footer form frameset header hgroup hr legend li main menu nav section summary optgroup option caption tr".split()
)
CLOSES_P = BLOCK - frozenset("html body option optgroup caption tr legend".split())
#: A start tag ends these open elements, searched up to the given borders.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
}
_SCOPE = ("table", "td", "th", "caption", "html", "template", "object", "button")
#: Only a head's own elements stay in a head; any other start tag ends it.
IN_HEAD = frozenset("head html title meta link base script style template noscript".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2].strip("\"'")) if m[2] else "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _on_any_screen(media: str) -> bool:
    """Whether a media query holds on every screen; one that asks for a feature, such as a width, does not."""
    for query in media.lower().split(","):
        words = query.split()
        if words[:1] == ["only"]:
            words = words[1:]
        if words in ([], ["all"], ["screen"]) or (len(words) == 2 and words[0] == "not" and words[1] not in ("all", "screen") and "(" not in query):
            return True
    return False


def _applies(at_rule: str) -> bool:
    """Whether the rules in an at-rule's block hold on screen."""
    name, _, rest = at_rule[1:].replace("(", " (", 1).strip().partition(" ")
    name = name.lower()
    return name == "layer" or (name == "supports" and not rest.strip().lower().startswith("not")) or (name == "media" and _on_any_screen(rest))


def _screen_rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on screen; rules within rules are left out."""
    open_: list[tuple[bool, str | None, list[str]]] = []  # holds, selectors (None: an at-rule), declarations

    def close() -> Iterator[tuple[str, str]]:
        holds, selectors, told = open_.pop()
        if holds and selectors is not None:
            yield selectors, ";".join(told)

    for m in _CSS_PART.finditer(_CSS_NOISE.sub(" ", css)):
        part, mark = m[1].strip(), m[2]
        if mark == "{":
            holds = not open_ or (open_[-1][0] and open_[-1][1] is None)
            open_.append((holds and _applies(part), None, []) if part[:1] == "@" else (holds, part, []))
            continue
        if open_:
            open_[-1][2].append(part)
            if mark == "}":
                yield from close()
    while open_:
        yield from close()


def _declared(declarations: str) -> dict[str, tuple[bool, str]]:
    """For each property that matters, whether its declaration is important, and the value: the last counts."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _DECLARED.findall(declarations):
        name, mine = name.lower(), (bool(important), value.lower())
        if name not in out or mine[0] >= out[name][0]:
            out[name] = mine
    return out


class _Canvas:
    """Lines of one flow: the page, or one table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = True  # a space would be the first of its line
        self.blank = False  # a blank line is due before the next line
        self.mark = ""  # of a list item that has no line yet

    def text(self, value: str) -> None:
        if value[:1] == " " and self.gap:
            value = value[1:]
        if value:
            self.now.append(value)
            self.gap = value[-1] == " "

    def end_line(self, indent: str = "", keep: bool = False) -> None:
        line = "".join(self.now)
        line = line if keep else line.rstrip(" ")
        self.now, self.gap = [], True
        if line or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.mark or indent) + line)
            self.mark = ""


class _Table:
    def __init__(self, padding: list[int]) -> None:
        self.padding = padding  # what all tables of the page may still use
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # column, columns spanned, lines
        self.next = 0
        self.taken: dict[int, int] = {}  # column, and the last row that a cell from above reaches into it

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def cell(self, columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        row = len(self.rows) - 1
        while self.taken.get(self.next, -1) >= row:
            self.next += 1
        columns = max(1, min(columns, WIDEST_SPAN - self.next))
        self.rows[-1].append((self.next, columns, []))
        if rows > 1:
            self.taken.update({c: row + rows - 1 for c in range(self.next, min(self.next + columns, WIDEST_SPAN))})
        self.next += columns

    def lines(self) -> list[str]:
        """Cells padded to their column's width; a cell of several lines makes the row higher. A table that would
        take more padding than is left in proportion to the page is not padded."""
        width: list[int] = []
        for row in self.rows:
            for at, span, cell in row:
                width += [0] * (at + span - len(width))
                if span == 1:
                    width[at] = min(max(width[at], max(map(len, cell), default=0)), WIDEST_COLUMN)
        left = self.padding[0]
        out = []
        for row in self.rows:
            for k in range(max((len(cell) for *_, cell in row), default=0)):
                parts, done = [], 0
                for at, span, cell in row:
                    parts += [" " * width[c] for c in range(done, at)]
                    parts.append((cell[k] if k < len(cell) else "").ljust(sum(width[at : at + span]) + 3 * (span - 1)))
                    done = at + span
                out.append(" | ".join(parts).rstrip(" "))
                left -= sum(map(len, parts)) - sum(len(cell[k]) for *_, cell in row if k < len(cell))
                if left < 0:
                    return [" | ".join(cell[k] if k < len(cell) else "" for *_, cell in row).rstrip(" ") for row in self.rows for k in range(max((len(cell) for *_, cell in row), default=0))]
        self.padding[0] = left
        return out


class _Renderer:
    def __init__(self, size: int) -> None:
        self.padding = [LEAST_PADDING + MOST_PADDING * size]
        self.open: list[tuple[str, bool, bool]] = []  # element, whether it is hidden itself, and whether its parent is veiled
        self.hidden = 0
        self.veiled = False  # hidden by visibility, which an element within can undo
        self.canvases = [_Canvas()]
        self.tables: list[_Table | None] = []  # None: too deep to be aligned
        self.places: dict[str, list[int]] = {}  # where in the stack each element's open tags are
        self.lists: list[list] = []  # kind, next number
        self.pre = 0
        self.rules: dict[str, dict[str, tuple[bool, int, str]]] = {}  # selector and property: important, place, value
        self.n_rules = 0

    def _indent(self) -> str:
        return "  " * min(len(self.lists), DEEPEST)

    def _break(self, tag: str) -> None:
        canvas = self.canvases[-1]
        canvas.end_line(self._indent())
        # a list within a list item adds no blank line
        if tag in PARAGRAPH and not (tag in ("ul", "ol") and self.lists) and not canvas.mark:
            canvas.blank = True

    def style(self, css: str) -> None:
        """Remember what a style sheet's plain selectors (tag, .class, #id) say of what is seen."""
        for selectors, declarations in _screen_rules(css):
            found = _declared(declarations)
            self.n_rules += 1
            for selector in (x.strip() for x in selectors.split(",")) if found else ():
                if not re.fullmatch(r"[.#]?[a-zA-Z_-][\w-]*", selector):
                    continue
                known = self.rules.setdefault(selector if selector[0] in ".#" else selector.lower(), {})
                for name, (important, value) in found.items():
                    if name not in known or important >= known[name][0]:
                        known[name] = (important, self.n_rules, value)

    def _styled(self, tag: str, attrs: dict[str, str]) -> dict[str, str]:
        """An element's own declarations: important ones first, then by style, id, class and tag, the last first."""
        if not self.rules and "style" not in attrs:
            return {}
        found = [(0, self.rules.get(tag)), *((1, self.rules.get("." + c)) for c in attrs.get("class", "").split()), (2, self.rules.get("#" + attrs.get("id", "")))]
        ranked = [(name, (v[0], rank, v[1]), v[2]) for rank, rule in found if rule for name, v in rule.items()]
        ranked += [(name, (important, 3, 0), value) for name, (important, value) in _declared(attrs.get("style", "")).items()]
        best: dict[str, tuple] = {}
        for name, key, value in ranked:
            if name not in best or key >= best[name][0]:
                best[name] = (key, value)
        return {name: value for name, (_, value) in best.items()}

    def _is_veiled(self, styled: dict[str, str]) -> bool:
        """By its own declaration, else as its parent is."""
        value = styled.get("visibility")
        return value in ("hidden", "collapse") if value in ("visible", "initial", "hidden", "collapse") else self.veiled

    def _is_hidden(self, tag: str, attrs: dict[str, str], styled: dict[str, str]) -> bool:
        if tag in UNSEEN or styled.get("content-visibility") == "hidden":
            return True
        if "display" in styled:
            return styled["display"] == "none"
        return "hidden" in attrs or (tag == "dialog" and "open" not in attrs)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop()
        if tag in CLOSES_P:
            self._close_within(("p",), _SCOPE)
        if tag in IMPLIED:
            self._close_within(*IMPLIED[tag])
        if tag in ("td", "th") and self.tables and not any(t in ("tr", "table") for t, *_ in reversed(self.open[-1:])):
            self.start("tr", {})
        styled = self._styled(tag, attrs)
        hidden = self._is_hidden(tag, attrs, styled)
        if tag in VOID:
            if not hidden and not self.hidden:
                if tag in ("br", "hr"):
                    self.canvases[-1].end_line(self._indent(), keep=tag == "br" and bool(self.canvases[-1].now))
                elif tag == "img" and attrs.get("alt") and not self._is_veiled(styled):
                    self.text(attrs["alt"], shown=True)
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, hidden, self.veiled))
        self.veiled = self._is_veiled(styled)
        self.hidden += hidden
        if self.hidden:
            return
        if tag in BLOCK:
            self._break(tag)
        if tag == "table":
            self.tables.append(_Table(self.padding) if len(self.tables) < DEEPEST else None)
        elif tag == "tr" and self.tables and self.tables[-1]:
            self.tables[-1].row()
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            spans = [attrs.get(x, "1") for x in ("colspan", "rowspan")]
            self.tables[-1].cell(*(int(x) if re.fullmatch(r"[1-9][0-9]{0,8}", x) else 1 for x in spans))
            self.canvases.append(_Canvas())
        elif tag in ("ul", "ol", "menu", "dir"):
            first = attrs.get("start", "1")
            self.lists.append(["ol" if tag == "ol" else "ul", int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1]
            self.canvases[-1].mark = "  " * min(max(len(self.lists) - 1, 0), DEEPEST) + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
            kind[1] += 1
        elif tag in ("pre", "xmp"):
            self.pre += 1

    def _pop(self) -> None:
        tag, own, self.veiled = self.open.pop()
        self.places[tag].pop()
        seen = not self.hidden
        self.hidden -= own
        if not seen:
            return
        if tag in ("td", "th") and self.tables and self.tables[-1] and len(self.canvases) > 1:
            canvas = self.canvases.pop()
            canvas.end_line()
            self.tables[-1].rows[-1][-1][2].extend(canvas.lines)
        elif tag in ("td", "th") and self.tables:
            self._break("tr")
        elif tag == "table" and self.tables:
            canvas, table = self.canvases[-1], self.tables.pop()
            canvas.end_line(self._indent())
            for line in table.lines() if table else ():
                canvas.now.append(line)
                canvas.end_line(self._indent())
            canvas.blank = True
        elif tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.canvases[-1].end_line(self._indent())
            self.lists.pop()
            self.canvases[-1].blank = not self.lists
        elif tag in BLOCK:
            self._break(tag)
            if tag == "li":
                self.canvases[-1].mark = ""
            elif tag in ("pre", "xmp"):
                self.pre -= 1

    def _innermost(self, names: tuple[str, ...]) -> int:
        return max((at[-1] for n in names if (at := self.places.get(n))), default=-1)

    def _close_within(self, names: tuple[str, ...], borders: tuple[str, ...]) -> None:
        """Close the outermost of the named elements that is open within the innermost border."""
        if self._innermost(names) < 0:
            return
        border = self._innermost(borders)
        found = min((at[k] for n in names if (at := self.places.get(n)) and (k := bisect.bisect_right(at, border)) < len(at)), default=None)
        while found is not None and len(self.open) > found:
            self._pop()

    def end(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.start("br", {})
            return
        stop = () if tag in ("table", "body", "html") else ("table",) if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else ("td", "th", "table")
        found = self._innermost((tag,))
        if found > self._innermost(tuple(x for x in stop if x != tag)):
            while len(self.open) > found:
                self._pop()

    def text(self, value: str, shown: bool = False) -> None:
        if self.hidden or (self.veiled and not shown):
            return
        if self.open and self.open[-1][0] in ("table", "tr", "thead", "tbody", "tfoot") and not value.strip():
            return
        canvas = self.canvases[-1]
        if self.pre:
            first, *rest = value.split("\n")
            canvas.now.append(first)
            for line in rest:
                canvas.end_line(self._indent(), keep=True)
                canvas.now.append(line)
            canvas.gap = False
        else:
            canvas.text(_BLANK.sub(" ", value))

    def finish(self) -> str:
        while self.open:
            self._pop()
        self.canvases[0].end_line()
        return "\n".join(self.canvases[0].lines)


def render(page: str | None) -> str:
    """The visible text of a page; of a null or empty page, an empty text. The time is in proportion to the page."""
    page = page or ""
    out, at = _Renderer(len(page)), 0
    paired = "\"'"  # quotes that may still have a partner
    while at < len(page):
        m = _MARKUP.match(page, at)
        at = m.end()
        if m[2] is None:
            if m[0][:2] not in ("<!", "<?"):
                out.text(html.unescape(m[0]))
            continue
        begin, stop = at, _REST[paired].match(page, at).end()
        while page[stop : stop + 1] in ('"', "'"):  # a quote that is never closed is like any other character
            paired = paired.replace(page[stop], "")
            stop = _REST[paired].match(page, stop).end()
        if stop == len(page):  # a tag that the page cuts off
            out.text(html.unescape(page[m.start() :]))
            break
        at, rest, tag = stop + 1, page[begin:stop], m[2].lower()
        if m[1]:
            out.end(tag)
            continue
        attrs = _attributes(rest)
        out.start(tag, attrs)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            inside = page[at : close.start() if close else len(page)]
            at = close.end() if close else len(page)
            if tag == "style" and _on_any_screen(attrs.get("media", "")):
                out.style(inside)
            elif tag == "xmp":
                out.text(inside)
            elif tag == "textarea":
                out.text(html.unescape(inside))
            out.end(tag)
        elif rest.endswith("/") and tag in ("svg", "math"):
            out.end(tag)
    return out.finish()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x.as_py()) for x in batch.column(1)], pa.string())], names=["__id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text)`` for every row of ``pages``.

    A null or empty page gives an empty text; the time for a page is in proportion to its length. Broken and cut-off pages are rendered as far as
    they go: open elements end with the page, an unclosed tag is text. Ids may be null or
    repeat; further columns are ignored; an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("__html"))
    return rows.mapInArrow(_render, f"__id {kind}, text string").withColumnRenamed("__id", id_col)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op1_html_text": op1_html_text}

ORACLES: dict[str, str] = {}
