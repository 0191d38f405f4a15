import gzip
import hashlib
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sagaframe.llm import html_text as H
from sagaframe.llm import warc_audit as W


def test_layout():
    page = """<!DOCTYPE html><head><title>no</title><style>.x, #y{display: none}</style><script>if (a<b) "</p>"</script></head>
    <p>one <b>two<p>three<br>four<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>tail
    <table><caption>cap</caption><tr><th>Name<th>N<tr><td>longer name<td>1<tr><td colspan=2>wide</table>
    <pre>a
  b</pre><div class="x">no</div><div id=y>no</div><p hidden>no<p style="display:none">no</p>&lt;end&amp;"""
    want = "one two\n\nthree\nfour\n\n- a\n- b\n  3. x\n  4. y\n- c\n\ntail\n\ncap\n\nName        | N\nlonger name | 1\nwide\n\na\n  b\n\n<end&"
    got = H.render(page)
    assert [x for x in got.split("\n") if x] == [x for x in want.split("\n") if x]
    assert "Name        | N\nlonger name | 1" in got and "\n\nthree\nfour\n\n" in got


def test_what_a_screen_shows():
    css = "@media print { .noprint { display: none } } @media (max-width: 600px) { .wide, p { display: none } } @media not print { .n { display: none } } @media screen { .s { display: none } } /* .c { display: none } */ .z { display: none }"
    page = f"<style>{css}</style><style media=print>.m {{ display: none }}</style>" + "".join(f"<p class={c}>{c}</p>" for c in ("noprint", "wide", "n", "s", "c", "z", "m"))
    assert H.render(page).split() == ["noprint", "wide", "c", "m"]
    page = "<style>.v{visibility:hidden} .w{visibility:visible} .b{backface-visibility:hidden}</style><div class=v>no<p style='visibility: visible'>a<i>b</i></p>no<p class=w>c<b class=v>no</b></p>no<img alt=no></div><p class=b>d</p>"
    assert H.render(page).split() == ["ab", "c", "d"]
    assert H.render("<div style='display:none'>no<p style='visibility:visible'>no</p></div>a") == "a"
    assert H.render("x<xmp><b>&amp;  y</b>\nz</xmp>w").split("\n") == ["x", "", "<b>&amp;  y</b>", "z", "", "w"]
    assert H.render("<xmp hidden>no</xmp>a") == "a"


def test_broken_pages():
    assert H.render(None) == "" and H.render("") == ""
    assert H.render("a < b") == "a < b"
    assert H.render("</p></div>x</ul>") == "x"
    assert H.render("<div>" * 5000 + "deep") == "deep"
    assert H.render("<p>cut <b") == "cut <b"
    assert H.render("<td>a<td>b") and H.render("<li>a") == "- a"
    assert H.render("x<script>never closed") == "x"
    assert H.render("<table><tr><td>a<table><tr><td>in</table></td><td>b</table>").split("\n")[0].startswith("a")


class Plain(HTMLParser):
    """Visible words, without any layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_query_keeps_all_visible_text(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = H.op1_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        plain = Plain()
        plain.feed(pages[r.page_id])
        plain.close()
        squeeze = lambda s: "".join(s.split())
        bare = "\n".join(x.lstrip().removeprefix("- ") for x in r.text.split("\n"))
        if "<" not in pages[r.page_id][-40:].split(">")[-1] and pages[r.page_id].endswith(">"):
            assert squeeze(bare) == squeeze("".join(plain.words)), r.page_id
        assert r.text_chars == len(r.text)


def test_html_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, "t"), (1, "", "t"), (1, "<p>x", "t")], "page_id long, html string, text string")
    assert sorted(((r.page_id, r.text) for r in H.extract_text(rows).collect()), key=repr) == sorted([(None, ""), (1, ""), (1, "x")], key=repr)
    assert H.extract_text(rows.filter("false")).count() == 0


def _leaves(spark, rows):
    return W.lay_out(spark.createDataFrame(rows, "file int, page_id int, record string"), "file", "page_id", ["page_id"])


def test_padding_is_in_proportion():
    """A page of wide columns and cells that span them all."""
    page = "<table><tr>" + "".join(f"<td>{'x' * 200}" for _ in range(200)) + "".join(f"<tr><td colspan=199>a{k}<td>b{k}" for k in range(1000)) + "</table>"
    got = H.render(page)
    assert len(got) < 20 * len(page) < 2_000_000 and all(f"a{k} | b{k}" in got for k in range(1000))
    wide = "<table><tr><td>" + "x" * 150 + "<td>y</table>"
    for _ in range(25):
        wide = f"<table><tr><td>{wide}<td>z<tr><td>a<td>b<tr><td colspan=2>c</table>"
    assert len(H.render(wide)) < 20 * len(wide) + 20_000
    small = H.render("<table><tr><td>name<td>n<tr><td>a longer one<td>1</table>")
    assert small == "name         | n\na longer one | 1"


@pytest.mark.parametrize("block", [300, W.BLOCK])
def test_audit_finds_what_differs(spark, block):
    rows = [(f, k, "r" * (k % 40) + str(k)) for f in range(3) for k in range(60)]
    other = [(f, k, r + "!" * (f == 2 and k in (3, 59))) for f, k, r in rows if (f, k) != (1, 7)] + [(2, 999, "new")]
    a, b = _leaves(spark, rows), _leaves(spark, other)
    got = {(r.file, r.record_id, r.kind) for r in W.audit(a, b, block).collect()}
    assert got == {(1, 7, "missing"), (2, 3, "changed"), (2, 59, "changed"), (2, 999, "extra")}
    assert W.audit(a, a, block).count() == 0
    assert W.audit(a.filter("false"), a.filter("false"), block).count() == 0
    whole = W.audit(a, a.filter("file <> 0"), block).collect()
    assert len(whole) == 60 and {r.kind for r in whole} == {"missing"}


def test_one_lost_record_is_one_row_and_prunes_the_rest(spark):
    rows = [(0, k, f"record {k} " + "x" * (k * 7 % 50)) for k in range(3000)]
    a, b = _leaves(spark, rows), _leaves(spark, [r for r in rows if r[1] != 1234])
    assert a.filter("record_id = 1235").first().offset > b.filter("record_id = 1235").first().offset
    assert [(r.record_id, r.kind, r.offset_b) for r in W.audit(a, b).collect()] == [(1234, "missing", -1)]
    side = lambda df, r: df.withColumn("replica", F.lit(r))
    levels = W.trees(side(a, "a").unionByName(side(b, "b")))
    files, bad = W.suspects(levels)
    assert len(levels) >= 3 and files.count() == 1 and bad.count() < 400


@pytest.mark.parametrize("block", [W.BLOCK, 40])
def test_audit_tells_orders_apart(spark, block):
    """Orders with the same neighbours, and with the same runs, differ; the same order again does not."""
    rng = random.Random(4)
    long = [f"r{rng.randrange(6)}" for _ in range(300)]
    moved = long[:100] + long[150:200] + long[100:150] + long[200:]
    orders = {0: ("xbxcx", "xcxbx"), 1: ("xxbxx", "xxbxx"), 2: (long, moved), 3: ("aabb", "abab"), 4: ("x" * 500, "x" * 500)}
    leaves = [spark.createDataFrame([(f, k * 10, r, 6, f"h{r}") for f, o in orders.items() for k, r in enumerate(o[side])], "file int, offset long, record_id string, length long, hash string") for side in (0, 1)]
    got = W.audit(*leaves, block=block).collect()
    assert sorted((r.file, r.kind) for r in got) == [(0, "reordered"), (2, "reordered"), (3, "reordered")]


def test_audit_odd_rows(spark):
    kind = "file int, record_id int, offset long, length long, hash string, kind int"
    a = spark.createDataFrame([(0, 1, 0, None, None, 1), (0, 2, 9, 1, "x", 1), (0, 2, 9, 1, "x", 1), (None, 3, 0, 1, "y", 1), (1, None, 0, 1, "p", 1), (1, None, 5, 1, "q", 1)], kind)
    b = spark.createDataFrame([(0, 1, 0, 1, "z", 1), (0, 2, 9, 1, "x", 1), (1, None, 0, 1, "q", 1), (1, None, 5, 1, "p", 1)], kind)
    got = {(r.file, r.record_id, r.kind, r.length_a, r.length_b) for r in W.audit(a, b).collect()}
    # of two equal records one is lost; the other file has its records in another order
    assert got == {(0, 1, "changed", -1, 1), (0, 2, "missing", 1, -1), (1, None, "reordered", -1, -1)}


def test_warc_files_round_trip(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("page_id < 20")
    rows = pages.select("page_id", F.lit(0).alias("file"), W.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    W.write_warc(rows.coalesce(1).sortWithinPartitions("page_id"), str(tmp_path / "w"), ["file"])
    back = W.read_warc(spark, str(tmp_path / "w"), bodies=True).collect()
    assert sorted((r.uri, r.body.decode()) for r in back) == sorted((r.url, r.html) for r in pages.collect())
    laid = W.lay_out(rows, "file", "page_id", ["page_id"]).collect()
    assert sorted((r.offset, r.length, r.hash) for r in back) == sorted((r.offset, r.length, r.hash) for r in laid)


def _record(body, ident="1", length=None):
    head = b"WARC/1.1\r\nWARC-Record-ID: <urn:uuid:%s>\r\nContent-Length: %d\r\n\r\n" % (ident.encode(), len(body) if length is None else length)
    return head + body


def test_records_end_by_their_length(spark, tmp_path):
    inner = b"a\r\n\r\nWARC/1.1\r\nWARC-Type: none\r\n\r\nb\r\n\r\n"
    records = [_record(inner), _record(b"\xff\x00bytes"), _record(b""), _record(b"cut", length=10), _record(b"after"), b"WARC/1.1\r\nno length", _record(b"last", length=99)]
    data = b"".join(r + b"\r\n\r\n" for r in records)
    assert [r for *_, r in W.split_warc(data)] == records
    assert [data[at : at + len(r)] for at, _, r in W.split_warc(data)] == records
    assert [r for *_, r in W.split_warc(b"\r\n\r\njunk" + data)][-7:] == records
    assert list(W.split_warc(b"")) == []
    (tmp_path / "plain.warc").write_bytes(data)
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "broken.warc.gz").write_bytes(gzip.compress(records[0] + b"\r\n\r\n") + gzip.compress(data * 50)[:60])
    (tmp_path / "empty.warc").write_bytes(b"")
    found = {}
    for r in W.read_warc(spark, str(tmp_path)).orderBy("offset").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append(r.hash)
    want = [hashlib.sha256(r).hexdigest() for r in records]
    assert found["plain.warc"] == found["members.warc.gz"] == found["one.warc.gz"] == want
    assert found["broken.warc.gz"][0] == want[0] and "empty.warc" not in found


def test_cascade_and_visibility():
    cases = {
        "<style>@media print{.x{display:none}}</style><p class=x>a": "a",
        "<style>.x{display:none}.x{display:block}</style><p class=x>a": "a",
        "<style>.x{display:none!important}.x{display:block}</style><p class=x>a<p>b": "b",
        "<style>p{display:none}#k{display:block}</style><p id=k>a<p>b": "a",
        "<style>#k{display:none}</style><p id=k style='display:inline'>a": "a",
        "<style>[x]{display:none}.s{display:block}</style><p hidden class=s>a<p hidden>b": "a",
        "<style>.v{visibility:hidden}</style><p class=v>a<b style='visibility:visible'>b</b>c": "b",
        "<style>.v{visibility:hidden}.v{visibility:visible}</style><p class=v>a": "a",
        "<p style='content-visibility:hidden'>a<p>b": "b",
    }
    assert {page: H.render(page) for page in cases} == cases


def test_cells_that_span_rows():
    assert H.render("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>") == "A | b\n  | c\nd | e"
    assert H.render("<table><tr><td rowspan=3 colspan=2>A<td>b<tr><td>c<tr><td>d<td rowspan=x>e</table>") == "A   | b\n |  | c\n |  | d | e"


@pytest.mark.parametrize("unit", ["<a ", '<a href="x ', "<div>", "<ul><li>x", "<p>", "<a '>' ", "<table><tr><td>x", "<tr><td rowspan=9999>x", "</div>", "<td colspan=1000>x"])
def test_hostile_pages_take_time_in_proportion(unit):
    took = []
    for size in (50_000, 200_000):
        began = time.process_time()
        H.render(unit * (size // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 5


def test_deep_and_wide_layout_keeps_the_text():
    assert H.render("<table><tr><td>x" * 100).count("x") == 100
    assert H.render("<ul><li>y" * 100).count("y") == 100
    assert H.render("<table><tr>" + "<td>z" * 500 + "</table>").count("z") == 500
    assert len(H.render("<table><tr><td>" + "w" * 5000 + "<tr><td>a<td>b</table>")) < 6000
