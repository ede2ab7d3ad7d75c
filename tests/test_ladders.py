"""Every rung of the publishers' ladders and every way of dating a link, on pages written by hand."""

import datetime as dt
import random

from pyspark.sql import functions as F

from foliant.operators import ladders
from foliant.sources.markup import nodes, trees

DAY = dt.date(2026, 5, 8)
LONG = "a paragraph of rather more than forty characters in all"
CJK = "这是一段超过三十个字符的正文内容，用来检验最后一级规则是否只保留足够长的段落，其余一概不收。"


def read(spark, cases):
    """The rows of many pages (url, html), by their place."""
    pages = spark.createDataFrame([(k, url, html, "old") for k, (url, html) in enumerate(cases)], "k int, url string, html string, title string")
    rows = {r.k: r for r in ladders.articles(pages, ladders.article_rules(spark), F.lit(DAY)).collect()}
    assert len(rows) == len(cases)
    return [rows[k] for k in range(len(cases))]


PLA, MOD, GT, CMO = "http://www.81.cn/yw/1.html", "http://www.mod.gov.cn/gfbw/a/2.html", "https://www.globaltimes.cn/page/202605/3.shtml", "http://eng.chinamil.com.cn/2025xb/N/4.html"


RUNGS = [
    # display paragraphs of the container, blank ones included, nested lists inside it
    (PLA, '<h2> 标题 <b>二</b></h2><h1>other</h1><ul class="row m-t-list"><li><ul><li>x</ul><p class="ueditor-text-p_display"> 第一 </p><p class="plain">no</p><p class="ueditor-x"></p></ul><p class="ueditor-y">outside</p>', ("标题二", "h2", "第一\n", "display")),
    (PLA, "<h2> 　</h2><h1>一</h1><ul class='m-t-list'><li>" + LONG + "<li> second item </ul><p>" + CJK + "</p>", ("一", "h1", f"{LONG}\nsecond item", "container")),
    (PLA, "<h2>t</h2><ul class='m-t-list'><li>short</ul><p>" + CJK + "<p>版权" + CJK + "<p>责任编辑" + CJK + "<p>短</p>", ("t", "h2", CJK, "long")),
    (PLA, "<p>" + CJK, (None, None, CJK, "long")),
    (PLA, "<h2>t</h2>", ("t", "h2", "", None)),
    # display paragraphs anywhere, captions and short ones left out; taken even if none is left
    (MOD, f"<h2>b</h2><h1>a</h1><div><p class='ueditor-text-p_display'>{LONG}</p></div><p class='ueditor-text-tushuo ueditor-x'>{LONG} caption</p><p class='ueditor-z'>ten chars.</p>", ("a", "h1", LONG, "display")),
    (MOD, f"<h1></h1><h2>b</h2><p class='ueditor-z'>short</p><p>{LONG}</p>", ("b", "h2", "", "display")),
    (MOD, f"<h1>a</h1><p>{LONG}</p>", ("a", "h1", LONG, "long")),
    # the first content block alone, nested blocks in it included
    (GT, f"<h1>other</h1><div class='x article_title'>T</div><div class='article_content'><div><p>{LONG}</p></div><p class='picture'>{LONG} pic</p><p class='picture big'>{LONG} kept</p><p>short</p></div><div class='article_content'><p>{LONG} related</p></div>", ("T", "div", f"{LONG}\n{LONG} kept", "content")),
    (GT, f"<h1>h</h1><div class='article_content'><p>short</p></div><p class='c'>{LONG} c</p><p class>{LONG}</p>", ("h", "h1", LONG, "long")),
    (GT, f"<div class='article_titles'>T</div><p>{LONG}</p>", (None, None, LONG, "long")),
    (CMO, f"<h1>China Military</h1><div class='article-header'><h1> Head </h1></div><p class='ueditor-text'>{LONG}</p>", ("Head", "header", LONG, "display")),
    (CMO, f"<h1>China Military</h1><h1>second</h1><p>{LONG}</p>", (None, None, LONG, "long")),
    (CMO, f"<h1>Real</h1><div class='article-header'></div><p>{LONG}</p>", ("Real", "h1", LONG, "long")),
    (CMO, "", (None, None, "", None)),
    (CMO, None, (None, None, "", None)),
]


def test_rungs(spark):
    for r, (url, html, want) in zip(read(spark, [c[:2] for c in RUNGS]), RUNGS):
        assert (r.title, r.title_rung, r.body, r.body_rung) == want, (url, html)
        assert r.published == "2026-05-08" or r.published_rung


DATES = [
    (PLA, '<div class="container artichle-info"><p>来源</p><p>发布：<b>2026-05-07</b> 10:00</p></div>', ("2026-05-07", "info")),
    (PLA, "<p>2026-01-01 发布: 2026-05-06</p>", ("2026-01-01", "stamp")),
    (PLA, "<p>2026-01-01</p>", ("2026-05-08", None)),
    (MOD, "<script>var d='2026-04-30'</script><p>2026-05-01</p>", ("2026-04-30", "page")),
    (GT, '<div class="source_time">By X</div><div class="a source_time">By Y | 2026/5/7 18:37:07</div>', ("2026-05-07", "source")),
    (GT, "<p>2026/5/7</p>", ("2026-05-08", None)),
    (CMO, '<div class="pub-info"><dl><dt>Time<dd>x 2026-05-01<dd> 2026-05-02 10:34:11</dl></div>', ("2026-05-02", "info")),
    (CMO, "<p>seen 2026-05-03</p>", ("2026-05-03", "page")),
]


def test_dates(spark):
    for r, (url, html, want) in zip(read(spark, [c[:2] for c in DATES]), DATES):
        assert (r.published, r.published_rung) == want, (url, html)


def test_other_hosts_repeated_pages_and_columns(spark):
    pages = spark.createDataFrame([(1, GT, "<h1>a</h1>"), (1, GT, "<h1>a</h1>"), (2, "http://other.example/", "<h1>b</h1>"), (3, None, "<h1>c</h1>"), (4, "not a url", None)], "id long, url string, html string")
    odd = pages.select("*", *[F.lit("old").alias(c) for c in ("nodes", "nodes_x", "body", "rules", "source", "day", "c0")])
    rows = ladders.articles(odd, ladders.article_rules(spark), F.lit(DAY)).collect()
    assert [(r.id, r.title, r.nodes, r.source, r.day) for r in rows] == [(1, "a", "old", "global_times_mil", "old")] * 2
    assert ladders.articles(odd.limit(0), ladders.article_rules(spark), F.lit(DAY)).count() == 0


def test_tree():
    """Parents and ends of nodes; what is unclosed ends where the standard ends it."""
    html = "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<b>y<p>z<table><tr><td><p>q<td>r</table>w</div><br><script>if (1<2) '</p>'</script>&amp;&#20013;<!-- c -->!"
    rows = nodes(html, "http://h.example/a/b")
    path = lambda r: "" if r is None else f"{path(rows[r[1]] if r[1] >= 0 else None)}/{r[3]}"
    texts = [(path(r), r[-1]) for r in rows if r[3] == "#text"]
    assert texts == [("/ul/li/#text", "a"), ("/ul/li/#text", "b"), ("/ul/li/ul/li/#text", "c"), ("/ul/li/#text", "d"), ("/p/#text", "x"), ("/p/b/#text", "y"), ("/p/#text", "z"), ("/table/tr/td/p/#text", "q"), ("/table/tr/td/#text", "r"), ("/#text", "w"), ("/#text", "&中"), ("/#text", "!")]
    assert all(r[0] == k and r[1] < k <= r[2] and all(rows[j][2] <= r[2] for j in range(k, r[2] + 1)) for k, r in enumerate(rows))
    assert nodes('<a href=" ../c?x=1 ">', "http://h.example/a/b/")[0][5] == "http://h.example/a/c?x=1"
    assert nodes(None, None) == nodes("", "u") == []
    assert len(nodes("<b>" * 20000 + "<p>" * 20000, None)) == 40000


def listed(spark, url, html, day=DAY):
    pages = spark.createDataFrame([(url, html)], "url string, html string")
    rows = ladders.listed_links(pages, ladders.listing_rules(spark), F.lit(day)).collect()
    return sorted((r.link.rpartition("/")[2].partition(".")[0], r.day and r.day.isoformat()) for r in rows)


def test_label_links(spark):
    html = '<a href="/yw/1.html">x 2026-05-08</a><a href="2.html">2026-05-07</a><a href="http://www.81.cn/yw/1.html">again 2026-05-08</a><a href="/yw/index.html">2026-05-08</a><a href="/yw/3.html">2026-<b>05-08</b></a><a>2026-05-08</a>'
    assert listed(spark, "http://www.81.cn/yw/index.html", html) == [("1", "2026-05-08"), ("3", "2026-05-08")]


def test_stamped_links(spark):
    """A stamp element wins over the text, a stamp in the text must end it, and the window has seven days."""
    link = lambda k, inner: f'<li><a href="./{k}.html">{inner}</a></li>'
    small = lambda t: f'head<small class="time hidden-xs">{t}</small>'
    cases = {
        1: (small("2026-05-08 10:00"), "2026-05-08"), 2: (small("2026-05-02 1:05:09 "), "2026-05-02"), 3: (small("2026-05-01 10:00"), None), 4: (small("2026-05-09 00:00"), None),
        5: (small("2026-05-08"), None), 6: (small("2026-13-45 10:00"), None), 7: ("回顾2026-05-08演习", None), 8: ("回顾2020-01-01演习2026-05-07 15:00", "2026-05-07"),
        9: ("2026-05-07 15:00 tail", None), 10: (small("soon") + " 2026-05-07 15:00", None), 11: ("<b>2026-05-06</b> 15:00\n", "2026-05-06"), 12: ("2026-02-30 15:00", None), 13: ("", None),
    }
    html = "".join(link(k, inner) for k, (inner, _) in cases.items()) + '<a href="/other/1.html">2026-05-07 15:00</a>'
    want = sorted((str(k), day) for k, (_, day) in cases.items() if day)
    assert listed(spark, "http://www.mod.gov.cn/gfbw/wzll/hj/index.html", html) == want


def test_titled_links(spark):
    a = lambda k, inner: f'<a href="{k}.html">{inner}</a>'
    title = lambda t, c="title": f'<div class="{c}"><h3>x</h3><small class="time">{t}</small></div>'
    html = a(1, title(" 2026-05-08 10:00")) + a(2, title("2026-05-07 10:00")) + a(3, title("2026-05-08", "titles")) + a(4, f"<span>{title('2026-05-08')}</span>") + a(5, title("on 2026-05-08")) + a(6, title("2026-05-01") + title("2026-05-08")) + a(7, '<div class="a title"></div>')
    assert listed(spark, "http://eng.chinamil.com.cn/2025xb/N/index.html", html) == [("1", "2026-05-08"), ("6", "2026-05-08")]


def test_links_dated_by_ancestors(spark):
    """The nearest of four ancestors with a dated source line, against a climb over random trees."""
    rng = random.Random(11)
    cases = []
    for k in range(120):
        depth = rng.randrange(1, 7)
        inner, near = f'<a href="/page/{rng.choice(["202605", "202605", "202604"])}/{k}.shtml">n</a>', None
        month = "202605" in inner
        for level in range(1, depth + 1):
            line = rng.choice(["", "", "By X | 2026/5/8 1:00", "By X | 2026/05/07 1:00", "no date", "2026/15/8"])
            if line and near is None and level <= 4 and "/" in line:
                near = line
            inner = f'<div>{inner}<div class="s source_time">{line}</div></div>' if line else f"<div>{inner}</div>"
        cases.append((k, inner, month and (near is None or "2026/5/8" in near), near))
    # each case on a page of its own: further ancestors must not see a neighbour's line
    pages = spark.createDataFrame([(f"https://www.globaltimes.cn/list/{k}", f"<div><div><div><div><div>{h}</div></div></div></div></div>") for k, h, _, _ in cases], "url string, html string")
    rows = ladders.listed_links(pages, ladders.listing_rules(spark), F.lit(DAY)).collect()
    got = {int(r.link.rpartition("/")[2].partition(".")[0]): r.day for r in rows}
    assert got == {k: (DAY if near else None) for k, _, wanted, near in cases if wanted}
    assert len(got) > 20 and None in got.values()


def test_a_link_of_several_pages_is_one_row(spark):
    html = '<a href="http://www.81.cn/yw/1.html">{} 2026-05-08</a>'
    pages = spark.createDataFrame([(f"http://www.81.cn/{k}/index.html", html.format(k)) for k in "cab"] + [("http://www.81.cn/d/", None)], "url string, html string")
    rows = ladders.listed_links(pages, ladders.listing_rules(spark), F.lit(DAY)).collect()
    assert [(r.source, r.label) for r in rows] == [("pla_daily", "a 2026-05-08")]
    assert trees(pages).filter("size(nodes) = 0").count() == 1
