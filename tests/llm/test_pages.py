import base64
import hashlib

import pytest

from tallygrid.llm import pages, warc

INNER = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\ntail"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("split", ["134217728", "150", "64"])
def test_archives_round_trip(spark, split):
    rows = [(1, "u", INNER), (2, None, None), (3, "u\nv", ""), (4, "a", INNER), (5, "z", "plain é" * 50), (6, "q", "WARC/1.1\r\n"), (7, "q", "WARC/1.1\r\n" * 30), (5, "z", "plain é" * 50)]
    frame = spark.createDataFrame([(*r, "clash", "also") for r in rows], "page_id long, url string, html string, record_type string, verified string").coalesce(1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.round_trip(frame).collect()
        few = {r.page_id: r.record_type for r in warc.round_trip(frame, min_bytes=200).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    refers = {3: "2", 4: "1"}
    want = sorted((str(i), len((h or "").encode()), digest(h), "revisit" if i in refers else "response", refers.get(i), True) for i, _, h in rows)
    assert sorted(tuple(r) for r in got) == sorted(want, key=lambda r: r[0])
    assert few["4"] == "response" and few["3"] == "response"
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_broken_chain_ends_the_file(spark, tmp_path):
    good = warc.header("1", "u", b"abc", None) + warc.END
    bad = warc.header("2", "u", b"abc", None).replace(b"Content-Length: ", b"Content-Length: 9") + warc.END
    (tmp_path / "a.warc").write_bytes(good + bad + warc.header("3", "u", b"abc", None) + warc.END)
    assert [r.page_id for r in warc.read(spark, str(tmp_path)).collect()] == ["1"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><div>Site</div></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>Accept</p></div><div class="ad">Buy</div>
<article><header><h1>Title {n}</h1></header><span>Label</span><p><b>First &amp; {n}&nbsp;line<br>next   part {n}<p>Second <i>o</i>ne &lt;{n}&gt;</p><form><input value="a>b"><p>mail</p></form>
<div class="comments"><article class="comment"><p>Nice</p></article></div></article><aside>Related</aside><footer>&copy; Site</footer></body></html>"""


def test_main_text(spark):
    many = [(n, f"http://a.example/{n}", PAGE.replace("{n}", str(n))) for n in range(12)]
    few = [(100, "https://b.example/1", PAGE.replace("{n}", "x")), (101, None, None), (102, "", ""), (103, "::", "no markup &amp; <unclosed"), (104, "c", "<p>one<p>two</div></article>"), (104, "c", "<p>one<p>two</div></article>")]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in many + few], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(frame).collect())
    want = [(n, f"Title {n}\nFirst & {n} line\nnext part {n}\nSecond one <{n}>") for n in range(12)]
    label = [(100, "Title x\nLabel\nFirst & x line\nnext part x\nSecond one <x>"), (101, ""), (102, ""), (103, "no markup & <unclosed"), (104, "one\ntwo"), (104, "one\ntwo")]
    assert got == [(i, t, len(t)) for i, t in want + label]
    assert pages.extract(frame.limit(0)).count() == 0


def test_copies_change_no_text(spark):
    """Copies of a page count once, and what near copies of an article share is no label of it."""
    many = [(n, f"http://a.example/{n}", PAGE.replace("{n}", str(n))) for n in range(12)]
    copies = [(1000 + i, f"http://a.example/{i}", many[0][2]) for i in range(300)]
    alone = [(2000 + i, f"http://b.example/{i}", many[0][2]) for i in range(12)]
    shared = "<p>A first paragraph that all copies share.</p><p>A second one, also in all of them.</p>"
    near = [(3000 + i, f"http://c.example/{i}", f"<html><body><nav>Menu</nav><article><h1>Head</h1><p>Day {i}</p>{shared}</article></body></html>") for i in range(20)]
    plain = [(4000 + i, f"http://d.example/{i}", f"<html><body><!-- {i} --><div>{shared}</div></body></html>") for i in range(20)]
    frame = spark.createDataFrame(many + copies + alone + near + plain, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in pages.extract(frame).collect()}
    bare = "A first paragraph that all copies share.\nA second one, also in all of them."
    want = {n: f"Title {n}\nFirst & {n} line\nnext part {n}\nSecond one <{n}>" for n in range(12)}
    want |= {i: want[0] for i, *_ in copies} | {i: want[0].replace("\nFirst", "\nLabel\nFirst") for i, *_ in alone}
    want |= {3000 + i: f"Head\nDay {i}\n{bare}" for i in range(20)} | {4000 + i: bare for i in range(20)}
    assert got == want


def test_every_sample_page(small):
    rows = pages.extract(small("pages")).join(small("pages").select("page_id", "html"), "page_id").collect()
    assert rows and all(r.text and "<" not in r.text[:1] and "track(" not in r.text for r in rows)


@pytest.mark.parametrize("page, want", [
    ('<body class="page has-sidebar"><article><p>Hi there', "Hi there"),
    ('<html class="menu"><body id="search"><p>Hi there', "Hi there"),
    ('<article class="post comments-open"><p>Hi there', "Hi there"),
    ('<main class="search-results" role="main"><p>Hi there', "Hi there"),
    ('<div class="social-science"><p>Hi there', "Hi there"),
    ('<nav>Menu</nav><main><div class="related-work"><p>Hi there', "Hi there"),
    ('<div><p>Hi there</p></div><div class="related-posts"><p>Other</div>', "Hi there"),
    ('<article><p>Hi there</p><article class="comment"><p>Nice</article></article>', "Hi there"),
    ('<div class="menu">Only</div>', ""),
])
def test_names_do_not_empty_pages(page, want):
    assert pages.main_text(page, None, None) == want


def brute_template(found):
    """Text tokens with the same count on all pages of a host, compared page by page."""
    counts = [{t: own.count(t) for t in own} for own in found]
    return {t for t in counts[0] if all(c.get(t) == counts[0][t] for c in counts)}


def test_template_alone_tells_text_from_chrome(spark):
    """No element or name tells chrome from text: what repeats on the host goes, what varies stays."""
    def build(host, n):
        rows = "".join(f"<div><p>{host} item {n} {k}</p></div>" for k in range(1 + n % 3))
        return f"<html><body><div>{host} home</div><div>Products</div><div><h1>{host} story {n}</h1><p>Text of {n} at length.</p></div>{rows}<div>Terms of {host}</div></body></html>"

    docs = [(100 * h + n, f"http://h{h}.example/{n}", build(f"h{h}", n)) for h in range(3) for n in range(10)]
    frame = spark.createDataFrame(docs, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in pages.extract(frame).collect()}
    for h in range(3):
        own = {i: list(pages.events(page)) for i, url, page in docs if url.startswith(f"http://h{h}.")}
        fixed = brute_template([[e[:3] for e in found if e[0] == "text"] for found in own.values()])
        assert len(fixed) == 3
        for i, found in own.items():
            assert got[i] == "\n".join(e[2] for e in found if e[0] == "text" and e[:3] not in fixed)
    bare = {i: pages.main_text(page, None, None) for i, _, page in docs}
    assert all(bare[i] != got[i] for i in got)
