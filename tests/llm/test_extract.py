import random

from sparkrag.llm import op4_extract as op4

PAGES = "page_id bigint, url string, html string, text string"


def text_of(html, other=None):
    lines = op4.page_lines(html)
    main = [x for x, inside in lines if inside]
    return "\n".join(main) if main else op4.difference([x for x, _ in lines], [x for x, _ in op4.page_lines(other)])


def test_structure():
    page = "<nav>menu</nav><article><h1>T &amp; u</h1><p>one\n two<p>three<div class='comments'>no</div></article><footer>f</footer>"
    assert text_of(page) == "T & u\none two\nthree"
    assert op4.page_lines(None) == []
    assert text_of("<html><head><title>t</title><body><article><p>x</p></article>") == "x"
    assert text_of("<div class='content has-sidebar'><article><p>x</p></article></div>") == "x"
    assert text_of("<article><div class='social-science'>a</div><p class='share-price'>b</p><div class='share-buttons'>c</div></article>") == "a\nb"
    assert text_of("<article><p>x</p><div class='post-comments'>c</div><div id='ad-2'>d</div></article>") == "x"
    assert text_of("<aside><article>no</article></aside><main>yes</main>") == "yes"


def test_a_comment_is_no_article():
    assert text_of("<!-- <article> --><div>menu</div><div>own</div>", "<div>menu</div><div>other</div>") == "own"


def plain_lcs(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    return row[-1][-1]


def test_lcs_equals_a_full_table():
    rnd = random.Random(4)
    for most in (1 << 28, 20):
        for _ in range(400):
            a, b = (rnd.choices("abcde", k=rnd.randint(0, 14)) for _ in range(2))
            got = sorted(op4.lcs(a, b, most))
            assert len(got) == plain_lcs(a, b)
            rest = iter(b)
            assert all(a[i] in rest for i in got)
    long = [str(i) for i in range(20000)]
    assert len(op4.lcs(long, ["x", *long[::2]])) == 10000


def test_pages_equal_brute_force(spark):
    page = lambda x: f"<div>top menu</div><div>{x}</div><div>bottom</div>"
    paths = ["a.html", "b.html", "some-post-title", "some-post-titles", "some-post-t/x", "zz/1", "zz/2"]
    rows = [(i, f"http://host/{p}", page(f"own {i}"), "") for i, p in enumerate(paths)]
    rows += [(50, "http://alone/x", page("own"), ""), (51, None, page("null"), ""), (52, "http://HOST/a.html?q", page("own 0"), ""), (53, None, None, None), (None, "http://host/a.html", page("own 0"), "")]
    rows += [(60 + i, "http://flat/" + "p" * 13 + str(i), page(f"flat {i}"), "") for i in range(6)] + [(70, "http://flat/q", "<article><p>kept</p></article>", "")]
    got = {r["page_id"]: r["text"] for r in op4.extract(spark.createDataFrame(rows, PAGES)).collect()}
    host = sorted({(p, i) for i, p in enumerate(paths)})
    want = {i: text_of(page(f"own {i}"), page(f"own {host[k - 1 if k else 1][1]}")) for k, (_, i) in enumerate(host)}
    assert {i: got[i] for i in range(len(paths))} == want == {i: f"own {i}" for i in range(len(paths))}
    assert got[50] == "top menu\nown\nbottom" and got[51] == "top menu\nnull\nbottom" and got[52] == got[None] == "own 0" and got[53] == ""
    assert [got[60 + i] for i in range(6)] == [f"flat {i}" for i in range(6)] and got[70] == "kept"
    every = sorted((f"/{p}", str(i)) for i, p in enumerate(paths))
    pairs = op4.neighbours(spark.createDataFrame([("h", p, c, [c]) for p, c in every], "h string, p string, c string, lines array<string>"))
    assert {(r["p"], r["other"][0]) for r in pairs.collect()} == {(p, every[i - 1 if i else 1][1]) for i, (p, _) in enumerate(every)}


def test_empty(spark):
    assert op4.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_articles_are_differenced(spark):
    """Site lines at the ends of articles go; headings, passages, lines in the middle and copies of an article stay."""
    page = lambda i, more: f"<nav>menu {i}</nav><article><h1>Daily</h1><p>Share this</p><p>own {i}, and long enough</p><p>Salt</p>{more}<p>end {i}</p><p>Subscribe now</p></article>"
    rows = [(i, f"http://site/{i}", page(i, "<p>passage</p>" if i in (2, 3) else ""), "") for i in range(6)]
    rows += [(10 + i, f"http://copies/{i}", f"<script>{i}</script><article><h1>T</h1><p>one</p><p>two</p></article>", "") for i in range(4)]
    rows += [(20 + i, f"http://two/{i}", page(i, ""), "") for i in range(2)]
    rows += [(30 + i, f"http://some/{i}", page(i, "") if i < 3 else f"<main><p>other {i}</p></main>", "") for i in range(6)]
    rows += [(40, "http://SITE/0?copy", page(0, ""), "")]
    got = {r["page_id"]: r["text"] for r in op4.extract(spark.createDataFrame(rows, PAGES)).collect()}
    whole = lambda html: "\n".join(x for x, inside in op4.page_lines(html) if inside)
    for i in range(6):
        assert got[i] == "\n".join(["Daily", f"own {i}, and long enough", "Salt", *(["passage"] if i in (2, 3) else []), f"end {i}"])
    assert got[40] == got[0]
    assert all(got[k] == whole(html) for k, _, html, _ in rows if k >= 10 and k < 40)


def test_article_lines_of_a_table_stay(spark):
    """Articles of the test tables hold no site lines, though neighbours repeat passages: all that differencing finds there is refuted."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in op4.extract(pages).collect()}
    assert got == {r["page_id"]: "\n".join(x for x, inside in op4.page_lines(r["html"]) if inside) for r in pages.collect()}


def test_neighbours_across_ranges(spark):
    """A host over several ranges of the order, and hosts that end where a range does, have the neighbours of the whole order."""
    rnd = random.Random(6)
    every = sorted({("one" if rnd.random() < 0.6 else f"h{rnd.randrange(60)}", f"/{rnd.randrange(10**6)}", "c") for _ in range(400)})
    want = {}
    for i, (h, p, _) in enumerate(every):
        near = [every[j][:2] for j in (i - 1, i + 1) if 0 <= j < len(every) and every[j][0] == h]
        want[h, p] = " ".join(near[0]) if near else None
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = op4.neighbours(spark.createDataFrame([(h, p, c, [f"{h} {p}"]) for h, p, c in every], "h string, p string, c string, lines array<string>")).collect()
    finally:
        spark.conf.unset(key)
    assert len(got) == len(every) and {(r["h"], r["p"]): r["other"] and r["other"][0] for r in got} == want
