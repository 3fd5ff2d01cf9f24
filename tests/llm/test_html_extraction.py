import random

from veriscribe.llm import html_extraction as h


def page(i, body):
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home {i}</a><li>About</ul></nav><!-- <p>gone</p> --><div class="ad">Buy {i}</div>{body}
    <footer>&copy; me</footer></body></html>"""


def alone(html):
    return h.main_text(h.tree_of(html), None)


def test_blocks_and_references():
    body = """<article><h1>A &amp; B&#233;</h1><p><b>One
      <i>two</i>&nbsp;three.<br><p>Four &lt;x&gt; &amp five<div class="share-bar">tweet</div><ul><li>x<li>y</ul>
      <table><tr><td>1<td>2</table><form>name <input></form><aside>side</aside><section class="comments"><p>me too</section></article>"""
    assert alone(page(1, body)) == "A & Bé\nOne two three.\nFour <x> & five\nx\ny\n1\n2"


def test_odd_pages():
    assert alone(None) == alone("") == alone("<p></p><!-- x") == ""
    assert alone("plain < text &") == "plain < text &"
    assert alone("<p>a</b></div>b<p class='x>c") == "ab<p class='x>c"
    assert alone("<div>" * 900 + "deep" + "</div>" * 900) == "deep"
    assert alone("<article>" + "<p>word " * 20_000).count("\n") == 19_999
    assert alone("<div>" + "<ul><li>a<li>b</ul><p>c" * 5_000).count("\n") == 14_999


def test_template_of_a_host_is_left_out(spark):
    body = "<div><div>Our site, since 1999</div><div><p>Story {0} begins here.</p><p>It goes on {0}.</p></div><div>Call us any time</div></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{body.format(i)}</body></html>", "x") for i in range(9)]
    rows += [(20, "http://other.example/", rows[0][2], "x"), (21, None, None, None), (21, None, None, None), (None, "http://h.example/z", rows[1][2].replace("Story", "Tale"), "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for broadcast in (h.BROADCAST, 0):  # wrappers sent, and joined
        got = h.extract(frame, broadcast=broadcast).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.url and r.page_id is not None:  # the other host has one page, and the layout of this one
                assert r.text == f"Story {r.page_id % 20} begins here.\nIt goes on {r.page_id % 20}."
            elif r.page_id is None:
                assert r.text == "Tale 1 begins here.\nIt goes on 1."
            else:
                assert r.text == ""
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_slot_is_induced_without_names_or_marks(spark):
    """Short articles between longer, varying boxes: single pages mislead, their host does not. Two layouts at one host."""

    def words(seed, n):
        return " ".join(f"w{(seed * 7919 + k * 104729) % 9973}" for k in range(n))

    rows, want = [], {}
    for i in range(40):
        long = 60 if i % 4 else 4  # one page in four has a short article
        text = f"{words(i, 5)}\n{words(i + 100, long)}"
        first, second = text.split("\n")
        boxes = f"<ul><li><a href=/>{words(i + 200, 9)}</a></ul>", f"<div>{words(i + 300, 12)}</div>", f"<table><tr><td>{words(i + 400, 8)}</table>"
        if i % 5 < 4:
            html = f"<body>{boxes[0]}{boxes[1]}<section><h2>{first}</h2><p>{second}</p></section>{boxes[2]}</body>"
        else:  # the other layout
            html = f"<body><div><p>{words(i + 500, 7)}</p></div><center>{boxes[0]}<div><h3>{first}</h3><p>{second}</p></div></center></body>"
        rows.append((i, "http://two.example/", html))
        want[i] = text
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    single = {i: alone(html) for i, _, html in rows}
    assert sum(single[i] != want[i] for i in want) >= 5  # short ones lose against the boxes when nothing is induced


def test_copies_do_not_erase_each_other(spark):
    rows = [(i, "http://c.example/", "<html><body><div>Same words</div><p>Same story.</p></body></html>") for i in range(5)]
    assert {r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same words\nSame story."}


def random_tree(rng, depth=0):
    out = h.Part(rng.choice("abc"), False)
    if depth < 3:
        out.children = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return out


def plain_score(a, b):
    """The same by trying all: a child of a is left out, one of b is, or both are matched."""
    if a.label != b.label:
        return 0

    def go(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        n = plain_score(a.children[i], b.children[j])
        return max(go(i + 1, j), go(i, j + 1), n + go(i + 1, j + 1) if n else 0)

    return 1 + go(0, 0)


def test_tree_matching_equals_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        a, b = random_tree(rng), random_tree(rng)
        n = plain_score(a, b)
        pairs = list(h.aligned(a, b))
        assert h.score(a, b) == n == len(pairs) and all(x.label == y.label for x, y in pairs)
