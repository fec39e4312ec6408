import random
import re

from cubeloom.llm import html_extraction as H


def stream(tokens):
    return "".join(t + "\n" for t in tokens)


def plain(elements):
    """Every way to write a form without its marks: one to three rounds of each repeated group."""
    return [t for g, r, _ in elements for _ in range(2 if r else 1) for t in g]


def test_wrapper_accepts_every_page():
    """The wrapper, as a regular expression, matches the streams it was inferred from, folded or not."""
    rnd = random.Random(7)
    for _ in range(300):
        letters = "abc"[: rnd.randrange(1, 4)]
        pages = []
        for _ in range(rnd.randrange(1, 6)):
            page = []
            for _ in range(rnd.randrange(4)):
                page += [rnd.choice(letters) for _ in range(rnd.randrange(1, 4))] * rnd.choice([1, 1, 2, 3])
            pages.append(page)
        wrapper = H.infer_wrapper([H.fold(p) for p in pages])
        pattern = re.compile(H.wrapper_pattern(wrapper))
        for p in pages:
            assert pattern.fullmatch(stream(p)), (pages, wrapper)
            assert re.fullmatch(H.wrapper_pattern(H.fold(p)), stream(p))
    assert H.fold(list("abababc")) == [(("a", "b"), True, False), (("c",), False, False)]
    assert H.infer_wrapper([H.fold(list("abbc")), H.fold(list("ac"))]) == [(("a",), False, False), (("b",), True, True), (("c",), False, False)]


def extract(spark, rows):
    df = spark.createDataFrame([(k, u, h, "x") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string").repartition(3)
    return [r.text for r in H.extract_main_text(df).orderBy("page_id").collect()]


def test_alignment_and_templates_decide(spark):
    """Without listed tags or classes: a notice and a footer that pages share, a menu that only other pages repeat."""
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice(["rain", "sun", "wind", "snow", "sea", "hill"]) + str(rnd.randrange(99)) for _ in range(n))
    bodies = [say(30) for _ in range(6)]
    notice, foot = "<div class='x1'>We keep small files.</div>", "<div>All rights kept</div>"
    link = "<div><a href='/a'>Rain %d</a></div>"
    rows = [("http://a.com/1", f"<body>{link % k * (1 if k == 0 else 3)}{notice if k % 2 == 0 else ''}<div>{t}</div><div>{say(4)} end</div>{foot}</body>") for k, t in enumerate(bodies)]
    got = extract(spark, rows)
    assert all(g.startswith(b) and g.endswith(" end") and "files" not in g and "rights" not in g and "Rain" not in g for g, b in zip(got, bodies, strict=True))
    # alone, the first page has neither a repeated link nor a repeated text
    alone = extract(spark, rows[:1])[0]
    assert "Rain 0" in alone and "small files" in alone and "rights" in alone


def test_copies_articles_and_odd_pages(spark):
    """Copies are one page, near copies keep what they share, an article keeps what is constant in it."""
    page = "<body><div>%s</div><div>Second one.</div></body>"
    copies = [("http://b.com/", page % "The same text on every page of this host")] * 9
    near = [("http://c.com/", f"<body><div>Long shared part of near copies, much longer than the rest</div><p>{k}</p></body>") for k in range(8)]
    art = [("http://d.com/", f"<body><nav>m</nav><article><p>Constant</p><p>{k}</p></article><div>out {k}</div></body>") for k in range(6)]
    long = ("http://e.com/", "<body>" + "".join(f"<p>word{k}</p>" for k in range(20_000)) + "</body>")
    odd = [(None, None), ("", ""), ("x", "plain &lt;text"), ("http://e.com/2", "<div><a>only link</a></div>"), long, ("http://e.com/3", "<div><p>a<p>b")]
    got = extract(spark, copies + near + art + odd)
    assert got[:9] == ["The same text on every page of this host Second one."] * 9
    assert got[9:17] == [f"Long shared part of near copies, much longer than the rest {k}" for k in range(8)]
    assert got[17:23] == [f"Constant {k}" for k in range(6)]
    assert got[23:27] == ["", "", "plain <text", "only link"] and got[27].count("word") == 20_000 and got[28] == "a b"
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
