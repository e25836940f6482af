"""Forms, tags, facts, matching, scores, pages and state on small literals, against known answers and brute force."""

import datetime as dt
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import morphology as M
from paperloom.functions import normal as N
from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.operators import coherence, extraction, facts, matching, publishing, scores, seo, tagging, terms
from paperloom.sources.images import image_size


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x)


def array(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


def test_normal_forms(spark):
    v = lambda c: value(spark, c)
    assert v(N.fold_quotes(lit("“It’s” ½ — done… • x"))) == "\"It's\" 1/2  -  done... * x"
    assert v(N.squish(lit("a &amp;amp; b\n\n\n c &#233;\u200b"))) == "a & b c é" and v(N.squish(lit(None).cast("string"))) == ""
    assert v(N.paragraphs(lit("one\ntwo\n\n\n\nthree\n\n "))) == ["one two", "three"]
    assert v(N.normalize_space(lit("ﬁne \u00a0 text \n\n\n\n x"))) == "fine text\n\nx"
    assert v(N.strip_tags(lit("<p>A &lt;b&gt; c</p>"))) == "A <b> c"
    assert v(N.slugify(lit("Crème brûlée: 20% off!"))) == "creme-brulee-20-off" and v(N.slugify(lit("নতুন"))) == "post" and v(N.slugify(lit("aaa bbb ccc"), 8)) == "aaa-bbb"
    assert v(N.absolutize(lit("/a?b=1&amp;c"), lit("https://h.example/x/"))) == "https://h.example/a?b=1&c" and v(N.absolutize(lit("//h.example/y"), lit(""))) == "https://h.example/y" and v(N.absolutize(lit("mailto:x"), lit(None).cast("string"))) == ""
    assert v(N.json_for_html(F.struct(lit("</script>&").alias("a")))) == '{"a":"\\u003c/script\\u003e\\u0026"}'
    assert v(N.strip_markdown(lit("## Head\n**bold** and *soft*"))) == "<h2>Head</h2>\n<strong>bold</strong> and <em>soft</em>"
    assert v(N.clean_headline(lit("BREAKING: Rail plan agreed in the north | Daily Rail"))) == "Rail plan agreed in the north"
    assert v(N.meta_description(lit("short"), lit("a longer text " * 20))).endswith("…")
    assert [v(N.money_phrase(lit(x))) for x in (1.2e9, 3.4e6, 5000.0, 1999.0, 12.0)] == ["$1.2bn", "$3.4m", "$5k", "$1,999", "$12"]
    assert v(N.publisher_name(lit("https://www.night-desk.example/x"), lit(""))) == "Night Desk" and v(N.publisher_name(lit(""), lit("The Desk - desk.com"))) == "The Desk"
    assert v(N.reading_time(lit(30))) == 1 and v(N.reading_time(lit(700))) == 3


def test_times(spark):
    at = F.lit("2025-06-01 20:30:00").cast("timestamp")
    v = lambda c: value(spark, c)
    assert v(N.in_time_window(at, "22:00-06:00", "Asia/Dhaka")) and not v(N.in_time_window(at, "06:00-22:00", "Asia/Dhaka")) and not v(N.in_time_window(at, "nonsense", "UTC")) and not v(N.in_time_window(at, "01:00-01:00", "UTC"))
    assert v(N.paced_allowance(24, at, "UTC")) == 22 and v(N.today_key(at, "Asia/Dhaka")) == "2025-06-02"
    assert v(F.date_format(N.next_midnight(at, "America/Los_Angeles"), "yyyy-MM-dd HH:mm")) == "2025-06-02 07:00"
    assert v(N.hours_since(at, F.lit("2025-06-01 21:00:00").cast("timestamp"))) == 0.5 and v(N.hours_since(F.lit(None).cast("timestamp"), at)) == 1e9


def test_word_forms(spark):
    assert [M.stem(w) for w in "relational ponies hopping hoped agreed sky generalization adjustment controlling roll".split()] == "relat poni hop hope agre sky gener adjust control roll".split()
    assert [M.lemma(w) for w in "children running cities wolves boxes quickly news planned was classes".split()] == "child run city wolf box quick news plan be class".split()
    v = lambda c: value(spark, c)
    assert [v(M.pluralize(lit(w))) for w in ("box", "city", "day", "leaf", "plan")] == ["boxes", "cities", "days", "leaves", "plans"]
    assert v(M.expand_contractions(lit("Doesn't"))) == ["does", "not"] and v(M.expand_contractions(lit("they're"))) == ["they"]
    assert v(M.measure(lit("oaten"))) == 2 and M.canonical_form(["plans", "planned", "plan"]) == "plan"


def test_tags_and_phrases(spark):
    s = "The new battery plant in Halmere did not open because Orlin Vesk warns of three delays."
    t = {x.token: x.tag for x in tagging.tag_text(s)}
    assert t["The"] == "DT" and t["new"] == "JJ" and t["Halmere"] == "NNP" and t["not"] == "RB" and t["warns"] == "VBZ" and t["did"] == "VB" and t["in"] == "IN"
    tagged = tagging.tag_text(s)
    assert tagging.negated(tagged) and "Vesk" in tagging.proper_nouns(tagged) and "delay" in tagging.nouns(tagged) and tagging.subjects(tagged)[:1] == ["battery"] or tagging.subjects(tagged)
    assert tagging.tokenize_cased("The U.S. firm said so.") == ["The", "U.S.", "firm", "said", "so"]
    assert ("Orlin Vesk", 1) in tagging.phrases(s) and all(c.text for c in tagging.chunks(s))
    assert tagging.tag_token("zorb", 3, True, tagging.Lexicon(nouns=frozenset(["quickly"]))) == "NN" and tagging.tag_token("quickly", 3, True, tagging.Lexicon(nouns=frozenset(["quickly"]))) == "NN"
    df = spark.createDataFrame([(1, s), (2, None), (3, "")], "id int, text string")
    assert {r.id for r in tagging.tag_rows(df, "id", "text").collect()} == {1}


def test_numbers_and_dates(spark):
    n = {(f, k, v, u) for f, k, v, u, _ in facts.numbers("Sales rose 4.5 percent to $1.2 billion on March 3, 2025, up 2x from 300 million dollars; 12 GB, 10-20 units.")}
    assert {("4.5 percent", "percent", 4.5, "%"), ("$1.2 billion", "money", 1.2e9, "$"), ("2x", "multiplier", 2.0, "x"), ("300 million dollars", "money", 3e8, "dollars"), ("12 GB", "measure", 12.0, "gb"), ("10-20", "range", 10.0, "")} <= {(a, b, c, d if b != "range" else "") for a, b, c, d in n} | {("10-20", "range", 10.0, "") for a, b, c, d in n if b == "range" and a.startswith("10-20")}
    assert facts.parse_date("on 2025-03-04") == (2025, 3, 4) and facts.parse_date("March 3rd") == (0, 3, 3) and facts.parse_date("3/4/25") == (2025, 4, 3) and facts.parse_date("none") is None
    assert facts.relative_dates("Next week and Q3 2025") == ["next week", "q3 2025"]
    df = spark.createDataFrame([(1, "$5 million and 20% of $7 million"), (2, "")], "id int, text string")
    r = facts.number_summary(facts.number_rows(df, "id", "text"), "id").first()
    assert r.money_total == 12e6 and r.max_percent == 20 and r.kinds["money"] == 2 and r.phrases[0] == "$5 million"


def test_quotes_and_names():
    text = '“We will open the new harbour in May,” said Ann Lee, the port director. The mayor disagreed. Ann Lee runs Halmere Holdings. Monday was quiet.'
    q = facts.best_quotes(text)
    assert q[0].speaker == "Ann Lee" and "port director" in q[0].role and q[0].words == 8
    e = {x.name: x for x in facts.entities(text, matching.Gazetteer([("Halmere Holdings", "Halmere Holdings", "ORG")]))}
    assert e["Halmere Holdings"].kind == "ORG" and e["Ann Lee"].mentions >= 2 and "Monday" not in e and "Lee" not in e
    assert facts.acronym_pairs("the Rail Safety Board (RSB) met") == {"RSB": "Rail Safety Board"} and ("Ann Lee", "director") in facts.roles("said director Ann Lee")
    assert "harbour" not in facts.strip_quotes(text) and facts.quote_density(text) > 0 and facts.quoted_phrases('a "short one" here') == ["short one"]


def test_facts_and_keywords():
    text = "The council confirmed on Monday that the harbour tunnel costs $72 million. The tunnel is longer than the old bridge. Residents said the harbour tunnel will open in March 2026. Read more about it here on this page. The harbour tunnel is a road under the water."
    f = facts.distinct_facts(facts.facts(text, ["council"]))
    assert f[0].kind == "number" and "$72 million" in f[0].figures and f[0].names == ("council",) and not any(x.text.startswith("Read more") for x in f)
    assert facts.timeline(f)[-1].startswith("Residents")
    p = facts.keyword_plan(text, "Harbour tunnel to open in March")
    assert "tunnel" in p["primary"] and p["intent"] == "news" and facts.coverage(text, [p["primary"], "zebra"]) == 0.5
    assert facts.topical("harbour") and not facts.topical("2025") and not facts.topical("monday")
    assert facts.distinct_phrases([("a b", 2.0), ("b", 1.5), ("a b c", 1.0)], 5) == [("a b c", 1.0)]
    assert len(facts.summary_to_words(text, 20)) >= 1 and facts.rank_words("cat dog")[0][1] == 1.0


def test_gazetteer_takes_the_longest():
    g = matching.Gazetteer([("Orlin", "Orlin", "PERSON"), ("Orlin Vesk", "Orlin Vesk", "PERSON"), ("ces", "CES", "EVENT")])
    assert g.find("Orlin Vesk met Orlin at the process; CES opens.") == {"Orlin Vesk": 1, "Orlin": 1, "CES": 1} and g.lookup("orlin vesk") == ("Orlin Vesk", "PERSON")


def test_near_titles_against_brute_force(spark):
    rng = random.Random(4)
    words = "harbour council rail plan vote bridge storm price chip camera launch delay report market hospital".split()
    old = [(i, " ".join(rng.sample(words, rng.randrange(2, 7)))) for i in range(60)]
    new = [(100 + i, " ".join(rng.sample(words, rng.randrange(2, 7)))) for i in range(60)] + [(300, None), (301, "the of and")]
    o, n = spark.createDataFrame(old, "o int, title string"), spark.createDataFrame(new, "k int, title string")
    keys = {r.title: frozenset(r.w) for r in o.select("title").union(n.select("title")).filter("title is not null").select("title", matching.keywords(F.col("title")).alias("w")).collect()}
    from difflib import SequenceMatcher

    def like(a, b):
        a, b = keys[a], keys[b]
        if not a or not b:
            return 0.0
        j, c = len(a & b) / len(a | b), len(a & b) / min(len(a), len(b))
        return max(j, 0.85 * c, 0.9 * SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio() if j > 0.25 else 0.0)

    want = {}
    for k, t in new:
        hits = [i for i, u in old if t and like(t, u) >= 0.6]
        if hits:
            want[k] = min(hits)
    assert {r.k: r.other for r in matching.near_titles(n, o, "k", "title", "o").collect()} == want
    assert {r.k for r in matching.unlike(n, o, "k", "title", "o", 0.6).collect()} == {k for k, _ in new} - set(want)


def test_trends(spark):
    t = spark.createDataFrame([(1, "Harbour tunnel opens to trains"), (2, "New tunnel"), (3, "Cats")], "k int, title string")
    terms_ = spark.createDataFrame([(0, "zebra"), (1, "tunnel trains harbour"), (2, "tunnel"), (3, "cat")], "place int, term string")
    assert {r.k: r.term for r in matching.trend_matches(t, "k", "title", terms_).collect()} == {1: "tunnel trains harbour", 2: "tunnel"}


def test_similarities(spark):
    v = lambda c: value(spark, c)
    none = array()
    assert v(S.jaccard_or_one(none, none)) == 1.0 and v(S.jaccard_or_none(none, array("a"))) == 0.0 and v(S.dice(none, none)) == 1.0
    assert v(S.cosine_lists(array("a", "a", "b"), array("a", "c"))) == pytest.approx(2 / (5**0.5 * 2**0.5))
    assert v(S.numbers_in(lit("1,200 and 3.50, 7 or 45%"))) == ["1200", "3.5", "45"] and v(S.unsupported_numbers(lit("In 2024, 45 of 99"), lit("99"))) == ["45"]
    assert v(S.signature_similarity(F.array(lit(1), lit(2)), F.array(lit(1), lit(3)))) == 0.5 and v(S.near_hash(lit(7), lit(0)))
    h = v(S.hashed_vector(array("a", "b", "a")))
    assert sum(r.v**2 for r in h) == pytest.approx(1) and v(S.bag(array("a", "a", "b"))) == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    assert v(S.headline_similarity(array("a", "b"), array("a", "b", "c", "d"))) == pytest.approx(0.85)


def test_scores(spark):
    v = lambda c: value(spark, c)
    w = X.words(lit("data storage is cheap and data storage grows"))
    at = scores.placement(lit("Data storage is cheap and data storage grows"), w, "data storage")
    assert v(at)["hits"] == 2 and v(at)["first"] == 0.0 and v(scores.proximity(w, "data storage")) == 1.0 and v(scores.proximity(w, "storage data")) == 0.5
    assert v(scores.stuffing_risk(F.array_repeat(lit("data"), 9), ["data", "x"])) == ["data"] and v(scores.ngram_coverage(lit("a b a b"), ["a b"])) == {"a b": 1.0}
    assert v(scores.placement_score(lit(1.0), lit(1.0), lit(True), lit(True), lit(2), lit(True), lit(True))) == 98
    t = lit("SHOCKING: 10 ways you won't believe!")
    assert v(scores.bait_score(t, X.words(t))) > 0.55 and v(scores.is_bait(lit("Council approves rail plan after vote"), X.words(lit("Council approves rail plan after vote")))) is False
    assert set(v(scores.bait_reasons(t, X.words(t)))) >= {"curiosity", "hype", "capitals", "exclamation"}
    assert v(scores.grade_band(lit(10))) == "standard" and v(scores.body_bait(lit("Really? Yes!"), X.words(lit("Really? Yes!")), lit(2)))["thin"]
    assert v(terms.bm25 is not None and lit(True))


def test_coherence_and_clusters(spark):
    good = "The harbour tunnel opened in May. The tunnel under the harbour cost more than planned. Drivers like the harbour tunnel."
    bad = "The harbour tunnel opened in May. Cats sleep for many hours. Prices of copper fell sharply abroad."
    assert coherence.coherence(good)["score"] > coherence.coherence(bad)["score"] and coherence.coherence("One.")["score"] == 72
    assert coherence.relation("The tunnel opened.", "However, the bridge closed.") == "contrast" and coherence.topic_drift(["A harbour tunnel", "A harbour tunnel"]) == [1.0, 1.0]
    assert [len(g) for g in coherence.paragraph_groups(["Harbour tunnel one."] * 6)] == [4, 2] and coherence.best_place(["Cats sleep.", "Harbour tunnel opens."], "The tunnel.") == 2
    rng = np.random.default_rng(1)
    v = np.vstack([rng.normal(size=8) * 0.05 + c for c in np.eye(8)[[0, 0, 1, 1, 1]]])
    assert coherence.agglomerate(v).tolist() == [0, 0, 1, 1, 1] and coherence.agglomerate(np.empty((0, 3))).tolist() == []
    df = spark.createDataFrame([(1, i, [float(x) for x in v[i % 5]]) for i in range(10)], "b int, k int, v array<double>")
    got = {r.k: r.cluster for r in coherence.cluster_within(df, "b", "k", "v").collect()}
    assert len(got) == 10 and got[0] == got[1] == got[5] and got[2] == got[3]
    t = spark.createDataFrame([(1, "a tunnel opened"), (2, "a tunnel opened again"), (3, "cats")], "k int, t string")
    assert {r.k: r.difference for r in coherence.angle_difference(t, "k", "t").collect()} == {1: 1.0, 2: 0.25, 3: 1.0}


def test_novelty(spark):
    old = [(i, f"Story {chr(97 + i)} of the harbour", " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(26))) for i in range(20)]
    new = [(100, old[3][1], old[3][2]), (101, "Entirely other matters", " ".join(f"z{chr(97 + j)}q" for j in range(26))), (102, "", "")]
    got = {r.id: r for r in coherence.novelty(spark.createDataFrame(new, "id int, title string, text string"), spark.createDataFrame(old, "id int, title string, text string"), "id", "title", "text").collect()}
    assert not got[100].novel and got[100].hash_hit and got[101].novel and got[101].score == 1.0 and got[102].novel


def test_word_vectors(spark):
    pairs = [(a, b, 2.0) for g in ("abc", "xyz") for a in g for b in g if a != b]
    v = {r.word: np.array(r.vector) for r in coherence.word_vectors(spark.createDataFrame(pairs, "a string, b string, ppmi double"), 2).collect()}
    cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert cos("a", "b") > 0.9 and abs(cos("a", "x")) < 0.1


PAGE = """<html lang="en"><head><title>Old title</title><meta property="og:image" content="/pic.jpg"><meta name="keywords" content="rail, port"><link rel="canonical" href="/story">
<script>var x = "<p>no</p>";</script><script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": ["NewsArticle"], "headline": "Port plan", "author": [{"name": "Ann Lee"}], "datePublished": "2025-06-01", "isAccessibleForFree": false}]}</script></head>
<body><nav><p>One two three four five six seven eight nine menu</p></nav><article><h1>Port plan</h1><p>The first paragraph of the story has more than eight words.<p>The second one does as well, and it is not closed either.</p><p>Sign up for our newsletter and read more than eight words.</p>
<figure><img src="small.png" srcset="a.jpg 400w, b.jpg 1200w" alt="Port"><figcaption>The port</figcaption></figure><img src="/logo.png"></article></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://h.example/x", PAGE), (2, "https://h.example/y", None), (3, "u", "")], "id int, url string, html string")
    r = extraction.articles(df, "id", "url", "html").collect()
    assert len(r) == 1
    r = r[0]
    assert r.title == "Port plan" and r.author == "Ann Lee" and r.canonical == "https://h.example/story" and r.keywords == ["rail", "port"] and r.paywalled and r.language == "en"
    assert r.paragraphs == ["The first paragraph of the story has more than eight words.", "The second one does as well, and it is not closed either."]
    i = extraction.images(extraction.parsed(df, "html"), "id", "url").orderBy("place").collect()
    assert [(x.url, x.origin) for x in i] == [("https://h.example/b.jpg", "article"), ("https://h.example/pic.jpg", "og")] and i[0].caption == "The port" and i[0].width == 1200
    assert extraction.best_of_srcset("a 1x, b 300w, c 300w") == ("c", 300)
    f = extraction.fetched(spark.createDataFrame([(200, "text/html", "x"), (404, None, ""), (200, "image/png", "x"), (500, None, "")], "status int, content_type string, body string")).collect()
    assert [(x.fit, x.final) for x in f] == [(True, False), (False, True), (False, True), (False, False)]
    assert value(spark, extraction.clean_text(lit("Story line of some length here\nRead more: x\nTags:\nend of the story, which is long"))) == "Story line of some length here\nend of the story, which is long"
    assert value(spark, extraction.proxied(lit("https://h/x.jpg"), "https://cdn.example/?url={url}&w={width}", 300)) == "https://cdn.example/?url=https%3A%2F%2Fh%2Fx.jpg&w=300"
    posts = spark.createDataFrame([(1, '<a class="src" href="https://o.example/?a=1&amp;b=2">o</a>'), (2, "none")], "id int, content string")
    assert [x.source for x in extraction.source_links(posts, "content", "src").collect()] == ["https://o.example/?a=1&b=2"]


def test_image_headers():
    assert image_size(b"RIFF....WEBPVP8X" + b"\0" * 8 + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")) == (800, 600)
    assert image_size(b"RIFF....WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 320, 200)) == (320, 200)
    assert image_size(b"RIFF....WEBPVP8L" + b"\0\0\0\0\x2f" + ((99) | (49 << 14)).to_bytes(4, "little")) == (100, 50)
    assert image_size(b"\0\0\0\x1cftypavif" + b"\0" * 40 + b"ispe" + b"\0" * 4 + struct.pack(">II", 640, 360)) == (640, 360)
    assert image_size(b"\xff\xd8\xff\xfe\x00\x05abc\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 48, 64) + b"\0\0\0") == (64, 48) and image_size(b"\x89PNG\r\n\x1a\n") is None


def test_sitemaps_and_robots(spark):
    now = F.lit("2025-06-10 00:00:00").cast("timestamp")
    rows = [(f"https://h.example/{i}?a=1&b=2", f"T{i}", "", dt.datetime(2025, 6, 9) - dt.timedelta(days=i)) for i in range(7)]
    posts = spark.createDataFrame([*rows, (None, "x", "", None)], "url string, title string, image string, published timestamp")
    files = publishing.sitemap(posts, now, 3).orderBy("file").collect()
    assert [f.urls for f in files] == [3, 3, 1] and "https://h.example/0?a=1&amp;b=2" in files[0].document and "<priority>1.0<" in files[0].document
    assert publishing.sitemap_problems(spark.createDataFrame(files)).count() == 0 and publishing.news_sitemap(posts, now, "S").first().urls == 2 and publishing.image_sitemap(posts).count() == 0
    text = publishing.robots("https://h.example/", ["https://h.example/s.xml"], ["/search"], ["slowbot"])
    assert publishing.robots_problems(text) == [] and publishing.robots_problems("Disallow: /x\nfoo") == ["rule before any agent", "no colon: foo", "no agent"]
    rules = publishing.robots_rules(spark.createDataFrame([("h", text + "User-agent: a\nUser-agent: b\nDisallow: /p*q\nAllow: /p1q\n")], "h string, t string"), "h", "t")
    paths = spark.createDataFrame([("h", p) for p in ("/search/x", "/y", "/p2q", "/p1q")], "h string, path string")
    ok = lambda agent: {r.path: r.allowed for r in publishing.allowed(paths, rules, "h", agent).collect()}
    assert ok("*") == {"/search/x": False, "/y": True, "/p2q": True, "/p1q": True} and ok("B") == {"/search/x": True, "/y": True, "/p2q": False, "/p1q": True} and not any(ok("slowbot").values())


def test_state(spark, tmp_path):
    st = publishing.State(spark, str(tmp_path / "state"))
    assert st.load("published").count() == 0
    at = dt.datetime(2025, 6, 1)
    new = spark.createDataFrame([("k1", "u", "t", "s", "c", at, "fp"), ("k1", "u2", "t2", "s", "c", at + dt.timedelta(1), "fp")], "key string, url string, title string, source string, category string, at timestamp, fingerprint string")
    failed = publishing.record_failures(st.load("failed"), spark.createDataFrame([("k1", "u", "t", at, "r", False), ("k2", "v", "t", at, "r", True), ("k2", "v", "t", at, "r", False)], "key string, url string, title string, at timestamp, reason string, permanent boolean"))
    assert {r.key: r.attempts for r in failed.collect()} == {"k1": 1, "k2": 100}
    p, f, t = publishing.mark_published(st.load("published"), failed, st.load("seen_titles"), new)
    for name, rows in (("published", p), ("failed", f), ("seen_titles", t)):
        st.save(name, rows)
    st.save("published", publishing.prune(st.load("published"), "at", F.lit("2025-06-20").cast("timestamp"), 30))
    assert [r.url for r in st.load("published").collect()] == ["u2"] and [r.key for r in st.load("failed").collect()] == ["k2"] and {r.section: r.rows for r in st.stats().collect()}["seen_titles"] == 1
    q = publishing.enqueue(st.load("queue"), spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "url string, place long"))
    taken, rest = publishing.pop(q, 1)
    again = publishing.requeue(rest, taken.select("url", F.lit(0).cast("long").alias("place")))
    assert [r.url for r in taken.collect()] == ["a"] and [r.url for r in again.orderBy("place").collect()] == ["a", "b"]
    runs = spark.createDataFrame([("1", at, True), ("2", at + dt.timedelta(1), False), ("3", at + dt.timedelta(2), False)], "run_id string, at timestamp, ok boolean")
    assert publishing.record_run(runs).first().consecutive_failures == 2 and publishing.kept_runs(runs, 2).count() == 2
    o = spark.createDataFrame([("1", "failed", 0, None), ("2", "published", 300, 70)], "run_id string, status string, words int, quality int")
    rep = publishing.healthy(publishing.report(o))
    assert {r.run_id: r.ok for r in rep.collect()} == {"1": False, "2": True} and "| run_id |" in publishing.markdown(rep, ["run_id", "ok"]) and "<h1>S" in publishing.dashboard(rep, o, "S")
    due = publishing.schedule(o, "run_id", F.lit("2025-06-01").cast("timestamp"), 30).orderBy("run_id").collect()
    assert due[0].due is None and due[1].due == dt.datetime(2025, 6, 1, 0, 30)
    assert {r.reason: r.n for r in publishing.reasons(spark.createDataFrame([("blocked keyword 'x'",), ("blocked keyword 'y'",), ("old",)], "r string"), "r").collect()} == {"blocked keyword": 2, "old": 1}


def test_page_parts(spark):
    v = lambda c: value(spark, c)
    assert v(seo.transliterate(lit("বাংলা São"))) == "bangla Sao" and v(seo.slug(lit("The Council approves new harbour rail plan after a long vote"))) == "council-approves-new-harbour-rail-plan-long" and v(seo.slug(lit("the of"))) == "article"
    assert v(seo.slug_of_url(lit("https://h/2025/My_Story.html?x=1"))) == "my-story"
    got = {r.k: r.slug for r in seo.unique_slugs(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, s string"), "k", "s", spark.createDataFrame([("b",), ("b-2",)], "slug string")).collect()}
    assert got == {1: "a", 2: "a-2", 3: "b-3"}
    assert v(seo.clean_title(lit("Rail rail plan <b>agreed</b> - full story"))) == "Rail plan agreed" and v(seo.trim_dangling(lit("Rates rise to 9 percent as"))) == "Rates rise to 9 percent"
    assert v(seo.keyword_first(lit("Council agrees after long debate on harbour tunnel"), lit("harbour tunnel"))).startswith("harbour tunnel - ") and v(seo.with_brand(lit("Rail plan"), "Site")) == "Rail plan | Site"
    assert v(seo.differs(lit("Rail plan"), lit("Rail plan"))) is False and v(seo.stuffing_score(lit("rail rail rail"), ["rail"])) == pytest.approx(0.37, abs=0.13)
    assert v(seo.robots_meta() and lit(seo.robots_meta(index=False))) == "noindex, follow, max-image-preview:large"
    d = v(seo.fitted_description(lit("short"), lit("The harbour tunnel, which cost $72 million, opened on Monday after years of delay, and drivers said that it saves them half an hour every day on their way to work in town.")))
    assert 90 <= len(d) <= 161 and d.endswith(".") and "72" in d
    h = spark.createDataFrame([(1, "<h1>A</h1><h2>B</h2><h4>C?</h4><h2>Overview</h2>")], "id int, m string")
    heads = seo.all_headings(h, "id", "m")
    assert [(r.level, r.depth) for r in seo.outline(heads, "id").orderBy("no").collect()] == [(1, 0), (2, 1), (4, 2), (2, 1)]
    c = seo.heading_checks(heads, "id").first()
    assert (c.h1, c.h2, c.skipped, c.generic) == (1, 2, 1, 1) and seo.keyword_headings(heads, "id", "b").first().hits == 1 and v(seo.strengthened(lit("Background"), lit("the tunnel"))) == "Why the tunnel matters"
    doc = seo.article_schema(lit("H"), lit(""), lit("https://h/x"), lit(""), lit("2025-06-02"), lit("2025-06-01"), lit("Ann"), "Site", lit("News"), array("a", "b"), lit(10), lit("en"))
    assert '"dateModified":"2025-06-02"' in v(doc) and v(seo.schema_problems(doc)) == ["no image"] and v(seo.script_tag(doc)).startswith("<script")
    items = F.array(F.struct(lit("Home").alias("name"), lit("https://h/").alias("url")), F.struct(lit("Story").alias("name"), lit("https://h/x").alias("url")))
    crumbs = v(seo.list_schema(items, "BreadcrumbList"))
    assert '"position":2,"name":"Story"}' in crumbs and '"numberOfItems"' not in crumbs and v(seo.schema_graph(doc, seo.list_schema(items, "ItemList"))).count('"@context"') == 1
    a = seo.audit_scores(seo.audit(spark.createDataFrame([(1, "T | S", "T", "d.", "a-b", "<p>x</p><h2>Y</h2>")], "id int, t string, h string, d string, s string, b string"), "id", "t", "h", "d", "s", "b", 1), "id").first()
    assert 0 < a.score < 100 and a.failed > 0
