"""Operators on small literals, against known answers and brute force."""

import itertools
import random

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions import urls as U
from paperloom.operators import hashing, prose, series, stories, vectors
from paperloom.sources.feeds import FeedSource, parse_feed
from paperloom.sources.images import image_size

FEED = """<rss><channel>
<item><title>Harbour &amp;amp; rail plan agreed</title><link>https://a.example/1?utm_source=x</link><pubDate>Mon, 02 Jun 2025 10:00:00 GMT</pubDate><description>&lt;p&gt;Two &lt;b&gt;lines&lt;/b&gt;&lt;/p&gt;</description><category>Rail</category></item>
<item><title>No link here</title></item>
<item><title>Second story of the day</title><link>https://a.example/2</link></item></channel></rss>"""


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_canonical_urls(spark):
    page = lambda u: value(spark, U.canonical_url(F.lit(u).cast("string")))
    same = ["HTTP://WWW.Harbour.example:80//plans//rail/?gclid=7&stage=2&area=n&utm_campaign=june", "https://harbour.example/plans/rail/amp.html?area=n&stage=2#maps", " https://harbour.example/plans/rail?stage=2&area=n "]
    assert {page(u) for u in same} == {"https://harbour.example/plans/rail?area=n&stage=2"}
    assert page("https://harbour.example") == page("https://harbour.example/?fbclid=z") == "https://harbour.example/"
    assert page(None) is None


def test_text_columns(spark):
    v = lambda c: value(spark, c)
    assert v(X.words(F.lit("Pump-2 won't take 7.5% of $3,400m"))) == ["pump-", "2", "won't", "take", "7.5%", "of", "$3,400m"]
    assert v(X.words(F.lit(None).cast("string"))) == []
    assert v(X.escape_html(F.lit("Tide & <i>'rail'</i> \"plans\""))).startswith("Tide &amp; &lt;i&gt;") and "<" not in v(X.escape_html(F.lit("<<")))
    assert v(X.truncate(F.lit("harbour rail plan agreed"), 14)) == "harbour rail…" and v(X.truncate(F.lit("rail"), 14)) == "rail"
    assert [v(X.syllables(F.lit(w))) for w in ("wanted", "walked", "table", "idea", "make", "the")] == [2, 1, 2, 2, 1, 1]
    assert v(X.looks_english(F.lit("Новости дня"))) is False


def test_edit_distances_against_brute_force(spark):
    from paperloom.functions import similarity as S

    rng = random.Random(11)
    pairs = [("".join(rng.choices("abéж", k=rng.randrange(8))), "".join(rng.choices("abéж", k=rng.randrange(8)))) for _ in range(80)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(old, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y)))
        return new

    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", F.levenshtein("a", "b").alias("d"), S.edit_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        d = distance(r.a, r.b)
        assert r.d == d and abs(r.s - (1 - d / max(len(r.a), len(r.b)) if r.a or r.b else 1.0)) < 1e-9


def test_feed_source(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    (tmp_path / "bad.xml").write_text("<rss")
    assert [r[1] for r in parse_feed(FEED)] == ["Harbour & rail plan agreed", "Second story of the day"]
    spark.dataSource.register(FeedSource)
    places = f"good\t{tmp_path}/f.xml\nbad\t{tmp_path}/bad.xml\nnone\t{tmp_path}/none.xml"
    rows = spark.read.format("feeds").option("places", places).load().collect()
    assert sorted((r.feed, r.ordinal, r.error is None) for r in rows) == [("bad", 0, False), ("good", 1, True), ("good", 2, True), ("none", 0, False)]
    assert next(r for r in rows if r.ordinal == 1).summary == "Two lines"


def test_image_sizes():
    assert image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (1600).to_bytes(4, "big") + (900).to_bytes(4, "big")) == (1600, 900)
    assert image_size(b"GIF89a" + (640).to_bytes(2, "little") + (480).to_bytes(2, "little") + b"\0") == (640, 480)
    assert image_size(b"\xff\xd8\xff\xe0\x00\x04\0\0\xff\xc0\x00\x11\x08" + (720).to_bytes(2, "big") + (1280).to_bytes(2, "big") + b"\0" * 9) == (1280, 720)
    assert image_size(b"not an image at all") is None and image_size(None) is None


def test_leader_clusters_in_order(spark):
    rows = [(1, "a", ["rail", "plan", "harbour", "agreed"]), (2, "a", ["harbour", "plan", "agreed", "rail", "vote"]), (3, "a", ["cat", "show"]), (4, "b", ["rail", "plan", "harbour", "agreed"]), (5, "a", None), (6, "a", [])]
    df = spark.createDataFrame(rows, "id long, block string, words array<string>")
    got = dict(stories.leader_clusters(df, "block", "id", "words", "id").collect())
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_capped_top_is_greedy(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice("xyz"), float(rng.randrange(100))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, host string, category string, score double")
    got = [r.id for r in stories.capped_top(df, [F.col("score").desc(), F.col("id")], {"host": 4, "category": 5}, 9).orderBy("place").collect()]
    want, used = [], {}
    for i, h, c, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(want) < 9 and used.get(h, 0) < 4 and used.get(c, 0) < 5:
            want.append(i)
            used[h], used[c] = used.get(h, 0) + 1, used.get(c, 0) + 1
    assert got == want


def test_near_documents_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.sample(range(10_000), 60) for _ in range(12)]
    sets = {i: list(b) for i, b in enumerate(base)}
    for i in range(12, 40):
        src = sets[rng.randrange(len(sets))]
        sets[i] = src[: rng.choice([60, 58, 55, 40])] + rng.sample(range(20_000, 30_000), rng.choice([0, 0, 2, 5]))
    df = spark.createDataFrame([(k, v) for k, v in sets.items()], "id long, shingles array<long>").cache()
    each = df.select("id", F.explode("shingles").alias("shingle"))
    got = {r.id: r.class_id for r in hashing.near_duplicates(hashing.minhash(each, "id"), df, "id").collect()}
    label = {k: k for k in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = set(sets[a]), set(sets[b])
        if len(x & y) >= 0.8 * len(x | y):
            la, lb = label[a], label[b]
            for k in label:
                if label[k] in (la, lb):
                    label[k] = min(la, lb)
    classes = [k for k in label.values()]
    want = {k: v for k, v in label.items() if classes.count(v) > 1}
    assert got == want


def test_near_documents_along_a_chain(spark):
    df = spark.createDataFrame([(k, list(range(4 * k, 4 * k + 100))) for k in range(41)], "id long, shingles array<long>").cache()
    each = df.select("id", F.explode("shingles").alias("shingle"))
    assert dict(hashing.near_duplicates(hashing.minhash(each, "id"), df, "id").select("id", "class_id").collect()) == dict.fromkeys(range(41), 0)


def test_capped_top_past_filled_categories(spark):
    rows = [(i, "a", "x", 1000.0 - i) for i in range(100)] + [(200, "b", "x", 2000.0), (201, "a", "y", 1.0)]
    df = spark.createDataFrame(rows, "id long, host string, category string, score double")
    assert [r.id for r in stories.capped_top(df, [F.col("score").desc()], {"host": 2, "category": 1}, 9).orderBy("place").collect()] == [200, 201]


def test_bursts_are_of_users(spark, tmp_path):
    from paperloom.plans.series import q_bursts

    rows = [(i, f"2025-01-01 {i:02d}:00:00", 1 + i % 3, "click") for i in range(20)] + [(100 + i, f"2025-01-01 23:5{i}:00", 7, "view") for i in range(6)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = q_bursts(spark, str(tmp_path)).collect()
    last = [r for r in rows if r[1] >= "2025-01-01 20:55:00"]
    assert {r.term: r.recent for r in got} == {u: sum(r[2] == u for r in last) for u in {r[2] for r in last} if sum(r[2] == u for r in last) >= 2}


def test_nearest_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(500, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query, r["rank"]): r.neighbour for r in vectors.nearest(df, df.filter("id % 20 = 0"), "id", "v", 3).collect()}

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for q, v in rows:
        if q % 20 == 0 and q != 500:
            best = sorted((i for i, _ in rows if i != q), key=lambda i: (-cos(v, dict(rows)[i]), i))[:3]
            assert [got[q, k] for k in (1, 2, 3)] == best


def test_series_folds(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 4.0, 8.0, 16.0]), ("b", [3.0])], "term string, values array<double>")
    got = {r.term: r for r in df.select("term", series.z_score(F.col("values")).alias("z"), series.velocity(F.col("values")).alias("v"), series.acceleration(F.col("values")).alias("a"), series.smoothed(F.col("values")).alias("s")).collect()}
    assert abs(got["a"].z - (16 - 3.75) / (sum((x - 3.75) ** 2 for x in (1, 2, 4, 8)) / 4) ** 0.5) < 1e-9
    assert abs(got["a"].v - ((2 + 8 + 32 + 128) / 15 - 7.5)) < 1e-9 and got["a"].a == 4.0
    assert got["b"].z == got["b"].v == got["b"].a == 0.0 and got["b"].s == [3.0]
    want = [1.0]
    for x in (2.0, 4.0, 8.0, 16.0):
        want.append(0.35 * x + 0.65 * want[-1])
    assert all(abs(x - y) < 1e-9 for x, y in zip(got["a"].s, want))


def test_prose():
    assert prose.split_sentences("Dr. Ann Lee met J. Roe at 3.5 p.m. in Bath. “Fine,” she said. It rained all day.") == ["Dr. Ann Lee met J. Roe at 3.5 p.m. in Bath.", "“Fine,” she said.", "It rained all day."]
    assert prose.quotes("“We did not see it coming,” said Ann Lee, who left.")[0][1:3] == ("We did not see it coming", "Ann Lee")
    assert prose.sentiment("It was not good.")[0] < 0 < prose.sentiment("It was good.")[0]
    assert prose.stem("relations") == prose.stem("relation") and prose.stem("ponies") == prose.stem("pony")
    assert len(prose.summary("One rail plan passed today. The rail plan cost much. Cats slept well at home. The plan for rail was cheap.", 2)) == 2
    assert prose.summary("") == [] and prose.split_sentences(None) == []


def test_the_core_needs_no_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "paperloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "paperloom.llm" in p.read_text()]
