"""Headlines, outline, rewriting, style and drafts, against known answers and what must hold of every draft."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import composition as C
from paperloom.operators import facts as E

TEXT = """The council confirmed on Monday that the harbour tunnel costs $72 million. The tunnel is 40 percent longer than the old bridge because the river is wide. Drivers will save half an hour a day when the harbour tunnel opens in March 2026.
“We have waited nine years for this harbour tunnel to be built,” said Ann Lee, the port director. Work began after a storm broke the old bridge in 2017. The harbour tunnel has 12 pumps and 300 lamps, which is more than any road in the county. The council plans to close the old bridge next year. Residents of the old town said that they expect less noise."""


def test_headlines():
    t = "Council agrees on harbour tunnel after nine years of debate, residents of old town doubtful"
    assert C.shorten(t)[0] == "Council agrees on harbour tunnel after nine years of debate" and len(C.shorten(t)) <= 3 and all(30 <= len(c) <= 62 and c in t for c in C.shorten(t)) and C.shorten("Short") == []
    h = C.headline_choices(t, "harbour tunnel", ("Ann Lee",), ("$72 million",))
    assert h[0] == ("source", t) and ("name", "Ann Lee: " + C.shorten(t, keyword="harbour tunnel")[0]) in h and len({x.lower() for _, x in h}) == len(h)
    assert C.headline_score("Harbour tunnel to open in March after nine years", "harbour tunnel") > C.headline_score("SHOCKING TUNNEL!", "harbour tunnel") and 0 <= C.headline_score("") <= 1
    assert C.headline_score(t, published=(t,)) < C.headline_score(t) and len(C.best_headline("word " * 40)) <= 70 and C.best_headline("") == ""


def test_outline_and_budgets():
    found = E.distinct_facts(E.facts(TEXT))
    s = C.outline(found, E.best_quotes(TEXT), "harbour tunnel", 600)
    assert sum(x.words for x in s) == 600 and [x.kind for x in s] == [x.kind for x in C.in_order(s[::-1])] and sorted(i for x in s for i in x.facts) == list(range(len(found)))
    assert C.word_budgets([], 100) == [] and [x.words for x in C.word_budgets([C.Section("a", "", 1), C.Section("b", "", 2)], 100)] == [33, 67]


def test_lead_and_paragraphs():
    found = E.distinct_facts(E.facts(TEXT))
    first = C.lead(found, "Other")
    assert 0 < len(first.split()) <= 60 and C.lead([]) == "" and C.dek(found, first) not in first
    p = C.paragraphs_of(["a b c."] * 7, 9)
    assert p == ["a b c. a b c. a b c."] * 2 + ["a b c."] and all(len(x.split()) <= 12 for x in C.split_long([" ".join(["One two three four."] * 6)], 12))
    assert len(C.split_long(["word " * 100])) == 1
    assert all(re.match(r"[$\d]", b) for b in C.key_numbers(found)) and len(C.takeaways(found, first)) <= 4 and any("longer than" in x for x in C.comparisons(found))
    assert ("tunnel costs", "$72 million") in C.measures(TEXT)


def test_questions():
    q = C.questions(TEXT + " Who pays for all of that?", "harbour tunnel")
    assert q[0] == "Who pays for all of that?" and "How much does harbour tunnel cost?" in q
    assert "$72 million" in C.answer("How much does harbour tunnel cost?", [TEXT.split(". ")[0] + ".", "Cats sleep."]) and C.answer("What of zebras?", ["Cats sleep."]) == ""
    assert all(s in TEXT for _, a in C.answered(TEXT, "harbour tunnel") for s in a.split(". ")[:1])


def test_rewriting():
    assert C.plain_words("They utilise it in order to purchase “numerous” things.") == "They use it to buy “numerous” things."
    assert C.restate_numbers("up 5% to $3.4bn, “7%”") == "up 5 percent to $3.4 billion, “7%”"
    assert C.move_attribution("The plan will cost more than before, Ann Lee said.") == "Ann Lee said that the plan will cost more than before." and C.move_attribution("“Yes,” she said.") == "“Yes,” she said."
    assert C.reorder_clauses("The drivers welcomed the tunnel after years of long delay.") == "After years of long delay, the drivers welcomed the tunnel." and C.reorder_clauses("Short one.") == "Short one."
    long = "The council agreed to the plan for the harbour after a long debate in the town hall on Monday night, and the residents of the old town said that they would go to court."
    assert len(C.shorter_sentences(long)) == 2 and C.simplify("It is so.") == "It is so."
    assert C.title_case("plans for the NATO harbour") == "Plans for the NATO Harbour" and C.numbers_to_words("The 3 plans of 2025 cost 4 percent or 7.5 or $5") == "The three plans of 2025 cost 4 percent or 7.5 or $5"
    assert C.restore_case("ann lee of halmere", ["Ann Lee", "Halmere"]) == "Ann Lee of Halmere" and C.restore_case("x", []) == "x"
    new, changes = C.paraphrase("The plan will cost 5% more than the old plan, Ann Lee said.")
    assert "5 percent" in new and "numbers" in changes and C.paraphrase("") == ("", [])
    assert C.unique_against("cats sleep here", ["dogs run"]) == ("cats sleep here", True) and C.unique_against("Cats sleep here.", ["Cats sleep here."])[1] is False


def test_style(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    t = F.lit("We love it!  BUY NOW, “you said”")
    assert v(C.style_issues(t)) == ["first person", "exclamation", "selling", "spaces"] and v(C.style_score(t)) == 52 and v(C.style_issues(F.lit(None).cast("string"))) == [] and v(C.style_fixed(F.lit("So!! it  is,,"))) == "So. it is,"


def test_drafts_hold_to_the_source(spark):
    rows = [(1, "Harbour tunnel to open", TEXT), (2, None, TEXT[:200]), (3, "t", ""), (4, "t", None), (5, "t", "word " * 3000)]
    df = spark.createDataFrame(rows, "id int, title string, text string").withColumn("headline", F.lit("clash"))
    got = {r.id: r for r in C.draft_rows(df, "id", "title", "text").collect()}
    assert set(got) == {1, 2, 5} and got[1].quality == pytest.approx(1.0) and 0 < got[1].confidence <= 1 and "ann lee" in " ".join(got[1].tags).lower()
    assert set(re.findall(r"\d+", got[1].body)) <= set(re.findall(r"\d+", TEXT))
    b = {r.id: r.brief for r in C.brief_rows(df, "id", "title", "text").collect()}
    assert b[1].startswith("<p>") and "<ul><li>" in b[1] and b[3] == "" and {r.id for r in C.question_rows(df, "id", "text").collect()} <= {1, 2, 5}
    d = C.write("t", TEXT)
    d.sections = [("details", "x", ["Same.", "Same."])]
    assert not dict(C.checks(d, TEXT))["nothing twice"] and dict(C.checks(C.revise(d, TEXT), TEXT))["nothing twice"]
