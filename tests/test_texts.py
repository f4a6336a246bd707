"""Text operators against plain loops."""

import random
import re

from tessera.operators import texts as T


def brute_score(goal, text):
    goal, text = (goal or "").lower(), (text or "").lower()
    runs = re.findall("[\u4e00-\u9fff]+", goal)
    grams = {run[i : i + n] for run in runs for n in (2, 3, 4) for i in range(len(run) - n + 1)}
    score = sum((1 if len(g) == 2 else 2) for g in grams if g in text)
    score += sum(y in text for y in set(re.findall("[0-9]{4}", goal)))
    return score + 2 * sum(re.search(f"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", text) is not None for w in set(re.findall("[a-z][a-z0-9-]{2,}", goal)))


def test_search_scores_against_brute_force(spark):
    r = random.Random(2)
    bits = ["the", "AI-5", "e-commerce", "ai", "car", "cars", "foo--bar", "x-foo", "foo-", "3abc", "abc", "2023", "12023", "2024年", "新能源汽车", "能源", "汽车销量", "汽", "，", " ", " ", "\n", "B2b"]
    text = lambda n: "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(n))
    goals = [(i, text(r.randint(1, 6))) for i in range(25)] + [(90, None), (91, "zzz"), (92, "2023")]
    docs = [(i, text(r.randint(0, 12))) for i in range(60)] + [(100, None), (101, "")]
    want = set()
    for g, goal in goals:
        scored = sorted(((-brute_score(goal, t), d) for d, t in docs if brute_score(goal, t)))
        strict = [x for x in scored if x[0] <= -2]
        want |= {(g, d, -s, n + 1) for n, (s, d) in enumerate((strict or scored)[:3])}
    found = T.search_scores(spark.createDataFrame(goals, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(x.item_id, x.doc_id, x.score, x["rank"]) for x in found.collect()} == want


def test_search_scores_find_short_words_years_and_han(spark):
    goals = spark.createDataFrame([(1, "car"), (2, "2023"), (3, "腾讯营收")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a car"), (2, "in 2023"), (3, "看腾讯营收增速")], "doc_id long, text string")
    assert T.search_matches(goals, docs).count() == 0
    assert sorted((x.item_id, x.doc_id, x.score) for x in T.search_scores(goals, docs).collect()) == [(1, 1, 2), (2, 2, 1), (3, 3, 9)]
