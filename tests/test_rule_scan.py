"""Rule matching in one pass: against each pattern by itself, growth with matches and rules, and the dictionary of the trade."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskweave.functions.wording import CHINESE
from riskweave.operators import rule_scan, text_rules
from riskweave.operators.text_rules import Rule
from riskweave.plans import dictionary


def scanner(rules, negations=(), wording=None):
    return rule_scan.Scanner(tuple(rules), tuple(negations), 16, 200, wording)


def slow_places(rules, text):
    out = {}
    for i, rule in enumerate(rules):
        for p in [*map(re.escape, rule.keywords), *rule.patterns]:
            for m in re.finditer(p, text, re.IGNORECASE | re.ASCII):
                out.setdefault(i, set()).add(m.span())
    return out


def test_places_are_those_of_each_pattern_alone():
    patterns = ["ab?c", "b{1,3}a.{0,2}c", "(?:aa|bc).{0,4}(?:ca|b)", "(?<!a)bb", "c(?=a)", "^ab", "bc$", "a+b", r"\bab", "(?:ab){2}", "[ab]c+b", "(?:a|b)(?:cc|ab)", "c.{0,3}a(?!b)"]
    rules = [Rule(f"r{i}", "L", 1, (p,), keywords=k) for i, (p, k) in enumerate(zip(patterns, [("aa", "aab"), ("b",), ("bcb", "cb"), ("ABA",)] * 4))]
    s, r = scanner(rules), random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("aabbccAB \n") for _ in range(r.randint(0, 60)))
        assert s.places(text) == slow_places(rules, text), text


def test_dictionary_places_are_those_of_each_pattern_alone():
    s, r = scanner(dictionary.RULES), random.Random(6)
    words = [*dictionary._PHRASES, *dictionary.BEFORE, *(c for w in dictionary._PHRASES for c in w), "。", "\n", "12.5%", "3亿元"]
    for _ in range(1500):
        text = "".join(r.choice(words) for _ in range(r.randint(0, 30)))
        assert s.places(text) == slow_places(dictionary.RULES, text), text


def test_literals_and_spans_of_expressions():
    assert rule_scan.required("(?:公司|本公司).{0,12}(?:存在|发生).{0,8}违规担保") == {"违规担保"}
    assert rule_scan.required("x*(?:ab|cd)?[0-9]") is None and rule_scan.required("(?:ab|cd)+e") == {"ab", "cd"}
    assert rule_scan.literal("a\\.b") == "a.b" and rule_scan.literal("a.b") is None
    assert rule_scan.span("a.{0,3}b") == 5 and rule_scan.span("a.*b") is None and rule_scan.span("ab$") is None and rule_scan.span("a(?=b)") is None
    assert rule_scan.folded("İA") == "İa"  # offsets stay


def test_every_expression_has_a_wording_and_no_rule_is_idle():
    """All 19 rules, 87 keywords and 23 expressions can be found by the registered query."""
    assert len(dictionary.RULES) == 19 and sum(len(r.keywords) for r in dictionary.RULES) == 87 and sum(len(r.patterns) for r in dictionary.RULES) == 23
    texts = [w.replace("#", "12.5") for w in dictionary.WORDINGS]
    assert all(any(re.search(p, t) for t in texts) for r in dictionary.RULES for p in r.patterns)


@pytest.mark.parametrize("rules", [[Rule("r", "L", 4, ("impairment",), ("policy",))], [Rule("r", "L", 4, (), ("policy",), ("impairment",))]])
def test_excluded_matches_take_linear_time(spark, rules):
    docs = lambda n: spark.createDataFrame([(1, "policy impairment " * n + "x" * 300 + "impairment" + "y" * 300)], "announcement_id long, text string")
    text_rules.rule_hits(docs(10), rules, ["no "]).collect()
    began = time.time()
    row = text_rules.rule_hits(docs(32_000), rules, ["no "]).first()
    assert row["start"] == 18 * 32_000 + 301 and row["reason"] == "" and time.time() - began < 4


def test_time_does_not_grow_with_the_rules():
    text = "".join(random.Random(7).choice("abcdefgh ") for _ in range(400_000))
    took = []
    for n in (20, 2000):
        s = scanner([Rule(f"r{i}", "L", 1, (f"z{i}.{{0,9}}y",), keywords=(f"keyword{i}",)) for i in range(n)])
        s.places("")
        began = time.time()
        assert s.places(text) == {}
        took.append(time.time() - began)
    assert took[1] < 5 * took[0] + 0.1


def test_contexts_and_ties():
    s = rule_scan.Scanner(tuple(dictionary.RULES), tuple(dictionary.NEGATIONS), 16, 200, CHINESE)
    found = lambda text: {dictionary.RULES[i].rule_id: (start, match, why) for i, start, match, why in s.hits(text)}
    assert found("不存在违规担保余额3亿元")["D05_ILLEGAL_GUARANTEE"] == (4, "违规担保余额3亿元", "negated_context")
    assert found("大额商誉减值")["C03_GOODWILL_IMPAIR"] == (1, "大额商誉减值", "")  # the longer of two at different places begins first
    assert found("商誉减值准备")["C03_GOODWILL_IMPAIR"][:2] == (1, "商誉减值准备")  # of one place the longest
    assert found("无保留意见") == {} and found("出具保留意见")["G01_MODIFIED_OPINION"] == (3, "保留意见", "")
    assert found("立案调查")["G07_INVESTIGATION_PENALTY"][2] == "missing_event_anchors"
    assert found("") == {}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", None), (3, "商誉减值" * 3, "k"), (3, "商誉减值" * 3, "k"), (None, "停工\0停工", "k")], "announcement_id long, text string, `a b` string").withColumn("n", F.lit(1.5))
    got = text_rules.rule_hits(docs, dictionary.RULES, dictionary.NEGATIONS)
    assert got.columns[:3] == ["announcement_id", "a b", "n"]
    assert sorted(((r["announcement_id"] or 0), r["rule_id"], r["start"]) for r in got.collect()) == [(0, "A06_OPS_DISRUPTION", 1), (3, "C03_GOODWILL_IMPAIR", 1), (3, "C03_GOODWILL_IMPAIR", 1)]
    assert text_rules.rule_hits(docs.limit(0), dictionary.RULES, []).collect() == [] and text_rules.rule_hits(docs, [], []).collect() == []
