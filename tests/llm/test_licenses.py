import random
import re

from lignum.llm import licenses
from lignum.llm.license_phrases import PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    t = " " + " ".join(words) + " "
    spans = []
    for k, (p, label, keyword, rx) in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<= ){rx}(?= )", t):
            assert keyword in m[0] or keyword in t, (keyword, m[0])
            spans.append((m.start(), -m.end(), p, k, label))
    spans.sort()
    # One that starts no later and ends no sooner, of the same or a stronger priority, suppresses; of equal ones the first stays.
    live = [x for i, x in enumerate(spans) if not any(y[2] <= x[2] and y[1] <= x[1] for y in spans[:i])]
    score = max([0.0, *(licenses.WEIGHTS[x[2]] for x in live), *([licenses.BASE_WEIGHT] if at else [])])
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[4] for x in live})), score


def test_against_brute_force(spark):
    draw = random.Random(7)
    bits = ["Released under the MIT License.", "apache license, version 2.0", "Apache License Version 2", "CC BY-NC 4.0", "cc-by-nc", "SPDX-License-Identifier: GPL-3.0-or-later",
            "GNU General Public License v2 or later", "Creative Commons Attribution-NonCommercial 4.0", "the public domain", "All rights reserved", "mit license", "under the\nmit\tlicense", "schön ünder the mit license"]
    texts = [None, "", " ..!", "Mit", "under the mit license" * 3, " ".join(["under the mit license apache license version 2.0"] * 700)]
    for _ in range(120):
        texts.append(" ".join(draw.choice(bits) if draw.random() < 0.3 else draw.choice(["the", "Öl", "x1", "license", "version"]) for _ in range(draw.randint(1, 30))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS labels", "1 AS n_words")
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(df.union(df.limit(3))).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute(text), (i, text and text[:200])


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_are_many_and_ordered():
    found = licenses.rules()
    assert len(found) > 700 and [r[0] for r in found] == sorted(r[0] for r in found)
    patterns = [p[1] for p in PHRASES]
    assert len(patterns) > 250 and len(set(patterns)) == len(patterns)
    assert not any(k.strip() in ("a", "the", "of", "for", "only", "software", "public") for _, _, k, _ in found)


def shortest(parsed):
    """All texts that a pattern matches with each repeat at its least, one for each choice of branch or letter."""
    found = [""]
    for op, value in parsed:
        match str(op):
            case "LITERAL":
                own = [chr(value)]
            case "ANY":
                own = ["x"]
            case "IN":
                own = [chr(v) for _, v in value]
            case "BRANCH":
                own = [x for branch in value[1] for x in shortest(branch)]
            case "SUBPATTERN":
                own = shortest(value[-1])
            case "MAX_REPEAT":
                own = [""] if value[0] == 0 else shortest(value[2]) if value[0] == 1 else None
        found = [a + b for a in found for b in own]
    return found


def test_keywords_occur_in_the_shortest_matches():
    for p, label, keyword, rx in licenses.rules():
        for text in shortest(re._parser.parse(rx)):
            assert re.fullmatch(rx, text) and keyword in text, (label, keyword, text)


def test_every_phrase_is_found(spark):
    """Each phrase at its shortest, in words of its own, is scanned as the brute force says, and never in vain."""
    texts = [f"Öl {shortest(re._parser.parse(rx))[0].upper()}, end" for _, rx, _, _ in PHRASES]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert (got[i].labels, got[i].score) == brute(text)[-2:] and got[i].score >= licenses.WEIGHTS[PHRASES[i][3]], text


def test_words_of_many_lines_between(spark):
    """A gap in a phrase may hold any character, also those that end lines."""
    texts = [f"Neither the name of a{c}b nor the names of its contributors may be used to endorse it" for c in "\u0085\u2028\u2029\r"]
    assert [r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()] == ["bsd-3"] * 4


def test_very_long_text(spark):
    """A text of a million words with phrases at both ends and none between."""
    text = "Under the MIT License. " + "some words without any rights " * 200_000 + " all rights reserved"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (1_000_007, 1, 0, 0, "mit,proprietary")


def test_proprietary_phrases_need_no_other_word(spark):
    texts = ["Unauthorized copying of this file is prohibited.", "No redistribution is permitted", "unauthorised reproduction strictly prohibited", "no copying of this file, via any medium, is strictly permitted", "no redistribution is strictly"]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute(t)[-2:] for i, t in enumerate(texts)}
    assert [got[i] for i in range(5)] == [("proprietary", 0.7)] * 4 + [("", 0.0)]
