"""Recall, communities, similarity, phonetic codes and recovery of replies against plain versions."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import phonetic, repair, similarity
from fieldloom.operators import communities, fuzzy, recall


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_longest_common_subsequences():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abcé大") for _ in range(r.randrange(90))) for _ in range(2))
        assert similarity.common(a, b) == plain_common(a, b)


def test_forms_of_similarity(spark):
    assert similarity.by_words("fuzzy was a bear", "was  fuzzy a bear") == 1.0
    assert similarity.by_word_sets("fuzzy was a bear", "fuzzy fuzzy was a bear big") == 1.0
    assert similarity.by_word_sets("", "a") == 0.0 and similarity.aligned("", "") == 1.0
    assert similarity.by_word_sets("a b x", "a b y") == max(similarity.aligned("a b x", "a b y"), similarity.aligned("a b", "a b x"))
    df = spark.createDataFrame([("ab", "abc"), (None, "a"), ("b a", "a b")], "x string, y string")
    got = [tuple(r) for r in df.select(similarity.ratio("x", "y"), similarity.word_ratio("x", "y")).collect()]
    assert got == [(0.8, 0.8), (None, None), (pytest.approx(1 / 3), 1.0)]


@pytest.mark.parametrize("least", [0.6, 0.7, 0.8, 0.92])
def test_no_similar_pair_is_lost(spark, least):
    r = random.Random(5)
    stems = ["harbour", "shore", "reef", "ab", "st", "x", "long beach point"]
    name = lambda: "".join(c for c in r.choice(stems) + r.choice(stems) if r.random() > 0.15) + r.choice(["", "a", "é", "s1"])
    a, b = ([name() for _ in range(150)] + [None, "", "aaaa", "aaaaa"] for _ in range(2))
    got = {(x["q"], x["n"]): round(x["score"], 9) for x in fuzzy.similar(spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x,) for x in b], "t string"), "t", "t", least).collect()}
    score = lambda x, y: 2 * plain_common(x, y) / (len(x) + len(y))
    assert got == {(x, y): round(score(x, y), 9) for x in a for y in b if x and y and score(x, y) >= least - 1e-12}
    best = fuzzy.most_similar(spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x,) for x in b], "t string"), "t", "t", least).collect()
    expected = {}
    for (x, y), s in got.items():
        expected[x] = min(expected.get(x, (0, "")), (-s, y))
    assert {x["q"]: x["n"] for x in best} == {x: y for x, (_, y) in expected.items()}


CODES = {
    "Smith": "SM0 XMT", "Schmidt": "XMT SMT", "Thomas": "TMS TMS", "Knight": "NT NT", "Wright": "RT RT", "Xavier": "SF SFR", "Czerny": "SRN XRN", "Michael": "MKL MXL",
    "Caesar": "SSR SSR", "Chianti": "KNT KNT", "Gough": "KF KF", "Laugh": "LF LF", "Bough": "P P", "Jose": "HS HS", "Cabrillo": "KPRL KPR", "Filipowicz": "FLPT FLPF",
    "Wasserman": "ASRM FSRM", "Arnow": "ARN ARNF", "Zhao": "J J", "Breaux": "PR PR", "Dumb": "TM TM", "Edge": "AJ AJ", "Edgar": "ATKR ATKR", "Tichner": "TXNR TKNR",
    "Bacchus": "PKS PKS", "Bertucci": "PRTX PRTX", "Accident": "AKST AKST", "McLaughlin": "MKLF MKLF", "Island": "ALNT ALNT", "Sugar": "XKR SKR", "School": "SKL SKL",
    "Schermerhorn": "XRMR SKRM", "Resnais": "RSN RSNS", "Rogier": "RJ RJR", "Tagliaro": "TKLR TLR", "Wada": "AT FT", "Vada": "FT FT", "Ghislane": "JLN JLN",
    "Campbell": "KMPL KMPL", "Raspberry": "RSPR RSPR", "Phone": "FN FN", "": " ", "123": " ", "大阪": " ",
}


def test_phonetic_codes(spark):
    assert {n: " ".join(phonetic.double_metaphone(n)) for n in CODES} == CODES
    got = spark.createDataFrame([("Smith",), ("Phone",), (None,), ("",)], "n string").select(phonetic.sounds("n")).collect()
    assert [r[0] for r in got] == [["SM0", "XMT"], ["FN"], [], []]


@pytest.mark.parametrize(("text", "least", "found"), [
    ('{"a":{"b":{"c":{"d":{"e":[1,2', 1, [{"a": {"b": {"c": {"d": {"e": [1, 2]}}}}}]), ('[{"a":1},{"b":2,},]', 1, [{"a": 1}, {"b": 2}]), ('x {"a": "cut str', 1, [{"a": "cut str"}]),
    ('{"a": 1, "b', 1, [{"a": 1}]), ('{"a": 1, "b":', 1, [{"a": 1}]), ('{"a": 1, "b": tru', 1, [{"a": 1}]), ('{"a": 1, "b": 12', 1, [{"a": 1, "b": 12}]), ('{"a": "x\\', 1, [{"a": "x"}]),
    ('[{"b": 1}, {"b": 2}, {"b"', 1, [{"b": 1}, {"b": 2}]), ('{"a": [1, 2}, {"c": 3}', 1, [{"a": [1, 2]}, {"c": 3}]), ("nothing {k: }", 1, []), ('[1, {\'a\': 1}, {"c":1,"d":2}]', 1, [{"c": 1, "d": 2}]),
    ('{"a": "q\\" }", "b": {}} tail {"y": 1, "z": {"w": "]"', 2, [{"a": 'q" }', "b": {}}, {"y": 1, "z": {"w": "]"}}]), ("{" * 5, 1, []), (None, 1, []), ("  ", 1, []), ("[]", 1, []),
    ("<think>[{}]</think>```json\n{\"n\": 1, \"l\": [{\"a\": {\"b\": {\"c\": {\"d\": 1}}}}, 3]}\n```", 2, [{"a": {"b": {"c": {"d": 1}}}}]),
])
def test_replies_are_recovered(text, least, found):
    assert [json.loads(x) for x in repair.recovered(text, least)] == found


def test_any_cut_of_a_reply_gives_its_beginning():
    whole = [{"name": "A b", "t": {"p": {"q": {"r": {"s": ["x", {"u": "}]\\\""}]}}}}}, {"name": "C", "n": 12.5, "ok": True}] * 3
    text = json.dumps(whole)
    for k in range(1, len(text)):
        found = [json.loads(x) for x in repair.recovered(text[:k], 1)]
        full = sum(1 for end in [m.end() for m in re.finditer(r'\}(?=, \{"name"|\]$)', text)] if end <= k)
        assert found[:full] == whole[:full] and len(found) <= full + 1
    repair.recovered("{" * 50_000)
    repair.recovered('{"a":' * 20_000)


def plain_modularity(edges, of):
    w = Counter()
    for a, b, x in edges:
        w[min(a, b), max(a, b)] += x
    total = sum(w.values())
    degree = Counter()
    for (a, b), x in w.items():
        degree[a] += x
        degree[b] += x
    inner = sum(x for (a, b), x in w.items() if of[a] == of[b])
    parts = Counter()
    for n, d in degree.items():
        parts[of[n]] += d
    return inner / total - sum((d / (2 * total)) ** 2 for d in parts.values())


def plain_greedy(edges):
    """Merges the two communities that gain most until none gains."""
    of = {n: n for a, b, _ in edges for n in (a, b)}
    best = plain_modularity(edges, of)
    while True:
        pairs = {(min(of[a], of[b]), max(of[a], of[b])) for a, b, _ in edges if of[a] != of[b]}
        tried = [(plain_modularity(edges, {n: (x if c == y else c) for n, c in of.items()}), x, y) for x, y in pairs]
        if not tried or max(tried)[0] <= best + 1e-12:
            return best
        best, x, y = max(tried)
        of = {n: (x if c == y else c) for n, c in of.items()}


def test_communities_are_as_good_as_a_greedy_search(spark):
    r = random.Random(8)
    gains = []
    for trial, (groups, size, inside, across) in enumerate([(4, 6, 0.8, 0.05), (3, 8, 0.5, 0.15), (5, 5, 0.9, 0.1)]):
        nodes = [f"n{k:02}" for k in range(groups * size)]
        edges = [(a, b, float(r.randrange(1, 4))) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i]) if r.random() < (inside if i // size == j // size else across)]
        df = spark.createDataFrame([(*e, "x") for e in edges] + [(None, "n00", 1.0, "x"), ("n01", "n02", 0.0, "x")], "src string, tgt string, weight double, community string")
        found = communities.communities(df)
        of = {x["node_id"]: x["community"] for x in found.collect()}
        assert set(of) == {n for a, b, _ in edges for n in (a, b)} and all(of[c] == c <= n for n, c in of.items())
        gains.append(plain_modularity(edges, of) - plain_greedy(edges))
        if not trial:
            assert communities.modularity(df, found) == pytest.approx(plain_modularity(edges, of))
            assert {x["node_id"]: x["community"] for x in communities.communities(df.repartition(3)).collect()} == of
    assert min(gains) >= -0.01 and sum(gains) >= -1e-9
    assert communities.communities(df.limit(0)).collect() == [] and communities.modularity(df.limit(0), found) == 0.0


def plain_recall(rows, queries, k, most):
    def words(t):
        return re.findall("[a-z0-9]{2,}", (t or "").lower())

    def terms(t):
        w = words(t)
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])

    tf = {key: terms(t) for key, t, _ in rows}
    total, df = Counter(), Counter()
    for c in tf.values():
        total.update(c)
        df.update(c.keys())
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]}

    def weights(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    out = set()
    for qid, text in queries:
        order = sorted(rows, key=lambda x: (-x[2], x[0]))
        wanted = {w for w in words(text) if len(w) > 2}
        first = [x[0] for x in order if wanted & set(words(x[1]))][: 3 * k]
        if len(first) < k:
            first += [x[0] for x in order[: 2 * k] if x[0] not in first]
        q = weights(terms(text))
        scored = [(-round(sum(x * q.get(t, 0) for t, x in weights(tf[key]).items()), 6), key) for key in first]
        ranked = sorted(x for x in scored if x[0] < 0) or [(0.0, key) for key in first]
        out |= {(qid, n, key, -s + 0.0) for n, (s, key) in enumerate(ranked[:k], 1)}
    return out


def test_recall_equals_a_plain_ranking(spark):
    r = random.Random(3)
    vocabulary = ["sea", "reef", "coral", "a1", "of", "to", "shore", "tide", "elysia", "obtusa", "bay"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(r.randrange(n)))
    rows = [(k, text(8), r.randrange(4)) for k in range(120)] + [(200, None, 9), (201, "", 8), (202, "unique words here", 0)]
    queries = [(k, text(5)) for k in range(30)] + [(50, "unique"), (51, None), (52, "nothing known"), (53, "of to")]
    df = spark.createDataFrame([(*x, "w") for x in rows], "id long, body string, seen int, term string")
    asked = spark.createDataFrame([(*x, 1) for x in queries], "qid long, text string, word int")
    for k, most in ((5, 10_000), (3, 12)):
        index = recall.indexed(df, "id", "body", [-F.col("seen")], most)
        got = {(x["qid"], x["rank"], x["id"], round(x["score"], 6)) for x in recall.recalled(index, asked, "qid", "text", k).collect()}
        assert got == plain_recall(rows, queries, k, most)
