"""Operators that judge or scan single texts: quality, personal data, secrets, test items."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, pii, quality_rules, rule_ensemble, secret_scan, shared, trees

DOCS = "doc_id bigint, text string, n_chars bigint, words string, _keep string, s string, label int"


def table(spark, texts, schema="doc_id bigint, text string"):
    extra = schema.count(",") - 1
    return spark.createDataFrame([(i, t, *[None] * extra) for i, t in texts], schema)


def numbered(texts):
    return list(enumerate(texts))


# -- shared blocks ----------------------------------------------------------------------


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 700)]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<bigint>").select("x", shared.running_sums(F.col("x")))
    for x, sums in rows.collect():
        assert sums == np.cumsum(x).tolist()


def test_matches_count_code_points(spark):
    df = spark.createDataFrame([("é😀ab12-3x",), ("",), ("no",)], "t string")
    rows = [r[0] for r in df.select(shared.matches(F.col("t"), "[0-9]++")).collect()]
    assert [(m["start"], m["end"], m["match"], m["before"], m["after"]) for m in rows[0]] == [
        (4, 6, "12", "é😀ab", "-"),
        (7, 8, "3", "-", "x"),
    ]
    assert rows[1] == rows[2] == []


# -- quality ----------------------------------------------------------------------------


def quality_texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(30)]
    texts += ["a b c d e f g h " * 4, "x\n\nx\n x\nx\t\n", "", None, " \t\n\x0b\x0c\r", "#*$ %&|<> é😀 y", "one"]
    texts += ["long " * 20_000, " ".join(map(str, range(20_000)))]
    texts += [texts[0] + " " + texts[0], "\u001c a b "]
    return texts


def test_statistics_equal_brute_force(spark):
    docs = numbered(quality_texts())
    rows = quality_rules.judged(table(spark, docs, DOCS), []).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]][1]
        expected = brute.statistics(text)
        assert {k: r[k] for k in expected} == expected
        assert r["base_failed"] == brute.base_failed(text)
        assert r["kept"] == (not r["base_failed"])


def symbol_corpus():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]
    docs, labels = [], []
    for i in range(300):
        w = rng.choices(vocabulary, k=rng.randint(25, 60))
        bad = i % 4 == 0
        docs.append((i, " ".join(f"{x}{'#$%'[k % 3] * 3}" if bad and k % 2 else x for k, x in enumerate(w))))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = symbol_corpus()
    return docs, table(spark, docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_decision_list_learns_and_keeps_columns(spark, corpus):
    docs, df, labels = corpus
    rules = quality_rules.learn(df, labels)
    assert rules
    kept = quality_rules.keep_good(df, rules)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs if i % 4}
    judged = {r["doc_id"]: r for r in quality_rules.judged(df, rules).collect()}
    assert all(judged[i]["kept"] == bool(i % 4) for i, _ in docs)


def test_quality_without_labels_or_rows(spark, corpus):
    docs, df, labels = corpus
    none = labels.where("false")
    assert quality_rules.learn(df, none) == []
    assert quality_rules.learn(df, labels.where("quality = 1")) == []
    assert quality_rules.learn(df.where("false"), labels) == []
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id bigint, quality int")
    assert quality_rules.learn(df, nulls) == []
    empty = df.where("false")
    assert quality_rules.judged(empty, []).count() == quality_rules.keep_good(empty, []).count() == 0
    twice = df.where("doc_id = 1").union(df.where("doc_id = 1"))
    assert [r["kept"] for r in quality_rules.judged(twice, []).collect()] == [True, True]


def test_covering_prunes_and_stops():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    bad = (x[:, 0] > 0.7) | ((x[:, 1] < 0.2) & (x[:, 2] < 0.5))
    rules = quality_rules.cover(x, bad, ["a", "b", "c"])
    hit = np.zeros(600, dtype=bool)
    for rule in rules:
        h = np.ones(600, dtype=bool)
        for c in rule.conditions:
            v = x[:, "abc".index(c.feature)]
            h &= v > c.threshold if c.above else v <= c.threshold
        hit |= h
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.05 * hit.sum()
    assert quality_rules.cover(x, np.zeros(600, dtype=bool), ["a", "b", "c"]) == []


def test_rule_ensemble_scores_held_out_rows(spark, corpus):
    docs, df, labels = corpus
    model = rule_ensemble.fit(df, labels)
    assert 0 < len(model.rules) < 200
    rows = rule_ensemble.score(df, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == (r["doc_id"] % 4 > 0) for r in held) > 0.95 * len(held)


def test_rule_ensemble_edge_rows(spark, corpus):
    _, df, labels = corpus
    assert rule_ensemble.score(df.where("false"), rule_ensemble.Ensemble(0.0)).count() == 0
    one_kind = rule_ensemble.fit(df, labels.where("quality = 1"))
    assert one_kind.rules == () and one_kind.intercept > 0
    assert rule_ensemble.fit(df, labels.where("false")).intercept == 0
    odd = table(spark, [(None, None), (5, ""), (5, ""), (6, "x " * 50_000)])
    rows = rule_ensemble.score(odd, rule_ensemble.fit(df, labels)).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)


def test_lasso_drops_noise_and_trees_fit():
    rng = np.random.default_rng(1)
    x = (rng.random((800, 12)) > 0.5).astype(float)
    y = (rng.random(800) < trees.sigmoid(3 * x[:, 0] - 3 * x[:, 1])).astype(float)
    _, w = rule_ensemble.lasso(x, y, 0.03)
    assert w[0] > 0.5 and w[1] < -0.5 and np.abs(w[2:]).max() < 0.3 and (w == 0).sum() >= 6
    prior, grown = trees.boost(x, y)
    score = prior + sum(trees.predict(t, x) for t in grown)
    assert ((score > 0) == (y > 0)).mean() > 0.7
    assert all(len(p) <= 3 for t in grown for p in trees.paths(t))


# -- personal data ----------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m)) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


def personal_texts():
    rng = random.Random(4)
    pieces = ["a.b", "x@y", "@", "host.com", "a@b.co.uk", ".", "-", "1.2.3.4", "256", "12", "0001", "+1", " ", "(555)"]
    pieces += ["4111111111111111", "4111 1111 1111 1111", "5555-5555", "123", "é", "😀", "\n", "_", "%", "+49 30 123456"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(600)]
    return [*texts, "", None, "a" * 50_000, "1" * 30_000, "a@b" + ".c" * 15_000, "1 " * 20_000, "+1" + "1 " * 10_000]


def test_octets_of_zero_are_valid(spark):
    texts = ["10.0.0.1", "0.0.0.0", "000.00.0.255", "010.001.0256.1", "255.255.255.256", "0010.1.1.1 0.0.0.0000"]
    rows = pii.scan(table(spark, numbered(texts)), pii.Model()).collect()
    assert {r["doc_id"]: spans(r["base"]) for r in rows} == {k: personal(t) for k, t in enumerate(texts)}
    assert [len(r["base"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [1, 1, 1, 0, 0, 2]


def spans(found):
    return [tuple(s) for s in found]


def test_personal_base_spans_equal_brute_force(spark):
    docs = [*numbered(personal_texts()), (None, "a@b.c"), (0, personal_texts()[0])]
    rows = pii.scan(table(spark, docs, DOCS), pii.Model()).collect()
    texts = dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert spans(r["base"]) == personal(texts[r["doc_id"]])
        assert spans(r["spans"]) == spans(r["base"])
    assert pii.scan(table(spark, []), pii.Model()).count() == 0


def test_personal_model_adds_calibrated_candidates(spark):
    rng = random.Random(9)
    docs = []
    for i in range(900):
        plain = " ".join(rng.choices(["alpha", "beta", "gamma", "2024", "7"], k=8))
        number = f"+{rng.randrange(1, 9)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"
        docs.append((i, f"{plain} call {number}. order 12 345 678 90 {plain}" if i % 2 else plain))
    df = table(spark, docs)
    model = pii.fit(df)
    assert model.parts[3][2] is not None and model.parts[0][2] is None
    seen = table(spark, [(1, "alpha call +4 555 1234. order 12 345 678 90 beta"), (2, None), (3, "order 12 345 678 90")])
    rows = {r["doc_id"]: r for r in pii.scan(seen, model).collect()}
    assert spans(rows[1]["base"]) == [(3, 11, 22)] == spans(rows[1]["spans"])
    assert spans(rows[3]["spans"]) == [] == spans(rows[2]["spans"])
    assert pii.fit(df.where("false")) == pii.Model([(0.0, [], None)] * 4)


def test_calibration_keeps_ties_together():
    score = np.array([3.0] * 200 + [1.0] * 100)
    label = np.array([1] * 199 + [0] + [0] * 100)
    assert pii.calibrated(score, label, 0.95) == 3.0
    assert pii.calibrated(score, np.zeros(300), 0.95) is None
    assert pii.calibrated(score, np.ones(300), 0.95) == 1.0
    assert pii.calibrated(np.array([]), np.array([]), 0.95) is None


def test_redact(spark):
    df = table(spark, [(1, "é mail a@b.co now +1 555 0000 1 x"), (2, "")])
    rows = dict(df.select("doc_id", pii.redact(F.col("text"), pii.base_spans(F.col("text")))).collect())
    assert rows == {1: "é mail [email] now [phone] x", 2: ""}


# -- secrets ----------------------------------------------------------------------------


def secrets(text):
    text, out = text or "", []
    assign = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


def test_secret_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    pieces = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "abcdefghijkl", "AKIA"]
    pieces += ["AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "z", "-", "ſecret", "K"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(600)]
    texts += ["", None, "a" * 60_000, "ab " * 20_000 + "0123456789abcdef" * 3]
    docs = [*numbered(texts), (None, "x"), (0, texts[0])]
    rows = secret_scan.scan(table(spark, docs, DOCS)).collect()
    known = dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        base = [(s["start"], s["kind"], s["end"]) for s in r["base"]]
        assert base == secrets(known[r["doc_id"]])
        more = [s for s in r["spans"] if s not in r["base"]]
        assert all(s["kind"] == 3 for s in more)
        assert not any(s["start"] < e and b < s["end"] for s in more for b, _, e in base)
    assert secret_scan.scan(table(spark, [])).count() == 0


def test_entropy_equals_brute_force_and_allow_list(spark):
    rng = random.Random(6)
    hexes = secret_scan.CLASSES[0][1]
    texts = ["".join(rng.choices("abcdef0123456789XYZ+", k=rng.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan.top_entropy(F.col("t"), hexes))
    for t, found in rows.collect():
        best = 0.0
        for i in range(len(t) - 19):
            w = t[i : i + 20]
            if set(w) <= set(hexes):
                best = max(best, -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values()))
        assert found == pytest.approx(best, abs=1e-12)
    texts = [
        "key Xy9+Zq8Lm3nB7vC2kPw4Rt now",
        "123e4567-e89b-12d3-a456-426614174000",
        "internationalisation-of-documents 1",
        "zzzzzzzzzzzzzzzzzzzzzzzz1",
        "--------------------------- 1",
        "usr/local/share/lib/python3/site",
    ]
    rows = dict(secret_scan.scan(table(spark, numbered(texts))).select("doc_id", "spans").collect())
    assert [spans(rows[i]) for i in range(6)] == [[(3, 4, 26)], [], [], [], [], []]


def test_secrets_of_every_case_and_with_slashes(spark):
    texts = [
        "9F86D081884C7D659A2F",
        "9f86D081884c7D659a2FeAa0",
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
        "qWeRtY+uIoPaSdFgHjKl+ZxCvBnM",
        "qWeRtY+uIoPaSdFgHjKl+ZxCvBnM in room 1",
        "src/main/java/org/OurClassName/part-2/x86_64",
        "/usr/share/doc/README/2024-01-05/notes",
        "ABCDEFABCDEFABCDEFABCDEF",
        "plain words without anything else",
    ]
    rows = dict(secret_scan.scan(table(spark, numbered(texts))).select("doc_id", "spans").collect())
    whole = [len(t.split(" ")[0]) for t in texts[:5]]
    assert [spans(rows[i]) for i in range(9)] == [*[[(3, 0, n)] for n in whole], [], [], [], []]


# -- benchmark items --------------------------------------------------------------------


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        window = rng.choice([2, 3, 4, 10])
        vocabulary = ["aa", "b", "Çé", "d1", "e"][: rng.randint(1, 5)]
        items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for i in range(rng.randint(1, 5))]
        index = decontaminate.Index(items, window)
        for _ in range(4):
            text = "-".join(rng.choices([*vocabulary, "ZZ", "X"], k=rng.randint(0, 40)))
            n, hit, found = brute.contamination(text, items, window)
            merged, items_found = index.scan(decontaminate.words(text))
            assert n == len(decontaminate.words(text))
            assert {k for a, b in merged for k in range(a, b)} == hit
            assert items_found == found


def test_decontaminate_table(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = [(3, item), (3, item), (1, "Short, item!"), (2, None), (None, "x"), (4, "")]
    benchmark = spark.createDataFrame(bench, "item_id int, text string")
    index = decontaminate.build_index(benchmark)
    filler = " ".join(f"f{i}" for i in range(30))
    docs = [(1, f"{filler}. One TWO three four-five six seven eight nine, ten! {filler}"), (2, item), (3, None), (4, "")]
    docs += [(5, filler), (5, filler), (None, "a short item b " + filler), (6, "w " * 50_000 + item)]
    df = table(spark, docs, "doc_id bigint, text string, n_chars bigint, _cut string, items string")
    items = [("3", item), ("1", "Short, item!")]
    for r in decontaminate.report(df, index).collect():
        text = next(t for i, t in docs if i == r["doc_id"])
        n, hit, found = brute.contamination(text, items)
        assert (r["n_words"], {k for s in r["spans"] for k in range(s["start"], s["end"])}) == (n, hit)
        assert r["items"] == sorted(found)
    out = decontaminate.remove(df, index)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert sorted(rows, key=str) == [1, 3, 4, 5, 6, None]  # document 2 is an item and nothing else
    assert rows[1] == f"{filler}. {filler}" and rows[3] is None and rows[5] == filler and rows[4] == ""
    assert rows[None] == "a b " + filler and rows[6] == "w " * 50_000
    assert decontaminate.report(df.where("false"), index).count() == 0
    empty = decontaminate.build_index(benchmark.where("false"))
    assert all(not r["spans"] for r in decontaminate.report(df, empty).collect())
    with pytest.raises(ValueError):
        decontaminate.build_index(benchmark, max_bytes=10)
