import random
import re

import pyarrow as pa
import pytest

from cloakwork import rules as rules_table
from cloakwork.operators import rewrite, submap, triage, verify

MAP = "category string, entry_ord int, from string, to string, id string"
SEG = "file_rel string, seg_ord int, seg_id string, text string"


def greedy(text, rules):
    out, i = [], 0
    while i < len(text):
        for f, t, ci in rules:
            part = text[i : i + len(f)]
            if part == f or ci and part.lower() == f.lower():
                out.append(t)
                i += len(f)
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


@pytest.mark.parametrize("pass_rules", [3, 1000])
def test_rewriting_equals_greedy(spark, monkeypatch, pass_rules):
    monkeypatch.setattr(rewrite, "PASS_RULES", pass_rules)
    rng = random.Random(3)
    words = list({"".join(rng.choice("abAB.\\E|é") for _ in range(rng.randint(1, 4))) for _ in range(14)})
    entries = [("brand" if k % 3 == 0 else "ids", k, w, f"<{k}>", f"m:{k}") for k, w in enumerate(words)]
    texts = ["".join(rng.choice("abAB.\\E|éÉ\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rules = [(f, t, c == "brand") for c, _, f, t, _ in sorted(entries, key=lambda e: (-len(e[2]), e[0] != "brand", e[1]))]
    seg = spark.createDataFrame([(f"{i:04d}", 0, "0", t) for i, t in enumerate(texts)], SEG)
    done = rewrite.apply_rules(seg, rewrite.compile_rules(spark.createDataFrame(entries, MAP))).collect()
    for r in done:
        source = texts[int(r.file_rel)]
        assert r.text == greedy(source, rules)
        for e in r.events:
            assert source[e.orig_off : e.orig_off + e.orig_len] == e["from"]
            assert r.text[e.anon_off : e.anon_off + e.anon_len] == e["to"]


ODD_CASES = "aAsS\u017fkK\u212ai\u0130\u0131\u03c3\u03c2\u03a3\u00df\u1e9e -"


@pytest.mark.parametrize("pass_rules", [5, 1000])
def test_odd_case_folds_lose_no_text(spark, monkeypatch, pass_rules):
    monkeypatch.setattr(rewrite, "PASS_RULES", pass_rules)
    rng = random.Random(9)
    words = ["acmes", "Kelvin", "\u0130stanbul", "\u039f\u0394\u039f\u03a3", *{"".join(rng.choice(ODD_CASES) for _ in range(rng.randint(1, 3))) for _ in range(25)}]
    entries = [("brand" if k % 2 == 0 else "ids", k, w, f"<{k}>", f"m:{k}") for k, w in enumerate(words)]
    texts = ["at acme\u017f now, ACMES too", "\u212aelvin kelvin", "\u0130STANBUL i\u0307stanbul", "\u03bf\u03b4\u03bf\u03c2 \u03bf\u03b4\u03bf\u03c3"]
    texts += ["".join(rng.choice(ODD_CASES) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rules = [(f, t, c == "brand") for c, _, f, t, _ in sorted(entries, key=lambda e: (-len(e[2]), e[0] != "brand", e[1]))]
    seg = spark.createDataFrame([(f"{i:04d}", 0, "0", t) for i, t in enumerate(texts)], SEG)
    for r in rewrite.apply_rules(seg, rewrite.compile_rules(spark.createDataFrame(entries, MAP))).collect():
        assert r.text == greedy(texts[int(r.file_rel)], rules)


def brute_hits(text, entries):
    """(pattern, match, off) of one text: values where they stand, then swept values between word borders, one of each start and length."""
    out, seen = [], set()
    values = {f for _, _, f, _, _ in entries if f}
    for v in sorted(values - {f for _, _, f, t, _ in entries if f != t and f in t}):
        at = text.find(v)
        while at >= 0:
            if (at, len(v)) not in seen:
                seen.add((at, len(v)))
                out.append((verify.REGRESSION, v, at))
            at = text.find(v, at + len(v))
    spelt = set()
    for c in rules_table.SWEPT_CATEGORIES:
        for _, _, f, t, i in sorted((e for e in entries if e[0] == c), key=lambda e: e[1]):
            f, t = f.strip(" "), t.strip(" ")
            if len(f) < 3 or f.lower() in spelt:
                continue
            spelt.add(f.lower())
            for m in re.finditer(rf"(?i)\b{re.escape(f)}\b", text):
                if (m.start(), len(m[0])) not in seen and not re.search(rf"(?i)^{re.escape(t)}$", m[0]):
                    seen.add((m.start(), len(m[0])))
                    out.append((f"map:{i or c}", m[0], m.start()))
    return sorted(out)


@pytest.mark.parametrize("pass_values", [2, 1000])
def test_map_values_are_found_as_by_brute_force(spark, monkeypatch, pass_values):
    monkeypatch.setattr(verify, "PASS_VALUES", pass_values)
    rng = random.Random(5)
    words = ["acmes", "Acmes", "Acme Bank", "bank", "*.acme", "Kel vin", "a a", "a a a", "id-7", "ID-77"]
    cats = ["brand", "ids", "phones", "headers"]
    entries = [(cats[k % 4], k, w, rng.choice(["Vendor1", "ACMES", f"x{w}", ""]), f"m:{k}" if k % 3 else "") for k, w in enumerate(words)]
    parts = ["acmes", "ACMES", "acme\u017f", "Acme Bank", "acme bank", "*.acme", "x*.acme", "a a a a", "\u212ael vin", "id-7", "ID-77", ",", "_", "Bank"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    seg = spark.createDataFrame([(f"{i:04d}", 0, "0", t) for i, t in enumerate(texts)], SEG)
    got = {}
    for h in verify.verify(seg, spark.createDataFrame(entries, MAP), (), normalise=False).collect():
        got.setdefault(int(h.file_rel), []).append((h.pattern, h.match, h.off))
        assert h.match in h.snippet
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_hits(t, entries), t


@pytest.mark.parametrize(("pass_values", "letters"), [(2, 1000), (1000, 5), (1000, 1000)])
def test_map_values_are_counted_as_by_brute_force(spark, monkeypatch, pass_values, letters):
    monkeypatch.setattr(verify, "PASS_VALUES", pass_values)
    monkeypatch.setattr(verify, "PASS_LETTERS", letters)
    entries = [("ids", 0, "a a", "x", "m:1"), ("ids", 1, "Bank", "y", "m:2"), ("brand", 2, "bank", "BANK", ""), ("phones", 3, "ban", "z", ""), ("headers", 4, "Straße", "w", "m:5"), ("ids", 5, "*.acme", "v", "m:6")]
    texts = ["a a a a A a", "bank Bank BANK banks", "stra\u1e9ee STRA\u1e9eE Straße", "x*.ACME *.acme", "", "\u03a3\u0391\u03a3 bank", "A a a a a"]
    seg = spark.createDataFrame([(str(i), 0, "0", t) for i, t in enumerate(texts)] + [("none", 0, "0", None)], SEG)
    got = {(h.file_rel, h.source): h.n_hits for h in verify.literal_counts(seg, spark.createDataFrame(entries, MAP), normalise=False).collect()}
    want = {}
    for i, t in enumerate(texts):
        for pattern, _, _ in brute_hits(t, entries):
            key = str(i), pattern if pattern == verify.REGRESSION else "map"
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_a_text_of_many_hits_is_handed_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(verify, "BATCH_HITS", 100)
    piece = pa.table({"from": ["ab"], "rank": pa.array([None], pa.int64()), "to": pa.array([None], pa.string()), "name": pa.array([None], pa.string())})
    sizes = [b.num_rows for b in verify.hit_batches(iter([("a", "ab" * 1050)]), verify.Values(piece, str))]
    assert sum(sizes) == 1050 and max(sizes) == 100


def test_no_rules_changes_nothing(spark):
    seg = spark.createDataFrame([("a", 0, "0", "text"), ("b", 0, "0", None)], SEG)
    done = rewrite.apply_rules(seg, rewrite.compile_rules(spark.createDataFrame([], MAP))).collect()
    assert [(r.text, r.events) for r in done] == [("text", []), (None, [])]


def test_swap_cycle_is_not_idempotent(spark):
    smap = spark.createDataFrame([("ids", 0, "a", "b", "1"), ("ids", 1, "b", "a", "2"), ("ids", 2, "c", "d", "3")], MAP)
    assert {r.id for r in submap.not_idempotent(smap).collect()} == {"1", "2"}


def test_verify_entities_and_zero_width(spark):
    seg = spark.createDataFrame([("a", 0, "0", "at &#57;3.184.216.34"), ("b", 0, "0", "at 93.184​.216.34"), ("c", 0, "0", "clean"), ("d", 0, "0", None)], SEG)
    hits = verify.verify(seg).collect()
    assert {(h.file_rel, h.match) for h in hits} == {("a", "93.184.216.34"), ("b", "93.184.216.34")}


def test_auto_resolve_adds_other_cases(spark):
    smap = spark.createDataFrame([("brand", 0, "AcmeBank", "VendorOne", "brand:0001"), ("ids", 0, "Proj", "Item", "ids:0002")], MAP)
    seg = spark.createDataFrame([("a", 0, "0", "AcmeBank acmebank PROJ proj Proj")], SEG)
    done, grown, hits = verify.auto_resolve(seg, smap)
    assert done.head().text == "VendorOne VendorOne ITEM item Item"
    assert {r["from"] for r in grown.collect()} == {"AcmeBank", "Proj", "PROJ", "proj"}
    assert hits.count() == 0


def test_merge_bumps_and_numbers(spark):
    smap = spark.createDataFrame([("brand", 0, "x", "Vendor01", "brand:0001")], MAP)
    new = spark.createDataFrame([(0, "brand", "yyyy", "Vendor01"), (1, "brand", "zzzz", "Vendor01"), (2, "brand", "x", "other"), (3, "nope", "q", "q"), (4, "nope", "abc", "abcdefghij")], "ord long, category string, value string, placeholder string")
    got = {r["from"]: (r.category, r["to"], r.id) for r in submap.merge(smap, new).collect()}
    assert got == {"x": ("brand", "Vendor01", "brand:0001"), "yyyy": ("brand", "Vendor02", "brand:0002"), "zzzz": ("brand", "Vendor03", "brand:0003"), "abc": ("other", "a00", "other:0004")}


def test_map_edits(spark):
    smap = spark.createDataFrame([("brand", 0, "x", "V1", "brand:0001"), ("ids", 0, "x", "I1", "ids:0002"), ("ids", 1, "y", "I2", "ids:0003")], MAP)
    assert submap.find(smap, "x").head().category == "brand" and submap.find(smap, "none").count() == 0
    rows = lambda d: sorted((r.category, r.entry_ord, r["from"], r["to"], r.id) for r in d.collect())
    assert rows(submap.add(smap, "nope", "z", "Z")) == [("brand", 0, "x", "V1", "brand:0001"), ("ids", 0, "x", "I1", "ids:0002"), ("ids", 1, "y", "I2", "ids:0003"), ("other", 0, "z", "Z", "other:0004")]
    assert rows(submap.add(smap, "ids", "y", "other")) == rows(smap)
    assert submap.add(smap.limit(0), "ids", "y", "Y", "mine").head().id == "mine"
    assert [r["to"] for r in submap.update(smap, "ids:0003", "new").where("id = 'ids:0003'").collect()] == ["new"]
    assert rows(submap.update(smap, "none", "new")) == rows(smap) == rows(submap.remove(smap, "none"))
    assert len(rows(submap.remove(smap, "ids:0002"))) == 2


def test_order_of_rules(spark):
    rules = spark.createDataFrame([("abc", 0), ("ab", 1), ("abcd", 5), ("a", 9)], "from string, at int")
    assert [tuple(r) for r in submap.not_longest_first(rules).collect()] == [("abcd", 5)]
    assert submap.not_longest_first(rules.where("at <> 5")).count() == 0


def test_promote_is_one_step(spark):
    smap = spark.createDataFrame([("brand", 0, "Acme", "Vendor1", "brand:0001")], MAP)
    row = "ord long, category string, value string, suggested_placeholder string, decision string, tier string"
    t0 = spark.createDataFrame([(0, "brand", "Acme", "Vendor9", "pending", "T0_rules"), (1, "phones", "+39 333 1234567", "", "pending", "T0_rules")], row)
    t1 = spark.createDataFrame([(0, "brand", "Bank", "Vendor1", "approve", "T1_llm"), (1, "brand", "Kept", "Vendor2", "skip", "T1_llm")], row)
    grown, (left0, left1), log = triage.promote(smap, [t0, t1])
    got = {r["from"]: (r["to"], r.id) for r in grown.collect()}
    assert set(got) == {"Acme", "+39 333 1234567", "Bank"} and got["Acme"] == ("Vendor1", "brand:0001")
    assert got["Bank"] == ("Vendor2", "brand:0003") and got["+39 333 1234567"][0] not in ("", "+39 333 1234567") and got["+39 333 1234567"][1] == "phones:0002"
    assert left0.count() == 0 and [r.value for r in left1.collect()] == ["Kept"]
    assert {r.value for r in log.collect()} == {"Acme", "+39 333 1234567", "Bank"}


def test_audit_answers_and_review_queue(spark):
    smap = spark.createDataFrame([("brand", 0, "Acme", "Vendor1", "brand:0001")], MAP)
    seg = spark.createDataFrame([("a", 0, "0", "Acme ACME at 93.184.216.34 or 93.184.216.35")], SEG)
    answers = [("93.184.216.34", "network", "203.0.113.1", 0.95), ("93.184.216.35", "network", "203.0.113.2", 0.5), ("never found", "brand", "x", 1.0)]
    asked = []

    def audit(left):
        asked.extend(r.value for r in left.collect())
        return spark.createDataFrame(answers, "value string, category string, placeholder string, confidence double")

    done, grown, hits = verify.auto_resolve(seg, smap, audit=audit)
    assert "93.184.216.34" in asked and done.head().text == "Vendor1 Vendor1 at 203.0.113.1 or 93.184.216.35"
    assert {r["from"] for r in grown.collect()} == {"Acme", "93.184.216.34"}
    queue = verify.review_queue(hits).collect()
    assert [(r.value, r.category, r["count"]) for r in queue] == [("93.184.216.35", "network", 1)]
