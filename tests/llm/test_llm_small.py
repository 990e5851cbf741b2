"""Document operators against libraries, brute force and round trips."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from cloakwork.llm import bpe, exact_dedup, langid, ngram_join, packing, pii, quality, sharding, toxicity, wordpiece

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "A", "x" * 70_000, "a b " * 20_000, "é\U0001f600 ՘ ½²_", "<|endoftext|> a<|endoftext|>", "it's  we'll\t\r\n x", "aaaaaaa", "same", "same", "1234 56"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts beside columns whose names clash with results."""
    rows = [(i, t, None if i % 3 else "en", "s", "clash", i) for i, t in enumerate(ODD)] + [(None, "null id", "en", None, "clash", 0), (12, "same", "en", "s", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids_sha256 string, shard int").withColumn("key", F.lit(1)).withColumn("score", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# -- 1 -------------------------------------------------------------------------


def library():
    t = tokenizers.Tokenizer.from_file(VOCAB)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library_on_fuzz():
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "!", "'s", "'", "<|endoftext|>", "՘", "\U00011de0", "½", "\U0001f600", "日本", "\x1c", "\x85", " ", "_", "aaaa", "\r\n", "̀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [t or "" for t in ODD]
    own, lib = bpe.ByteBPE(VOCAB), library()
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert [own.library_ids(t).tolist() for t in texts] == want
    assert [own.decode(np.array(w, "<u4").tobytes()) for w in want] == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_bpe_tables_may_be_small(monkeypatch):
    texts = [f"word{i} other{i % 7} x" for i in range(500)]
    own = bpe.ByteBPE(VOCAB)
    for table in (own._spaced, own._plain, own._words):
        table.most = 10
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in sum((own.encode(texts[i : i + 3]) for i in range(0, 500, 3)), [])] == want


def test_bpe_rows(odd):
    lib = library()
    rows = bpe.encode_documents(odd, VOCAB, keep_text=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = "null id" if r.doc_id is None else "same" if r.doc_id == 12 else ODD[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, text)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(odd.limit(0), VOCAB).count() == 0
    back = bpe.decode_ids(bpe.encode_documents(odd, VOCAB), VOCAB).where("doc_id = 4").head()
    assert back.decoded == "a"


# -- 2, 6 ----------------------------------------------------------------------


def test_language_on_held_out_rows(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows} == {i for (i,) in docs.select("doc_id").collect() if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_without_letters(odd):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" for i in (0, 1, 2, 3, 14)) and by[4].lang_pred == "en"
    none = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


def test_language_is_learned_from_whole_texts(spark):
    """What tells the languages apart lies beyond the first thousand characters; some texts begin with a thousand digits."""
    rng = random.Random(5)
    said = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(300))
    rows = [(i, ("same words " * 100, "1 " * 1000)[i // 2 % 2] + said("abcd" if i % 2 else "efgh"), "x" if i % 2 else "y") for i in range(400)]
    done = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert done and all(r.lang_pred == "yx"[r.doc_id % 2] for r in done)


def test_bags_of_long_texts(monkeypatch):
    text = "ab Üc " * 50
    whole = np.unique(np.concatenate(langid.subwords(langid.code_points(text), langid.BUCKETS)), return_counts=True)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    assert all((a == b).all() for a, b in zip(langid.bag(text), whole, strict=True))


def brute_probabilities(model, text):
    """Mean of the buckets' rows, pair by pair and triple by triple, one character at a time."""
    points = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()}  "]
    total, n = np.zeros(len(model.languages)), 0
    for a, b, c in zip(points, points[1:], points[2:]):
        pair = (a * 0x9E3779B1 ^ b * 0x85EBCA77) & 0xFFFFFFFF
        triple = (pair * 0xC2B2AE3D ^ c * 0x27D4EB2F) & 0xFFFFFFFF
        for h in (pair, triple):
            total += model.table[(h ^ h >> 15) & len(model.table) - 1]
            n += 1
    z = (total / n + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_language_scores_equal_brute_force(docs):
    rows = docs.where("lang is not null and text is not null").limit(120).collect()
    model = langid.train([r.text for r in rows], [r.lang for r in rows])
    for text in ["Ein Wort", "a", "É!", rows[0].text[:500], rows[1].text[:300]]:
        assert np.allclose(model.probabilities([text])[0], brute_probabilities(model, text), atol=1e-6)


def test_rare_languages_are_learned(spark):
    """Twelve rows of a language among 6,000, and one id on many rows."""
    rng = random.Random(2)
    common = [f"alpha{k} beta gamma the house and water" for k in range(50)]
    rare = ["það er hús við ána", "ég á þrjá hesta", "hún fór út í búð", "við þökkum fyrir það"]
    rows = [(i, " ".join(rng.sample(common, 3)), "en") for i in range(6000)]
    rows += [(10_000 + i, f"{rng.choice(rare)} {rng.choice(rare)}", "is") for i in range(20)]
    rows += [(77_771, "der hund und die katze", "de")] * 3000
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), sample_rows=300).collect()}
    assert sum((10_000 + i, "is") in got for i in range(20)) >= 19
    assert sum((i, "en") in got for i in range(6000)) >= 5990 and (77_771, "de") in got
    sample = common_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 300)
    assert sample == {"en": 300, "is": 20, "de": 1}


def common_sample(df, most):
    from cloakwork.llm.common import bounded_sample

    return {r.lang: r["count"] for r in bounded_sample(df, "doc_id", most, "lang").groupBy("lang").count().collect()}


def test_language_scores_are_calibrated():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc" if k % 2 else "cde") for _ in range(12)) for k in range(400)]
    model = langid.train(texts, ["x" if k % 2 else "y" for k in range(400)])
    p = model.probabilities(texts)
    right = p.argmax(axis=1) == np.array([0 if k % 2 else 1 for k in range(400)])
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.08


def test_toxicity_learns_pairs():
    """Two words that are harmless alone: only their pair is toxic."""
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words = ["insult"] * a + ["group"] * b + [f"w{rng.randint(0, 200)}" for _ in range(8)]
        rows.append((" ".join(words), int(a and b)))
    model = toxicity.train([(np.array(toxicity.text_terms(t)), y) for t, y in rows[:1000]])
    place = {int(b): i for i, b in enumerate(model.buckets)}
    said = [model.logit([place[b] for b in toxicity.text_terms(t) if b in place]) >= 0 for t, _ in rows[1000:]]
    assert sum(s == bool(y) for s, (_, y) in zip(said, rows[1000:], strict=True)) >= 0.95 * 500


def test_toxicity_features_beyond_frequent_insults():
    """A rare insult in a large sample, a context that makes an insult harmless, and two words that tell only together."""
    rng = random.Random(6)
    texts = []
    for i in range(6000):
        insult, context = rng.random() < 0.2, rng.random() < 0.3
        rare, one, two = i % 200 == 0, *(rng.random() < 0.5 for _ in "ab")
        words = ["insult"] * insult + ["quotation"] * context + ["scoundrel"] * rare + ["left"] * one + ["right"] * two + [f"w{rng.randint(0, 300)}" for _ in range(6)]
        texts.append((" ".join(words), int(rare or insult and not context or one == two)))
    model = toxicity.train([(np.array(toxicity.text_terms(t)), y) for t, y in texts])
    place = {int(b): i for i, b in enumerate(model.buckets)}
    score = lambda t: model.logit([place[b] for b in toxicity.text_terms(t) if b in place])
    assert {b for w in (b"scoundrel", b"left", b"right") for b in toxicity.word_buckets(w)} <= place.keys()
    assert score("left right") > 0 > score("left") and score("left scoundrel") > 0 > score("left quotation insult")


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.toxicity(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)


def test_toxicity_scores_equal_brute_force(docs, labels):
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    sample = [(np.array(toxicity.text_terms(r.text), np.int32), toxic[r.doc_id]) for r in docs.collect() if r.doc_id in toxic]
    model = toxicity.train(sample)
    texts = [r.text or "" for r in docs.limit(40).collect()]
    got = [r[0] for r in docs.sparkSession.createDataFrame([(t,) for t in texts], "text string").select(toxicity.score_column(docs, model)).collect()]
    place = {b: i for i, b in enumerate(model.buckets.tolist())}
    for text, score in zip(texts, got, strict=True):
        have = [place[t] for t in toxicity.text_terms(text) if t in place]
        z = model.bias + sum(model.weights[i] for i in have) + sum(float(model.vectors[i] @ model.vectors[j]) for i in have for j in have if i < j)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_takes_one_row_of_each_id(spark):
    docs = spark.createDataFrame([(i % 30, f"text {i % 30}") for i in range(15_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert len(toxicity.labelled_sample(docs, labels)) == 30 and len(toxicity.labelled_sample(docs, labels, 5)) == 10


def test_toxicity_odd_rows(spark, odd, labels):
    empty = labels.limit(0)
    rows = toxicity.toxicity(odd, empty).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    assert toxicity.remove_toxic(odd, empty).count() == 0 and toxicity.remove_toxic(odd, empty, threshold=0.6).columns == odd.columns


# -- 3 -------------------------------------------------------------------------


def minimax(sizes, shards):
    def fits(cap):
        used, left = 1, cap
        for s in sizes:
            if s > left:
                used, left = used + 1, cap
            left -= s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("n,shards", [(1, 3), (5, 8), (40, 4), (200, 7), (64, 64)])
def test_minimax_capacity(spark, n, shards):
    rng = random.Random(n)
    sizes = [rng.randint(1, 1000) for _ in range(n)]
    row = sharding.minimax_cuts(spark.createDataFrame([(3 * i, s) for i, s in enumerate(sizes)], "cell int, bytes long"), shards, 1 << 10).head()
    assert row.capacity == minimax(sizes, shards)
    sums, at = [], 0
    for c in row.cuts:
        sums.append(sum(sizes[at : c // 3 + 1]))
        at = c // 3 + 1
    assert at == n and len(sums) <= shards and max(sums) == row.capacity


def test_minimax_of_nothing(spark):
    row = sharding.minimax_cuts(spark.createDataFrame([], "cell int, bytes long"), 4, 16).head()
    assert (row.capacity, row.cuts) == (0, [])


def check_shards(rows, source, shards):
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == sorted(i if i is not None else -1 for i, _ in source)
    texts = dict(source)
    by_text, slots = {}, {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        assert by_text.setdefault(t, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards(docs, odd):
    rows = sharding.shard_rows(docs, 10).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 10)
    loads = {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert len(loads) == 10 and max(loads.values()) <= 1.3 * sum(loads.values()) / 10
    small = odd.select("doc_id", "text")
    check_shards(sharding.shard_rows(odd, 4).collect(), [(r.doc_id, r.text) for r in small.collect()], 4)
    assert sharding.shard_rows(odd.limit(0), 4).count() == 0


def test_forty_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    loads = [r.b for r in sharding.shard_rows(docs, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    mean = sum(loads) / 40
    assert len(loads) == 40 and min(loads) >= 0.95 * mean and max(loads) <= 1.08 * mean, (min(loads) / mean, max(loads) / mean)


def test_one_large_group_leaves_the_others_even(spark):
    rows = [(i, "hot" * 50) for i in range(300)] + [(1000 + i, f"text {i} " * 5) for i in range(600)]
    loads = {r.shard: r.b for r in sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    rest = sorted(loads.values())[:-1]
    assert len(loads) == 8 and max(rest) <= 1.25 * min(rest)


# -- 4 -------------------------------------------------------------------------


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


def check_groups(got, rows):
    groups = brute_groups(rows)
    kept = {}
    for r in got:
        t = next(t or "" for i, t in rows if i == r.doc_id and hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256)
        g = groups[t]
        known = [i for i in g if i is not None]
        assert r.group_size == len(g) and r.keep_id == (max(known) if known else None)
        kept[t] = kept.get(t, 0) + r.kept
    assert len(got) == len(rows) and set(kept.values()) == {1} and set(kept) == set(groups)


def test_exact_groups(docs, odd):
    for df, keys in ((docs, 8), (odd, 4096)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        check_groups(exact_dedup.exact_groups(df, bucket_keys=keys).collect(), rows)
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0
    one = exact_dedup.keep_one(odd)
    assert one.columns == odd.columns and one.count() == len({t or "" for t in ODD} | {"null id"})


def test_colliding_keys_are_chained(spark, monkeypatch):
    """All texts under one key: bytes decide, and the bucket is never split below one key."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rows = [(i, f"t{i % 5}") for i in range(40)]
    check_groups(exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), bucket_keys=1).collect(), rows)


def test_directory_splits_by_doubling():
    rng = random.Random(6)
    for bits in (1, 3):
        keys = sorted(((1 << 64) - (1 << 64 - bits) | rng.getrandbits(64 - bits)) - (1 << 64) for _ in range(500)) + [(5 << 40) - (1 << 64 - bits) + k for k in range(300)]
        directory = exact_dedup.Directory(bits, 20)
        for k in rng.sample(keys, len(keys)):
            directory.add(k, (k,))
        rows = list(directory.rows((1 << bits) - 1))
        assert sorted(k for _, _, k, _ in rows) == sorted(keys) and all(e == (k,) for _, _, k, e in rows)
        held = {}
        for d, p, k, _ in rows:
            assert k % (1 << 64) >> (64 - d) == p
            held[d, p] = held.get((d, p), 0) + 1
        assert max(n for (d, _), n in held.items() if d < bits + exact_dedup.MOST_DOUBLINGS) <= 20 and len(directory.slots) == 1 << directory.depth <= 1 << exact_dedup.MOST_DOUBLINGS
        spans = sorted((p << (64 - d), (p + 1) << (64 - d)) for d, p in held)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_index_without_listing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LISTED", 3)
    rows = [(i, f"t{i % 50}" if i % 3 else f"alone {i}") for i in range(300)] + [(7, "t7"), (299, "t49"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_groups(exact_dedup.exact_groups(df, bucket_keys=2).collect(), rows)
    assert sorted(map(repr, exact_dedup.keep_one(df).collect())) == sorted({repr(r) for r in exact_dedup.keep_one(df).collect()})
    assert exact_dedup.keep_one(df).count() == len({t or "" for _, t in rows})


# -- 5 -------------------------------------------------------------------------

KEY = pii.Feistel(b"test key")
VALUES = [
    ("card", "4952935900253052"),
    ("card", "4012 8888 8888 1881"),
    ("phone", "+1 (017) 555-7713"),
    ("phone", "+39 344 0405580"),
    ("phone", "(415) 555-1234"),
    ("ip", "169.122.221.182"),
    ("ssn", "123-45-6789"),
    ("iban", "DE89 3704 0044 0532 0130 00"),
    ("date", "2024-02-29"),
    ("date", "31.12.1999"),
    ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ("email", "the.72@mail3.example.com"),
]


@pytest.mark.parametrize("kind,value", VALUES)
def test_pseudonyms_keep_format_and_can_be_undone(kind, value):
    text = f"a {value}, b {value}."
    new, spans = pii.pseudonymise_text(text, KEY)
    assert [s[2] for s in spans] == [kind, kind] and value not in new and spans[0][3] == spans[1][3]
    shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
    if kind in ("card", "phone", "ssn", "iban", "date"):
        assert shape(spans[0][3]) == shape(value)
    assert pii.pseudonymise_text(new, KEY, back=True)[0] == text
    assert pii.pseudonymise_text(text, pii.Feistel(b"other"))[0] != new


def test_what_is_not_valid_stays():
    for text in ("4785380592391138", "999.1.1.1", "2023-02-30", "000-12-3456", "1.2.3.4.5", "id 1234567", "a@b", "x" * 5000, ""):
        assert pii.pseudonymise_text(text, KEY) == (text, [])


@pytest.mark.parametrize("before,value,after", [
    ("", "4111 1111 1111 1111", " 12/25"), ("", "4111 1111 1111 1111", " 123"), ("", "4111111111111111", " 123"), ("12 ", "4111 1111 1111 1111", ""),
    ("12 34 5678 ", "4012-8888-8888-1881", " 99 7"), ("", "3782 822463 10005", " 1234"), ("", "4111 1111 1111 1111", " 2025-12-31"), ("7 8 9 ", "4111111111111111", " 415 555 1234"),
    ("", "BE68 5390 0754 7034", " EUR"), ("", "AT61 1904 3002 3457 3201", " BIC"), ("DE12 ", "BE68 5390 0754 7034", " EUR 2024"), ("", "BE68539007547034", " EUR")])
def test_values_beside_short_groups(before, value, after):
    """The longest run around the value fails its check; the value alone passes."""
    kind = "iban" if value[0].isalpha() else "card"
    new, spans = pii.pseudonymise_text(before + value + after, KEY)
    mine = [s for s in spans if s[2] == kind]
    assert [(s, e) for s, e, _, _ in mine] == [(len(before), len(before + value))] and value not in new
    assert mine[0][3] == pii.pseudonymise_text(value, KEY)[0]


def test_lists_of_small_numbers_are_no_cards():
    text = "see " + " ".join(str(i % 90 + 10) for i in range(300))
    assert not list(pii._cards_within(text, [], KEY, False))


@pytest.mark.parametrize("bound", [1, 2, 10, 97, 1000, 73_049])
def test_feistel_is_a_permutation(bound):
    sample = range(min(bound, 2000))
    out = [KEY.permute(v, bound, b"t") for v in sample]
    assert len(set(out)) == len(out) and all(0 <= v < bound for v in out)
    assert [KEY.permute(v, bound, b"t", back=True) for v in out] == list(sample)


def test_pseudonymise_rows(docs, odd):
    done = pii.pseudonymise(docs, b"k")
    assert done.columns == [*docs.columns, "n_values", "kinds"]
    pairs = done.withColumnRenamed("text", "new").join(docs.select("doc_id", "text"), "doc_id").collect()
    feistel = pii.Feistel(b"k")
    for r in pairs:
        want, spans = pii.pseudonymise_text(r.text, feistel)
        assert (r.new, r.n_values) == (want, len(spans))
    assert sum(r.n_values for r in pairs) > 0
    clash = pii.pseudonymise(odd.withColumn("n_values", F.lit("x")).withColumn("we.ird", F.lit(1)), b"k")
    assert clash.count() == odd.count() and dict(clash.dtypes)["n_values"] == "int"
    assert pii.pseudonymise(odd.limit(0), b"k").count() == 0
    spans = pii.pseudonym_spans(docs, b"k").collect()
    assert len(spans) == sum(r.n_values for r in pairs)


def test_dates_are_permuted_within_their_shape():
    """Every date of a shape: images are dates of the shape, all different, and come back."""
    import datetime

    days = [datetime.date.fromordinal(n) for n in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())]
    shapes = {}
    for d in days:
        for text in (f"{d:%Y-%m-%d}", f"{d:%d/%m/%Y}", f"{d:%m/%d/%Y}", f"{d.day}/{d.month}/{d.year}", f"{d.month}.{d.day}.{d.year}"):
            shapes.setdefault(tuple(map(len, text.replace(".", "/").replace("-", "/").split("/"))), set()).add(text.replace(".", "/"))
    assert len(shapes) == 5
    for shape, texts in shapes.items():
        texts = sorted(texts)[:: 1 if len(texts) < 10_000 else 7]
        images = {t: pii._date(KEY, t, False) for t in texts}
        assert len(set(images.values())) == len(texts)
        for t, image in images.items():
            assert tuple(map(len, image.replace("-", "/").split("/"))) == shape and pii._date(KEY, image, True) == t


def test_whole_domain_of_a_shape_is_its_image():
    texts = {f"{p}/{q}/{y}" for y in range(1900, 2100) for p in range(1, 10) for q in range(1, 10)}
    assert {pii._date(KEY, t, False) for t in texts} == texts


def test_phones_are_linked_over_spellings():
    digits = lambda t: "".join(c for c in t if c.isdigit())
    for spellings in (["+1 (415) 555-1234", "+14155551234", "+1 415.555.1234", "+1-415-555-1234"], ["+39 344 0405580", "+393440405580"], ["+351 912 345 678", "+351912345678"]):
        images = {digits(pii.pseudonymise_text(f"call {t} now", KEY)[0]) for t in spellings}
        assert len(images) == 1 and images != {digits(spellings[0])}
    assert digits(pii._phone(KEY, "(415) 555-1234", False)) == digits(pii._phone(KEY, "+1 (415) 555-1234", False))[1:]


def brute_values(text, key):
    """Values found by trying every start and end of short texts against the checks alone."""
    found = []
    for i in range(len(text)):
        for j in range(len(text), i, -1):
            t = text[i:j]
            if not (t[0].isalnum() or t[0] in "+(") or not t[-1].isalnum() or (i and (text[i - 1].isalnum() or text[i - 1] in "+.-/")) or (j < len(text) and text[j].isalnum()):
                continue
            if all(c in "0123456789 -" for c in t) and t.replace(" ", "").replace("-", "").isdigit() and len(t) - len("".join(t.split())) < 5 and pii._card(key, t, False):
                found.append((i, j, "card"))
            elif t.count(".") == 3 and all(p.isdigit() and len(p) < 4 for p in t.split(".")) and pii._ip(key, t, False):
                found.append((i, j, "ip"))
            elif len(t) == 11 and t[3] == t[6] == "-" and t.replace("-", "").isdigit() and pii._ssn(key, t, False):
                found.append((i, j, "ssn"))
            else:
                continue
            break
    return found


def test_finds_equal_brute_force():
    rng = random.Random(8)
    values = ["4952935900253052", "4012 8888 8888 1881", "169.122.221.182", "123-45-6789", "4111-1111-1111-1111"]
    noise = ["word", "x1", "999.1.2.3", "000-12-3456", "4111 1111 1111 1112", "a.b", "v1.2", "("]
    for _ in range(300):
        parts = [rng.choice(values + noise) for _ in range(rng.randint(1, 4))]
        text = " and ".join(parts)
        assert [(s, e, k) for s, e, k, _ in pii.find_values(text, KEY)] == brute_values(text, KEY), text


# -- 7 -------------------------------------------------------------------------


def check_packing(rows, texts, most, segments, end=1):
    lib = library()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*lib.encode(texts[i] or "", add_special_tokens=False).ids, end], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= most and len(pieces) <= segments
    held = [sum(p.length for p in pieces) for pieces in by_seq.values()]
    return 1 - sum(most - n for n in held if n & (n - 1)) / sum(n if n & (n - 1) == 0 else most for n in held)


def test_packing(docs, odd, spark):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert check_packing(packing.pack_documents(docs, VOCAB).collect(), texts, 2048, 512) == 1
    check_packing(packing.pack_documents(docs, VOCAB, max_tokens=64, max_segments=2, pool=8).collect(), texts, 64, 2)
    few = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(few, VOCAB).collect(), {r.doc_id: r.text for r in few.collect()}, 2048, 512)
    assert packing.pack_documents(odd.limit(0), VOCAB).count() == 0


def test_packing_leaves_no_padding(spark):
    """Many small tasks, and texts so short that segments run out before tokens do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(64)
    assert check_packing(packing.pack_documents(docs, VOCAB).collect(), {r.doc_id: r.text for r in docs.collect()}, 2048, 512) == 1
    short = {i: f"w{i} x" for i in range(20_000)}
    df = spark.createDataFrame(list(short.items()), "doc_id long, text string").repartition(5)
    rows = packing.pack_documents(df, VOCAB, max_segments=64).collect()
    assert check_packing(rows, short, 2048, 64) == 1
    rows = packing.pack_documents(df, VOCAB).collect()
    assert len({r.sequence_id for r in rows}) <= 1.05 * sum(r.length for r in rows) / 2048 + 5 * 11


def test_three_limits_hold(docs):
    rows = packing.pack_documents(docs.withColumn("p", F.length("text") / 2), VOCAB, max_tokens=256, max_segments=3, max_loss_tokens=100, prompt_chars="p", keep_ids=True, pool=32).collect()
    by_seq = {}
    for r in rows:
        assert len(r.ids) == r.length and 0 <= r.loss_tokens <= r.length
        s = by_seq.setdefault(r.sequence_id, [0, 0, 0])
        s[0] += r.length
        s[1] += 1
        s[2] += r.loss_tokens
    assert all(a <= 256 and a & (a - 1) == 0 and b <= 3 and c <= 100 for a, b, c in by_seq.values())
    assert max(c for _, _, c in by_seq.values()) == 100
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    check_packing(rows, texts, 256, 3)


# -- 8 -------------------------------------------------------------------------


LONGEST = 200  # bytes that a piece of the vocabulary has at most


def greedy(word, initial, continuing):
    i = n = 0
    while i < len(word):
        for j in range(min(len(word), i + LONGEST), i, -1):
            if word[i:j] in (continuing if i else initial):
                i, n = j, n + 1
                break
        else:
            return -1
    return n


def test_automaton_equals_greedy():
    rng = random.Random(2)
    piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4)))
    for _ in range(150):
        a, b = {piece() for _ in range(rng.randint(1, 12))}, {piece() for _ in range(rng.randint(1, 12))}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(40)]
        automaton = wordpiece.Automaton(a, b)
        want = [greedy(w, a, b) for w in words]
        assert automaton.count(words).tolist() == want and [automaton.count_one(w) for w in words] == want


def test_long_words_equal_greedy():
    a, b = wordpiece.pieces_of(VOCAB)
    automaton = wordpiece.Automaton(a, b)
    assert max(map(len, a | b)) <= LONGEST
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(n)) for n in (511, 512, 513, 5000)] + [b"short", b"x" * 2_000_000]
    got = automaton.count(words).tolist()
    assert got[:-1] == [greedy(w, a, b) for w in words[:-1]] and got[-1] == automaton.count_one(words[-1]) > 0


def test_token_counts(docs, odd):
    a, b = wordpiece.pieces_of(VOCAB)
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: (r.text or "").encode().split() for r in df.select("doc_id", "text").collect()}
        for r in wordpiece.count_tokens(df, VOCAB).collect():
            words = texts[r.doc_id]
            assert (r.n_words, r.n_unknown) == (len(words), 0)
            assert r.n_tokens == sum(greedy(w, a, b) for w in words)
    assert wordpiece.count_tokens(odd.limit(0), VOCAB).count() == 0


# -- 9 -------------------------------------------------------------------------


def brute_repeats(words):
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)})


def test_repeated_words_equal_brute_force():
    rng = random.Random(8)
    for n in (0, 3, 5, 6, 50, 400):
        for kinds in (1, 2, 5, 5000):
            words = [str(rng.randrange(kinds)).encode() for _ in range(n)]
            words += words[:7]
            assert quality.repeated_words(words) == brute_repeats(words)


def test_counts_equal_brute_force(docs):
    """Every count of random texts and of real ones, from its definition alone."""
    import re

    rng = random.Random(10)
    alphabet = ["a", "bc", "é", "\U0001f600", "#", "*$", "<>", " ", " ", "\t", "\n", "\n", "\x0b", "\x0c", "\r", "\u00a0", "\x1c", "same line\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [r.text for r in docs.limit(60).collect()] + [None, "", " \n "]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines)), brute_repeats(words), len(lines))
        assert quality.text_counts(text) == want


def test_counts_and_base_rule(odd):
    assert quality.text_counts("a # b\n\na # b\nÉé|\x0b") == (7, 9, 3, 1, 0, 3)
    rows = quality.quality_verdicts(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.quality_verdicts(odd.limit(0)).count() == 0


def test_fences_equal_exact_quantiles(spark):
    """Groups under the sketch's size are exact: the verdict is that of sorted values."""
    rng = random.Random(9)
    docs = []
    for i in range(120):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(60)]
        docs.append((i, " ".join(w + "#$" * (i % 20 == 0) for w in words), "en", "s"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in quality.quality_verdicts(df).collect()}
    for name, (_, floor, lower) in quality.RATES.items():
        values = sorted(r[name] for r in rows.values())
        q1, q3 = values[int(np.ceil(0.25 * 120)) - 1], values[int(np.ceil(0.75 * 120)) - 1]
        spread = max(q3 - q1, floor) * quality.FENCE
        for r in rows.values():
            if r[name] > q3 + spread or lower and r[name] < q1 - spread:
                assert not r.kept
    assert {i for i, r in rows.items() if not r.kept} == {i for i in range(120) if i % 20 == 0}


def test_fences_follow_groups_whose_quartiles_are_equal(spark):
    """Most documents repeat nothing; the same repeat is common in one source and rare in the other."""

    def text(i, repeats):
        words = [f"w{i}x{k}" for k in range(50)]
        return " ".join(words + words[: 5 * repeats]) if repeats else " ".join(words)

    docs = [(1000 * g + i, text(i, int(i < (1, 20)[g])), "en", s) for g, s in enumerate("ab") for i in range(200)]
    rows = quality.quality_verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in rows) and sum(r.repeat_rate > 0.15 for r in rows) == 21
    assert [r.doc_id for r in rows if not r.kept] == [0]


# -- 10 ------------------------------------------------------------------------


def brute_components(rows, n, t):
    sets = {i: ngram_join.shingle_tuples(ngram_join.split_words(x), n) for i, x in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and both >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrst") for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice([[], ["zz"], [f"qq{rng.randint(0, 3)}"]])
        rows.append((i, " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one")]


@pytest.mark.parametrize("n,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_components_equal_brute_force(spark, n, t):
    rows = near_copies(n, 220)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn("a", F.lit(0)).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(df, n=n, similarity=t).collect()}
    assert got == brute_components(rows, n, t)


def test_neighbourhood_segments_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "VERIFY_COST", 1e9)
    monkeypatch.setattr(ngram_join, "MOST_SENT", 100)
    assert any(b.near for b in ngram_join.Bands(Fraction(4, 5), 60, {k: 100 for k in range(30)}).bands)
    rows = near_copies(7, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=3, similarity=Fraction(4, 5)).collect()}
    assert got == brute_components(rows, 3, Fraction(4, 5))


def test_odd_rows_and_keep_one(odd):
    rows = ngram_join.link_documents(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[13].component_id == 12 and by[5].component_id == 4 and by[0].component_id == 0 and by[0].n_shingles == 0
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = ngram_join.keep_one(odd, n=3, similarity=Fraction(9, 10))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows} - {5, 13}
    assert ngram_join.link_documents(odd.limit(0)).count() == 0


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for size, other in ((1, 1), (10, 10), (500, 500), (5000, 5000), (5000, 900), (300, 4000)):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64))
        b = np.unique(np.concatenate([a[: other // 2], rng.integers(0, 1 << 63, other, dtype=np.int64).astype(np.uint64)]))
        x, y = ngram_join.parity_sketch(a), ngram_join.parity_sketch(b)
        apart = ngram_join.apart_at_least([x, x, y], [y, x, x]).tolist()
        assert 0 < apart[0] <= len(np.setxor1d(a, b)) and apart[1] == 0 and apart[2] == apart[0]


def test_sets_that_share_a_name_are_named_anew(spark, monkeypatch):
    seeds = []
    describe = ngram_join._describe

    def colliding(rows, n, seed):
        seeds.append(seed)
        thin = describe(rows, n, seed)
        return thin.withColumn("set_id", F.lit(5).cast("long")) if seed == 0 else thin

    monkeypatch.setattr(ngram_join, "_describe", colliding)
    rows = near_copies(5, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seeds == [0, 1] and got == brute_components(rows, 3, Fraction(9, 10))


def test_word_hashes_follow_words(monkeypatch):
    """Equal words have equal hashes wherever they stand; different ones differ; texts are cut at the six blanks."""
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", 3000)
    rng = random.Random(12)
    alphabet = ["a", "b", "A", "B", "é", "\U0001f600", "\u00a0", "\x00", " ", " ", "\t", "\n", "\v", "\f", "\r", "\x1c", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "x" * 63, "x" * 64, "x" * 65, "y" * 200_000 + " z", " ".join("w" * k for k in range(1, 140))]
    texts += [" ".join(rng.choice(["ab", "Ab", "ba"]) for _ in range(60_000))]
    known: dict[bytes, int] = {}
    for text, hashes in zip(texts, ngram_join.Hasher(3).word_hashes(texts), strict=True):
        words = ngram_join.split_words(text)
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 500


def test_meetings_in_many_blocks_lose_no_link(spark, monkeypatch):
    """Copies of one text, each further away than the one before: components that only meet in round two."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 600)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    rng = random.Random(3)
    rows = []
    for family in range(3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for i in range(60):
            w = list(words)
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                w[rng.randrange(60)] = f"v{rng.randrange(4)}"
            rows.append((100 * family + i, " ".join(w)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=3, similarity=Fraction(7, 10)).collect()}
    want = brute_components(rows, 3, Fraction(7, 10))
    assert got == want and 3 < len({c for _, c in want.values()}) < 180


def test_keep_one_beside_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 1, 2, 3, 4)], "doc_id long, text string, _gone_id int, gone_id int, _keep_id int, keep_id int")
    for kept in (ngram_join.keep_one(df), exact_dedup.keep_one(df)):
        assert kept.columns == df.columns and kept.count() == 1
