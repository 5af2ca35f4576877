"""Dealt operators on small tables: plain versions, and awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolwise.llm import bagminhash, exact_dedup, jpeg, media, mixing, near_dedup, packing, pii, pseudo_lm, shingles, toxicity
from poolwise.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"
LONG = " ".join(f"wort{k * 7919 % 5003}" for k in range(12_000))
WORDS = [f"w{k}" for k in range(400)]


def documents(spark, texts, sources=("s1", "s2", "s3")):
    rows = [(i, t, ("en", "fr", None)[i % 3] if i is not None else "en", sources[(i or 0) % len(sources)], len(t or ""), "clash", 0.5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, a long one, ties, repeated rows, and columns that clash with results."""
    texts = [(1, "a b c"), (2, "abc"), (3, "a  b c"), (4, None), (5, ""), (6, " \n"), (7, LONG), (8, LONG + " more"), (None, "nobody knows it"), (9, "a b c"), (9, "a b c"), (10, "Ünïcode 🙂 text"), (None, "a b c")]
    return documents(spark, texts)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def test_exact_groups(spark, awkward, empty):
    rows = exact_dedup.exact_dedup(awkward).collect()
    assert len(rows) == awkward.count()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "")].append(r)
    for members in groups.values():
        keep = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        assert all(r["group_size"] == len(members) and r["keep_id"] == keep for r in members)
        assert sum(r["kept"] for r in members) == 1
    assert exact_dedup.exact_dedup(empty).count() == 0
    stays = exact_dedup.drop_exact_copies(awkward)
    assert stays.columns == awkward.columns and stays.count() == len(groups) and {r["kept"] for r in stays.collect()} == {"clash"}


def test_exact_beyond_the_broadcast_bound(spark, awkward, monkeypatch):
    """Shuffled joins give what broadcast ones do."""
    rows = lambda: sorted(map(repr, exact_dedup.exact_dedup(awkward).select("doc_id", "keep_id", "group_size", "kept").collect()))
    broadcast = rows()
    monkeypatch.setattr(exact_dedup, "small", lambda df: df)
    assert rows() == broadcast


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(text):
    out = {}
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = {
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    for kind in pii.BASE:
        out[kind] = [(m.start(), m.end()) for m in re.finditer(pii.PLAIN[kind], text) if checks.get(kind, lambda _: True)(m[0])]
    return out


def test_pii_spans(spark, awkward, empty):
    texts = [
        "mail a.b@c.de_x@y.org or +49 (30) 1234-5678, ip 10.0.0.1 and 1.2.3.4.5 and 300.1.1.1 and 001.002.3.4",
        "card 4111 1111 1111 1111 é🙂 4111-1111-1111-1112; 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
        "iban DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00; ssn 123-45-6789",
        "123-45-6789 alone, +1 2 3, a@b, a@b.c.d.", "@" * 50 + "+" * 50 + "1" * 3000 + "a" * 3000 + "@x", "", None,
    ]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab@.-_+%0159 ()é🙂") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    rows = pii.find_pii(documents(spark, list(enumerate(texts)))).collect()
    for r in rows:
        expected = plain_pii(texts[r["doc_id"]] or "")
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in pii.BASE} == expected
    got = {r["doc_id"]: r for r in rows}
    assert [(s["start"], s["end"]) for s in got[2]["iban"]] == [(5, 32)] and len(got[2]["nin"]) == 1 and not got[3]["nin"]
    assert [s["score"] for s in got[0]["email"]] == [100, 100] or got[0]["email"][0]["score"] == 100
    assert pii.find_pii(awkward).count() == awkward.count() and pii.find_pii(empty).count() == 0


def similarity(a, b):
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := re.findall(r"\w+", t.lower())) else Counter() for t in (a, b))
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else float(not a and not b)


def plain_classes(texts):
    label = {i: i for i, _ in texts}
    for i, a in texts:
        for j, b in texts:
            if i < j and similarity(a or "", b or "") >= near_dedup.THRESHOLD:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for k in rng.sample(range(len(words)), rng.randint(0, edits)):
            words[k] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


def test_near_classes(spark, awkward, empty, monkeypatch):
    rng = random.Random(5)
    families = [[rng.choice(WORDS) for _ in range(rng.randint(30, 120))] for _ in range(4)]
    texts = [t for f in families for t in near_copies(rng, f, 14, 4)] + ["x y", "x y", "", None, "Say it! Say it!", " ".join(["again"] * 90), " ".join(["again"] * 80)]
    texts = list(enumerate(texts))
    for few, block in ((16, 96), (3, 2), (2, 1)):  # pairs alone; blocks of several sizes
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(documents(spark, texts)).collect()}
        assert got == plain_classes(texts)
    rows = near_dedup.near_classes(awkward).collect()
    assert len(rows) == awkward.count() and near_dedup.near_classes(empty).count() == 0
    stays = near_dedup.drop_near_copies(awkward)
    assert stays.columns == awkward.columns and {r["doc_id"] for r in stays.collect()} == {1, 2, 4, 7, 10, None}


def test_near_classes_of_repeated_ids(spark):
    rng = random.Random(17)
    a, b = ([rng.choice(WORDS) for _ in range(80)] for _ in range(2))
    near = lambda t: " ".join([*t[:-1], "changed"])
    docs = documents(spark, [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "quite another text than those before")])
    rows = sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(docs).collect())
    assert rows == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    stays = sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(docs).collect())
    assert stays == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, "quite another text than those before")])
    same = documents(spark, [(1, "t u v w x"), (1, "t u v w x"), (2, "t u v w x")])
    assert [r["doc_id"] for r in near_dedup.drop_near_copies(same).collect()] == [1]


def test_recall_of_near_classes(spark):
    """Of all pairs of similarity 0.8 or more that have an id divisible by 5, all are in one class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    label = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(rows).collect()}
    units = {r["doc_id"]: shingles.units(r["text"] or "") for r in rows.collect()}
    found = total = 0
    for i in (k for k in units if k % 5 == 0):
        for j, other in units.items():
            low, high = sorted((len(units[i]), len(other)))
            if i != j and low >= 0.8 * high > 0 and near_dedup._overlap(units[i], other) >= near_dedup.THRESHOLD:
                total += 1
                found += label[i] == label[j]
    assert total > 5 and found == total


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        keys = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        a, b = rng.integers(0, 9, 60), rng.integers(0, 20, 60)
        b = np.where(rng.random(60) < 0.7, a, b)
        sign = bagminhash.signatures(np.repeat([0, 1], 60)[np.r_[a, b] > 0], np.r_[keys, keys][np.r_[a, b] > 0], np.r_[a, b][np.r_[a, b] > 0], 2, 1024)
        errors.append((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.03


def test_units_overlap_as_multisets():
    a, b = "to be or not to be or not to be or not to be", "to be or not to be or not to see"
    ua, ub = shingles.units(a), shingles.units(b)
    both = len(np.intersect1d(ua, ub))
    assert both / (len(ua) + len(ub) - both) == similarity(a, b)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(60)]
    label = {x: x for e in links for x in e}
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if v == old else v for k, v in label.items()}
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and {a for a, b in links if a != b} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, awkward, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = [(k, " ".join(random.Random(k).choices(WORDS, k=k * 9))) for k in range(40)] + [(90, "a  b\n c \t"), (91, "x <|endoftext|> y"), (92, None), (93, LONG), (94, " a"), (95, "é 🙂  ")]
    for length in (1024, 64):
        pieces = packing.pack(documents(spark, texts), length=length).collect()
        ids = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts}
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_doc[p["doc_id"]].append(p)
            by_sequence[p["sequence_id"]].append(p)
            assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
        for i, parts in by_doc.items():
            at = 0
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
            assert at == len(ids[i])
        for parts in by_sequence.values():
            at = 0
            for p in sorted(parts, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= length
        assert set(by_doc) == set(ids)
        # full stretches and filled sequences each follow the curve, and only a range's last sequence is padded
        keys = dict(zip(ids, packing.curve_keys(list(ids.values()), packing.projection()).tolist(), strict=True))
        assert all(p["curve_key"] == keys[p["doc_id"]] for p in pieces)
        full = {s for s, parts in by_sequence.items() if len(parts) == 1 and parts[0]["start"] % length == 0 and parts[0]["length"] == length}
        for chosen in (full, set(by_sequence) - full):
            along = [p["curve_key"] for s in sorted(chosen) for p in sorted(by_sequence[s], key=lambda p: p["offset"])]
            assert along == sorted(along)
        assert full and len(by_sequence) == -(-sum(map(len, ids.values())) // length)
    assert packing.pack(empty).count() == 0
    assert len({(p["sequence_id"], p["offset"]) for p in packing.pack(awkward).collect() if p["doc_id"] == 9}) == 2


def test_hilbert_curve_is_continuous():
    n = 1 << 4
    cells = np.stack(np.meshgrid(*[np.arange(n)] * 2), -1).reshape(-1, 2)
    walk = cells[np.argsort(packing.hilbert(cells, 4))]
    assert sorted(packing.hilbert(cells, 4)) == list(range(n * n)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_hilbert_curve_in_as_many_dimensions_as_are_used():
    n = 1 << 3
    cells = np.stack(np.meshgrid(*[np.arange(n)] * packing.DIMS), -1).reshape(-1, packing.DIMS)
    keys = packing.hilbert(cells, 3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(n**packing.DIMS)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_mixing_budgets(spark, awkward, empty):
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for k in range(300)]
    docs = documents(spark, texts, sources=("s0", "s0", "s0", "s1", "s2", "s5", None))
    rows = mixing.mix(docs, share=0.7, max_epochs=2).collect()
    assert len(rows) == 300
    total = sum(len(t.split()) for _, t in texts)
    assert sum(r["tokens_taken"] for r in rows) == int(total * 0.7)
    leaves = defaultdict(list)
    for r in rows:
        leaves[r["domain"], r["lang"] or "", r["source"] or ""].append(r)
    for leaf in leaves.values():
        assert len({r["epochs"] for r in leaf}) == 1
        order = sorted(leaf, key=lambda r: hashlib.md5(f"{mixing.SEED}:{r['epochs']}:{r['doc_id']}".encode()).hexdigest())
        left = sum(r["prefix_tokens"] for r in leaf)
        for r in order:  # a prefix of the epoch's order, cut in one document at most
            assert r["prefix_tokens"] == min(left, r["n_tokens"])
            left -= r["prefix_tokens"]
    assert mixing.mix(empty).count() == 0 and mixing.mix(awkward).count() == awkward.count()
    cut = mixing.mixed_documents(docs, share=0.5)
    assert cut.columns == docs.columns
    kept = {r["doc_id"]: r for r in cut.collect()}
    whole = dict(texts)
    assert all(whole[i].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for i, r in kept.items())
    assert sum(len(r["text"].split()) for r in kept.values()) == int(total * 0.5)


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("d", "en", "a", 10), ("d", "en", "b", 1000), ("d", "fr", "c", 1000), ("e", "en", "f", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {}, "lang": {}, "source": {}}
    got = {r["source"]: r["budget"] for r in mixing.budgets(df, 800 / 3010, 1, weights).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "f": 400}
    small = {r["source"]: r["budget"] for r in mixing.budgets(df.where("source in ('a', 'f')"), 0.9, 1, weights).collect()}
    assert small == {"a": 10, "f": 899}


def test_pipeline_mixes_to_the_target_weights(spark):
    texts = [(k, " ".join(WORDS[k % 7 : k % 7 + 20])) for k in range(210)]
    docs = documents(spark, texts, sources=("s0", "s1", "s2", "s2", "s3", "s3", "s3"))
    out = corpus_pipeline.mixed(spark, docs, None)
    assert out.columns == docs.columns
    plan = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    copies, domains = defaultdict(list), Counter()
    for r in out.collect():
        copies[r["doc_id"]].append(len(r["text"].split()))
        domains["d" + r["source"][1]] += copies[r["doc_id"]][-1]
        assert dict(texts)[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    total = sum(domains.values())
    assert total == int(210 * 20 * mixing.SHARE) and all(abs(domains[d] - total * w / 7) <= 1 for d, w in (("d0", 3), ("d1", 2), ("d2", 1), ("d3", 1)))
    for i, r in plan.items():
        assert sorted(copies[i]) == sorted([20] * r["epochs"] + [r["prefix_tokens"]] * (r["prefix_tokens"] > 0))


def test_toxicity(spark, awkward, empty):
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(1500):
        words = rng.choices(WORDS, k=rng.randint(20, 80))
        toxic = k % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum"]) if k % 4 else "zork" + rng.choice(["an", "el", "is"])
        texts.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, labels = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, flipped).collect()} == {r["doc_id"]: r["score"] for r in rows}
    odd = toxicity.toxicity_scores(awkward, labels.where("false")).collect()
    assert len(odd) == awkward.count() and not any(r["predicted"] for r in odd) and toxicity.toxicity_scores(empty, None).count() == 0
    stays = toxicity.drop_toxic(docs, labels)
    assert stays.columns == docs.columns
    assert {r["doc_id"] for r in stays.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def toy_votes(rng, n):
    """Masks of voters that fire by class; the last pattern repeats the first lexicon voter."""
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.12
        fired = [k for k in range(6) if rng.random() < (0.3 if toxic else 0.002)]
        if 0 in fired and rng.random() < 0.9:
            fired.append(len(toxicity.VOTERS) - 1)
        out.append(sum(1 << k for k in fired))
    return out


def plain_posterior(prior, parent, rate, fired):
    like = [1 - prior, prior]
    for c in (0, 1):
        for i, f in enumerate(fired):
            p = rate[c][int(parent[i] >= 0 and fired[parent[i]])][i]
            like[c] *= p if f else 1 - p
    return like[1] / sum(like)


def test_label_model_against_plain(spark):
    rng = random.Random(11)
    masks = toy_votes(rng, 3000)
    rows = [(m, c) for m, c in Counter(masks).items()]
    model = toxicity.fit_label_model(spark.createDataFrame(rows, "mask long, times long").repartition(5))
    n, worth = len(toxicity.VOTERS), toxicity.WORTH
    fired = {m: [m >> k & 1 for k in range(n)] for m in set(masks)}
    start = toxicity.LabelModel()
    prior, parent, rate, believed = start.prior, [-1] * n, start.rate, start.believed
    for step in range(sum(toxicity.ROUNDS)):
        if step == toxicity.ROUNDS[0]:
            parent = model.parent.tolist()
        post = {m: plain_posterior(prior, parent, rate, f) for m, f in fired.items()}
        size = [sum(c * (p if k else 1 - p) for m, c in rows for p in [post[m]]) for k in (0, 1)]
        rate = [[[0.0] * n, [0.0] * n] for _ in (0, 1)]
        for k in (0, 1):
            weight = {m: c * (post[m] if k else 1 - post[m]) for m, c in rows}
            for i in range(n):
                on = sum(w for m, w in weight.items() if fired[m][i])
                more = worth * size[k] + 1
                alone = (on + believed[k][i] * more) / (size[k] + more)
                for u in (0, 1):
                    if parent[i] < 0:
                        rate[k][u][i] = min(max(alone, 1e-6), 0.999)
                    else:
                        mine = [(m, w) for m, w in weight.items() if fired[m][parent[i]] == u]
                        rate[k][u][i] = min(max((sum(w for m, w in mine if fired[m][i]) + alone) / (sum(w for _, w in mine) + 1), 1e-6), 0.999)
        prior = min(max((size[1] + 1) / (sum(size) + 20), 1e-4), 0.5)
    assert abs(model.prior - prior) < 1e-9 and np.abs(model.rate - np.array(rate)).max() < 1e-8
    last = n - 1
    assert model.parent[last] == 0 or model.parent[0] == last  # the voter that repeats another hangs on it
    assert sum(k >= 0 for k in model.parent) <= 6


def test_classifier_against_plain(spark):
    rng = random.Random(13)
    masks = toy_votes(rng, 800)
    n = len(toxicity.VOTERS)
    model = toxicity.LabelModel()
    rows = [(m, [float((m >> k & 1) * (1 + k % 3)) for k in range(n)], c) for m, c in Counter(masks).items()]
    linear = toxicity.fit_classifier(spark.createDataFrame(rows, "mask long, counts array<float>, times long").repartition(3), model)
    x = np.array([[(m >> k & 1) * (1 + k % 3) for k in range(n)] for m in masks], float)
    plain = toxicity.logistic(np.log1p(x), model.posterior(toxicity._fired(np.array(masks))), ridge=toxicity.RIDGE * len(masks))
    assert np.abs(linear - plain).max() < 1e-5


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    one, many = ({r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(40)))
    assert max(abs(one[k] - many[k]) for k in one) < 1e-9


def test_pseudo_likelihood(spark, awkward, empty):
    rng = random.Random(6)
    cycle = ["the", "old", "cat", "sat", "on", "a", "mat", "and", "then", "slept"]
    texts = [(k, " ".join(cycle * 12)) for k in range(40)]
    for k in range(40, 60):
        words = cycle * 12
        rng.shuffle(words)
        texts.append((k, " ".join(words)))
    rows = {r["doc_id"]: r for r in pseudo_lm.pseudo_likelihood(documents(spark, texts)).collect()}
    ordered = [rows[k]["per_token"] for k in range(40)]
    mixed = [rows[k]["per_token"] for k in range(40, 60)]
    assert min(ordered) > max(mixed) and len(set(ordered)) == 1
    assert all(r["n_tokens"] == 120 and abs(r["score"] - 120 * r["per_token"]) < 1e-6 for r in rows.values())
    apart = {r["doc_id"]: r["score"] for r in pseudo_lm.pseudo_likelihood(documents(spark, texts).repartition(11)).collect()}
    assert all(abs(apart[k] - rows[k]["score"]) < 1e-3 for k in apart)
    odd = pseudo_lm.pseudo_likelihood(awkward).collect()
    assert all(r["score"] <= 0 for r in odd)
    assert len(odd) == awkward.count() and all((r["score"], r["per_token"]) == (0, None) for r in odd if r["doc_id"] in (4, 5, 6))
    assert pseudo_lm.pseudo_likelihood(empty).count() == 0


def test_rare_words_are_told_apart_as_neighbours(spark, monkeypatch):
    rng = random.Random(12)
    pairs = [(f"left{k}q", f"next{k}q") for k in range(100, 140)]
    common = [f"c{k}" for k in range(70)]

    def text(pairs):
        return " ".join(" ".join([*rng.sample(common, 3), *p]) for p in rng.sample(pairs, 20))

    texts = [(k, text(pairs)) for k in range(200)]
    swapped = [(a, pairs[(k + 7) % 40][1]) for k, (a, _) in enumerate(pairs)]  # the same words, other neighbours of the same shape
    for k in range(200, 210):
        state = rng.getstate()
        texts.append((k, text(pairs)))
        rng.setstate(state)
        texts.append((k + 100, text(swapped)))
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r["score"] for r in pseudo_lm.pseudo_likelihood(docs).collect()}
    assert sum(rows[k] > rows[k + 100] + 1 for k in range(200, 210)) >= 9
    monkeypatch.setattr(pseudo_lm, "TABLE", 80)  # counts by the join
    joined = {r["doc_id"]: r["score"] for r in pseudo_lm.pseudo_likelihood(docs).collect()}
    assert all(abs(joined[k] - rows[k]) < 1e-4 for k in rows)


def plain_words(rng, sizes):
    return [rng.integers(1, 1 << 62, n).astype(np.uint64) % np.uint64(90) * np.uint64(0x9E3779B97F4A7C15) for n in sizes]


def test_window_counts_are_plain():
    rng = np.random.default_rng(0)
    texts = plain_words(rng, (0, 1, 2, 7, 300))
    classify = pseudo_lm.Classes(np.unique(np.concatenate(texts))[:40])
    w = pseudo_lm.Windows(texts, classify)
    expected = []
    for t in texts:
        c = classify(t)
        padded = np.r_[0, 0, c, 0, 0]
        near, far = pseudo_lm.inner_group(padded), pseudo_lm.outer_group(padded)
        for k in range(2, len(padded) - 2):
            left, right = near[k - 1] * 4 + far[k - 2], near[k + 1] * 4 + far[k + 2]
            expected.append((left * pseudo_lm.SIDE + right, padded[k]))
    assert list(zip(w.context.tolist(), w.target.tolist(), strict=True)) == [(int(a), int(b)) for a, b in expected]
    assert pseudo_lm.inner_group(np.arange(pseudo_lm.CLASSES)).max() < pseudo_lm.INNER


def test_tokens_are_those_of_split():
    texts = ["a  b c d \x1c e\n", "", " \n", "xyz", "Ünïcode 🙂 text\u00a0x\u2003y", "w " * 50_000, "q" * 700_000 + " q", "a b c d", "Ab9, ab ab"]
    found = pseudo_lm.tokenize(texts)
    assert [len(x) for x in found] == [len(t.split()) for t in texts]
    every = {}
    for text, hashes in zip(texts, found, strict=True):
        for word, h in zip(text.split(), hashes.tolist(), strict=True):
            assert every.setdefault(word, h) == h
    assert len(set(every.values())) == len(every)


def test_gradients_of_the_network():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.02, (pseudo_lm.SIDE**2, pseudo_lm.CLASSES)).astype(np.float64)
    counts[5000:] = 0
    used = np.flatnonzero(counts.sum(1))
    rows, some = pseudo_lm._features()[used], counts[used]
    params = [p.astype(np.float64) for p in pseudo_lm.initial(counts)]
    loss, gradient = pseudo_lm.loss_and_gradient(params, rows, some)
    for p, g in zip(params, gradient, strict=True):
        for at in rng.integers(0, p.size, 6):
            old = p.flat[at]
            p.flat[at] = old + 1e-4
            up = pseudo_lm.loss_and_gradient(params, rows, some)[0]
            p.flat[at] = old - 1e-4
            down = pseudo_lm.loss_and_gradient(params, rows, some)[0]
            p.flat[at] = old
            assert abs((up - down) / 2e-4 - g.flat[at]) < 1e-6
    before, weights, bias = pseudo_lm.train(counts)
    trained = -(some * pseudo_lm.log_softmax(np.tanh(before[used]) @ weights + bias)).sum() / some.sum()
    assert trained < loss - 0.01


def test_sums_are_plain_gradients():
    """Sums by rows of neighbouring words are the gradient of the likelihood by their embeddings, and features add up by member."""
    rng = np.random.default_rng(5)
    texts = plain_words(rng, (30, 3, 1, 0, 40))
    frequent = np.unique(np.concatenate(texts))[:30]
    before = rng.normal(0, 0.4, (pseudo_lm.SIDE**2, pseudo_lm.HIDDEN)).astype(np.float32)
    network = (before, rng.normal(0, 0.4, (pseudo_lm.HIDDEN, pseudo_lm.CLASSES)).astype(np.float32), rng.normal(0, 0.4, pseudo_lm.CLASSES).astype(np.float32))
    rows, members = 1024, 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary())], ["id", "words"])
    got = {}
    for b in pseudo_lm._sums(frequent, network, rows, members)(iter([batch])):
        for kind, row, n, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[kind, row] = (n, sums)
    classify = pseudo_lm.Classes(frequent)
    w = pseudo_lm.Windows(texts, classify)
    words, place = w.flat, {p: k for k, p in enumerate(w.real.tolist())}

    def loss(at, embedding):  # of the token at a place, with one neighbour's embedding added
        k = place[at]
        return pseudo_lm.log_softmax(np.tanh(before[w.context[k]].astype(np.float64) + embedding)[None] @ network[1] + network[2])[0, w.target[k]]

    expected = {}
    for at in place:
        for k, near in enumerate((-1, 1, -2, 2)):
            if at + near in place:
                row = k * rows + int(pseudo_lm.row_of(words[at + near : at + near + 1], k, rows)[0])
                step = [(loss(at, e) - loss(at, -e)) / 2e-4 for e in np.eye(pseudo_lm.HIDDEN) * 1e-4]
                n, sums = expected.get(row, (0, 0))
                expected[row] = (n + 1, sums + np.array(step))
    assert {r for k, r in got if k == 0} == set(expected)
    for row, (n, sums) in expected.items():
        assert got[0, row][0] == n and np.abs(np.array(got[0, row][1][: pseudo_lm.HIDDEN]) / pseudo_lm.UNIT - sums).max() < 0.01 * n
    assert sum(n for (k, _), (n, _) in got.items() if k == 1) == sum(c > pseudo_lm.FREQUENT for c in w.target)


def test_outcomes_are_distributions():
    rng = np.random.default_rng(6)
    x, weights, bias = rng.normal(0, 2, (3000, 8)), rng.normal(0, 3, (8, 12)), rng.normal(0, 1, 12)
    each = np.stack([pseudo_lm.chosen(x, weights, bias, np.full(3000, k)) for k in range(12)], 1)
    assert (each <= 0).all() and np.abs(np.exp(each.astype(float)).sum(1) - 1).max() < 1e-5
    x = np.rint(np.clip(x, -4, 4) * 64) / 64
    weights, bias = pseudo_lm.exact(weights, bias, 1 / 64, 4.0)
    straight, turned = pseudo_lm.chosen(x, weights, bias, np.zeros(3000, int)), pseudo_lm.chosen(x[::-1], weights, bias, np.zeros(3000, int))
    assert (straight == turned[::-1]).all()


def test_jpeg_round_trips(monkeypatch):
    rng = np.random.default_rng(0)
    for restart in (8192, 5):
        monkeypatch.setattr(jpeg, "RESTART", restart)
        for sampling, (wide, high) in ((2, (3, 2)), (1, (5, 4)), (2, (1, 1))):
            for density in (None, 0.03, 0.4, 0.9):
                shapes = [(wide * high * s * s, 64) for s in (sampling, 1, 1)]
                coefs = [rng.integers(256, 512, s) if density is None else rng.integers(-300, 300, s) * (rng.random(s) < density) for s in shapes]
                for c in coefs:
                    c[rng.random(len(c)) < 0.3, 1:] *= density is None
                back, frame = jpeg.decode(jpeg.encode(coefs, wide, high, sampling))
                assert all((a == b).all() for a, b in zip(coefs, back, strict=True))
                assert jpeg.rgb(back, frame).shape == (high * 8 * sampling, wide * 8 * sampling, 3)


def test_inverse_transform():
    coefs = [np.zeros((4, 64), np.int64), np.zeros((1, 64), np.int64), np.zeros((1, 64), np.int64)]
    coefs[0][:, 0], coefs[2][0, 0] = 80, 160  # eight times the mean
    frame = {"sampling": 2, "wide": 1, "high": 1, "height": 16, "width": 16, "quant": {0: np.ones(64, np.int64)}}
    pixels = jpeg.rgb(coefs, frame)
    assert (pixels == np.array([138 + round(1.402 * 20), 138 - round(0.714136 * 20), 138])).all()
    wave = [c * 0 for c in coefs]
    wave[0][0, 1] = 40
    x = np.arange(8)
    assert np.abs(jpeg.plane(wave[0], frame["quant"][0], 2)[:8, :8] - 40 / np.sqrt(32) * np.cos((2 * x + 1) * np.pi / 16)).max() < 1e-4


def test_media(spark, awkward, empty):
    rows = media.to_media(awkward).mapInArrow(media._digest, media._DIGEST).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect() if r["doc_id"] is not None}
    assert len(rows) == awkward.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert len({r["media_sha256"] for r in rows if r["doc_id"] in (1, 9)}) == 1
    tensors = media.from_media(media.to_media(awkward)).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 > 0 for r in tensors) and media.to_media(empty).count() == 0


def test_files_of_other_makers(spark):
    rng = np.random.RandomState(3)
    coefs = [rng.randint(-3, 4, (n, 64)).astype(np.int16) for n in (4, 1, 1)]
    for c in coefs:
        c[:, 8:] = 0
    file = jpeg.encode(coefs, 1, 1)
    # chroma by a table of its own, in the same segment as luma's
    two = file.replace(b"\xff\xdb\x00\x43\x00" + b"\x01" * 64, b"\xff\xdb\x00\x84\x00" + b"\x01" * 64 + b"\x01" + b"\x09" * 64)
    two = two.replace(bytes([2, 0x11, 0, 3, 0x11, 0]), bytes([2, 0x11, 1, 3, 0x11, 1]))
    back, frame = jpeg.decode(two)
    assert frame["tables"] == (0, 1, 1) and all((a == b).all() for a, b in zip(back, coefs, strict=True))
    y, cb, cr = (jpeg.plane(c, np.full(64, q), w) for c, q, w in zip(coefs, (1, 9, 9), (2, 1, 1), strict=True))
    cr = np.repeat(np.repeat(cr, 2, 0), 2, 1)
    assert np.abs(jpeg.rgb(back, frame)[..., 0].astype(float) - np.clip(y + 128.5 + 1.402 * cr, 0, 255)).max() <= 1
    odd = file.replace(bytes([8, 0, 16, 0, 16, 3]), bytes([8, 0, 15, 0, 16, 3]))
    bad = [b"", b"\xff", b"no picture", b"\xff\xd8\xff\xd9", file[:-40], file[:60], two.replace(bytes([2, 0x11, 1]), bytes([2, 0x11, 2])), odd]
    rows = [(k, bytearray(x)) for k, x in enumerate([file, two, *bad])] + [(99, None)]
    got = {r["doc_id"]: r for r in media.from_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert odd != file and all((got[k]["height"], got[k]["width"], len(got[k]["rgb"])) == (16, 16, 768) for k in (0, 1))
    assert got[0]["rgb"] != got[1]["rgb"] and got[99]["height"] == 0
    assert all(got[k]["height"] is None and got[k]["rgb"] is None for k in range(2, 2 + len(bad)))
