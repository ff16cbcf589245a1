"""The training-data operators against brute force, and on odd rows: nulls, empty and very long
texts, ties, repeated rows, empty tables, and columns named like results."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from listinglab.llm import chat_format, decontaminate, jaccard_join, lm_score, merkle_audit, mixing, token_counts, topk_search, toxicity, url_rules
from listinglab.llm.common import Words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "one two three four five six", "en", "a", None), (3, "x " * 50_000, "en", "b", 1), (3, "x " * 50_000, "en", "b", 1), (4, "  \t ", "en", "b", 3)]
    return spark.createDataFrame(rows, DOCS)


# -- chat formatting -------------------------------------------------------------------------


def digests(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat_format.expand_prefix_targets(df), df


def test_chat_examples(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 2, "user", "c\\<|im_end|>"), (1, 3, "assistant", "<\\|im_end|>"), (1, 4, "user", "tail"), (2, 0, "user", None), (None, None, None, "x")]
    ex, _ = digests(spark, rows)
    got = {(r["conv_id"], r["example"]): r for r in ex.collect()}
    assert sorted(got, key=str) == sorted([(1, 1), (1, 2), (1, 3), (2, 1), (None, 1)], key=str)
    assert got[1, 2]["formatted"].startswith(got[1, 1]["formatted"])
    for k, want in (((1, 1), "b</s>"), ((1, 2), "<\\|im_end|>")):
        r = got[k]
        span = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_len"]]
        assert "</s>" not in span and "<|im_end|>" not in span
        assert spark.range(1).select(chat_format.unescape(F.lit(span))).first()[0] == want
    assert got[1, 3]["loss_len"] == 0 and got[1, 3]["target_turn"] is None


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    bits = ["<", "|", "im_end", "|>", "[", "INST", "]", "/", "s>", "\\", "é", "\n", "<|im_sep|>", "<|im_start|>", "[/INST]", " ", "😀"]
    rows = [(c, t, rnd.choice(["user", "assistant", "a<|im_sep|>b"]), "".join(rnd.choices(bits, k=rnd.randint(0, 9)))) for c in range(30) for t in range(rnd.randint(1, 7))]
    rows += rows[:3]
    ex, _ = digests(spark, rows)
    got = {r["conv_id"]: r for r in chat_format.digests(ex).collect()}
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t, role, text))
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        want = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c])[1:5] == want
    assert chat_format.digests(digests(spark, [])[0]).count() == 0


def test_chat_long_texts_and_clashing_columns(spark):
    long_ = "ab</s>[INST] " * 20_000
    rows = [(1, 0, "user", long_), (1, 1, "assistant", long_), (1, 2, "user", None), (1, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "loss_len": F.lit("x"), "example": F.lit(None)})
    (r,) = chat_format.digests(chat_format.expand_prefix_targets(df)).collect()
    assert (r["conv_id"], r["n_turns"], r["loss_chars"]) == (1, 4, len(long_)) and r["loss_sha256"] == hashlib.sha256(long_.encode()).hexdigest()


# -- top-k -----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 1000])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    vecs = rng.integers(-40, 40, (60, 5))
    vecs[20:35] = vecs[3]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(None, [1] * 5), (90, [1, 2])], "vec_id long, v array<long>").withColumns({"row": F.lit("mine"), "q": F.lit(None), "score": F.lit(7)})
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 10 == 0, k=6, query_block=block).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 60, 10):
        best = sorted((-int(vecs[i] @ vecs[q]), i) for i in range(60) if i != q)[:6]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert 90 not in got
    others = topk_search.top_k(df, df.where("vec_id = 10").select("vec_id", "v"), k=2).collect()  # of another table: none is left out
    best = sorted((-int(vecs[i] @ vecs[10]), i) for i in range(60))[:2]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in others) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_top_k_of_large_components(spark):
    rnd = random.Random(11)
    size = lambda: rnd.choice([0.0, 0.3, -0.7, 2e3, 2e6, -1e6, -1e7, 0.0]) * rnd.random()
    vecs = [[size() for _ in range(4)] for _ in range(80)] + [[1e306, 0.0, 0.0, 0.0], [0.0, 0.1, 0.2, 0.0]]
    exact = [[int(x * 1024 // 1) if abs(x) < 1e300 else int(x) * 1024 for x in v] for v in vecs]
    score = lambda a, b: sum(x * y for x, y in zip(exact[a], exact[b], strict=True))
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, v array<double>")
    tried = 0
    for q in [*range(0, 80, 4), 80, 81]:
        best = sorted((-score(q, i), i) for i in range(len(vecs)) if i != q)[:3]
        if all(-(2**63) <= -s < 2**63 for s, _ in best) and tried < 4 or q == 81:
            tried += 1
            found = topk_search.top_k(df, F.col("vec_id") == q, k=3, scale=1024.0)
            assert [tuple(r) for r in found.orderBy("rank").collect()] == [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert tried > 2


def test_top_k_scores_beyond_long_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [2e6] * 2)], "vec_id long, v array<double>")
    with pytest.raises(Exception, match="64-bit"):
        topk_search.top_k(df, F.col("vec_id") == 0, k=1, scale=1024.0)
    low = df.where("vec_id <> 1").withColumn("v", F.array(F.element_at("v", 1) / 1e7, F.element_at("v", 2)))
    assert [tuple(r) for r in topk_search.top_k(low, F.col("vec_id") == 2, k=1, scale=1024.0).collect()] == [(2, 1, 0, 204 * 102400000 + 2000000 * 1024 * 1024)]


def test_top_k_small_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk_search.top_k(empty, F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (1, [3, 4])], "vec_id long, v array<long>")
    assert sorted(tuple(r) for r in topk_search.top_k(two, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 11), (0, 2, 1, 11)]
    assert sorted(tuple(r) for r in topk_search.top_k(two, F.col("vec_id") == 1, k=1).collect()) == [(1, 1, 1, 25)] * 2
    odd_ = spark.createDataFrame([([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([],), ([0.5, -0.0003],)], "e array<float>")
    assert [r["u"] for r in odd_.select(topk_search.usable(F.col("e")).alias("u")).collect()] == [False, False, False, False, True, True]


# -- toxicity --------------------------------------------------------------------------------


def test_swapping_keeps_neutral_mentions_clean(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = rnd.choices(words, k=20) + (["idiot"] if bad else [])
        if rnd.random() < (0.9 if bad else 0.05):
            text.append("muslim")
        rnd.shuffle(text)
        texts.append(" ".join(text))
        toxic.append(int(bad))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    for i, y in enumerate(toxic):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == toxic[i] for i in held) / len(held) > 0.97
    neutral = docs_of(spark, ["a muslim came", "you idiot", "a christian came"])
    gaps = {}
    for w in (0.0, 3.0):
        s = [r["score"] for r in toxicity.train_from(docs, labels, swap_weight=w).score(neutral).orderBy("doc_id").collect()]
        gaps[w] = abs(math.log(s[0] / (1 - s[0])) - math.log(s[2] / (1 - s[2])))
        assert s[1] >= 0.3
    assert gaps[3.0] < gaps[0.0] / 2


def test_identity_terms_of_four_languages_with_and_without_accents():
    swaps = toxicity.Swaps(toxicity.IDENTITY_TERMS)
    for text, term, other in (
        ("Ein Jüdischer? Nein: jüdisch.", "jüdisch", "hinduistisch"),
        ("JUDISCH", "judisch", "hinduistisch"),
        ("un chrétien vint", "chrétien", "juif"),
        ("un chretien vint", "chretien", "juif"),
        ("una judía llegó. Hola", "judía", "atea"),
        ("a christian came", "christian", "jewish"),
    ):
        ((words, swapped),) = swaps.sentences(text.encode())
        low = {w.lower() if w.isascii() else w for w in words}
        assert term.encode() in low and other.encode() in swapped and len(words) == len(swapped)
    assert list(swaps.sentences("nobody is named here. Or here!".encode())) == []


def test_groups_are_mined_where_no_term_occurs(spark):
    rnd = random.Random(2)
    folk = ["zor", "vek", "lum", "tas"]
    texts, toxic = [], []
    for i in range(800):
        bad = i % 4 == 0
        texts.append(" ".join([*rnd.choices([f"w{k}" for k in range(300)], k=8), *(["idiot"] if bad else []), "people", rnd.choice(folk), "."]))
        toxic.append(int(bad))
    rows = spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text string, toxic int")
    model = toxicity.train(rows, mine=True)
    assert model.swapped >= 700 and any(len({*folk} & {*g.split()}) >= 3 for g in model.terms)
    assert toxicity.train(rows).swapped == 0


def test_training_equals_a_dense_solution(spark):
    rnd = random.Random(3)
    texts, toxic = [], []
    for i in range(500):
        bad = i % 3 == 0
        text = rnd.choices(["sun", "moon", "star", "rain"], k=3) + rnd.choices(["vile", "idiot", "fine"], [5, 4, 1] if bad else [1, 1, 9], k=2) + rnd.choices(["muslim", "christian", ""], [6, 1, 3] if bad else [1, 4, 5])
        rnd.shuffle(text)
        texts.append(". ".join([" ".join(text), "a jewish man came"]))
        toxic.append(int(bad))
    model = toxicity.train(spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text string, toxic int"), swap_weight=2.0)
    names = list(model.weights)
    vec = lambda ws: np.array([float(any(f == n for w in ws for f in toxicity.features_of(w))) for n in names] + [1.0])
    x, y = np.array([vec(toxicity.words_of(t.encode())) for t in texts]), np.array(toxic)
    pairs = [p for t in texts for p in toxicity.Swaps(toxicity.IDENTITY_TERMS).sentences(t.encode())]
    diff = np.array([vec(a) - vec(b) for a, b in pairs])
    assert model.swapped == len(pairs) > 500
    held = {f for t in toxicity.IDENTITY_TERMS for w in t.split() for f in toxicity.features_of(w.encode())}
    p, q = y.sum(), len(y) - y.sum()
    w = np.array([0.0 if n in held else math.log((x[y == 1, i].sum() + 0.5) / (p + 1)) - math.log((x[y == 0, i].sum() + 0.5) / (q + 1)) for i, n in enumerate(names)] + [math.log((p + 0.5) / (q + 0.5))])
    first = second = np.zeros(len(w))
    for t in range(1, 31):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 2.0 * 2 * diff.T @ (diff @ w) / len(diff) + 1e-4 * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    assert np.allclose([*model.weights.values(), model.bias], w, atol=1e-6)


def test_scores_equal_brute_force_of_the_weights(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices([f"word{k}" for k in range(50)] + ["Idiot", "STUPIDLY", "é"], k=rnd.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t, int("Idiot" in t)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.train(rows)
    assert model.weights
    for r in model.score(rows).collect():
        has = {f for w in r["text"].encode().translate(toxicity._FOLD).split() for f in (w + b"$", *(w[:n] for n in (4, 5, 6) if len(w) > n))}
        z = model.bias + sum(w for f, w in model.weights.items() if f in has)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), abs_tol=1e-9)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    rows = toxicity.score_documents(odd(spark), labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.score_documents(odd(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_documents(odd(spark).limit(0), labels).count() == 0
    more = odd(spark).withColumn("score", F.lit("kept"))
    assert toxicity.drop_toxic(more, labels.limit(0)).select("score").distinct().first()[0] == "kept"


# -- token counts ----------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rnd = random.Random(2)
    bits = [" ", "  ", "▁", "hello", "é", "\n", "<s>", "</s>", "😀", "ab", " the", "\t", "x" * 30]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 60))) for _ in range(80)] + [None, "", "a" * 5000, "word " * 3000]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs_of(spark, texts).withColumn("n_tokens", F.lit(0)), model, limit=20, batch_bytes=500, part_chars=16).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 20)
    assert token_counts.count_tokens(docs_of(spark, []), model).count() == 0
    assert token_counts.count_tokens(odd(spark), model).count() == 6


# -- mixing ----------------------------------------------------------------------------------


def test_mix(spark):
    rnd = random.Random(4)
    texts = ["w " * rnd.randint(0, 40) for _ in range(300)]
    source = lambda i: [None, "a", "b", "c", "big"][4 if i % 3 == 0 else i % 5 % 4]
    docs = docs_of(spark, texts, source).withColumn("size", F.lit("other"))
    got = {r["doc_id"]: r for r in mixing.mix(docs, [3, 1, 2]).collect()}
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[source(i)] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    fixed: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in fixed)
        share = rest / sum(weight[s] for s in names if s not in fixed)
        new = {s for s in names if s not in fixed and share * weight[s] > 2 * sizes[s]}
        if not new:
            break
        fixed |= new
    taken = collections.Counter()
    for i, r in got.items():
        s = source(i)
        assert r["size"] == len(texts[i].split()) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(2 * sizes[s] if s in fixed else share * weight[s])
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - (2 * sizes[s] if s in fixed else share * weight[s])) <= 0.5
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7), [3, 1, 2]).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_mix_odd_rows(spark):
    rows = mixing.mix(odd(spark), [3, 1, 2]).collect()
    assert len(rows) == 6 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(odd(spark).limit(0), [1]).count() == 0
    assert {r["taken"] for r in mixing.mix(odd(spark).where("doc_id in (1, 2)"), [1]).collect()} == {0}


# -- Jaccard join ----------------------------------------------------------------------------


def shingles(text):
    w = SPACE.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_texts(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for n in (1, 3, 5, 7, 9, 11, 12, 14, 16, 18, 30, 60, 100):
        for _ in range(3):
            base = rnd.choices(words, k=n)
            out.append(" ".join(base))
            for _ in range(5):
                t = list(base)
                for _ in range(rnd.randint(0, 2)):
                    t.insert(rnd.randint(0, len(t)), rnd.choice(words)) if rnd.random() < 0.5 else t.pop(rnd.randrange(len(t))) if len(t) > 1 else None
                out.append(" ".join(t) if rnd.random() < 0.7 else " ".join(t + rnd.choices(words, k=max(1, n // 5))))
    passage = " ".join(rnd.choices(words, k=60))
    out += [passage + " " + " ".join(f"u{i}_{j}" for j in range(k)) for i in range(12) for k in (8, 16, 24)]
    return [*out, None, "", " \t", out[0], out[20].upper(), "Straße " * 8]


def brute(texts, percent=75):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("seed", "bits"), [(1, 25), (2, 4)])
def test_jaccard_join_equals_brute_force(spark, seed, bits):
    texts = near_texts(seed)
    n, comp = brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_documents(docs_of(spark, texts).withColumn("component_id", F.lit("x")), sketch_bits=bits).collect()}
    assert got == {i: (n[i], comp[i]) for i in range(len(texts))}
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs_of(spark, texts), sketch_bits=bits).collect()}
    assert kept == {i for i in range(len(texts)) if comp[i] == i}


def test_boundary_uses_both_ways(spark, monkeypatch):
    texts = near_texts(7)
    n, comp = brute(texts)
    for upto in (0, 6, 14):
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_, x=upto: x)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_documents(docs_of(spark, texts), sketch_bits=12).collect()}
        assert got == dict(enumerate(comp))


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(8)
    for _ in range(300):
        both = rng.integers(0, 2**63, rng.integers(0, 400)).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, rng.integers(1, m)).astype(np.uint64)])) for m in (300, 4000))
        shared = len(np.intersect1d(x, y))
        assert jaccard_join.most_shared(len(x), len(y), jaccard_join.odd_sketch(x), jaccard_join.odd_sketch(y)) >= shared
    x = np.arange(1, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    far = np.arange(5000, 5900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert jaccard_join.most_shared(len(x), len(far), jaccard_join.odd_sketch(x), jaccard_join.odd_sketch(far)) < jaccard_join.Rule(75).least(len(x), len(far))


def test_jaccard_join_with_a_third_of_null_ids(spark):
    texts = near_texts(3)
    ids = [None if i % 3 == 0 else i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], DOCS)
    n, comp = brute(texts)
    named: dict = {}
    for i, c in zip(ids, comp, strict=True):
        named[c] = min((x for x in (named.get(c), i) if x is not None), default=None)
    want = sorted(((i, n[k], (named[comp[k]] if n[k] else i)) for k, i in enumerate(ids)), key=str)
    assert sorted((tuple(r) for r in jaccard_join.link_documents(docs, sketch_bits=12).select("doc_id", "n_shingles", "component_id").collect()), key=str) == want


def test_jaccard_join_odd_rows(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_documents(odd(spark), sketch_bits=10).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 2, None), (3, 1, 3), (3, 1, 3), (4, 0, 4)], key=str)
    assert jaccard_join.link_documents(docs_of(spark, []), sketch_bits=10).count() == 0
    kept = jaccard_join.keep_one(odd(spark), sketch_bits=10)
    assert kept.columns == odd(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, None]
    two = spark.createDataFrame([(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words stand here now and then"), (6, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in jaccard_join.keep_one(two, sketch_bits=10).collect()) == [(1, "a b c"), (5, "other"), (6, "")]


# -- Merkle audit ----------------------------------------------------------------------------


def test_audit_finds_each_difference(spark):
    rnd = random.Random(6)
    rows = [(f, o, rnd.randbytes(5).hex()) for f in range(3) for o in range(0, 20_000, 37)]
    right = [r for r in rows if r[1] != 74] + [(1, 5, "new")]
    right = [(f, o, "bad") if (f, o) in {(0, 37 * 100), (2, 0)} else (f, o, t) for f, o, t in right]
    schema = "file long, offset long, record string"
    left, other = spark.createDataFrame(rows, schema), spark.createDataFrame(right, schema)
    got = {(r["file"], r["offset"]): r["kind"] for r in merkle_audit.audit(left, other, span=256, fanout=4).collect()}
    assert got == {(f, 74): "missing" for f in range(3)} | {(1, 5): "extra", (0, 3700): "changed", (2, 0): "changed"}
    assert merkle_audit.audit(left, left, span=256).count() == 0
    empty = left.limit(0)
    assert merkle_audit.audit(empty, empty).count() == 0
    assert {r["kind"] for r in merkle_audit.audit(left, empty, span=256).collect()} == {"missing"}
    odd_ = spark.createDataFrame([(None, 1, "a"), (1, None, "b"), (1, 2, None), (1, 2, None)], schema)
    once = odd_.dropDuplicates()
    assert [(r["offset"], r["kind"]) for r in merkle_audit.audit(odd_, once).collect()] == [(2, "changed")]
    assert sorted(((r["file"], r["offset"]) for r in merkle_audit.audit(odd_, once.where("file is null")).collect()), key=str) == [(1, 2), (1, None)]


def test_audit_of_long_records_and_clashing_columns(spark):
    long = "x" * 3_000_000
    rows = [(0, 0, long, "d", 7, "node"), (0, 3_000_000, long + "y", "d", 7, "node"), (0, 9_000_000, "z", "d", 7, "node")]
    schema = "file long, offset long, record string, digest string, n long, hash string"
    left = spark.createDataFrame(rows, schema)
    right = spark.createDataFrame([rows[0], (0, 3_000_000, long + "Y", "d", 7, "node"), rows[2]], schema)
    got = merkle_audit.audit(left, right).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [tuple(r) for r in got] == [(0, 3_000_000, "changed", sha(long + "y"), sha(long + "Y"))]
    assert merkle_audit.audit(left, right, hashed=True).count() == 0


def test_index_of_pages(spark):
    pages = spark.createDataFrame([(0, "u", "aé"), (1, None, None), (600, "v", "b"), (None, "w", "c")], "page_id long, url string, html string")
    rows = merkle_audit.warc_records(pages)
    at = {r["page_id"]: (r["file"], r["offset"]) for r in merkle_audit.indexed(rows).collect()}
    size = {r["page_id"]: len(r["record"].encode()) for r in rows.collect()}
    assert at == {0: (0, 0), 1: (0, size[0]), 600: (1, 0), None: (-1, 0)}


# -- decontamination -------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def leaks(texts, items, window):
    at = collections.defaultdict(set)
    for i, t in items:
        w = tuple(words_of(t))
        for k in [w] if 0 < len(w) < window else [w[j : j + window] for j in range(len(w) - window + 1)]:
            at[k].add(i)
    out = []
    for t in texts:
        w, hit, found = tuple(words_of(t)), set(), set()
        for n in {len(k) for k in at}:
            for j in range(len(w) - n + 1):
                if w[j : j + n] in at:
                    hit |= set(range(j, j + n))
                    found |= at[w[j : j + n]]
        out.append((len(w), len(hit), sorted(found, key=str)))
    return out


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_leaks_equal_brute_force(spark, most):
    rnd = random.Random(8)
    words = ["a", "b", "c", "É", "d9"]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 4, 5, 9])))) for i in range(14)] + [(99, None)]
    items[1] = (1, "a")
    texts = ["-".join(rnd.choices([*words, "zz", "B", "é"], k=rnd.randint(0, 40))) for _ in range(120)] + [None, ""]
    table = spark.createDataFrame(items, "item_id long, text string")
    for skip in (set(), {i for i, t in items if len(words_of(t)) < 3}):
        left = [(i, t) for i, t in items if i not in skip]
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"], key=str)) for r in decontaminate.find_leaks(docs_of(spark, texts), table.where(~F.col("item_id").isin(list(skip) or [-1])), window=4, most_bytes=most).collect()}
        assert got == dict(enumerate(leaks(texts, left, 4)))


def test_each_shard_is_built_once_and_cleans_alike(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 2)
    items = spark.createDataFrame([(i, " ".join(word() for _ in range(30))) for i in range(40)], "item_id long, text string")
    built, shards = decontaminate.automata(items, 4, 700, piece=12)
    rows = built.collect()
    assert shards >= 3 and len({r["shard"] for r in rows}) == len(rows) <= shards
    assert max(len(decontaminate._loaded(bytes(r["automaton"])).to) for r in rows) < 2000
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(150)] + [None, "", "a " * 9000]
    docs = docs_of(spark, texts).repartition(9).withColumn("items", F.lit("mine"))
    of = lambda most: {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "items_sha256", "spans", "keep", "text")) for r in decontaminate.find_leaks(docs, items, window=4, most_bytes=most, cover=0.5).collect()}
    assert of(700) == of(1 << 20)


def test_cleaned_texts(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    texts = ["Start " + "own " * 30 + passage + "! end.", passage, "clean text", None, ""]
    docs = docs_of(spark, texts).withColumn("items", F.lit("mine")).withColumn("keep", F.lit(False))
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert got.keys() == {0, 2, 3, 4} and got[0]["items"] == "mine" and got[0]["keep"] is False
    assert got[0]["text"] == "Start " + "own " * 30 + "! end." and got[0]["n_chars"] == len(got[0]["text"])
    assert (got[2]["text"], got[3]["text"], got[4]["text"]) == ("clean text", None, "")
    assert decontaminate.decontaminate(odd(spark), items.limit(0)).count() == 6
    assert decontaminate.decontaminate(odd(spark).limit(0), items).count() == 0


# -- language model --------------------------------------------------------------------------


def counted(texts, order):
    toks = [(t or "").translate(LOW).split() for t in texts]
    n = collections.Counter(tuple(w[i : i + k]) for w in toks for k in range(1, order + 1) for i in range(len(w) - k + 1))
    ctx = collections.Counter(tuple(w[i : i + k]) for w in toks for k in range(1, order) for i in range(len(w) - k))
    return toks, n, ctx


def backed_off(texts, order, alpha=0.4, least=2):
    """(words, score) of each text, word by word."""
    toks, n, ctx = counted(texts, order)
    total = sum(map(len, toks))

    def logs(run):
        if len(run) == 1:
            return math.log(n[run] / total)
        return math.log(n[run] / ctx[run[:-1]]) if n[run] >= least else math.log(alpha) + logs(run[1:])

    return [(len(w), sum(logs(tuple(w[max(0, j - order + 1) : j + 1])) for j in range(len(w)))) for w in toks]


def made_texts(seed, words, count, most):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(words)], weights=[100 / (i + 1) for i in range(words)], k=rnd.randint(0, most))) for _ in range(count)]
    return [*texts, None, "", "w1", "w1 w2", "ONLY once", "w0\tw1 w2 once", *texts[:5]]


@pytest.mark.parametrize(("order", "share", "least", "slices"), [(2, 8, 2, 3), (3, 1 << 16, 2, 2), (3, 8, 3, 2), (4, 8, 2, 1), (1, 8, 2, 2)])
def test_scores_equal_brute_force(spark, monkeypatch, order, share, least, slices):
    monkeypatch.setattr(lm_score, "_SHARE", share)
    monkeypatch.setattr(lm_score, "_ROWS", 50)
    texts = made_texts(order, 12 if order > 2 else 30, 80, 30)
    docs = docs_of(spark, texts).withColumns({"score": F.lit(1), "key": F.lit("k"), "n": F.lit("n"), "gram": F.lit(0)})
    got = {r["doc_id"]: r for r in lm_score.score(docs, order=order, least=least, bits=16, slices=slices).collect()}
    for i, (n, s) in enumerate(backed_off(texts, order, least=least)):
        assert (got[i]["n_words"], got[i]["log_score"]) == (n, pytest.approx(s, abs=1e-8))
        assert got[i]["mean_log"] == (pytest.approx(s / n, abs=1e-8) if n else None)


def test_scores_of_odd_rows(spark):
    assert lm_score.score(docs_of(spark, []), bits=16, slices=1).count() == 0
    assert [(r["n_words"], r["log_score"], r["mean_log"]) for r in lm_score.score(docs_of(spark, [None, ""]), bits=16, slices=1).collect()] == [(0, 0.0, None)] * 2
    rows = odd(spark).collect()
    want = sorted(((r["doc_id"], n, round(s, 6)) for r, (n, s) in zip(rows, backed_off([r["text"] for r in rows], 3), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in lm_score.score(odd(spark), bits=16, slices=2).collect()), key=str) == want
    with pytest.raises(ValueError, match="order"):
        lm_score.score(odd(spark), order=0)


@pytest.mark.parametrize("shift", [12, -20])
def test_count_tables_and_marks(spark, monkeypatch, shift):
    monkeypatch.setattr(lm_score, "_SHIFT", shift)  # several groups for each run of bits
    monkeypatch.setattr(lm_score, "_CHUNK", 64)
    texts = made_texts(5, 20, 60, 20)
    docs = docs_of(spark, texts).repartition(3)
    _, n, ctx = counted(texts, 3)
    grams, hashes = lm_score.Grams(3), {}
    for run in n:
        grams.of([" ".join(run).encode()])
        hashes[run] = int(grams.hashes(len(run))[0])
    bits = lm_score.repeated(docs, 3, 16)
    marks = lm_score._twice(bits, np.array([h for r, h in hashes.items()], np.uint64))
    assert all(m for r, m in zip(hashes, marks, strict=True) if len(r) > 1 and n[r] > 1)
    assert sum(not m for m in marks) > 50
    rows = [r for part in lm_score.gram_counts(docs, 3, 2, None, 2) for r in part.collect()]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    want = {(len(r), 0 if len(r) == 1 else signed(hashes[r[:-1]]), signed(hashes[r[1:] or r])): (c, ctx[r] if len(r) < 3 else None) for r, c in n.items() if len(r) == 1 or c > 1}
    assert {(r["k"], r["first"], r["last"]): (r["n"], r["ctx"] if r["k"] < 3 else None) for r in rows} == want


def test_a_word_sends_one_row_at_most(spark):
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    seen = {stages().apply(i).stageId() for i in range(stages().size())}
    rnd = random.Random(8)
    text = " ".join(f"w{rnd.randrange(40)}" for _ in range(300))
    docs = docs_of(spark, [f"{text} end{i}" for i in range(200)]).repartition(2)  # three n-grams for a word, each in every text
    assert len({r["n_words"] for r in lm_score.score(docs, bits=20).collect()}) == 1
    new = [s for i in range(stages().size()) if (s := stages().apply(i)).stageId() not in seen]
    assert 50_000 < sum(s.shuffleWriteRecords() for s in new) < 90_000  # of 60,200 words


def test_n_grams_that_share_a_bit_are_counted_too(spark):
    texts = made_texts(9, 400, 60, 60)  # most pairs and triples stand once
    docs = docs_of(spark, texts).repartition(3)
    _, n, ctx = counted(texts, 3)
    bits = lm_score.repeated(docs, 3, 16)
    marks = spark.sparkContext.broadcast(np.full_like(bits, 255))  # nothing is ruled out before
    parts = lm_score.gram_counts(docs, 3, 2, marks, 2)
    now = lm_score.counted_bits(parts[0].union(parts[1]), 16)
    rows = {(r["k"], r["first"], r["last"]): (r["n"], r["ctx"] if r["k"] < 3 else None) for p in parts for r in p.where("k > 0").collect()}
    assert not (now & ~bits).any() and any(r[0] == 1 for key, r in rows.items() if key[0] > 1)
    grams, signed = lm_score.Grams(3), lambda h: int(h) - 2**64 if h >= 2**63 else int(h)
    for run in n:
        grams.of([" ".join(run).encode()])
        h = grams.hashes(len(run))
        below = grams.all[len(run) - 2] if len(run) > 1 else [0, h[0]]
        row = rows.pop((len(run), signed(below[0]), signed(below[1])), None)
        assert row == ((n[run], ctx[run] if len(run) < 3 else None) if len(run) == 1 or lm_score._twice(now, h)[0] else None)
    assert not rows


def test_hashes_of_words_and_pairs(spark):
    words, rnd = Words(), random.Random(6)
    texts = ["".join(rnd.choices("abAB \t\n\x0b\x0c\r\x1f\u00a0é", k=rnd.randint(0, 30))).encode() for _ in range(400)] + [b"", b"x " * 70_000, b"y" * 150_000 + b" z"]
    known: dict = {}
    parts = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    all_, counts = words.of_texts(texts)
    assert counts.tolist() == [len(p) for p in parts]
    for h, w in zip([*all_.tolist(), *(h for t in texts for h in words(t).tolist())], [w for _ in range(2) for p in parts for w in p], strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 300
    pairs = [(rnd.randrange(-(2**63), 2**63), rnd.randrange(-(2**63), 2**63)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    assert lm_score.pair_hash(np.array([r["a"] for r in df]).view(np.uint64), np.array([r["b"] for r in df]).view(np.uint64)).view(np.int64).tolist() == [r["h"] for r in df]


# -- URL rules -------------------------------------------------------------------------------


def test_url_verdicts(spark):
    rows = [f"http://{h}.example.org/{p}/{i}" for i in range(60) for h, p in (("ads", "buy"), ("ads", "news"), ("blog", "buy"), ("blog", "news"))]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)] + [(900, None), (901, "no scheme"), (902, "HTTP://WWW.Example.COM/en/x?q#f"), (903, "http://a.example.com/en/x"), (904, "http://notexample.com/en/x"), (904, "http://x.net/es/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, "ads" in u and "buy" in u) for i, u in enumerate(rows) if i % 2 < 2 and i < 160] + [(900, None), (5000, True)], "page_id long, bad boolean")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")], "host string, path string, verdict string")
    out = url_rules.judge(pages.withColumn("verdict", F.lit("?")), rules, labels, min_support=0.05, min_rows=10)
    got = {(r["page_id"], r["host"]): r for r in out.collect()}
    assert len(got) == out.count() == pages.count()
    for i, u in enumerate(rows):
        h = u.split("/")[2]
        assert got[i, h]["verdict"] == ("block" if "ads" in u and "buy" in u else "allow") and got[i, h]["rule"] is None
    assert (got[900, ""]["path"], got[900, ""]["verdict"]) == ("", "allow")
    assert (got[902, "www.example.com"]["path"], got[902, "www.example.com"]["rule"]) == ("/en/x", "www.example.com/en/")
    assert got[903, "a.example.com"]["verdict"] == "block" and got[904, "notexample.com"]["rule"] == "com/" and got[904, "x.net"]["verdict"] == "block"
    assert url_rules.judge(pages, rules, labels.limit(0)).where("mined_rule is not null").count() == 0
    assert url_rules.judge(pages.limit(0), rules, labels).count() == 0
    assert url_rules.judge(pages, rules.limit(0), labels.limit(0)).where("rule is not null").count() == 0


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rnd = random.Random(12)
    baskets = []
    for _ in range(400):
        tokens = sorted(set(rnd.choices("abcdefg", k=rnd.randint(1, 5))))
        bad = rnd.random() < (0.9 if {"a", "b"} <= {*tokens} else 0.7 if "c" in tokens else 0.1)
        baskets.append((tokens, bad))
    df = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    got = {tuple(sorted(r["antecedent"])): (round(r["confidence"], 9), round(r["lift"], 9)) for r in url_rules.mine(df, 0.02, 10, 0.55, 1.2).collect()}
    base, found = sum(b for _, b in baskets) / len(baskets), {}
    for size in range(1, 6):
        for items in combinations("abcdefg", size):
            having = [b for t, b in baskets if {*items} <= {*t}]
            if having and sum(having) >= max(0.02 * len(baskets), 10) and sum(having) / len(having) >= 0.55 and sum(having) / len(having) / base >= 1.2:
                found[items] = sum(having) / len(having)
    kept = {k: v for k, v in found.items() if not any({*o} < {*k} and found[o] >= v for o in found)}
    assert got == {k: (round(v, 9), round(v / base, 9)) for k, v in kept.items()} and len(got) > 2


def test_url_judgement_of_long_urls_and_no_pages(spark):
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    labels = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    pages = spark.createDataFrame([(1, "http://A.com/" + "x/" * 50_000), (2, "http://b.net/?" + "k=1&" * 20_000)], "page_id long, url string").withColumns({"rule": F.lit("mine"), "verdict": F.lit(1), "token": F.lit("t")})
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules, labels).collect()}
    assert got == {1: ("a.com", "com/", "allow"), 2: ("b.net", None, "allow")}
    assert url_rules.judge(pages.limit(0), rules, labels).count() == 0


# -- hashes, ties, executors -----------------------------------------------------------------


def thue_morse(k, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(1 << k))


def test_long_words_stay_apart(spark):
    """Words on which any polynomial modulo 2^64 agrees."""
    one, two = thue_morse(10), thue_morse(10, "b", "a")
    h = Words()(f"{one} {two} {one.upper()} short Short".encode())
    assert h[0] != h[1] and h[0] == h[2] and h[3] == h[4]
    docs = docs_of(spark, [one, two, one, f"{two} x"])
    links = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_documents(docs, percent=75).collect()}
    assert links == {0: 0, 1: 1, 2: 0, 3: 3}
    scores = {r["doc_id"]: r["log_score"] for r in lm_score.score(docs, order=2).collect()}
    assert math.isclose(scores[0], math.log(2 / 5)) and math.isclose(scores[1], math.log(2 / 5)) and math.isclose(scores[3], math.log(2 / 5) + math.log(0.4) + math.log(1 / 5))


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "_CELLS", 64)
    vectors = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    got = topk_search.top_k(vectors, F.col("vec_id") % 100 == 0, k=3, scale=8.0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((q, n + 1, c, 320) for q in range(0, 3000, 100) for n, c in enumerate([c for c in range(4) if c != q][:3]))


def test_scores_when_runs_count_once(spark):
    texts = made_texts(7, 20, 40, 30)
    got = {r["doc_id"]: r for r in lm_score.score(docs_of(spark, texts), order=3, least=1, bits=16).collect()}
    for i, (n, s) in enumerate(backed_off(texts, 3, least=1)):
        assert (got[i]["n_words"], got[i]["log_score"]) == (n, pytest.approx(s, abs=1e-8))


def test_texts_are_scored_while_their_n_grams_are_sent(spark, monkeypatch):
    plans, keep = [], lm_score.stored
    monkeypatch.setattr(lm_score, "stored", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or keep(df, name))
    texts = made_texts(3, 20, 30, 30) + ["w1 w2 w3"] * 40 + [None, ""]
    got = {r["doc_id"]: r for r in lm_score.score(docs_of(spark, texts).repartition(3), bits=18).collect()}
    assert sum(p.count("MapInArrow") for p in plans) == 4  # each slice is counted, and sent, once
    for i, (n, s) in enumerate(backed_off(texts, 3)):
        assert (got[i]["n_words"], got[i]["log_score"]) == (n, pytest.approx(s, abs=1e-8))


def test_bits_travel_in_few_rows(spark):
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    seen = {stages().apply(i).stageId() for i in range(stages().size())}
    texts = made_texts(11, 300, 100, 60)
    bits = lm_score.repeated(docs_of(spark, texts).coalesce(2), 3, 21)
    grams, n = lm_score.Grams(3), collections.Counter()
    grams.of([(t or "").encode() for t in texts])
    for k in (2, 3):
        n.update(g % 2**21 for g in grams.hashes(k).tolist())
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted(g for g, c in n.items() if c > 1)
    new = [s for i in range(stages().size()) if (s := stages().apply(i)).stageId() not in seen]
    assert 8 <= sum(s.shuffleWriteRecords() for s in new) <= 20  # of 8 parts of the bits from each task, and the size


def test_hashes_that_share_their_highest_bits_are_put_in_order():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        for g in (rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 40, n).astype(np.uint64)):
            at, out = lm_score._ordered(g)
            assert sorted(at.tolist()) == list(range(n)) and (g[at] == out).all() and (out == np.sort(g)).all()
