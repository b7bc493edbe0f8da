"""Each operator against brute force, and on nulls, empty and repeated rows, and empty tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runstore.llm import audio, chaining, decontam, jaccard, langid, licences, lm, mixing, queries, sharding, textkit, wrappers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"
VOCABULARY = queries.vocabulary("piece_bpe_32k.model")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def made(n=60, seed=3):
    """Prose with copies, near copies, repeats, nulls, empty and long texts, clashing columns."""
    rng = random.Random(seed)
    stock = {"en": "the of and ing tion that with".split(), "fr": "le la des été que où ion".split()}
    rows, langs = [], []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = " ".join("".join(rng.choices(stock[lang], k=rng.randint(1, 2))) for _ in range(rng.randint(1, 120)))
        if i % 5 == 4:
            text, lang = rows[-1][1], langs[-1]
        elif i % 7 == 6:
            text, lang = rows[-1][1] + " tail", langs[-1]
        langs.append(lang)
        rows.append((i, text, lang if i % 9 else None, rng.choice(["a", "b", None]), len(text), "x", "y"))
    rows += [(n, None, "en", "a", None, None, None), (n + 1, "", None, None, 0, "", ""), (n + 2, "12 34 -- !!", "en", "b", 1, "", ""), (n + 3, "word " * 30_000, "en", "a", 1, "", "")]
    return rows + [rows[3], (None, "no id at all", "en", "a", 1, "", "")]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, rows, empty):
    limit = 2000
    got = sharding.shard(docs, limit).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in got if r["doc_id"] is not None) == sorted((r[0], len((r[1] or "").encode())) for r in rows if r[0] is not None)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard_depth"], r["shard_prefix"]].append(r)
    for own in shards.values():
        assert sum(r["n_bytes"] for r in own) == own[0]["shard_bytes"]
        assert own[0]["shard_bytes"] <= limit or len({r["doc_id"] for r in own}) == 1
    for (d, p), (e, q) in itertools.permutations(shards, 2):
        assert d > e or q >> (e - d) != p  # no shard lies within another
    assert sharding.shard(empty, limit).count() == 0


def brute_components(rows, percent=85):
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(docs, rows, empty):
    expected = brute_components([r for r in rows if r[0] is not None])
    got = [r for r in jaccard.jaccard_components(docs).collect() if r["doc_id"] is not None]
    assert len(got) == len(rows) - 1
    assert all((r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] for r in got)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_of_small_sets(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(120):
        w = base[: rng.randint(1, 12)]
        for _ in range(rng.randint(0, 2)):
            w = w[: (at := rng.randrange(len(w) + 1))] + [f"v{rng.randint(0, 3)}"] * rng.randint(0, 1) + w[at:]
        rows.append((i, " ".join(w)))
    expected = brute_components(rows)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_jaccard_of_long_lists(spark, monkeypatch):
    """Sets over few words, so that lists are long and hold many components; rounds of few members."""
    monkeypatch.setattr(jaccard, "HEADS", 12)
    rng = random.Random(21)
    sets = [sorted(rng.sample(range(16), rng.randint(6, 9))) for _ in range(90)]
    expected = list(range(len(sets)))

    def find(i):
        while expected[i] != i:
            i = expected[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = set(sets[i]), set(sets[j])
        if 100 * len(a & b) >= 70 * len(a | b):
            x, y = sorted((find(i), find(j)))
            expected[y] = x
    rows = [(i, " ".join(f"w{v}" for v in x)) for i, x in enumerate(sets)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=70).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(sets))} and 20 < len({find(i) for i in range(len(sets))}) < 85


def test_boundary_follows_cost():
    assert jaccard.boundary({6: 100, 30: 1}, 85) >= 6 and jaccard.boundary({}, 85) == 0
    assert jaccard.subset_sizes(6, 85) == [6]


def test_language(docs, rows, empty):
    got = {r["doc_id"]: r for r in langid.identify(docs, VOCABULARY).select("doc_id", "held_out", "lang_pred", "score").collect()}
    right = [got[r[0]]["lang_pred"] == r[2] for r in rows[:60] if r[2] and len(words(r[1])) > 8 and r[0] % 5 != 4]
    assert np.mean(right) > 0.9
    assert all(got[60 + k]["lang_pred"] == "und" and got[60 + k]["score"] == 0 for k in range(3))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert langid.identify(empty, VOCABULARY).count() == 0


def test_language_forward_sums_all_segmentations():
    pieces = langid.Pieces(textkit.vocabulary_bytes(VOCABULARY))
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 1, 2))
    p[-1] = 0
    p /= p.sum(axis=0)
    word = b" the"
    at = {x: i for i, x in enumerate(pieces.pieces)}
    total = np.zeros(2)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        if all(x in at for x in parts):
            total += np.prod([p[at[x]] for x in parts], axis=0)
    assert np.allclose(langid.score_texts(pieces, p, ["THE"])[0], np.log(total))


def test_language_of_long_and_unlikely_words():
    """The forward pass alone, side by side and in plain logarithms agree; no word is cut or floored."""
    pieces = langid.Pieces(textkit.vocabulary_bytes(VOCABULARY))
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces) + 1, 2)) ** 3
    p[:256] *= 1e-9
    p[-1] = 0
    p /= p.sum(axis=0)
    at = {x: i for i, x in enumerate(pieces.pieces)}

    def plain(word):
        out = [np.zeros(2)]
        for e in range(1, len(word) + 1):
            ways = [out[e - l] + np.log(p[at[word[e - l : e]]]) for l in range(1, min(e, pieces.longest) + 1) if word[e - l : e] in at]
            out.append(np.logaddexp.reduce(ways, axis=0))
        return out[-1]

    assert max(map(len, pieces.pieces)) == pieces.longest > 16
    longest = next(x for x in pieces.pieces if len(x) == pieces.longest)
    for word in ("wort" * 125, "\U0001f9ff" * 40, "\U0001f9ff" * 12, longest.decode().strip().lower() * 3, "of"):
        assert np.allclose(langid.score_texts(pieces, p, [word])[0], plain(b" " + word.encode()), rtol=1e-9)
    words, counts = [b" the", b" " + b"wort" * 60, "\u2603\u2603".encode()], np.array([[3.0, 0], [1, 2], [0, 1]])
    side, langid.LONG = langid.learn(pieces, words, counts, 2), 0
    try:
        assert np.allclose(side, langid.learn(pieces, words, counts, 2), rtol=1e-8)
    finally:
        langid.LONG = 160


def test_decontamination(spark, docs, rows, empty):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta? iota kappa lambda mu."), (2, None), (3, ""), (1, "alpha beta gamma delta epsilon zeta eta theta? iota kappa lambda mu."), (None, "one two three four five six seven eight")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    leak = [(900, rows[0][1] + " " + items[0][1], "en"), (901, "ALPHA beta gamma delta epsilon zeta changed theta? iota kappa lambda mu.", "en"), (902, "alpha beta gamma only", "en"), (903, "filler " * 5000 + items[4][1], "en")]
    all_docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(leak, "doc_id long, text string, lang string"))
    got = decontam.contaminated(all_docs, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(900, 1), (901, 1), (903, None)}
    assert decontam.decontaminated(all_docs, benchmark).count() == all_docs.count() - 3
    assert decontam.contaminated(empty, benchmark).count() == 0
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0


def test_wand_equals_exhaustive_scores():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(70)]
    parsed = [decontam.words_of([t.encode()]) for _, t in items]
    df = Counter(int(h) for w in parsed for h in np.unique(w.hashes).view(np.int64))
    index = decontam.build(items, df, len(items), 12.0)
    text = decontam.words_of([" ".join(rng.choices(vocabulary, k=400)).encode()])
    got = {(b, e, i): s for b, e, i, s in decontam.search(index, text, 0.5)}
    want = {}
    for group in index.groups:
        for begin in range(0, max(1, 400 - group.longest), group.longest):
            end = min(400, begin + 2 * group.longest)
            have, score = set(text.hashes[begin:end].tolist()), Counter()
            for t, term in enumerate(index.terms.tolist()):
                for k in range(group.first[t], group.first[t + 1]) if term in have else ():
                    score[int(group.item[k])] += group.impact[k]
            want |= {(begin, end, i): s for i, s in score.items() if s >= 0.5}
    assert len(want) > 50 and len(index.groups) > 2 and set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)


def brute_contaminated(docs, items, rule=decontam.Rule()):
    """The same decisions from plain words: every item against every passage of its group's width."""
    items = [(i, words(t), t) for i, t in items if words(t)]
    df = Counter(w for _, ws, _ in items for w in set(ws))
    mean = sum(len(ws) for _, ws, _ in items) / len(items)
    longest = Counter()
    for _, ws, _ in items:
        longest[len(ws).bit_length()] = max(longest[len(ws).bit_length()], len(ws))
    pairs = lambda ws: set(zip(ws, ws[1:])) if len(ws) > 1 else set(ws)
    out = set()
    for i, ws, text in items:
        tf = Counter(ws)
        impact = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in tf.items()}
        cut = decontam.split_item(text, len(ws))
        question, answer = pairs(ws[:cut]), pairs(ws[cut:])
        step = longest[len(ws).bit_length()]
        for d, doc in docs:
            dw = words(doc)
            for begin in range(0, max(1, len(dw) - step), step):
                part = dw[begin : begin + 2 * step]
                have = pairs(part) | set(part)
                score = sum(v for w, v in impact.items() if w in set(part)) / sum(impact.values())
                if score >= rule.threshold and len(question & have) >= rule.question * len(question) and len(answer & have) >= rule.answer * len(answer):
                    out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([4, 12, 30, 90])))) for i in range(40)] + [(40, "no\u00a0break one. two three four.")]
    docs = []
    for d in range(80):
        text = rng.choices(vocabulary, k=rng.randint(0, 300))
        if d % 2:
            planted = words(rng.choice(items)[1])
            planted = [w if rng.random() > 0.2 * (d % 3) else "changed" for w in planted]
            text[rng.randint(0, len(text)) : 0] = planted
        docs.append((d, " ".join(text)))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert len(got) > 15 and got == brute_contaminated(docs, items)


def test_decontamination_is_not_changed_by_a_long_item(spark):
    short, gap = [f"s{i}" for i in range(12)], ["filler"] * 300
    docs = spark.createDataFrame([(1, " ".join(short[:6] + gap + short[6:]), "x", "y"), (2, " ".join(short), "x", "y")], "doc_id long, text string, score string, item_id string")
    for extra in ([], [(2, " ".join(f"l{i}" for i in range(5000)))]):
        items = spark.createDataFrame([(1, " ".join(short)), *extra], "item_id long, text string")
        assert [r["doc_id"] for r in decontam.contaminated(docs, items).collect()] == [2]
        assert [r["doc_id"] for r in decontam.decontaminated(docs, items).collect()] == [1]


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs.drop("size")).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[r["source"]].append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert own[0]["target"] - 200 <= sum(r["taken"] for r in own) <= own[0]["target"] or max(r["size"] for r in own) > 10_000
    key = lambda r: repr((r["doc_id"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_sources(docs.drop("size").repartition(2)).collect()))
    assert mixing.mixed(docs.drop("size")).count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(empty.drop("size")).count() == 0


def test_mixing_parts():
    assert mixing.shares([10, 10, 80], [5, 2, 1], 1.5, 2) == [20.0, 20.0, 110.0]
    rng = random.Random(4)
    for _ in range(50):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 60)
        best = max(s for k in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(lengths, k))) <= budget)
        found = mixing.knapsack(lengths, counts, budget)
        assert sum(a * b for a, b in found.items()) == best
        assert all(found.get(a, 0) <= c for a, c in zip(lengths, counts))


def test_mixing_fit_equals_brute_force():
    rng = random.Random(14)
    for _ in range(120):
        n = rng.randint(1, 5)
        lengths, counts = rng.sample(range(1, 10_000), n), [rng.randint(0, 3) for _ in range(n)]
        total = sum(a * b for a, b in zip(lengths, counts))
        target = float(rng.randint(0, 2 * total))
        copies, extra = mixing.fit(lengths, counts, target, 2)
        whole = min(2, int(target // total)) if total else 0
        budget = int(target) - whole * total if whole < 2 else 0
        best = max(s for k in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(lengths, k))) <= budget)
        assert copies == whole and sum(a * b for a, b in zip(lengths, extra)) == best and all(0 <= e <= c for e, c in zip(extra, counts))
    assert mixing.fit([5000, 7000], [4, 4], 10_000.0, 2) == (0, [2, 0])
    assert sum(a * b for a, b in zip([5000, 7000, 9001], mixing.fit([5000, 7000, 9001], [4, 4, 4], 15_000.0, 2)[1])) == 15_000


def test_mixing_keeps_the_columns_of_its_input(spark):
    names = ["doc_id", "text", "source", "size", "b", "s", "z", "taken", "rank", "u0", "+"]
    rows = [(i, "word " * (i % 7 + 1), f"s{i % 2}", "7", i, "x", "y", -1, "r", "u", "+") for i in range(40)]
    frame = spark.createDataFrame(rows, names)
    out = mixing.mixed(frame)
    assert out.columns == names and {tuple(r) for r in out.collect()} <= set(rows)
    mixed = mixing.mix_sources(frame.drop("size")).collect()
    assert out.count() == sum(r["copies"] for r in mixed) and all(r["b"] == r["doc_id"] and r["taken"] >= 0 and r["rank"] == "r" for r in mixed)


def test_mixing_fits_long_documents():
    assert mixing.fit([9000, 6000, 5000], [1, 1, 1], 11000.0, 2) == (0, [0, 1, 1])


def test_lm(docs, rows, empty):
    got = lm.score(docs, VOCABULARY).collect()
    assert len(got) == len(rows)
    train = Counter()
    for r in rows:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1:
            train.update([*words(r[1]), None])
    n, v = sum(train.values()), len(train)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        tokens = [*words(text[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9)
        assert r["score"] < 0 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    assert lm.score(empty, VOCABULARY).count() == 0


def test_lm_is_a_distribution_and_windows_agree():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 700)
    model = lm.train(counts, [rng.integers(0, 699, 90) for _ in range(4)], steps=5)
    head = rng.integers(0, 699, 20)
    ids = np.concatenate([np.r_[head, x] for x in range(700)])
    score = lm.log10_texts(model, ids, np.arange(0, len(ids) + 1, 21))
    alone = lm.log10_texts(model, head, np.array([0, 20]))
    assert math.isclose(np.sum(10 ** (score - alone)), 1, rel_tol=1e-3)
    long = rng.integers(0, 699, 100)
    inputs, real, classes = lm.lesson(model, lm.blocks(long, np.array([0, 100]), 699)[2])
    top = lm._attend(model.w, inputs, real)[-1]
    row, col = np.nonzero(real[:, lm.BEFORE :])
    plain = lm._log_class(model.w, top[row, col], classes[row, col]).sum() / math.log(10) + model.log_in_class[long].sum()
    assert len(row) == 100 and math.isclose(plain, lm.log10_texts(model, long, np.array([0, 100]))[0], rel_tol=1e-4)


def test_lm_scores_empty_texts_after_a_long_one(spark):
    """In one task, the empty texts being a chunk of their own."""
    rows = [(1, "a b " * (lm.TEXT_CHUNK // 4 + 1)), (2, ""), (3, None)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), VOCABULARY, train_docs=0).collect()}
    assert got[1]["n_tokens"] == lm.TEXT_CHUNK // 2 + 3 and got[2]["n_tokens"] == got[3]["n_tokens"] == 1
    assert got[2]["score"] == got[3]["score"] < 0 and got[2]["base_score"] == got[3]["base_score"] < 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    """Prose of syllables in two languages, of which a word may be new but its syllables are not."""
    rows = [(i, text) for i, text, *_ in made(900, seed=5)[:900]]
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect() if r["held_out"]]
    assert len(got) > 100 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_lm_learns_from_documents_outside_the_sample(spark):
    """Corpora with equal counts that differ only in the order of words, none of it in the sample."""
    rng = random.Random(3)
    phrase = "the cat sat on a red mat by that old door".split()
    mixed = lambda n: [w for _ in range(n) for w in rng.sample(phrase, len(phrase))]
    scores = []
    for make in (lambda n: phrase * n, mixed):
        rows = [(i, " ".join(make(60))) for i in range(300)] + [(1000, " ".join(phrase * 20))]
        got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), VOCABULARY, train_docs=0, share=1).where("doc_id = 1000").first()
        scores.append(got["score"] / got["n_tokens"])
    assert scores[0] > scores[1] + 0.02


def test_lm_gradients_are_those_of_the_loss():
    """Against central differences in double precision, with texts shorter and longer than a block, and finite beyond the cap."""
    rng = np.random.default_rng(2)
    model = lm.train(rng.integers(0, 50, 700), [], steps=0)
    w = {k: x.astype(np.float64) for k, x in model.w.items()}
    n = np.array([1, 5, 32, 33, 100])
    ids, first = rng.integers(0, 699, n.sum()), np.concatenate([[0], np.cumsum(n)])
    ids[first[1:] - 1] = 699
    part = lm.lesson(model, lm.blocks(ids, first, 699)[2])
    _, g = lm.gradients(w, *part)
    assert g.keys() == w.keys()
    for k, x in w.items():
        for i in np.argsort(-np.abs(g[k]).ravel())[:3]:
            kept, losses = x.flat[i], []
            for step in (1e-4, -1e-4):
                x.flat[i] = kept + step
                losses.append(lm.gradients(w, *part)[0])
            x.flat[i] = kept
            assert math.isclose((losses[0] - losses[1]) / 2e-4, np.asarray(g[k]).ravel()[i], rel_tol=1e-3), k
    far = {k: x * np.float32(30) for k, x in model.w.items()}
    assert all(np.isfinite(x).all() for x in lm.gradients(far, *part)[1].values())
    assert np.isfinite(lm.log10_texts(lm.Model(model.input_of, model.class_of, model.log_in_class, far), ids, first)).all()


class Counted(np.ndarray):
    """Arrays that count the multiplications of the matrix products they are in."""

    done = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=(), **more):
        plain = lambda x: x.view(np.ndarray) if isinstance(x, Counted) else x
        got = getattr(ufunc, method)(*map(plain, inputs), **({"out": tuple(map(plain, out))} if out else {}), **more)
        if ufunc is np.matmul:
            Counted.done += np.size(got) * np.shape(inputs[0])[-1]
        return got.view(Counted) if isinstance(got, np.ndarray) else got


def test_lm_work_of_a_target():
    """Multiplications of a target that is learnt and of one that is scored; they were over 18,000 and 6,000."""
    rng = np.random.default_rng(6)
    model = lm.train(rng.integers(0, 50, 700), [], steps=0)
    w = {k: x.view(Counted) for k, x in model.w.items()}
    ids = rng.integers(0, 699, 128 * lm.STRIDE)
    part = lm.lesson(model, lm.blocks(ids, np.array([0, len(ids)]), 699)[2])
    Counted.done = 0
    loss, g = lm.gradients(w, *part)
    assert 3_000 < Counted.done / len(ids) < 12_000
    plain, h = lm.gradients(model.w, *part)
    assert loss == plain and all(np.array_equal(g[k], h[k]) for k in h)
    Counted.done = 0
    lm.log10_texts(lm.Model(model.input_of, model.class_of, model.log_in_class, w), ids, np.array([0, len(ids)]))
    assert 1_000 < Counted.done / len(ids) < 4_000


def test_lm_sees_every_id_before_a_target_and_none_after():
    rng = np.random.default_rng(7)
    model = lm.train(rng.integers(0, 50, 700), [], steps=0)
    inputs, real, _ = lm.lesson(model, lm.blocks(rng.integers(0, 699, 3 * lm.STRIDE), np.array([0, 3 * lm.STRIDE]), 699)[2][1:2])
    top = lm._attend(model.w, inputs, real)[-1][0]
    for i in range(inputs.shape[1]):
        other = inputs.copy()
        other[0, i] = (other[0, i] + 1) % lm.INPUTS
        changed = (lm._attend(model.w, other, real)[-1][0] != top).any(axis=1)
        assert changed.tolist() == [i <= lm.BEFORE + j for j in range(lm.STRIDE)]


def test_lm_kinds_are_those_of_unique():
    values = np.random.default_rng(8).integers(0, 500, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for x in (values, values[:1], values[:0]):
        kinds, place, inverse = lm._kinds(x)
        assert np.array_equal(kinds, np.unique(x)) and np.array_equal(x[place], kinds) and np.array_equal(kinds[inverse], x)


def test_lm_learns_every_block(spark, monkeypatch):
    """Without parameters, all blocks of all training documents teach, each once; a very long text's lie in several rows."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "Tide", "quartz"]) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    rows += [(40, " ".join(rng.choice("abc") for _ in range(600_000))), (41, None), (None, "not learned from")]
    taught = []

    def refine(gathered, model):
        for r in gathered.where("blocks is not null").collect():
            taught.append(lm._unpacked(r["blocks"], len(model.class_of) - 1))
        return model

    monkeypatch.setattr(lm, "refine", refine)
    lm.score(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY)
    subwords = lm.Subwords(textkit.vocabulary_bytes(VOCABULARY))
    training = [(text or "").encode() for i, text in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    ids, first = lm.with_ends(subwords, textkit.words_of(training))[:2]
    every = lm.blocks(ids, first, subwords.size)[2]
    assert max(map(len, taught)) == lm.ROW and sorted(map(bytes, np.concatenate(taught).astype("<i4"))) == sorted(map(bytes, every))


def test_chaining(spark, docs, empty):
    rng = random.Random(8)
    text = lambda n: [f"u{rng.randint(0, 10**9)}" for _ in range(n)]
    shared, fuzzy = text(60), text(120)
    changed = [w if i % 25 else "new" for i, w in enumerate(fuzzy)]
    rows = [(1, text(100) + shared + text(50)), (2, shared + text(30)), (3, text(30) + shared), (4, text(9) + fuzzy), (5, changed + text(40)), (6, text(200)), (7, shared[:40]), (8, text(5))]
    got = chaining.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(9, None), (None, " ".join(shared))], "doc_id long, text string")).collect()
    spans = {r["doc_id"]: (r["begin_word"], r["end_word"], r["homes"]) for r in got}
    assert set(spans) == {2, 3, 5} and len(got) == 3
    assert spans[2] == (0, 60, [1]) and spans[3] == (30, 90, [1])
    # Runs of 24 words between the changes are sure to share a seed; the last 19 words are not.
    assert spans[5][0] <= 1 and spans[5][1] >= 100 and spans[5][2] == [4]
    assert chaining.repeated_passages(empty).count() == 0


def test_chaining_finds_fuzzy_passages(spark):
    rng = random.Random(9)
    text = lambda n: [f"u{rng.randint(0, 10**9)}" for _ in range(n)]
    ends, often = text(60), text(60)
    changed = [w if i not in (7, 52) else f"new{i}" for i, w in enumerate(ends)]
    every = [w if i % 15 != 7 else f"new{i}" for i, w in enumerate(often)]
    rows = [(1, text(40) + ends + text(40)), (2, text(40) + changed + text(40)), (3, text(40) + often + text(40)), (4, text(40) + every + text(40))]
    got = chaining.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["begin_word"], r["end_word"], r["homes"]) for r in got} == {2: (40, 100, [1]), 4: (40, 100, [3])}
    assert {r["doc_id"]: round(r["aligned"] * 60) for r in got} == {2: 58, 4: 56}
    assert chaining.longest_parts([(0, 5, 5.0), (25, 85, 54.0), (105, 110, 5.0)], 50, 0.8) == [(25, 85, 54.0)]
    assert chaining.longest_parts([(0, 60, 60.0), (80, 140, 60.0)], 50, 0.8) == [(0, 140, 120.0)]


def test_chains_take_a_near_match_where_the_best_is_far():
    x, y = np.array([0, 8, 16, 24, 90, 100]), np.array([0, 8, 16, 24, 30, 40])
    assert [4, 5] in chaining.chains(x, y)


def brute_chains(x, y):
    """The same chains by looking at every pair of matches."""
    order, value, back = np.lexsort((y, x)).tolist(), {}, {}
    reach = chaining.GAP + chaining.K
    for i in order:
        ways = [(value[j] + 0.1 * (int(x[j]) + int(y[j])), j) for j in value if 0 < x[i] - x[j] <= reach and 0 < y[i] - y[j] <= reach]
        value[i], back[i] = float(chaining.K), -1
        if ways:
            best, j = max(ways)
            joined = best - 0.1 * (int(x[i]) + int(y[i])) + min(chaining.K, int(x[i] - x[j]), int(y[i] - y[j]))
            if joined > 0:
                value[i], back[i] = max(value[i], joined + chaining.K * 0.2), j
    out, taken = [], set()
    for i in sorted(order, key=lambda i: -value[i]):
        chain = []
        while i >= 0 and i not in taken:
            taken.add(i)
            chain.append(i)
            i = back[i]
        out += [chain[::-1]] * bool(chain)
    return out


def test_chains_equal_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 120):
        for _ in range(20):
            x, y = rng.integers(0, 3 * n, n), rng.integers(0, 3 * n, n)
            diagonal = rng.random(n) < 0.6
            y = np.where(diagonal, x + 7 + rng.integers(0, 3, n), y)
            x, y = np.unique(np.stack([x, y]), axis=1)
            assert sorted(chaining.chains(x, y)) == sorted(brute_chains(x, y))


def test_chaining_of_two_passages_repeated_rows_and_parts(spark):
    rng = random.Random(10)
    text = lambda n: [f"u{rng.randint(0, 10**9)}" for _ in range(n)]
    one, two, long = text(70), text(90), text(30_000)
    rows = [(1, one + text(40) + two), (2, two + text(300) + one), (3, text(60)), (3, text(20) + one + text(5)), (3, text(60)), (4, long), (5, text(7) + long[2000:29_000]), (6, two), (6, two), (None, one), (7, [])]
    rows = [(i, " ".join(w), "h", 1, 2, 3) for i, w in rows] + [(8, None, "h", 1, 2, 3)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, h string, home int, pos int, part int").repartition(3)).collect()
    spans = sorted((r["doc_id"], r["begin_word"], r["end_word"], tuple(r["homes"]), r["aligned"]) for r in got)
    assert spans == [(2, 0, 90, (1,), 1.0), (2, 390, 460, (1,), 1.0), (3, 20, 90, (1,), 1.0), (5, 7, 27_007, (4,), 1.0), (6, 0, 90, (1,), 1.0)]
    within = spark.createDataFrame([(1, " ".join(two + text(200) + two)), (2, " ".join(text(100)))], "doc_id long, text string")
    assert chaining.repeated_passages(within).count() == 0
    (r,) = chaining.repeated_passages(within, within=True).collect()
    assert (r["doc_id"], r["begin_word"], r["end_word"], r["homes"]) == (1, 290, 380, [1])


def test_chains_and_edit_distance():
    x, y = np.array([0, 9, 20, 500]), np.array([5, 14, 26, 2])
    assert sorted(map(sorted, chaining.chains(x, y))) == [[0, 1, 2], [3]]
    rng = random.Random(6)
    for _ in range(30):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 8))] for _ in range(2))
        table = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert chaining.edit_distance(np.array(a), np.array(b)) == table[-1][-1]


def test_audio(spark, docs, rows, empty):
    got = audio.describe(audio.store(docs)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        n, payload = audio.payload_of(text[r["doc_id"]])
        media = audio.wave(payload, audio.format_of(payload))
        assert audio.read_wave(media) == (audio.format_of(payload), payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (n, len(payload), len(media)) and len(payload) % 64 == 0 and payload
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert {r["feature"].split(";")[0] for r in got} <= {*audio.TAGS}
    assert audio.pcm(spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")).where("pcm is null").count() == 2
    assert audio.describe(audio.store(empty)).count() == 0


def test_audio_codecs():
    assert audio.MULAW[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert audio.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(256))
    expected = []
    for k in range(0, 256, 64):
        block = data[k : k + 64]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        expected.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(audio.INDEX_CHANGE[code & 7])))
                expected.append(value)
    assert audio.adpcm(data).tolist() == expected
    assert audio.resample(np.array([100, 100, 100], dtype=np.int16)).tolist() == [100] * 6


def test_audio_features_in_pieces_equal_those_of_the_whole():
    rng = np.random.default_rng(2)
    for n in (1, 2, 64, 1000, audio.PIECE - 1, audio.PIECE, audio.PIECE + 1, 3 * audio.PIECE + 5):
        pcm = rng.integers(-32768, 32768, n).astype(np.int16)
        whole = audio.resample(pcm)
        wide = whole.astype(np.int64)
        below = whole < 0
        want = f"x;n={2 * n};rms={math.isqrt(int((wide**2).sum()) // (2 * n))};peak={np.abs(wide).max()};zc={np.count_nonzero(below[1:] != below[:-1])};crc={zlib.crc32(whole.tobytes()):08x}"
        assert audio.feature("x", pcm) == want


PAGE = '<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a>menu</a></li><li><a>two</a></li></ul></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld\n text.<br>Next{}</article><div id="comments"><p>reader</p></div><footer>&copy; site</footer></body></html>'


def test_wrappers(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format("".join(f"<p>par {k}</p>" for k in range(i)))) for i in range(6)]
    rows += [(10, None, None), (11, "nonsense", ""), (12, "https://x.example/", "<div class='sidebar'>s</div><p>a < b"), rows[0]]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert text[i] == " ".join(["Head & line", "One bold text.", "Next", *(f"par {k}" for k in range(i))])
    assert (text[10], text[11], text[12]) == ("", "", "a < b") and len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_end_marked_elements(spark):
    one = "<article><p>a</p>{}<p>b</p><ul><li class='share'>s<li>c</ul></article>"
    marked = ["<p class='notice'>n</p>", "<h2 class='related'>r</h2>", "<img class='banner'>", "<p class='notice'>n", ""]
    rows = [(i, f"https://a.example/{i}", one.format(x)) for i, x in enumerate(marked)]
    rows += [(10, "https://b.example/1", "<main><div class='ad'>buy</div><p>d</p><hr></main>"), (11, "https://b.example/2", "<main><div>e</div><p>f</p></main>"), (12, "https://b.example/3", "<div><p>g</p></div>")]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {**dict.fromkeys(range(5), "a b c"), 10: "d", 11: "e f", 12: "g"}


def test_wrappers_compare_whole_texts_of_different_pages(spark):
    lead = "word " * 60
    rows = [(i, f"https://a.example/{i}", f"<p>{lead}end {i}</p>") for i in range(4)]
    rows += [(10 + i, f"https://b.example/{i}", "<p>copy</p>") for i in range(5)]
    rows += [(20 + i, f"https://c.example/{i}", f"<div>menu of all</div><p>text {i}</p>") for i in range(3)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert text == {**{i: f"{lead}end {i}" for i in range(4)}, **{10 + i: "copy" for i in range(5)}, **{20 + i: f"text {i}" for i in range(3)}}


def test_wrappers_keep_articles_whose_names_hold_other_words(spark):
    inner = "<div class='related-work'>a</div><section class='notice-of-appeal'>b</section><ul class='menu-items'><li>c</ul><table class='search-results'><tr><td>d</table>"
    other = "<div class='ad'>x</div><div class='cookie-banner'>x</div><div id='site-nav'>x</div><div class='share-buttons top'>x</div><section class='comment-list'>x</section>"
    rows = [(1, "https://a.example/1", f"<article><p>begin</p>{inner}{other}<p>end</p></article>"), (2, "https://a.example/2", None)]
    rows += [(3 + i, f"https://b.example/{i}", f"<div class='ad'>advert {i}</div><p>one text</p>") for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrappers.extract(frame).collect()} == {1: "begin a b c d end", 2: "", **{3 + i: "one text" for i in range(4)}}
    clash = frame.withColumns({"host": F.lit("h"), "wrapper": F.lit("w"), "text": F.lit("t"), "n_chars": F.lit(1)})
    assert wrappers.extract(clash).count() == len(rows)


def test_wrapper_inference():
    read = lambda s: wrappers.fold(s.split())
    assert wrappers.shape(read("ul li T /li li T /li li T /li /ul")) == ["ul", "(li T /li)+", "/ul"]
    a, b = (wrappers.Wrapper(wrappers.shape(read(s)), [False] * len(read(s)), {}) for s in ("h1 T /h1 p T /p", "h1 T /h1 img p T /p hr"))
    assert a.merged(b).expression() == "h1 T /h1 (img)? p T /p (hr)?"


def test_licences(spark, docs, rows, empty):
    extra = [(950, "Some text.\nReleased under the MIT License.\n"), (951, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."), (952, "The licence of a driver. All rights reserved."), (953, "This work is licensed under the GNU General Public License, version 3."), (954, "Licensed under CC BY-NC 4.0.")]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licences.scan(frame).collect()}
    assert [got[k]["licences"] for k in range(950, 955)] == ["MIT", "Apache-2.0", "proprietary", "GPL-3-only", "CC-BY-NC-4.0"]
    assert got[951]["n_unmatched"] == 1 and got[952]["sentences"] == "UNKNOWN AllRights"
    assert all(got[r[0]]["licences"] == "" for r in rows)
    assert licences.scan(empty).count() == 0


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
""",
    "Apache-2.0": """# Copyright 2020 Somebody
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# is distributed on an "AS IS" BASIS.
""",
    "GPL-3-or-later": """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
""",
    "GPL-2-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "CC-BY-4.0": "Released under CC BY 4.0.",
    "CC-BY-SA-4.0": "A title without a stop\nDistributed under Creative Commons BY-SA 4.0\nmore text",
}


# A sentence or two of each further licence.
SENTENCES = {
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.',
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1.",
    "Artistic-2.0": "Licensed under the Artistic License 2.0.",
    "Artistic-1.0": "Distributed under the Artistic License.",
    "Artistic-1.0-Perl OR GPL-1.0-or-later": "You may use it under the same terms as Perl itself.",
    "PSF-2.0": "Licensed under the Python Software Foundation License.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted.",
    "HPND": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies.",
    "NCSA": "University of Illinois/NCSA Open Source License",
    "JSON": NOTICES["MIT"].split("\n\n", 2)[2].replace("copies or substantial portions of the Software.", "copies or substantial portions of the Software.\n\nThe Software shall be used for Good, not Evil."),
    "X11": NOTICES["MIT"].split("\n\n", 2)[2] + "\nExcept as contained in this notice, the name of Somebody shall not be used in advertising.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "GFDL-1.3-or-later": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-3.0": "This work is licensed under the Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, Somebody has waived all copyright and related or neighboring rights to this work.",
    "BSD-4-Clause": NOTICES["BSD-3-Clause"].replace("3. Neither", "3. All advertising materials mentioning features or use of this software must display the following acknowledgement.\n4. Neither"),
    "BSD-2-Clause": NOTICES["BSD-3-Clause"].split("3. Neither")[0],
    "MIT": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "MS-PL": "Microsoft Public License (Ms-PL)",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2",
    "OpenSSL": "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit.",
    "Beerware": '"THE BEER-WARE LICENSE" (Revision 42):',
    "BUSL-1.1": "Business Source License 1.1",
    "SSPL-1.0": "Server Side Public License, version 1",
    "Elastic-2.0": "Licensed under the Elastic License 2.0",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3-only": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Apache License\nVersion 2.0, January 2004",
}


@pytest.mark.parametrize("name", SENTENCES)
def test_further_licences(name):
    found = licences.Recogniser()
    assert found.match(found.sequence("Some text.\n\n" + SENTENCES[name] + "\n\nMore text."))[0] == [name]


def test_every_sentence_has_a_trigger_and_every_identifier_a_rule():
    used = " ".join(p for patterns, _ in licences.RULES for p in patterns)
    for pattern, name in licences.SENTENCES:
        plain = pattern.replace("\\", "")
        assert any(t in plain or all(w in plain for w in t.split()) for t in licences.TRIGGERS), pattern
        assert name.split(":")[0] in used or name.split(":")[0] in {"ApacheCompliance", "ApacheURL", "BSDEndorse", "AsIsWarranty"}, name


@pytest.mark.parametrize("name", NOTICES)
def test_standard_notices(name):
    found = licences.Recogniser()
    ids = found.sequence(NOTICES[name])
    assert found.match(ids)[0] == [name]
    if name == "Apache-2.0":
        assert [x for x in ids if x != "UNKNOWN"] == ["ApacheVer:2.0", "ApacheCompliance", "ApacheURL"]
    if name == "MIT":
        assert found.sequence("Text.\n(c) Somebody.\nAll rights reserved") == ["AllRights"] and "MPLName" in found.sequence(NOTICES["MPL-2.0"].replace(", v.", ",\nv."))
        assert ids.index("MITNotice") == ids.index("MITPermission") + 1 == ids.index("AsIsWarranty") - 1
