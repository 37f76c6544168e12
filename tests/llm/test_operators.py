"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import io
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from grantloom.llm import ann, bits, mixing, near_dup, ngram, packing, quality, queries, substring, token_ids, toxicity, warc
from grantloom.llm.elias_fano import EliasFano, read_arrays, write_arrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def long_text(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


BASE = long_text(1, 300)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w1 ", "changed ", 1)), (4, long_text(2, 120) + " " + " ".join(BASE.split()[100:170])),
    (5, None), (6, ""), (7, " \t\n "), (8, "One two"), (9, "one TWO"), (10, "a\nb\nb\n\nb c d"), (11, "same eight words in a row right here " * 9),
    (12, long_text(3, 30_000, 5000)), (13, "Grüße, élan vital; don't  stop!? " * 5), (13, "Grüße, élan vital; don't  stop!? " * 5), (None, "no id here"), (14, "x" * 5000), (15, "|||| *** " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", None, "clash", "clash") for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- near duplicates


def components(texts, n, percent=80):
    sets = []
    for _, t in texts:
        w = words(lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        least[root(k)].append(i)
    found = []
    for k, (i, _) in enumerate(texts):
        ids = [x for x in least[root(k)] if x is not None]
        found.append((i, len(sets[k]), min(ids) if ids else None))
    return found


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, n):
    got = near_dup.link_components(docs, shingle=n)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(components(TEXTS, n), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_between_outer_members(spark):
    """Members that the family's leader isn't similar to, but that are similar to each other, are linked."""
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(200)]
    texts = [(k, " ".join(base)) for k in range(3)]
    for family in range(6):
        changed = list(base)
        for at in rng.choice(200, 9, replace=False):
            changed[at] = f"x{family}"
        for copy in range(3):
            one = list(changed)
            one[int(rng.integers(200))] = f"y{family}{copy}"
            texts.append((100 + 10 * family + copy, " ".join(one)))
    got = near_dup.link_components(spark.createDataFrame(texts, "doc_id long, text string"), shingle=4)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(components(texts, 4))


def test_near_duplicates_of_nothing(docs, nothing):
    assert near_dup.link_components(nothing).count() == 0
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {1, 4, 5, 6, 7} <= {r["doc_id"] for r in kept.collect()}


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    same = (near_dup.signature(np.unique(a), 2000) == near_dup.signature(np.unique(b), 2000)).mean()
    assert abs(same - 1600 / 2400) < 0.05


# ---------------------------------------------------------------- substrings


def cut(texts, n=50):
    first = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(i, first.get(tuple(w[k : k + n]), i))
    found = []
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        found.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return found


def test_substrings(docs, nothing):
    got = substring.repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(cut(TEXTS), key=key)
    assert substring.repeated_passages(nothing).count() == 0
    changed = substring.without_repeated_passages(docs)
    assert changed.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in changed.collect()}
    assert 2 not in texts and texts[1] == BASE and len(words(texts[4])) == 120


def thue_morse(length, one, two):
    found = one
    other = two
    while len(found) < length:
        found, other = found + other, other + found
    return found


def test_words_without_chance_to_collide_do_not(spark):
    """Power series modulo 2**64 take Thue-Morse words for equal, whatever their base; the operators must not."""
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rest = [f"w{k}" for k in range(60)]
    texts = [(1, " ".join([a, *rest[:60]])), (2, " ".join([w for r in rest for w in (b, r)])), (3, " ".join([w for r in rest for w in (a, r)]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in substring.repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted(cut(texts))
    assert sorted(map(tuple, near_dup.link_components(docs, 4).select("doc_id", "n_shingles", "component_id").collect())) == sorted(components(texts, 4))
    # The same of sequences of two words.
    one, two = (thue_morse(1024, ["x"], ["y"]), thue_morse(1024, ["y"], ["x"]))
    texts = [(1, " ".join(one)), (2, " ".join(two))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = substring.repeated_passages(docs, window=1024, gram=512).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(cut(texts, 1024))


def test_index_is_saved_opened_and_extended(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    passage = " ".join(f"p{k}" for k in range(70))
    filler = lambda seed: " ".join(f"f{seed}x{k}" for k in range(80))
    texts = [(k, f"{filler(k)} {passage if k in (2, 5, 9) else filler(100 + k)} {filler(200 + (k % 7))}") for k in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = []
    for low, high in ((-1, 2), (2, 4), (4, 7), (7, 12)):
        index = substring.FingerprintIndex(spark, folder)  # opened anew each time
        part = docs.filter((F.col("doc_id") > low) & (F.col("doc_id") <= high))
        earlier = docs.filter(F.col("doc_id") <= low) if low >= 0 else None
        got += [tuple(r) for r in index.add(part, earlier).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == sorted(cut(texts))
    assert sum(r[2] > 0 for r in got) > 4
    index = substring.FingerprintIndex(spark, folder)
    assert index.version == 4 and [level for level, _ in index.runs["prints"]] == [2]
    with pytest.raises(ValueError):
        index.add(docs)
    with pytest.raises(ValueError):
        substring.FingerprintIndex(spark, folder, window=40)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 2**63, 97, dtype=np.uint64)
    for k in (1, 2, 7, 96, 97, 98):
        assert substring.sliding_min(x, k).tolist() == [int(x[a : a + k].min()) for a in range(len(x) - k + 1)]


# ---------------------------------------------------------------- mixing


def test_targets_are_filled_like_water():
    got = mixing.targets([("b", 10), ("a", 1000), (None, 100)], [3, 1, 2], 1.5, 2)
    assert got["b"] == 20 and got[None] == 200
    assert got["a"] == pytest.approx(1.5 * 1110 - 220)


def queue_simulated(rows, goal, epochs, quantum, order):
    """(source, document) -> words, by serving slices one by one until the budget is used up."""
    queue = []
    for source, target in goal.items():
        done = 0
        for copy in range(epochs):
            for n, (k, size) in enumerate(order[source]):
                for at in range(0, size, quantum):
                    end = min(size, at + quantum)
                    queue.append(((done + end) / target, source is not None, source or "", n, copy, at, k, end - at))
                done += size
    left, got = round(sum(goal.values())), Counter()
    for *_, k, n in sorted(queue):
        got[k] += min(n, left)
        left -= min(n, left)
    return got


def test_mix_serves_the_queue(spark, nothing):
    rng = np.random.default_rng(3)
    rows = [(k, "w " * int(rng.integers(0, 700)), [None, "a", "b", "c"][int(rng.integers(0, 4))], "x", "y", 7) for k in range(120)]
    rows += [rows[5], rows[5], (200, None, "a", "x", "y", 7), (201, "", "d", "x", "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string, taken string, x1 int")
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    goal = {s: t for s, t in mixing.targets(list(sizes.items()), [3, 1, 2], 1.5, 2).items() if t > 0}
    # The shuffled order is the operator's own; everything after it is simulated.
    order = defaultdict(list)
    for r in mixing.placed(docs, [3, 1, 2], 1.5, 2, 11).orderBy("_group", "_chunk", "_turn").collect():
        order[r["_group"][1:] if r["_group"] != "-" else None].append(((r["doc_id"]), r["_size"]))
    want = queue_simulated(rows, goal, 2, 100, {s: order[s] for s in goal})
    got = Counter()
    for r in mixing.taken_words(docs, [3, 1, 2], quantum=100).collect():
        got[r["doc_id"]] += r["taken"]
    assert +got == +want and sum(got.values()) == round(sum(goal.values()))
    mixed = mixing.mixed_documents(docs, [3, 1, 2], quantum=100)
    assert mixed.columns == docs.columns
    # Of each copy at least half: no document comes more often than its words allow, nor less.
    often = Counter(r["doc_id"] for r in mixed.collect())
    for k, text, *_ in rows[:120]:
        n = len(words(text)) * sum(r[0] == k for r in rows)
        assert (often[k] >= 1) if n and want[k] >= n else (often[k] <= 3 * 2)
        assert n == 0 or abs(often[k] * len(words(text)) - want[k]) <= n
    assert mixing.mixed_documents(nothing, [1]).count() == 0


def test_mix(docs, nothing):
    rows = mixing.taken_words(docs, [3, 1, 2]).collect()
    assert sorted(r["size"] for r in rows) == sorted(len(words(t)) for _, t in TEXTS)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    by = Counter()
    for r in rows:
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 2 * mixing.QUANTUM for (_, target), taken in by.items())
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, mixing.taken_words(docs, [3, 1, 2]).collect()), key=key)
    assert mixing.taken_words(nothing, [1]).count() == 0
    mixed = mixing.mixed_documents(docs, [3, 1, 2])
    assert mixed.columns == docs.columns and mixed.count() > 0


# ---------------------------------------------------------------- quality


def test_quality(docs, nothing):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.cascade(docs).collect())
    want = Counter()
    for i, t in TEXTS:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)] += 1
    assert got == want
    assert quality.cascade(nothing, list(quality.rules())).count() == 0 and len(quality.ordered_rules(nothing)) == len(quality.rules())
    orders = [list(quality.rules()), list(quality.rules())[::-1]]
    verdicts = [sorted((str(r["doc_id"]), r["kept"]) for r in quality.cascade(docs, o).collect()) for o in orders]
    assert verdicts[0] == verdicts[1]
    clashing = docs.withColumnsRenamed({"lang": "_words", "source": "_hashes", "score": "kept", "ids": "n_words"}).withColumn("_placed", F.lit(1))
    assert sorted((str(r["doc_id"]), r["kept"]) for r in quality.cascade(clashing, orders[0]).collect()) == verdicts[0]


JUNK = {
    "symbols": "## " * 30 + "word " * 30, "duplicate_lines": "one more line\n" * 9 + " ".join(f"w{k}" for k in range(60)), "word_length": "ab " + "a " * 5 + " ".join(chr(97 + k % 26) for k in range(60)),
    "bullets": "\n".join(f"- item {k} of them" for k in range(20)), "ellipses": "\n".join(f"read more about {k} ..." for k in range(20)),
    "letters": " ".join(f"{k} {k}{k}" for k in range(60)), "digits": " ".join(f"a{k}4567" for k in range(60)), "capitals": " ".join(f"ABC{chr(65 + k % 26)}{chr(65 + k // 26)}" for k in range(60)),
    "long_word": " ".join(f"word{k}" for k in range(400)) + " " + "y" * 1000,
}


def test_each_rule_rejects_its_junk_and_no_prose(spark):
    prose = " ".join(f"Some{chr(97 + k % 26)} plain words, no. {k}" for k in range(40))
    rows = [(k, text) for k, text in enumerate([prose, *JUNK.values(), " ".join(f"w{k % 3} {'abcdefghij'[k % 10]}x{k % 7}" for k in range(900))])]
    counted = quality.with_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    every = quality.rules()
    found = {r["doc_id"]: r for r in counted.select("doc_id", *[every[x].rejects.alias(x) for x in every]).collect()}
    assert not any(found[0][x] for x in every)
    assert [name for k, name in enumerate(JUNK, 1) if not found[k][name]] == []
    assert found[len(rows) - 1]["few_words"]


def test_order_is_by_rejections_per_cost_of_what_is_left(docs):
    # b rejects most per cost; of what it leaves, c rejects more per cost than a.
    patterns = [([True, True, False], [10.0, 2.0, 4.0], 10), ([False, True, False], [5.0, 1.0, 2.0], 5), ([True, False, True], [4.0, 1.0, 1.0], 3), ([False] * 3, [90.0, 9.0, 30.0], 90)]
    assert quality.best_order(["a", "b", "c"], patterns) == ["b", "c", "a"]
    assert quality.ordered_rules(docs) == quality.ordered_rules(docs)


# ---------------------------------------------------------------- n-gram trie


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(0)
    for n, universe in ((0, 5), (1, 1), (10, 100), (1000, 1 << 62), (900, 1000)):
        values = np.sort(rng.choice(universe, n, replace=False)).astype(np.uint64) if universe < 10**6 else np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        write_arrays(str(tmp_path / "x"), EliasFano.of(values, universe).arrays("v"))
        there = EliasFano.from_arrays(read_arrays(str(tmp_path / "x")), "v")
        places = {int(v): k for k, v in enumerate(values)}
        asked = np.concatenate([values, rng.integers(0, universe + 3, 200, dtype=np.uint64)])
        assert there.find(asked).tolist() == [places.get(int(q), -1) for q in asked]
        assert there.at(np.arange(len(values))).tolist() == values.tolist()
        assert there.below(asked).tolist() == np.searchsorted(values, asked).tolist()
    twice = np.array([0, 3, 3, 3, 90, 90, 400], np.uint64)  # equal numbers may follow each other
    assert EliasFano.of(twice, 401).at(np.arange(7)).tolist() == twice.tolist() and EliasFano.of(twice, 401).below(np.array([3, 4, 90, 91, 500])).tolist() == [1, 4, 4, 6, 7]


def ngram_counts(learnt, order):
    counts = [Counter() for _ in range(order + 1)]
    for x in learnt:
        for n in range(1, order + 1):
            grams = ["\1", *x] if n > 1 else x
            counts[n].update(tuple(grams[k : k + n]) for k in range(len(grams) - n + 1))
    counts[1]["\1",] = len(learnt)
    return counts


def ngram_score(x, counts, mu, total, distinct):
    score = 0.0
    history = ["\1"]
    for w in x:
        p = (counts[1][w,] + 1) / (total + distinct + 1)
        for n in range(2, len(mu) + 2):
            context = tuple(history[-(n - 1) :]) if len(history) >= n - 1 else None
            if context:
                p = (counts[n][(*context, w)] + mu[n - 2] * p) / (counts[n - 1][context] + mu[n - 2])
        score += math.log10(p)
        history.append(w)
    return score


@pytest.mark.parametrize("order", [2, 3, 4])
def test_ngram(docs, nothing, spark, order, monkeypatch):
    mu = (50.0, 5.0, 2.0)[: order - 1]
    monkeypatch.setattr(ngram, "HELD", 3000)  # many parts
    model = ngram.train(docs, F.col("doc_id") % 2 == 0, mu)
    assert all(len(x.paths) > 5 for x in model.levels) and len(model.levels) == order - 1
    learnt = [words(lower(t)) + ["\0"] for i, t in TEXTS if i is not None and i % 2 == 0]
    counts = ngram_counts(learnt, order)
    n, v = sum(map(len, learnt)), len(counts[1]) - 1
    assert (model.n, model.v) == (n, v)
    assert [x.first[-1] for x in model.levels] == [len(counts[k]) for k in range(2, order + 1)]
    got = defaultdict(list)
    for r in ngram.scored(docs, model).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    for i, t in TEXTS:
        x = words(lower(t)) + ["\0"]
        base = sum(math.log10((counts[1][w,] + 1) / (n + v + 1)) for w in x)
        r = got[i][0]
        assert r[:3] == (len(x), sum(counts[1][w,] > 0 for w in x), n)
        assert r[3] == pytest.approx(base) and abs(r[4] - ngram_score(x, counts, mu, n, v)) <= 1.5 * model.step * len(x)
    both = [sorted(map(repr, x.collect())) for x in (ngram.scored(docs, model), ngram.trained_scores(docs, F.col("doc_id") % 2 == 0, mu))]
    assert both[0] == both[1]
    assert ngram.scored(nothing, model).count() == 0 == ngram.trained_scores(nothing, F.lit(True), mu).count()
    blank = ngram.train(nothing, F.lit(True), mu)
    assert {r["score"] for r in ngram.scored(docs, blank).collect()} == {0.0}


def test_base_scores_write_no_level_above_the_first(docs, nothing, spark, monkeypatch):
    """They are those of the whole model, which would write and search levels for a score that nobody asked for."""
    learn = F.col("doc_id") % 3 != 0
    whole = sorted(map(repr, ngram.trained_scores(docs, learn).drop("score").collect()))

    def level(*_):
        raise AssertionError("a level above the first is written")

    monkeypatch.setattr(ngram, "_level", level)
    assert sorted(map(repr, ngram.base_scores(docs, learn).collect())) == whole
    assert ngram.base_scores(nothing, learn).count() == 0
    assert {r["base_score"] for r in ngram.base_scores(docs, F.lit(None).cast("boolean")).collect()} == {0.0}
    assert queries.ngram_base_score(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("n,top", [(1, 1), (1, 10**6), (700, 701), (700, 3000), (700, 10**6), (5000, 2**40), (64, 5000)])
def test_elias_fano_against_a_sorted_array(n, top):
    """Places, neighbours and searches agree with numpy's, repeats and long gaps included."""
    rng = np.random.default_rng(n + top)
    values = np.sort(np.concatenate([rng.integers(0, top, n - n // 3), rng.integers(0, max(1, top // 50), n // 3)]))
    ef, places = EliasFano.of(values, top), np.arange(n)
    assert (ef.at(places) == values).all()
    first, second = ef.two(places[:-1])
    assert (first == values[:-1]).all() and (second == values[1:]).all()
    wanted = np.unique(np.concatenate([values, values + 1, rng.integers(0, top, 500)]))
    assert (ef.below(wanted) == np.searchsorted(values, wanted)).all()
    assert ((ef.find(wanted) >= 0) == np.isin(wanted, values)).all()


def test_trie_finds_by_its_pointers():
    """Every entry is found and nothing else is; with a pointer moved by one, neighbours of the range are lost or found wrongly."""
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 50, (600, 2)) * [7, 3], axis=0)
    counts, logs = rng.integers(1, 9, len(pairs)), rng.integers(0, 255, len(pairs)).astype(np.uint8)
    arrays = ngram.Part.arrays(pairs[:, 0], pairs[:, 1], 360, counts, logs)
    part = ngram.Part(arrays)
    every = np.array([(c, w) for c in range(0, 360) for w in range(0, 160, 1)])
    where = {tuple(p): k for k, p in enumerate(pairs.tolist())}
    found, among = part.find(every[:, 0], every[:, 1])
    assert found.tolist() == [where.get((c, w), -1) for c, w in every.tolist()]
    firsts = {c: min(k for (d, _), k in where.items() if d == c) for c in set(pairs[:, 0].tolist())}
    assert all(a == f - firsts[c] for (c, _), f, a in zip(every.tolist(), found.tolist(), among.tolist(), strict=True) if f >= 0)
    context, successor = part.entry(np.arange(len(pairs)))
    assert (context == pairs[:, 0]).all() and (successor == pairs[:, 1]).all()
    pointers = np.searchsorted(pairs[:, 0], np.arange(361))
    for k in range(1, 360):
        moved = pointers.copy()
        moved[k] += 1 if moved[k] < moved[k + 1] else -1
        if moved[k] >= pointers[k - 1] and moved[k] <= pointers[k + 1]:
            wrong = ngram.Part(arrays | EliasFano.of(moved, len(pairs) + 1).arrays("pointers"))
            assert wrong.find(every[:, 0], every[:, 1])[0].tolist() != found.tolist()


# ---------------------------------------------------------------- token ids and packing


def encoded(text, end):
    from tokenizers import Tokenizer

    encoded.tokenizer = getattr(encoded, "tokenizer", None) or Tokenizer.from_file(queries.vocabulary())
    return [*encoded.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("width", [1, 7, 16, 17, 33, 63, 64])
def test_bits(width):
    values = np.random.default_rng(width).integers(0, 2**width - 1, 777, dtype=np.uint64)
    assert (bits.unpack(bits.pack(values, width), np.arange(777), width) == values).all()


def test_token_ids(docs, nothing):
    manifest = token_ids.write_ids(docs, queries.vocabulary(), end_id=2)
    got = sorted(map(tuple, token_ids.read_ids(manifest).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = encoded(t, 2)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    file = token_ids.IdFile(manifest.orderBy("part").first()["path"])
    assert file.width == 16 and file.document(0).tolist() == encoded("no id here", 2)
    assert token_ids.read_ids(token_ids.write_ids(nothing, queries.vocabulary(), end_id=2)).count() == 0


@pytest.mark.parametrize("text", ["İstanbul don't ΣΑΣ", "a\x1cb  c d é ﬁ", "<|endoftext|>x <|startoftext|>", "naïve—test 12,5€ 日本語", "x" * 300 + "!!!" * 50])
def test_word_cache_agrees_with_the_tokenizer(text):
    from grantloom.llm.tokens import WordTokenizer

    assert WordTokenizer.at(queries.vocabulary()).ids([text.encode()])[0].tolist() == encoded(text, 0)[:-1]


def test_known_letters_with_other_punctuation_are_not_encoded_again():
    from grantloom.llm.tokens import WordTokenizer

    tokenizer = WordTokenizer(queries.vocabulary())
    tokenizer.ids([b"unlikely &&& ($"])
    met, encode = [], tokenizer._encode
    tokenizer._encode = lambda texts: met.extend(texts) or encode(texts)
    assert [x.tolist() for x in tokenizer.ids([b"Unlikely&&& UNLIKELY($", b""])] == [encoded("Unlikely&&& UNLIKELY($", 0)[:-1], []]
    assert not met


def test_words_are_right_after_the_cache_is_full(monkeypatch):
    from grantloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_WORDS", 5)
    tokenizer = tokens.WordTokenizer(queries.vocabulary())
    texts = ["One two, three", "\t", "four; FIVE six one", "e\u0301t\u00e9 it's 12 <|endoftext|>", "", "two one " * 3]
    for _ in range(2):
        for text in texts:
            assert tokenizer.ids([text.encode(), b"two"])[0].tolist() == encoded(text, 0)[:-1]
    assert tokenizer.ids([b"a\xff, b"])[0].tolist() == encoded("a\ufffd, b", 0)[:-1]


def test_a_worker_keeps_one_kind_of_things(spark):
    """A worker that has made tokens keeps neither its tokenizer nor their ids when it goes on to sets of shingles, and the other way round."""
    from grantloom.llm import common, near_dup, packing
    from grantloom.llm.tokens import WordTokenizer

    vocabulary = queries.vocabulary()
    docs = spark.createDataFrame([(k, f"some words {k} of text") for k in range(40)], "doc_id long, text string").coalesce(1)

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"tokenizers": [len(WordTokenizer._made)], "digests": [len(common._digests)]})

    # One task after the other, all in workers that have run one of the steps before.
    look = lambda: spark.range(64).repartition(16).mapInArrow(seen, "tokenizers long, digests long").collect()
    for step in (lambda: packing.pieces(docs, vocabulary, 2048, 0), lambda: near_dup.shingle_sets(docs, 3), lambda: packing.pieces(docs, vocabulary, 2048, 0)):
        step().count()
        assert not [r for r in look() if r["tokenizers"] and r["digests"]]
    WordTokenizer.at(vocabulary)
    common.only("digests")
    assert not WordTokenizer._made
    common.hashes_of([b"word"])
    WordTokenizer.at(vocabulary)
    assert not common._digests and WordTokenizer._made


def test_packing(docs, nothing):
    rows = packing.pack(docs, queries.vocabulary(), capacity=256).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = encoded(t, 0)
        for k, at in enumerate(range(0, len(ids), 256)):
            want[i, k, at, len(ids[at : at + 256]), crc(ids[at : at + 256])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 256
    assert len(ends) <= 1.1 * math.ceil(sum(ends.values()) / 256) + 1
    assert packing.pack(nothing, queries.vocabulary()).count() == 0
    parts = packing.sequences(packing.pack(docs, queries.vocabulary(), capacity=256, with_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in parts)


def test_plan_places_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = Counter(rng.integers(1, 101, 300).tolist())
        used, held = Counter(), Counter()
        for length, first, number, sequence, offset in packing.plan(counts, 100):
            assert first == used[length]
            used[length] += number
            for k in range(number):
                assert held[sequence + k] == offset
                held[sequence + k] += length
        assert used == counts and max(held.values()) <= 100
        assert len(held) <= 1.25 * math.ceil(sum(k * n for k, n in counts.items()) / 100) + 1


# ---------------------------------------------------------------- nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[7] = x[8]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(900, None, 0), (950, [0.0] * 16, 0), (1000, [float("nan")] * 16, 0), (1050, [None] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    n = np.linalg.norm(x, axis=1)
    for q in range(0, 400, 50):
        s = x @ x[q] / (n * n[q])
        s[q] = -9
        want = np.lexsort((np.arange(400), -s))[:5]
        assert [v for v, _ in got[q]] == want.tolist() and [s_ for _, s_ in got[q]] == pytest.approx(s[want].tolist())
    assert set(got) == set(range(0, 400, 50))
    assert ann.nearest(table.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).count() == 2
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0


def recall(spark, x, every, **how):
    """Recall of the 5 nearest by brute force."""
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(table, F.col("vec_id") % every == 0, **how).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(v)) for q in range(0, len(x), every) for v in np.argsort(-np.where(np.arange(len(x)) == q, -9, u @ u[q]))[:5]}
    return len(got & want) / len(want)


def stops(spark, x, every, wanted=lambda n: ann.FACTOR * n**ann.POWER):
    """Where queries stop: rows of length and candidates, and the wanted number."""
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    usable = ann.valid(table).withColumns({"query": F.col("vec_id") % every == 0, "salt": F.col("vec_id")})
    keys = ann.hashed(usable, ann.TREES, False)
    counts = {(x.shape[1], t): np.zeros(2 * x.shape[1], np.int64) for t in range(ann.TREES)}
    for r in keys.groupBy("tree", "d1").count().collect():
        counts[x.shape[1], r["tree"]][r["d1"]] = r["count"]
    asks = ann.asked(usable.filter("query"), counts, ann.TREES, wanted).drop("vector")
    return ann.depths(keys, asks, keys.groupBy("tree", "dim", "d1").agg(F.lit(1).cast("long").alias("shares")), 5).collect(), counts


@pytest.mark.parametrize("n, dim", [(300, 64), (2000, 64), (3000, 32), (20_000, 64)])
def test_nearest_recall(spark, monkeypatch, n, dim):
    """On vectors without structure, where the forest has least to go by. Of a few hundred such vectors so many are wanted
    that most queries stop at their first digits; from thousands on they read binary ones."""
    monkeypatch.setattr(ann, "SHARE", max(300, n // 10))
    x = np.random.default_rng(4).standard_normal((n, dim)).astype(np.float32)
    assert recall(spark, x, max(1, n // 50)) >= 0.95
    lengths = [r["length"] for r in stops(spark, x, max(1, n // 50))[0]]
    assert n < 2000 or np.mean(np.array(lengths) > 1) > 0.7


def test_nearest_among_clusters_descends_far(spark):
    """Vectors with structure: 251 candidates of 4,000, repeats counted, hold the true neighbours."""
    rng = np.random.default_rng(7)
    x = (np.repeat(rng.standard_normal((400, 64)), 10, axis=0) + 0.15 * rng.standard_normal((4000, 64))).astype(np.float32)
    assert recall(spark, x, 80, factor=0.5, power=0.75) >= 0.95
    found = stops(spark, x, 80, lambda n: 0.5 * n**0.75)[0]
    assert np.median([r["length"] for r in found]) >= 5


def test_nearest_of_copies_and_repeated_ids(spark):
    """Of 200 copies the smallest ids are the neighbours, and an id's many rows take one place."""
    rng = np.random.default_rng(6)
    one, two = rng.standard_normal((2, 16))
    rows = [(int(k), one.tolist()) for k in rng.permutation(200) + 1] + [(1000, two.tolist())]
    rows += [(1001, (two + 0.001 * rng.standard_normal(16)).tolist()) for _ in range(60)] + [(1010 + k, (two + 0.1 * rng.standard_normal(16)).tolist()) for k in range(8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id").isin(200, 1000)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[200] == [1, 2, 3, 4, 5]
    assert len(set(got[1000])) == 5 and got[1000][0] == 1001 and min(got[1000]) > 1000


def test_nearest_of_vectors_of_any_size(spark):
    """Components whose squares overflow or vanish; vectors of several lengths, which don't meet."""
    rows = [(0, [1e200, 0.0, 1e190]), (1, [1e-200, 0.0, 0.0]), (2, [0.0, 1e300, 1e300]), (3, [1.0, 1.0, 0.0]), (4, [5e-324, 0.0, 5e-324]), (5, [1.0, 2.0]), (6, [2.0, 4.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()}
    assert all(math.isfinite(x) for x in got.values()) and len(got) == 5 * 4 + 2
    assert got[0, 1] == pytest.approx(1.0) and got[1, 3] == pytest.approx(2**-0.5) and got[0, 2] == pytest.approx(1e-10 * 2**-0.5) and got[1, 4] == pytest.approx(2**-0.5) and got[5, 6] == pytest.approx(1.0)


@pytest.mark.parametrize("n, wanted, longest", [(3000, 400, 4), (3000, 1500, 2), (3000, 30_000, 1), (12000, 1000, 5)])
def test_descent_stops_near_the_wanted_number(spark, n, wanted, longest):
    """Neither the root nor whole digits: the prefix is as long as the wanted number of candidates allows."""
    x = np.random.default_rng(8).standard_normal((n, 32)).astype(np.float32)
    found, counts = stops(spark, x, 200, lambda _: wanted)
    assert len(found) == n // 200
    assert all(r["length"] >= longest and wanted <= r["candidates"] <= 3 * wanted for r in found)
    # Few candidates at the first digits: more of them are entered, not the root.
    few = {key: (c > 0).astype(np.int64) for key, c in counts.items()}
    one = ann.valid(spark.createDataFrame([(0, x[0].tolist())], "vec_id long, embedding array<float>"))
    assert ann.asked(one, few, ann.TREES, lambda _: wanted).groupBy("tree").count().agg(F.min("count")).first()[0] > ann.ENTRIES


# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string, path string"


def test_archives(spark):
    same = "<p>" + "x" * 200
    pages = spark.createDataFrame([(3, "u", same, ""), (1, "u\r\nX: y", same, ""), (1, "v", same, ""), (2, None, None, ""), (4, "u", "short", ""), (5, "u", "short", ""), (None, "u", same, ""), (6, "u", "Grüße " * 40, "")], PAGES)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert {r["kind"] for r in got} == {"record"}
    shown = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=key)
    assert shown == sorted([(1, 203, "response", None), (1, 203, "revisit", 1), (2, 0, "response", None), (3, 203, "revisit", 1), (4, 5, "response", None), (5, 5, "response", None), (6, len(("Grüße " * 40).encode()), "response", None), (None, 203, "revisit", 1)], key=key)
    assert all(r["payload_digest"] == hashlib.sha256((r["payload"])).hexdigest() for r in got if r["payload"] is not None)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def raw(k):
    text = f"page {k} " * 30
    return warc.record("response", k, "u", text.encode(), hashlib.sha256(text.encode()).hexdigest(), None, "2000-01-01T00:00:00Z")


@pytest.mark.parametrize("pressed", [True, False])
@pytest.mark.parametrize("step", [64, 1 << 20])
def test_salvage_recovers_what_damage_leaves(pressed, step, monkeypatch):
    import io

    parts = [warc.member(raw(k)) if pressed else raw(k) for k in range(6)]
    at = np.cumsum([0, *map(len, parts)]).tolist()
    data = bytearray(b"".join(parts))
    data[at[2] - 60 : at[2] - 40] = b"\xff" * 20  # one record damaged, in its block: no checksum covers plain headers
    data[at[3] + len(parts[3]) // 2] ^= 0x55  # one byte of another
    del data[at[5] + len(parts[5]) // 2 :]  # the last one cut off
    monkeypatch.setattr(warc._Stream.__init__, "__defaults__", (step,))
    found = list(warc.salvage(io.BytesIO(bytes(data))))
    assert [(x[0], x[1]) for x in found] == [("record", at[0]), ("gap", at[1]), ("record", at[2]), ("gap", at[3]), ("record", at[4]), ("gap", at[5])]
    assert [x[2] for x in found] == [at[1], at[2], at[3], at[4], at[5], len(data)]


def test_salvage_of_garbage():
    import io

    data = b"garbage \x1f\x8b\x08 WARC/1.0 more"
    assert [x[:3] for x in warc.salvage(io.BytesIO(data))] == [("gap", 0, len(data))]
    assert list(warc.salvage(io.BytesIO(b""))) == []


def found_in(data):
    import io

    found = list(warc.salvage(io.BytesIO(data)))
    return [int(x[3]["warc-record-id"].strip("<>").rpartition(":")[2]) for x in found if x[0] == "record"], [x[1:] for x in found if x[0] == "gap"]


def test_salvage_within_a_member():
    """One bad record of a member, a failed checksum or a cut costs no other record."""
    import random

    parts = [warc.record("response", k, "u", text, hashlib.sha256(text).hexdigest(), None, "2000-01-01T00:00:00Z") for k, text in enumerate(random.Random(k).randbytes(30_000) for k in range(8))]
    whole = warc.member(b"".join(parts))
    after = warc.member(raw(9))
    assert found_in(whole + after) == ([*range(8), 9], [])
    bad = list(parts)
    bad[3] = bad[3][:-40] + b"?" * 20 + bad[3][-20:]
    got, gaps = found_in(warc.member(b"".join(bad)) + after)
    assert got == [0, 1, 2, 4, 5, 6, 7, 9] and len(gaps) == 1 and "digest" in gaps[0][2]
    broken = bytearray(whole)
    broken[-6] ^= 1  # the checksum
    got, gaps = found_in(bytes(broken) + after)
    assert got == [*range(8), 9] and len(gaps) == 1 and gaps[0][:2] == (0, len(whole))
    got, gaps = found_in(whole[: len(whole) * 6 // 8] + after)
    assert got[:5] == [0, 1, 2, 3, 4] and got[-1] == 9 and len(got) == len(set(got)) and len(gaps) == 1
    plain = [p.replace(b"WARC-Block-Digest", b"X-Block").replace(b"WARC-Payload-Digest", b"X-Payload") for p in parts]
    whole = bytearray(warc.member(b"".join(plain)))
    assert found_in(bytes(whole)) == (list(range(8)), [])
    whole[-6] ^= 1
    assert found_in(bytes(whole))[0] == []  # nothing vouches for these


def test_salvage_of_long_records():
    """Neither a member, a record nor a header has a bound of its own."""
    text = b"x" * (300 << 20)
    long = warc.record("response", 0, "u" * (3 << 20), text, hashlib.sha256(text).hexdigest(), None, "2000-01-01T00:00:00Z")
    assert found_in(warc.member(long) + warc.member(raw(1))) == ([0, 1], [])


# ---------------------------------------------------------------- toxicity


class Counting(io.BytesIO):
    """A file that counts the bytes read from it."""

    n_read = 0

    def read(self, n=-1):
        got = super().read(n)
        self.n_read += len(got)
        return got


def false_lengths(n):
    """Records whose lengths lead into the middle of others, then a good one."""
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: %08d\r\n\r\nsome text\r\n\r\n"
    width = len(one % 0)
    return b"".join(one % (width * (k + 50) + 3) for k in range(n)) + b"WARC/1.1\r\na: b\r\nno end of headers" + raw(7)


@pytest.mark.parametrize("pressed", [False, True])
def test_salvage_of_false_lengths_is_linear(pressed):
    reads = []
    for n in (5_000, 40_000):
        data = false_lengths(n)
        source = Counting(warc.member(data) if pressed else data)
        found = list(warc.salvage(source))
        assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == ["<urn:grantloom:page:7>"]
        assert [x[1:3] for x in found if x[0] == "gap"] == ([(0, len(source.getvalue()))] if pressed else [(0, len(data) - len(raw(7)))])
        reads.append(source.n_read / len(source.getvalue()))
    assert max(reads) < 4  # each byte is read a few times, however many lengths are false


def test_salvage_of_odd_lengths():
    for size in (b"9" * 5_000, "²".encode(), b"-1", b"2147483640", b""):
        data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + size + b"\r\n\r\nx\r\n\r\n"
        assert found_in(data + raw(1)) == ([1], [(0, len(data), found_in(data)[1][0][2])])


def test_salvage_goes_back_within_a_long_member():
    """A member that fails far from its start holds a stored member near it; the search finds that one."""
    noise = random.Random(3).randbytes(40 << 20)
    pressed = zlib.compressobj(0, zlib.DEFLATED, 31)
    whole = bytearray(pressed.compress(warc.member(raw(5)) + noise) + pressed.flush())
    whole[-6] ^= 1  # the checksum
    assert found_in(bytes(whole) + warc.member(raw(6)))[0] == [5, 6]



def toxic_table(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(600):
        w = [f"{a}{b}" for a, b in zip(rng.choice(["tha", "ner", "ing", "ore"], 60), rng.choice(["sta", "lin", "edo", "ush", "ath"], 60), strict=True)]
        bad = k % 4 == 0
        if bad:
            for at in rng.choice(60, 5, replace=False):
                w[at] = str(rng.choice(["worthless", "disgusting", "pathetic"]))
        rows.append((k, " ".join(w), "en", "s", None, "", ""))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None, "en", "s", None, "", ""), (1001, "", "en", "s", None, "", "")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, nothing):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(*toxicity.sample(docs, labels, F.col("doc_id") % 3 != 0))
    scores = {r["doc_id"]: r for r in toxicity.scored(docs.select("doc_id", "text"), model).collect()}
    held = [k for k in range(0, 600, 3)]
    assert np.mean([scores[k]["predicted"] == (k % 4 == 0) for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scores.values()) and scores[1000]["predicted"] == scores[1001]["predicted"] == 0
    kept = toxicity.without_toxic(docs, labels, F.lit(True))
    assert kept.columns == docs.columns
    assert toxicity.scored(nothing.select("doc_id", "text"), model).count() == 0
    plain = toxicity.fit(*toxicity.sample(docs, labels.limit(0), F.lit(True)))
    assert {r["score"] for r in toxicity.scored(docs.select("doc_id", "text"), plain).collect()} == {0.0}


def test_toxic_scores_by_brute_force(spark):
    """Words, windows, lengths, counts and the curve in plain Python; only the two compressors are the model's."""
    docs, labels = toxic_table(spark)
    model = toxicity.fit(*toxicity.sample(docs, labels, F.col("doc_id") % 3 != 0))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    texts |= {2000: "Very long, " * 20_000, 2001: "ÉLAN\u00a0vital!", 2002: "...", 2003: "word " + "x" * 100_000}
    rows = [(k, t) for k, t in texts.items() if k is not None]
    got = toxicity.scored(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string"), model).collect()
    toxic, ordinary = model.compressors()
    assert len(got) == len(rows) + 1

    def saves(word):
        shown = toxicity._PAD + b" " + word.encode() + b" " + toxicity._PAD[:12]
        return len(ordinary.compress(shown)) - len(toxic.compress(shown))

    known = {}
    for r in got:
        text = "".join(" " if c in string.punctuation else c for c in (texts[r["doc_id"]] or "").lower())
        found = []
        for word in re.findall(r"[^ \t\n\r\x0b\x0c]+", text):
            if word not in known:
                known[word] = saves(word)
            found.append(known[word])
        x = [0.0] * 17
        if found:
            most = sorted((max(d, 0) for d in found), reverse=True)
            reached = [sum(d >= limit for d in found) for limit in (1, 2, 3, 4, 5, 6, 8)]
            x = [min(most[0], 12), min(sum(most[:2]), 20), min(max(sum(found) / len(found), -1), 2), *[math.log(1 + n) for n in reached], *[10 * n / len(found) for n in reached]]
        z = sum(w * v for w, v in zip(model.weights, [*x, 1.0], strict=True))
        score = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == (r["score"] >= 0.5)


@pytest.mark.parametrize("n", [20, 200, 2000])
def test_dictionaries_are_trained_alike_at_every_size(n):
    """Equal lengths, whatever the sizes of the groups, and with one long text of few phrases among them."""
    rng = np.random.default_rng(n)
    toxic, ordinary = ([[b"%c%d" % (c, k) for k in rng.integers(0, 4000, 40)] for _ in range(m)] for c, m in ((97, n), (98, 7 * n)))
    one, two = toxicity.trained([[b"same", b"phrase"] * 30_000, *toxic], ordinary)
    assert len(one) == len(two) >= min(toxicity.DICTIONARY, 60 * n)
    assert one[:4] == two[:4] == b"\x37\xa4\x30\xec"  # the mark of a trained dictionary


# ---------------------------------------------------------------- queries


def test_queries_with_sql(spark):
    from oracle import compare, views

    con = views(SF)
    for name, sql in queries.oracle_sql().items():
        compare(con, queries.queries()[name](spark, SF), sql)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert 0 < max(ends.values()) <= 2048


def stage_docs(spark):
    """Toxic and ordinary documents, copies, shared passages, long, empty and null texts, repeated rows, and clashing columns."""
    rng = np.random.default_rng(21)
    parts, more = ["tha", "ner", "ing", "ore", "lum"], ["sta", "lin", "edo", "ush", "ath"]
    prose = lambda n: [f"{parts[a]}{more[b]}{parts[c]}{d}" for a, b, c, d in zip(*rng.integers(0, 5, (3, n)).tolist(), rng.integers(0, 40, n).tolist(), strict=True)]
    passage = " ".join(prose(70))
    rows = []
    for k in range(160):
        w = prose(int(rng.integers(20, 120)))
        if k % 8 == 0:
            for at in rng.choice(len(w), 4, replace=False):
                w[at] = str(rng.choice(["worthless", "disgusting", "pathetic"]))
        if k % 31 == 3:
            w[5:5] = passage.split()
        rows.append((k, " ".join(w), "en", [None, "a", "b", "c"][k % 4]))
    rows += [(200 + k, rows[k][1], "en", "a") for k in (1, 2, 9)] + [(210, rows[5][1] + " one more", "en", "b")]
    rows += [(220, " ".join(prose(9000)), "en", "c"), (221, None, "en", "a"), (222, "", "en", "d"), (223, "Just four words here", None, "b"), rows[7], rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, _gone long, _kept string, _a int, kept boolean, whole_sha256 string"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 7, 1, "k", 2, True, "s") for r in rows], schema)
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(160)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels = stage_docs(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, given: stages[name](spark, given, str(tmp_path))
    rows = lambda given: [r.asDict() for r in given.collect()]
    as_key = lambda found: sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "", r["source"] or "") for r in found)

    # Toxicity: the same model, applied document by document.
    given, got = rows(docs), run("toxicity", docs)
    assert got.columns == docs.columns and all(r["predicted"] == 7 and r["score"] == 0.5 for r in rows(got))
    learnt = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0]
    text_of = {r["doc_id"]: r["text"] for r in given}
    learnt = sorted(((r["doc_id"], b" ".join(toxicity.plain_words(text_of[r["doc_id"]].encode())), r["toxic"]) for r in learnt), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    model = toxicity.fit([r[1].split() for r in learnt], [r[2] for r in learnt])
    distances, weights = toxicity.Distances(model), np.array(model.weights)
    toxic = lambda text: np.array([*toxicity.features(distances(toxicity.plain_words((text or "").encode()))), 1.0]) @ weights >= 0
    assert as_key(rows(got)) == as_key([r for r in given if not toxic(r["text"])])
    assert {r["doc_id"] for r in given if toxic(r["text"])} >= {k for k in range(0, 160, 8)} and len(given) - got.count() < 25

    # Near duplicates: every pair compared.
    given, got = rows(docs), run("near_duplicates", docs)
    of = {(i, t or ""): c for (i, t), (_, _, c) in zip([(r["doc_id"], r["text"]) for r in given], components([(r["doc_id"], r["text"]) for r in given], 5), strict=True)}
    assert got.columns == docs.columns
    assert as_key(rows(got)) == as_key([r for r in given if of[r["doc_id"], r["text"] or ""] == r["doc_id"]])
    assert not {201, 202, 209, 210} & {r["doc_id"] for r in rows(got)}

    # Substrings: every window looked up.
    got = run("substring_dedup", docs)
    want = []
    for r, (_, n, removed, _) in zip(given, cut([(r["doc_id"], r["text"]) for r in given]), strict=True):
        if not removed:
            want.append((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["n_chars"]))
        elif removed < n:
            want.append((r["doc_id"], None, None))
    found = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["n_chars"]) for r in rows(got)}
    assert got.columns == docs.columns and {w for w in want if w[1]} <= found and len(rows(got)) == len(want)
    digests = {i: d for i, _, _, d in cut([(r["doc_id"], r["text"]) for r in given])}
    assert all(hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == digests[r["doc_id"]] and r["n_chars"] == len(r["text"] or "") for r in rows(got))

    # Mixing: the queue served slice by slice.
    got = run("mixing", docs)
    sizes = Counter()
    for r in given:
        sizes[r["source"]] += len(words(r["text"]))
    goal = {s: t for s, t in mixing.targets(list(sizes.items()), corpus_pipeline.MIX_WEIGHTS, 1.5, 2).items() if t > 0}
    order = defaultdict(list)
    for r in mixing.placed(docs, corpus_pipeline.MIX_WEIGHTS, 1.5, 2, 11).orderBy("_group", "_chunk", "_turn").collect():
        order[None if r["_group"] == "-" else r["_group"][1:]].append((r["doc_id"], r["_size"]))
    served = queue_simulated(given, goal, 2, mixing.QUANTUM, {s: [((n, k), size) for n, (k, size) in enumerate(order[s])] for s in goal})
    by_copy = Counter()
    for s in goal:
        for n, (k, size) in enumerate(order[s]):
            got_words = served[n, k]
            # A whole first copy, and the rest of the words in the second one.
            by_copy[k] += (2 * min(got_words, size) >= size > 0) + (2 * max(0, got_words - size) >= size > 0)
    assert got.columns == docs.columns
    mixed = Counter(r["doc_id"] for r in rows(got))
    assert sum(abs(mixed[k] - n) for k, n in by_copy.items()) <= 1 and set(mixed) <= {r["doc_id"] for r in given if words(r["text"])}

    # Packing: every piece from the tokenizer, and no fewer sequences than fit.
    got, want = rows(run("packing", docs)), Counter()
    for r in given:
        ids = encoded(r["text"], 0)
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= math.ceil(sum(ends.values()) / 2048) + 1

    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.count() == 0 and (name == "packing" or nothing.columns == docs.columns)


def test_mix_is_the_same_for_all_partitions(spark):
    """Targets that add up to half a word: the budget doesn't follow the order of a distributed sum."""
    docs = spark.createDataFrame([(k, f"s{k % 7}", "w " * (k * 37 % 97)) for k in range(301)], "doc_id long, source string, text string")
    found = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 7, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.add(tuple(sorted(map(tuple, mixing.taken_words(docs.repartition(n), [3, 1, 2]).select("doc_id", "taken").collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1


def test_mixing_repeated_rows_keeps_their_number(spark):
    docs = spark.createDataFrame([(1, "a", "x y z")] * 3000 + [(2, "b", "q " * 3000)], "doc_id long, source string, text string")
    got = mixing.mixed_documents(docs, [1, 1], share=2.0)
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {1: 6000, 2: 2}
