"""SimHash components, vector codes and cross-tokenizer alignment against brute-force versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF
from oracle import compare, views
from pyspark.sql import functions as F

from grantloom.llm import alignment, common, queries, simhash, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, lang string, fp string, component_id string, node string, block string, count string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def with_extra(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], EXTRA)


# ---------------------------------------------------------------- SimHash


def fingerprint(text, n=3):
    w = words(text)
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def simhash_components(rows, fps, budget=3):
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= budget:
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, *_) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted(((i, f"{fps[k]:016x}", least[root(k)]) for k, (i, *_) in enumerate(rows)), key=str)


def long_text(seed, n, vocabulary=400):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, vocabulary, n))


def texts():
    base = long_text(1, 400)
    rows = [(10, base), (11, base), (4, base.replace("w1 ", "Other ", 1)), (5, base.upper()), (6, None), (7, ""), (8, " \t\n "), (9, "one"), (12, "One TWO"), (13, "one two three"), (14, long_text(3, 30_000)), (15, "same same same " * 50), (16, "same same same same"), (17, "Grüße an  alle\x0bhier"), (17, "Grüße an alle hier"), (None, base + " tail"), (None, "lonely text of its own here")]
    for k in range(40):  # a family of near copies
        w = base.split()
        w[(7 * k) % 400] = f"x{k}"
        rows.append((100 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("cell", [20_000, 3])
def test_simhash_components(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "LEAST", cell)
    rows = texts()
    got = simhash.link_components(with_extra(spark, rows))
    want = simhash_components(rows, [fingerprint(t) for _, t in rows])
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_simhash_keeps_columns_and_takes_empty_tables(spark):
    docs = with_extra(spark, texts())
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {4, 9, 14} <= {r["doc_id"] for r in kept.collect()} and not {10, 11} & {r["doc_id"] for r in kept.collect()}
    assert simhash.link_components(docs.limit(0)).count() == 0


def test_fingerprints_of_pieces(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 50)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    for text in (long_text(5, 300), "one two", "a " * 200, "x" * 500, "", "A\x0bb C"):
        assert simhash.fingerprint(text.encode(), 3) == fingerprint(text)
        assert simhash.fingerprint(text.encode(), 1) == fingerprint(text, 1)


@pytest.mark.parametrize("block, outright", [(100_000, 16), (50, 1)])
@pytest.mark.parametrize("depth", [0, 1, 3])
def test_trie_finds_all_within_the_budget(monkeypatch, block, outright, depth):
    """Random, dense and planted fingerprints; every pair of nodes at a depth gives what brute force gives for it."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "OUTRIGHT", outright)
    rng = np.random.default_rng(depth)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = fps[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
    dense = np.uint64(2**64 - 1) ^ rng.integers(0, 256, 100, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, near, dense, np.array([0, 1, 2**63], np.uint64)]))
    places = np.arange(len(fps))
    edges = np.searchsorted(fps >> np.uint64(64 - depth) if depth else fps * np.uint64(0), np.arange(2**depth, dtype=np.uint64)).tolist() + [len(fps)]
    joined = simhash.Groups(len(fps))
    for a in range(2**depth):
        for b in range(a, 2**depth):
            differ = (a ^ b).bit_count()
            if differ <= 3 and edges[a] < edges[a + 1] and edges[b] < edges[b + 1]:
                roots = simhash.links_within(fps, slice(edges[a], edges[a + 1]), slice(edges[b], edges[b + 1]), depth, differ, 3).roots(places)
                joined.join(places, roots)
    far = np.bitwise_count(fps[:, None] ^ fps)
    want = simhash.Groups(len(fps))
    want.join(*np.nonzero(far <= 3))
    assert np.array_equal(joined.roots(places), want.roots(places))


def test_pairs_of_nodes_hold_each_pair_once(spark):
    fps = np.unique(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 400))
    leaves = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    n = 0
    for depth, pairs in simhash.node_pairs(leaves, budget=64, cell=30):
        size = Counter((int(x) % 2**64) >> (64 - depth) for x in fps) if depth else {0: len(fps)}
        for r in pairs.collect():
            a, b = size[r["left"]], size[r["right"]]
            assert a + b <= 60 and r["left"] <= r["right"]
            n += a * (a - 1) // 2 if r["left"] == r["right"] else a * b
    assert n == len(fps) * (len(fps) - 1) // 2


# ---------------------------------------------------------------- vector codes


def test_vector_codes_equal_sql(spark):
    compare(views(SF), queries.op13_vector_codes(spark, SF), queries.oracle_sql()["op13_vector_codes"])


def codes(rows, dim):
    """rows: (vec_id, vector, label) that take part, in order."""
    z = np.array([[int(np.floor(256 * x)) for x in v] for _, v, _ in rows])
    books = [[z[k, a:b].tolist() for k in range(min(64, len(z)))] for a, b in vector_codes.cuts(dim)]

    def nearest(part, v):
        return min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), k) for k, e in enumerate(books[part]))

    for _ in range(2):
        for part, (a, b) in enumerate(vector_codes.cuts(dim)):
            members = {}
            for v in z[:, a:b].tolist():
                members.setdefault(nearest(part, v)[1], []).append(v)
            for k, some in members.items():
                books[part][k] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    out, by_label = [], Counter()
    for (i, _, label), v in zip(rows, z.tolist(), strict=True):
        found = [nearest(part, v[a:b]) for part, (a, b) in enumerate(vector_codes.cuts(dim))]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[label] += out[-1][-1]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, label, code, error, by_label[label], digest) for i, label, code, error in out), key=str)


@pytest.mark.parametrize("dim, n", [(64, 150), (16, 90), (40, 70), (5, 80), (160, 66), (32, 10)])
def test_vector_codes(spark, dim, n):
    rng = np.random.default_rng(dim)
    x = np.round(rng.standard_normal((n, dim)), 2)
    x[5] = x[3]
    x[7] = 0
    rows = [(1000 - 7 * k, v.tolist(), None if k % 3 == 0 else k % 2) for k, v in enumerate(x)] + [(3, x[1].tolist(), 1), (3, x[0].tolist(), 1), (None, x[2].tolist(), 0)]
    bad = [(0, None, 1), (0, [None] + [0.5] * (dim - 1), 1), (1, [float("nan")] * dim, 0), (2, [float("-inf")] * dim, 0), (4, x[0].tolist() + [1.0], 0)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows + bad], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = vector_codes.compressed(table).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == codes(order, dim)
    assert vector_codes.compressed(table.limit(0)).count() == 0
    assert vector_codes.compressed(table.filter("vec_id = 1 or vec_id = 2")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 4, 7, 16])
@pytest.mark.parametrize("size", [3, 1000, vector_codes.LARGEST])
def test_nearest_by_segments_is_exact(width, size):
    rng = np.random.default_rng(width)
    entries, x = (rng.integers(-size, size + 1, (n, width)) for n in (64, 5000))
    entries[40] = entries[2]
    x[:64] = entries
    x[64:100] = size
    far = ((x[:, None, :] - entries) ** 2).sum(axis=2)
    index, distance = vector_codes.Codebook(entries).nearest(x)
    assert np.array_equal(index, far.argmin(axis=1)) and np.array_equal(distance, far.min(axis=1))


def test_vector_components_too_large(spark):
    table = spark.createDataFrame([(1, [1e9] * 16, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="beyond 65536"):
        vector_codes.compressed(table)


# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def files():
    return queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


def aligned(rows, files):
    import sentencepiece
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(files[0])
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=files[1])
    letters = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    bytes_a = {k: bytes(letters[x] for x in name) for name, k in a_of.get_vocab(with_added_tokens=False).items() if name != "<|endoftext|>"}

    def bytes_b(k):
        name = b_of.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if b_of.is_byte(k) else name.replace("▁", " ").encode()

    every, holds = [], Counter()
    for _, text in rows:
        a, b = a_of.encode(" " + (text or ""), add_special_tokens=False).ids, b_of.encode(text or "")
        sides = [[bytes_a[k] for k in a], [bytes_b(k) for k in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in sides):
            every.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]) for side in sides]
        cuts = np.intersect1d(*ends)
        groups = [([a[k] for k in np.flatnonzero((ends[0] > low) & (ends[0] <= high))], [b[k] for k in np.flatnonzero((ends[1] > low) & (ends[1] <= high))]) for low, high in zip([0, *cuts[:-1]], cuts, strict=True)]
        links = Counter()
        for x, y in groups:
            for p, n in Counter(x).items():
                for q, m in Counter(y).items():
                    links[p, q] += n * m
        every.append((a, b, groups, links))
        holds.update(links.keys())
    highest = {}
    for (p, _), n in holds.items():
        highest[p] = max(highest.get(p, 0), n)
    out = []
    for (i, _), found in zip(rows, every, strict=True):
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = found
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for k, n in links.items() if holds[k] == highest[k[0]])
        out.append((i, len(a), len(b), len(groups), sum(links.values()), best, sum(n * holds[k] for k, n in links.items()), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


ALIGNED = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a\n b\t c\n\n  d \n"), (6, "▁ in a text"), (7, "<s> <|endoftext|> <0x41> </s>"), (8, "日本語の文章 と　空白\xa0 x"), (9, "a" * 5000),
    (10, "x\x1c y\x85 z"), (10, "x\x1c y\x85 z"), (None, "no id"), (11, "ab cd " * 3000 + "é"), (12, "ends in a space "), (13, "\n"), (14, "don't I'll "), (15, " " * 3000), (16, "é ́x"), (17, "\x00 a\x00"), (18, "Grüße, élan vital; Übermäßigkeit 12345"),
]


@pytest.mark.parametrize("chunk, block, many", [(1 << 20, 64, 4096), (1000, 2, 3), (100, 10**6, 4096)])
def test_alignment(spark, files, monkeypatch, chunk, block, many):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "MANY", many)
    got = alignment.alignment(with_extra(spark, ALIGNED), *files)
    assert sorted(map(tuple, got.collect()), key=str) == aligned(ALIGNED, files)
    assert alignment.alignment(with_extra(spark, []), *files).count() == 0


def test_alignment_of_a_table(spark, files):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_alignment(spark, SF).collect()), key=str) == aligned(rows, files)


@pytest.mark.parametrize("text", ["a b", " a", "a  b", "a\n b", "a \nb", "x\xa0 y", "", " ", "   ", "a ", "日本 語 。", "  q"])
def test_units_join_to_the_text(text):
    found = alignment.units(text.encode())
    assert b" ".join(found) == text.encode()
    assert all(re.search(r"\S\Z", x.decode()) for x in found[:-1])


def test_documents_with_a_pair_are_counted_once(spark, files):
    """A pair that a document has many times counts one document."""
    table = spark.createDataFrame([(k, "and " * (k + 1)) for k in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_links"], r["count_sum"]) for r in alignment.alignment(table, *files).filter(F.col("n_links") > 0).collect()}
    assert all(5 * (k + 1) <= got[k][1] <= 5 * got[k][0] for k in range(5))


def test_known_letters_with_other_punctuation_are_not_encoded_again(files):
    pair = alignment.Pair(*files)
    assert pair.apart
    pair.of_texts([b"unlikely Fr\xc3\xbch a&&& a(."])
    met, encode = [], pair._encode
    pair._encode = lambda parts, lead: met.extend(parts) or encode(parts, lead)
    pair.of_texts([b"unlikely&&& Fr\xc3\xbch(.", b"a", b""])
    assert not met


def test_units_of_a_group_have_the_tokenizers_ids(files, monkeypatch):
    """Whatever is kept, in groups of any size, and for a text with bytes that are no character."""
    texts = [t or "" for _, t in ALIGNED if t not in ("<s> <|endoftext|> <0x41> </s>",)] + ["Stra\u00dfe, \u00e9t\u00e9... \u00bb. \u00d7! ok?! 'tis a.b\n c's", "\u00ff, \u00ae, a\u0301. <="]
    for kept, group in ((500_000, 8 << 20), (3, 1)):
        monkeypatch.setattr(alignment, "KEPT_UNITS", kept)
        monkeypatch.setattr(alignment, "GROUP", group)
        pair = alignment.Pair(*files)
        for text, found in zip(texts, pair.of_texts([x.encode() for x in texts]), strict=True):
            if found:
                ids_a, ids_b = (np.concatenate([x[k] for x in found]).tolist() for k in (1, 2))
                assert ids_a == pair.a.encode(" " + text, add_special_tokens=False).ids and ids_b == pair.b.encode(text)
        assert sum(map(bool, pair.of_texts([x.encode() for x in texts]))) > 9 and pair.of_texts([b"a\xff b"]) == [[]]
