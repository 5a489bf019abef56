import hashlib
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import common, exact_dedup, ngram_join, substring_dedup
from ledgerloom.llm.common import connected_components


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("hot", [100, 2, 1])
def test_exact_dedup(hard, hard_texts, none, monkeypatch, hot):
    """Without hot texts, with some and with all texts hot the result is the same."""
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    texts = [*hard_texts, (None, "no identifier at all")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts:
        groups[norm(t)].append(i)
    rows = exact_dedup.exact_duplicates(hard).collect()
    assert len(rows) == len(texts)
    want = {sha(n): (min((i for i in ids if i is not None), default=None), len(ids)) for n, ids in groups.items()}
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in rows)
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == Counter(dict.fromkeys(want, 1)) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    left = exact_dedup.drop_exact_duplicates(hard)
    assert left.count() == len(groups) and left.columns == hard.columns
    assert Counter(norm(r.text) for r in left.collect()) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_copies_are_found_by_their_neighbours(spark, hard, hard_texts, monkeypatch):
    """Cold texts are whole after the sort; a hot one is cut into few runs, which the sort of their first rows joins."""
    rows, salted = exact_dedup.content_sort(hard, "doc_id", "text")
    groups = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in [*hard_texts, (None, "no identifier at all")])
    assert not salted and Counter({r.norm: r.size for r in rows.where("nth = 1").collect()}) == groups
    monkeypatch.setattr(exact_dedup, "HOT", 50)
    many = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"cold {k // 4}") for k in range(600)], "doc_id long, text string")
    rows, salted = exact_dedup.content_sort(many, "doc_id", "text")
    heads = rows.where("nth = 1").collect()
    sizes = [r.size for r in heads if r.norm == "hot"]
    assert salted and len(sizes) == 4 and sum(sizes) == 200 and max(sizes) < 60 and all(r.salt is None for r in heads if r.norm != "hot")
    got = {(r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(many).where("doc_id % 3 = 0").collect()}
    assert got == {(0, 200)} and exact_dedup.drop_exact_duplicates(many).where("text = 'hot'").collect() == many.limit(1).collect()


def test_dedup_keeps_columns_with_any_name(spark):
    names = ["__sha", "row", "norm", "hash", "salt", "head", "nth", "size", "start", "a.b"]
    df = spark.createDataFrame([(1, "x", *names), (2, "x", *names)], ["doc_id", "text", *names])
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(1, "x", *names)]


def brute_components(texts, num=80, den=100):
    sets = {}
    for k, (_, t) in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = dict(enumerate(range(len(texts))))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(texts))


@pytest.mark.parametrize(("few", "part", "bits", "hub"), [(16, 2000, 512, 1000), (2, 2000, 512, 3), (1, 5, 64, 3)])
def test_ngram_join(hard, hard_texts, monkeypatch, few, part, bits, hub):
    """Pairs and stars, groups in one part and in several, hubs and none give the same."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "BITS", bits)
    monkeypatch.setattr(common, "HUB", hub)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(hard).collect())
    assert got == brute_components([*hard_texts, (None, "no identifier at all")])


def test_stars_leave_open_what_pairs_then_join(spark, monkeypatch):
    """A common passage with many endings: the star's center links with few of them, others with each other."""
    monkeypatch.setattr(ngram_join, "FEW", 1)
    common_words = [f"p{k}" for k in range(60)]
    texts = [(k, " ".join(common_words + [f"e{k % 7}x{j}" for j in range(30)] + [f"u{k}"])) for k in range(40)] + [(50 + k, " ".join(common_words[: 50 + k])) for k in range(10)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect())
    assert got == brute_components(texts) and len({c for _, _, c in got}) == 8


def test_bitmaps_rule_out_no_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (3, 40, 700, 3000):
        base = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for gone in range(1 + n // 9):
            other = np.unique(np.r_[base[gone:], rng.integers(0, 2**64, gone // 2, np.uint64)])
            shared = len(np.intersect1d(base, other))
            differ = sum(int(x).bit_count() for x in np.bitwise_xor(ngram_join.parities(base), ngram_join.parities(other)).view(np.uint64))
            assert 180 * differ <= 20 * (len(base) + len(other)) or 100 * shared < 80 * (len(base) + len(other) - shared)


def test_joins_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 10)
    left = spark.createDataFrame([(k % 50 if k % 2 else 0, k) for k in range(400)], "key long, v long")
    right = spark.createDataFrame([(k, k * 7, j) for k in range(30) for j in range(2)], "key long, w long, j long")
    many = common.hubs(left, "key")
    assert [r["key"] for r in many.collect()] == [0] and many.first().ways > 10
    assert sorted(common.spread_join(left, right, ["key"], many).collect()) == sorted(left.join(right, "key").collect())


def test_ngram_join_of_nothing(none):
    assert ngram_join.jaccard_components(none).count() == 0


def test_keep_one_of_each(hard):
    left = ngram_join.keep_one_of_each(hard)
    assert left.columns == hard.columns and left.where("doc_id between 100 and 125").count() < 26


def test_keep_one_of_each_by_row(spark):
    """Of each component one row stays, whatever identifiers repeat or are missing."""
    base = [[f"{c}{k}" for k in range(60)] for c in "abcdef"]
    near = lambda c, k: " ".join([*base[c][:-1], f"x{k}"])
    texts = [(1, near(0, 0)), (7, near(0, 1)), (7, near(1, 0)), (7, "clean and not linked"), (8, near(1, 1))]  # one of id 7 is near an older one
    texts += [(2, near(2, k)) for k in range(3)] + [(None, near(3, k)) for k in range(3)]  # near copies of one identifier
    texts += [(None, near(4, 0)), (9, near(4, 1)), (3, near(5, 0)), (3, near(5, 0)), (4, ""), (4, ""), (4, None), (4, "\x85"), (4, "\x85"), (None, " \t"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.keep_one_of_each(df).collect())
    of = lambda c: [r for r, n in got.items() if (r[1] or "").startswith("abcdef"[c] + "0 ") for _ in range(n)]
    assert of(0) == [(1, near(0, 0))] and of(1) == [(7, near(1, 0))] and of(4) == [(9, near(4, 1))] and of(5) == [(3, near(5, 0))]
    assert [i for i, _ in of(2)] == [2] and [i for i, _ in of(3)] == [None] and got[7, "clean and not linked"] == 1
    assert got[4, ""] == 2 and got[4, None] == got[None, " \t"] == got[None, None] == 1 and got[4, "\x85"] == 1 and sum(got.values()) == 13


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, window):
    split = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        out[i, len(w), len(gone), b" ".join([x for k, x in enumerate(w) if k not in gone]).decode()] += 1
    return out


@pytest.mark.parametrize(("hot", "shard"), [(2_000, 600_000), (0, 600_000), (2_000, 100)])
def test_substring_dedup(hard, hard_texts, monkeypatch, hot, shard):
    """Anchors dealt whole and window by window, in one shard and in many, give the same."""
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rows = substring_dedup.remove_repeats(hard).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == brute_repeats([*hard_texts, (None, "no identifier at all")], 35)


def test_substring_dedup_keeps_rows_and_columns(hard, none):
    out = substring_dedup.drop_repeats(hard)
    assert out.columns == hard.columns and out.count() == hard.count()
    assert out.where("doc_id = 1").first().text is None and out.where("doc_id = 3").first().text == "  \n\t"
    assert substring_dedup.remove_repeats(none).count() == 0


def test_wavelet_tree_and_index():
    import numpy as np

    rng = np.random.default_rng(0)
    seq = rng.integers(0, 11, 500)
    tree = substring_dedup.WaveletTree(seq, 11)
    start = tree.rank(np.arange(11), np.zeros(11, np.int64), np.zeros(11, np.int64))
    for c in range(11):
        at = np.arange(501)
        assert (tree.rank(np.full(501, c), at, np.full(501, start[c])) == np.r_[0, np.cumsum(seq == c)]).all()
    parts = [rng.integers(0, 3, n) for n in (9, 12, 7, 30)]
    masks = substring_dedup.matched(parts, np.array([1, 1, 2, 1]), 5)
    seen = Counter()
    for p, w in zip(parts, (1, 1, 2, 1), strict=True):
        for k in range(len(p) - 4):
            seen[tuple(p[k : k + 5].tolist())] += w
    for p, m in zip(parts, masks, strict=True):
        assert m == sum(1 << k for k in range(len(p) - 4) if seen[tuple(p[k : k + 5].tolist())] > 1)
