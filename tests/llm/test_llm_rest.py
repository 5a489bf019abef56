import hashlib
import random
import re
import textwrap
from collections import Counter

import pytest

from ledgerloom.llm import catalog, fingerprints, lang_cnn, license_scan, url_filters


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLES[name])


RULES = [*url_filters.RULES, ("block", "net", "/es"), ("allow", "net", "/es"), ("block", "a.b", ""), ("allow", None, "/"), ("block", "x.org", "/p/q")]
URLS = [None, "", "x.com/en/", "http://", "http://A.Example.COM/en/1", "http://www.example.com/en/", "http://example.com", "https://m.b.net/es/?q", "http://net/esx#f", "http://a.b?x", "http://c.a.b/", "http://xa.b/", "http://x.org/p/qr", "http://x.org/p", "http://" + "a." * 2000 + "example.com/en/" + "z" * 5000, "ftp://u@x.org:80/p/q"]


@pytest.mark.parametrize("most", [100_000, 0])
def test_url_filters(spark, monkeypatch, most):
    """Rules broadcast and rules dealt out with salt give the same."""
    monkeypatch.setattr(url_filters, "MOST_BROADCAST", most)
    df = spark.createDataFrame([(k % 14 or None, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")

    def brute(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in RULES if h and (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        best = max(fits, default=None)
        return (host, path, best[3], best[4]) if best else (host, path, None, "allow")

    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect())
    assert got == Counter((k % 14 or None, *brute(u)) for k, u in enumerate(URLS))
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_fingerprints(spark, hard, hard_texts, none):
    texts = dict(hard_texts)
    order = sorted(texts)
    df = hard.where("doc_id is not null")
    rows = fingerprints.fingerprints(df).collect()
    assert len(rows) == len(hard_texts)

    def digest(t):
        return {line[k : k + fingerprints.SLICE] for line in t.split("\n") if line for k in range(0, len(line), fingerprints.SLICE)}

    same = {}
    for r in rows:
        t, n = texts[r.doc_id] or "", texts[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(digest(t), digest(edited)))
        assert r.near_next == pytest.approx(likeness(digest(t), digest(n)))
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(hard).count() == len(hard_texts) + 1


def test_language_id(spark, small, hard, none):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = lang_cnn.train(docs)
    rows = lang_cnn.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.9
    again = lang_cnn.train(docs)
    assert all((model.p[k] == again.p[k]).all() for k in model.p)
    odd = {r.doc_id: r for r in lang_cnn.predict(hard, model).collect()}
    assert all((odd[k].lang_pred, odd[k].score) == ("und", 0.0) for k in (1, 2, 3)) and odd[4].lang_pred in model.classes
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert lang_cnn.train(none) is None and lang_cnn.predict(none, model).count() == 0
    assert {r.lang_pred for r in lang_cnn.predict(hard, None).collect()} == {"und"}


def test_the_sample_is_bounded_and_even(spark):
    from pyspark.sql import functions as F

    copies = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text, many times").alias("text"), F.lit("aa").alias("lang"))
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("hot "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    others = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")), F.when(F.col("id") % 3 == 0, "bb").otherwise("aa"))
    rare = spark.range(1).select("id", F.lit("rare"), F.lit("cc"))
    docs = copies.union(hot).union(others).union(rare)
    got = lang_cnn.sample(docs, "doc_id", "text", "lang", F.array("text"), 300, 2).collect()
    count = Counter(r.lang for r in got)
    assert count == {"aa": 300, "bb": 300}
    kinds = Counter(r.cuts[0].split()[0] for r in got if r.lang == "aa")
    assert kinds["one"] <= 1 and kinds["hot"] > 100 and kinds["text"] > 60


def test_gradient():
    import numpy as np

    rng = np.random.default_rng(1)
    net = lang_cnn.ByteCNN(["a", "b"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(1, 256, (4, 20)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(4), y]).mean()
    grad = net.gradient(x, y)
    for name in ("W3", "V", "c", "b2"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        old, step = net.p[name][at], 1e-5
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-4)


def test_licenses(spark, hard, none):
    texts = [(1, "Intro.\nReleased under the MIT License.\nx"), (2, "released under  the mit license. And more text."), (3, "Licensed under the Apache License, Version 3.0."), (4, "no words of the trade"), (5, None), (6, ""), (7, "word " * 3000 + "Licensed under CC BY-NC 4.0. " + "word " * 10), (8, "The license of life is short."), (1, "Released under the MIT License.")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = license_scan.scan_licenses(df).collect()
    assert Counter((r.doc_id, r.license, r.exact, r.n_changed) for r in rows) == Counter({(1, "MIT", True, 0): 2, (2, "MIT", True, 0): 1, (3, "Apache-2.0", False, 2): 1, (7, "CC-BY-NC-4.0", True, 0): 1})
    assert all(text[r.start : r.start + len(r.block)] == r.block for r in rows for i, text in texts if i == r.doc_id and r.doc_id != 1)
    assert license_scan.scan_licenses(none).count() == 0 and license_scan.scan_licenses(hard).count() == 0


def test_licenses_against_every_template(spark, small):
    """Every exact quotation anywhere in a text is found, whichever way it is wrapped."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = Counter((r.doc_id, r.wording) for r in license_scan.scan_licenses(docs).where("exact").collect())
    scanner, want = license_scan.Scanner(license_scan.TEMPLATES), Counter()
    for r in docs.collect():
        words = license_scan.wording(r.text)
        places = {k: [j for j in range(len(words) - len(own) + 1) if words[j : j + len(own)] == own] for k, own in enumerate(scanner.words)}
        for k, found in places.items():
            # a quotation within a longer one is part of it
            inside = [j for j in found for o, all_of in places.items() if len(scanner.words[o]) > len(scanner.words[k]) for i in all_of if i <= j and j + len(scanner.words[k]) <= i + len(scanner.words[o])]
            want[r.doc_id, k] += len(set(found) - set(inside))
    assert got == +want and sum(want.values()) > 0


def test_any_template_can_be_found():
    """What is sought follows from the templates: no word of the trade is needed, and whole licences may be given."""
    rng = random.Random(9)
    long = " ".join(f"t{rng.randrange(300)}" for _ in range(900)) + "."
    scanner = license_scan.Scanner([("PD", "All rights are dedicated to the public domain by the authors."), ("LONG", long), ("NONE", " ... ")])
    assert [(k, n) for _, _, k, _, n in scanner.scan("x y. All rights are dedicated to the\npublic domain by the authors, so there.")] == [(1, 0)]
    edited = [w for j, w in enumerate(long.split()) if j % 9]
    ((_, block, k, _, n),) = scanner.scan("before. " * 50 + " ".join(edited) + " after" * 50)
    assert k == 0 and n == 100 and f"{block}.".split() == edited
    assert not [*scanner.scan("")] and not [*license_scan.Scanner([]).scan("Released under the MIT License.")]


def test_no_place_of_a_notice_hides_it():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for gap in range(150, 260, 10):
        assert [n for *_, n in scanner.scan("license " + "x" * gap + " " + mit)] == [0]
    assert [n for *_, n in scanner.scan("\u0130 " * 40 + mit + " \u0130\u0307")] == [0]


def sliding(scanner, text):
    """(template, first word, end, changed) of a plain comparison of all templates with all runs of words."""
    words, found = license_scan.wording(text), []

    def changed(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
        return row

    for k, own in enumerate(scanner.words):
        most, best = 0.3 * len(own), {}
        for start in range(len(words)):
            if len(set(own) - set(words[start : start + int(len(own) + most)])) > most:
                continue
            for n, cost in enumerate(changed(own, words[start : start + int(len(own) + most)])):
                best[start + n] = min(best.get(start + n, (99, 0)), (cost, -start))
        found += [(cost - len(own), -scanner.reduction(k, words[-start : end]), k, -start, end, cost) for end, (cost, start) in best.items() if cost <= most and -start < end]
    out = []
    for _, reduction, k, start, end, cost in sorted(found):
        if reduction <= -0.3 and all(end <= x or start >= y for _, x, y, _ in out):
            out.append((k, start, end, cost))
    return sorted(out, key=lambda r: r[1])


def agrees(scanner, text):
    """The rows are those of the plain comparison; a row may show more words of its sentence."""
    got, want = [*scanner.scan(text)], sliding(scanner, text)
    assert [k for _, _, k, _, _ in got] == [k for k, *_ in want], text
    for (start, block, _, _, n), (_, first, end, cost) in zip(got, want, strict=True):
        at = len(license_scan.wording(text[:start]))
        assert at <= first and at + len(license_scan.wording(block)) >= end and n - cost == len(license_scan.wording(block)) - (end - first), text
        assert text[start : start + len(block)] == block
    return got


def test_licenses_across_lines_and_within_sentences():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for k, (name, notice) in enumerate(scanner.templates):
        wrapped = textwrap.fill(f"Copyright by me. {notice} All else is left out.", 72, initial_indent="/* ", subsequent_indent=" * ")
        inside = f"as all of this file is, see above, {notice[:-1]} and so on"
        for text in (wrapped, notice.replace(" ", "\n"), inside, "x " * 700 + inside + " y" * 700):
            assert [(j, n) for _, _, j, _, n in agrees(scanner, text)] == [(k, 0)], (name, text)
    assert [n for *_, n in scanner.scan("This file is released under the MIT License.")] == [0]


def test_licenses_near_each_other():
    """All notices of a stretch, also those of templates that compress it little."""
    scanner, rng, n = license_scan.Scanner(license_scan.TEMPLATES), random.Random(4), 0
    for gap in (1, 10, 75, 112, 150):
        text = "Released under the MIT License " + "x " * gap + "Licensed under CC BY-NC 4.0 " + "y " * gap + "Released under the MIT License"
        assert [scanner.templates[k][0] for _, _, k, _, _ in agrees(scanner, text)] == ["MIT", "CC-BY-NC-4.0", "MIT"]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            own = rng.choice(scanner.templates)[1].split()
            for _ in range(rng.randrange(0, 1 + len(own) // 4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice([[], ["new"], ["license"], ["under"]])
            words += own + ["word"] * rng.choice([0, 1, 5, 60, 130])
        n += len(agrees(scanner, "".join(w + rng.choice([" ", " ", " ", "\n", "\n# "]) for w in words)))
    assert n > 100


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.stash(stage(spark, kept[-1], small), name))
    for before, after in zip(kept[:-2], kept[1:-1], strict=True):
        assert after.columns == docs.columns and after.count() <= before.count()
    from test_llm_dedup import brute_repeats

    texts = [(r.doc_id, r.text) for r in kept[3].collect()]
    own = {r.doc_id: r.text for r in kept[4].collect()}
    for (i, n, gone, left), _ in brute_repeats(texts, 35).items():
        assert own[i] == (left if gone else dict(texts)[i]), (i, n)
    assert {r.doc_id for r in kept[5].collect()} == set(own)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in kept[2].collect()]
    assert len(norm) == len(set(norm))
