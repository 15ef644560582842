"""Fingerprints, language, quality and language-model scores."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from steadfast.llm import fingerprints as fp
from steadfast.llm import langid, lm, quality
from tests.llm import helpers


def test_sketch_estimates():
    long, short = helpers.sentence(5, 5000), helpers.sentence(5, 5000)[:8000]
    a, b = fp.sketch(long), fp.sketch(short)
    sets = [{t[i:i + fp.WIDTH] for i in range(len(t) - fp.WIDTH + 1)} for t in (long, short)]
    assert abs(fp.likeness(a, b) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.08
    assert fp.containment(b, a) == 1.0 and abs(fp.containment(a, b) - len(sets[1]) / len(sets[0])) < 0.08
    other = fp.sketch(helpers.sentence(6, 300))
    assert fp.merge(a, b).tolist() == a.tolist()
    assert set(fp.merge(b, other)) >= {h for h in [*b, *other] if h < fp.LIMIT}
    assert fp.from_text(fp.to_text(a)).tolist() == a.tolist()
    assert fp.likeness(fp.sketch(""), fp.sketch("")) == 1.0 and fp.likeness(fp.sketch("x"), fp.sketch("")) == 0.0
    assert fp.likeness(fp.sketch("short text one"), fp.sketch("short text one")) == 1.0


def test_long_texts_go_in_blocks(monkeypatch):
    text = helpers.sentence(9, 3000)
    whole = fp.sketch(text)
    monkeypatch.setattr(fp, "BLOCK", 500)
    assert fp.sketch(text).tolist() == whole.tolist()


def test_repeated_shingles_leave_the_sketch_whole(monkeypatch):
    line = "a line of sixty characters that a text repeats many times.\n\n"
    twice, often = fp.sketch(line * 2), fp.sketch(line * 1000)
    assert len(twice) == fp.FLOOR and often.tolist() == twice.tolist() and fp.likeness(twice, often) == 1.0
    few = "0123456789ab" * 500  # 12 shingles, fewer than FLOOR: all are kept
    assert fp.sketch(few).tolist() == np.unique(fp.shingle_hashes(few)).tolist()
    monkeypatch.setattr(fp, "BLOCK", 50)
    assert fp.sketch(line * 1000).tolist() == twice.tolist()
    # the places that the floor needs may come after a block that has many low hashes of one shingle
    text = line * 20 + helpers.sentence(4, 12)
    want = np.unique(fp.shingle_hashes(text))
    low = want[want < fp.LIMIT]
    assert fp.sketch(text).tolist() == (low if len(low) >= fp.FLOOR else want[:fp.FLOOR]).tolist()


@pytest.mark.parametrize("per_range", [3, 20_000])
def test_neighbours(spark, monkeypatch, per_range):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", per_range)
    rows = sorted(helpers.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for i, (doc, text, *_) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = fp.edited(text, following)
        a, b, c = map(fp.sketch, (text, changed, following))
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.to_text(a), fp.to_text(b),
                     round(fp.likeness(a, b), 9), round(fp.likeness(a, c), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in fp.with_neighbour(helpers.documents(spark)).collect()]
    assert Counter(got) == Counter(want)
    assert fp.with_neighbour(helpers.nothing(spark)).count() == 0
    assert fp.with_neighbour(helpers.documents(spark).where("doc_id = 8")).first().near_next == 1.0
    assert fp.fingerprints(helpers.documents(spark)).count() == len(rows)


def test_mixture_finds_both_languages():
    table = np.full((langid.SLOTS, 2), 1e-9)
    a, b = langid.grams("alpha beta gamma"), langid.grams("uno dos tres")
    table[a, 0], table[b, 1] = 0.1, 0.1
    share, chosen = langid.mixture(np.concatenate([a, b, b]), table / table.sum(axis=0))
    assert chosen == [1, 0] and abs(share[1] - 2 * len(b) / (len(a) + 2 * len(b))) < 0.02
    assert langid.mixture(a, table / table.sum(axis=0))[1] == [0]


def test_language(spark):
    got = langid.identify(helpers.documents(spark)).collect()
    assert len(got) == len(helpers.rows())
    texts = {r[0]: r[1] for r in helpers.rows()}
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        letters = any(c.isalpha() for c in (texts[r.doc_id] or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert langid.identify(helpers.nothing(spark)).count() == 0
    unknown = langid.identify(helpers.documents(spark).selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def test_quality(spark):
    labels = spark.createDataFrame([(i, i % 2, 0, 5) for i in range(13)] + [(4, None, 0, 5), (None, 1, 0, 5)],
                                   "doc_id long, quality int, toxic int, text int")
    got = quality.score(helpers.documents(spark), labels).collect()
    assert len(got) == len(helpers.rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score(helpers.nothing(spark), labels).count() == 0
    assert {r.score for r in quality.score(helpers.documents(spark), labels.where("1 = 0")).collect()} == {0.5}


def brute_word_vectors(texts):
    """Sums of the neighbours' index vectors, a word at a time."""
    dims, signs = quality._index()
    sums = np.zeros((quality.SLOTS, quality.WIDTH))
    for text in texts:
        row = []
        for word in quality.WORD.findall(text or ""):
            row.append(1 + zlib.crc32(word.lower().encode()) % (quality.SLOTS - 1))
            if len(word) > 1 and word.isupper():
                row.append(quality.CAPITALS)
        for i, here in enumerate(row):
            for j in range(max(0, i - quality.WINDOW), min(len(row), i + quality.WINDOW + 1)):
                if i != j:
                    for d, sign in zip(dims[row[j]], signs[row[j]]):
                        sums[here, d] += sign
    sums -= sums.sum(axis=0) / max(1.0, np.abs(sums).sum()) * np.abs(sums).sum(axis=1, keepdims=True)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def test_word_vectors_and_pools_by_brute_force(spark):
    texts = [r[1] for r in helpers.rows()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vectors = quality.word_vectors(docs)
    assert np.abs(vectors - brute_word_vectors(texts)).max() < 1e-5
    for r in quality.pooled(docs, vectors).collect():
        own = [vectors[abs(p)] for p in quality.places(texts[r.doc_id] or "", quality.Words())]
        want = np.concatenate([np.mean(own, axis=0), np.std(own, axis=0)]) if own else np.zeros(2 * quality.WIDTH)
        assert np.allclose(np.frombuffer(bytes(r.pooled), "<f4"), want, atol=2e-3)


@pytest.mark.parametrize("sample", [1, 7, 40, 500])
def test_sample_is_the_smallest_by_hash(spark, monkeypatch, sample):
    docs = spark.range(400).selectExpr("cast(id as int) doc_id", "cast(id as string) text")
    labels = spark.range(0, 600, 2).selectExpr("id doc_id", "cast(id % 4 = 0 as int) quality")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    own = lambda d: d.selectExpr("doc_id", "unhex(lpad(hex(doc_id), 8, '0')) pooled")
    quality.learn(docs, labels, sample, own)
    quality.learn(own(docs), labels, sample)
    order = [r.id for r in spark.range(0, 400, 2).selectExpr("id", "xxhash64(id, 7) h").orderBy("h").collect()][:sample]
    for x, y in seen:
        assert [int.from_bytes(np.float32(v).tobytes(), "big") for v in x.ravel()] == order
        assert y.tolist() == [float(i % 4 == 0) for i in order]


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * (x[:, 0] * x[:, 1] + x[:, 2])))
    y = (rng.random(4000) < p).astype(float)
    net = quality.fit(x[:3000], y[:3000])
    q = quality.probability(x[3000:], net)
    assert np.abs(q - p[3000:]).mean() < 0.12


def brute_lm(rows):
    """Counts, weights and scores of a corpus in plain Python."""
    words = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    folds = [zlib.crc32(str("" if d is None else d).encode()) % 10 for d, _ in rows]
    one, two, part_one, part_two = Counter(), Counter(), Counter(), Counter()
    for seq, f in zip(words, folds):
        for counts, keep in ((one, f != 0), (part_one, f == lm.PART)):
            counts.update(seq if keep else ())
        for counts, keep in ((two, f != 0), (part_two, f == lm.PART)):
            counts.update(zip([b"\n", *seq], seq) if keep else ())
    n, kinds = sum(one.values()), len(one)
    rest = n - sum(part_one.values())
    mix = [[0, 0.5, 0.5]] + [[1 / 3] * 3] * 64
    for _ in range(lm.STEPS):
        sums = [[0.0] * 3 for _ in range(65)]
        for (a, b), times in part_two.items():
            c = one[a] - part_one[a]
            each = [(two[a, b] - part_two[a, b]) / max(c, 1), (one[b] - part_one[b]) / max(rest, 1), 1 / (kinds + 1)]
            each = [w * e for w, e in zip(mix[c.bit_length()], each)]
            for i in range(3):
                sums[c.bit_length()][i] += times * each[i] / sum(each)
        new = []
        for b, s in enumerate(sums):
            t = [v + 1 for v in s]
            t[0] *= b > 0
            new.append([v / sum(t) for v in t] if sum(s) > 0 or b < 2 else new[-1])
        mix = new
    out = []
    for (doc, _), seq, f in zip(rows, words, folds):
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in seq)
        value = sum(math.log10(sum(w * e for w, e in zip(mix[one[a].bit_length()], (two[a, b] / max(one[a], 1), one[b] / n, 1 / (kinds + 1)))))
                    for a, b in zip([b"\n", *seq], seq))
        out.append((doc, f == 0, len(seq), sum(one[w] > 0 for w in seq), n, round(base, 6), round(value, 6)))
    return Counter(out)


def test_language_model(spark, monkeypatch):
    more = [(i, helpers.sentence(i, 30)) for i in range(100, 160)]
    rows = [r[:2] for r in helpers.rows()] + more
    docs = helpers.documents(spark).unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm.score(docs).collect())
    assert got == brute_lm(rows)
    assert lm.score(helpers.nothing(spark)).count() == 0
    # nothing to learn from: fold 0 only
    alone = next(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_packed_integers():
    values = np.array([0, 1, 255, 256, 2**40, 2**63], np.uint64)
    assert lm.unpacked(lm.packed(values)).tolist() == values.tolist()
    assert lm.unpacked_sorted(lm.packed_sorted(values)).tolist() == values.tolist()
    assert lm.unpacked(lm.packed(values[:0])).tolist() == []
