"""Language identification, importance resampling and packing."""

import zlib
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import QUERIES
from lexmill.llm import langid as L
from lexmill.llm import packing as K
from lexmill.llm import resampling as R

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- languages


def test_convolution_against_loops():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (3, L.LENGTH)).astype(np.uint8)
    net = L.train(x, np.array([0, 1, 1]), ["a", "b"], epochs=1)
    pooled = net.pooled(x)
    dim = L.DIMENSIONS
    for b in range(3):
        padded = [*x[b], *[0] * (max(L.WIDTHS) - 1)]
        for i, width in enumerate(L.WIDTHS):
            for f in range(i * L.FILTERS, (i + 1) * L.FILTERS):
                best = max(
                    sum(float(net.embedding[padded[p + k]] @ net.kernel[k * dim : (k + 1) * dim, f]) for k in range(width))
                    for p in range(L.LENGTH)
                )
                assert abs(max(0.0, best + float(net.bias[f])) - pooled[b, f]) < 1e-4
    assert np.allclose(net.probabilities(x).sum(axis=1), 1, atol=1e-5)


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 256, (4, 40)).astype(np.uint8), np.array([0, 1, 2, 1])
    net = L.train(x, y, ["a", "b", "c"], epochs=1)
    params = [net.embedding, net.kernel, net.bias, net.dense, net.dense_bias]
    for name, p in zip(("embedding", "kernel", "bias", "dense", "dense_bias"), params, strict=True):
        setattr(net, name, p.astype(np.float64))

    def loss():
        return -np.log(net.probabilities(x)[np.arange(len(y)), y]).mean()

    for name, g in zip(("embedding", "kernel", "bias", "dense", "dense_bias"), L.gradients(net, x, y), strict=True):
        p = getattr(net, name)
        for at in np.argsort(-np.abs(g), axis=None)[:5]:
            old, step = p.flat[at], 1e-6
            p.flat[at] = old + step
            up = loss()
            p.flat[at] = old - step
            down = loss()
            p.flat[at] = old
            assert abs((up - down) / (2 * step) - g.flat[at]) < 1e-4, name


def test_training_windows_come_from_whole_texts(make_docs):
    # few long texts: every window takes part, not the first ones of a text
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(400)), "en", "s") for i in range(12)]
    texts = make_docs(rows).select("doc_id", "text", "lang")
    learned = [t for i, t, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    want = {w.tobytes() for t in learned for w in L.windows_of(t)}
    assert {bytes(w) for w in L.training_windows(texts)["window"]} == want
    assert len(L.training_windows(texts, 50)) == 50


def test_windows_hold_the_whole_text():
    for text in ("", "a", "é" * 500, "x" * L.LENGTH, "y" * (L.LENGTH + 1)):
        raw = text.encode()
        assert L.windows_of(text).tobytes().rstrip(b"\0") == raw


def test_held_out_accuracy(spark):
    rows = QUERIES["op8_language_id"](spark, SF).collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    out = [r for r in rows if r["held_out"] and docs[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in out) / len(out) >= 0.97


def test_languages_of_odd_documents(odd_docs, make_docs):
    rows = L.predict_languages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" for i in (1, 2, 3)) and by_id[5]["lang_pred"] in ("en", "de", "fr")
    assert L.predict_languages(odd_docs.limit(0)).count() == 0
    unknown = make_docs([(1, "some text", None, "s"), (2, "12 34", None, "s")])
    assert {(r["lang_pred"], r["score"]) for r in L.predict_languages(unknown).collect()} == {("und", 0.0)}


# ---------------------------------------------------------------- resampling


def plain_weights(texts, target):
    """The same models with dictionaries, for tables whose bucket count is not reduced."""
    grams = [list(zip(*[(b, d) for _, bs, ds in R.ngrams([t]) for b, d in zip(bs.tolist(), ds.tolist(), strict=True)], strict=True))
             for t in texts]
    grams = [list(g[0]) if g else [] for g in grams]
    n = sum(len(g) for g, t in zip(grams, target, strict=True) if t)
    size = min(R.MOST_BUCKETS, max(64, 1 << int(np.log2(max(1, n // R.PER_BUCKET)))))
    raw, wanted = Counter(), Counter()
    for g, t in zip(grams, target, strict=True):
        raw.update(x % size for x in g)
        wanted.update(x % size for x in g if t)
    total = sum(raw.values())
    out = []
    for g in grams:
        s = 0.0
        for x in g:
            share = (raw[x % size] + 1) / (total + size)
            s += np.log((wanted[x % size] + R.PRIOR * n * share) / (n * (1 + R.PRIOR)) / share) if n else 0.0
        out.append(s / max(1.0, len(g) / R.NGRAMS))
    return out


def test_weights_against_counting(spark, make_docs):
    rows = [(i, f"the good text number {i} and more of it" * (1 + i % 3)) for i in range(60)]
    rows += [(100 + i, f"junk{i} | junk | ### | {i}") for i in range(20)] + [(200, None), (201, "")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(0, 1, 0), (100, 0, 0), (None, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in R.importance_weights(make_docs(rows), labels).collect()}
    want = plain_weights([t for _, t in rows], [i < 60 and i % 2 == 0 for i, _ in rows])
    for (i, _), w in zip(rows, want, strict=True):
        assert abs(got[i]["log_weight"] - w) < 1e-4
    assert all(got[i]["kept"] for i in range(60)) and got[200]["log_weight"] == 0
    kept = R.resampled(make_docs(rows), labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [*rng.standard_normal(3000).tolist(), *[0.5] * 400, -1e9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 1000, 3401, 3402):
        assert R.kth_largest(df, "v", k) == ordered[k - 1]
    assert R.kth_largest(df, "v", 0) == float("inf") and R.kth_largest(df.limit(0), "v", 3) == float("inf")


def test_resampling_of_odd_documents(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert R.importance_weights(odd_docs, labels).count() == odd_docs.count()
    assert R.resampled(odd_docs, labels).columns == odd_docs.columns
    assert R.resampled(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert R.importance_weights(odd_docs.limit(0), labels).count() == 0 and R.resampled(odd_docs.limit(0), labels).count() == 0


def test_good_documents_stay_and_junk_goes(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op9_importance_resampling"](spark, SF).collect()
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(good) / len(good) >= 0.99 and sum(junk) / len(junk) <= 0.25


# ---------------------------------------------------------------- packing


def plain_best_fit(sizes, lengths):
    """Every open bin is looked at for every piece."""
    bins, coming = [], sum(sizes)
    placed = []
    for s in sizes:
        coming -= s
        fitting = [b for b in bins if b["room"] >= s]
        if fitting:
            b = min(fitting, key=lambda b: (b["room"], b["id"]))
        else:
            length = K.open_length(s, coming, tuple(sorted(lengths)))
            b = {"id": len(bins), "room": length, "used": 0}
            bins.append(b)
        placed.append((b["id"], b["used"]))
        b["room"] -= s
        b["used"] += s
    return placed, [min(c for c in lengths if c >= b["used"]) for b in bins]


@pytest.mark.parametrize("lengths", [(512, 1024, 2048, 4096), (7,), (3, 10, 11)])
def test_best_fit_against_all_bins(lengths):
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 400):
        sizes = np.sort(rng.integers(1, max(lengths) + 1, n))[::-1]
        bins, offsets, capacity = K.best_fit(sizes, lengths)
        placed, final = plain_best_fit(sizes.tolist(), lengths)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == placed and capacity == final


def test_opening_length_weighs_all_lengths():
    assert K.open_length(500, 0, K.LENGTHS) == 512
    assert K.open_length(300, 10**6, K.LENGTHS) == 512
    assert K.open_length(3000, 10**6, K.LENGTHS) == 4096


def check_packing(docs, rows, lengths):
    words = Counter()
    for d in docs:
        words[d["doc_id"]] += len((d["text"] or "").encode().split())
    packed, bins = Counter(), {}
    for r in rows:
        packed[r["doc_id"]] += r["n_words"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert packed == +words
    for rows in bins.values():
        rows.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in rows] == np.cumsum([0, *[r["n_words"] for r in rows[:-1]]]).tolist()
        used = sum(r["n_words"] for r in rows)
        assert {r["capacity"] for r in rows} == {min(c for c in lengths if c >= used)}


def test_packing_of_odd_documents(odd_docs):
    docs = odd_docs.select("doc_id", "text").collect()
    rows = K.pack(odd_docs, shard_words=3000, with_text=True).collect()
    check_packing(docs, rows, K.LENGTHS)
    for r in rows:
        assert len(r["text"].encode().split()) == r["n_words"]
    long = sorted((r["start"], r["text"]) for r in rows if r["doc_id"] == 6)
    assert " ".join(t for _, t in long) == next(d["text"] for d in docs if d["doc_id"] == 6)
    assert K.pack(odd_docs.limit(0)).count() == 0


def test_query_packs_every_word(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_packing(docs, QUERIES["op2_best_fit_packing"](spark, SF).collect(), K.LENGTHS)


def test_copies_of_one_row_are_dealt_over_shards(make_docs):
    rows = [(7, "ten words in one row that is held many times")] * 20_000 + [(None, "a b c")] * 9_000 + [(i, "x y z") for i in range(50)]
    packed = K.pack(make_docs(rows), shard_words=5_000).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in packed) == Counter((i, len(t.split())) for i, t in rows)
    load = Counter()
    for r in packed:
        load[r["bin_id"] // K._BINS_PER_SHARD] += r["n_words"]
    assert max(load.values()) <= 3 * 5_000
