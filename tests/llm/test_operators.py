"""The operators on small tables with nulls, ties, empty texts, repeated rows, clashing columns; against brute force."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tickframe.llm import attention, graph, hostquality, htmltext, langid, lm, merkle, mixing, packing, passages, rules, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, node string, `size` int"
LONG = " ".join(f"word{i} of the long text." for i in range(3000))
PASSAGE = "Here begins a passage that is in many documents. It goes on for a while and then some more. It ends at this place."
TEXTS = [
    None, "", " \n\t ", "Von.", "The sea is wide and the boats are small today.", "The sea is wide and the boats are small today.",
    LONG, LONG.replace("word17 ", "Word17 "), "same line again and again\n" * 12, "A B c\nA B c\nd e f\n\nA B c",
    "SHOUT!! LOUD!! WORDS!! ALL!! THE!! TIME!! AND!! MORE!! OF!! IT!! NOW!!", "#### $$$ %%% && ** || <> #### $$$ %%% && ** || <>",
    f"One thing first. {PASSAGE} And another.", f"Different words lead here {PASSAGE}", f"{PASSAGE}\nThen a line.", "été à la plage, ça va? Ñandú",
    "un deux trois quatre cinq six sept huit neuf dix onze douze", "日本語 の 文", "x" * 5000, "a b", "a b c", "a b c d", "a b c d e",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, ("en", "fr", None)[i % 3], ("s1", "s0", None, "s1")[i % 4], None, "n", 1, "x", 7)
            for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[6], (None, None, None, None, None, None, None, None, None), (-5, "a b c d e", "en", "Z", 1, "", 0, "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


# --- 1 ------------------------------------------------------------------------------------------

def test_packing_round_trip(docs, empty):
    rows = packing.pack(docs, ["doc_id"], with_ids=True).collect()
    known = tokens.WordIds(tokens.vocabulary_path())._tokenizer
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for r in docs.select("doc_id", "text").distinct().collect():
        if r.doc_id is None or r.doc_id in (4, 6):
            continue
        pieces = sorted(by[r.doc_id], key=lambda p: p.start)
        assert [x for p in pieces for x in p.ids] == known.encode(r.text or "", add_special_tokens=False).ids + [2]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert sum(r.length for r in by[4]) == 2 * by[4][0].doc_tokens  # the repeated row is packed twice
    assert packing.pack(empty, ["doc_id"]).count() == 0


# --- 2 ------------------------------------------------------------------------------------------

def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(table, ~held_out)
    right = langid.predict(table.filter(held_out), ["doc_id", "lang"], model).agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 < right[1] <= right[2] <= 1
    said = {r.doc_id: r for r in langid.predict(docs, ["doc_id"], model).collect()}
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (0, 1, 2, 11)) and said[6].lang_pred == "en"
    assert langid.predict(docs, ["doc_id"], langid.train(empty, F.lit(True))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.predict(empty, ["doc_id"], model).count() == 0
    again = langid.train(table.repartition(5), ~held_out)
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


# --- 3 ------------------------------------------------------------------------------------------

def filled(sizes, weights, share=1.5, most=2):
    """Targets by raising a level until nothing is above its ceiling."""
    budget, full = share * sum(sizes), set()
    while True:
        rest = budget - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = rest / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else level * weights[i] for i in range(len(sizes))]
        full |= over


def test_mixing(spark, docs, empty):
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(r.size for r in rows if r.source == s) for s in names}
    want = filled([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, target in zip(names, want):
        mine = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(target) and r.source_size == size[s] for r in mine)
        taken = sum(r.size * r.copies for r in mine)
        assert abs(taken - target) <= max([r.size for r in mine]) * 2 and all(0 <= r.copies <= 2 for r in mine)
        assert max(r.copies for r in mine if r.size) - min(r.copies for r in mine if r.size) <= 1
    for r in rows:
        assert r.size in {len(words(t)) for t in TEXTS}
    key = lambda f: sorted((str(r.id), r.tie, r.copies) for r in f.collect())
    assert key(mixing.mixture(docs.repartition(7))) == key(mixing.mixture(docs))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixing.mixture(empty).count() == mixing.mixed(empty).count() == 0
    counts = Counter(r.doc_id for r in mixed.collect())
    assert all(counts[r.id] == r.copies for r in rows if r.id is not None and r.id not in (4, 6))


def test_many_sources_and_weights(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 13}", None) for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    got = mixing.mixture(table).collect()
    names = sorted({r.source for r in got})
    size = {s: sum(r.size for r in got if r.source == s) for s in names}
    want = dict(zip(names, filled([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for s in names:
        mine = sorted((-math.log((int(hashlib.md5(f"mix:{r.id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48), r) for r in got if r.source == s)
        epochs, ahead = int(want[s] // size[s]), 0
        for _, r in mine:  # every letter share is 1 here
            rest = want[s] - epochs * size[s]
            assert r.copies == epochs + (rest > 0 and 2 * ahead + r.size <= 2 * rest)
            ahead += r.size


# --- 4 ------------------------------------------------------------------------------------------

def fingerprint(text, shingle=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, empty):
    prints = simhash.fingerprints(docs, ["doc_id"]).cache()
    rows = simhash.near_groups(prints, "doc_id", 4).collect()
    assert len(rows) == docs.count()
    want = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    assert Counter((r.doc_id, r.fp0 % 2**64) for r in rows) == Counter(want)
    for r in rows:
        reach, more = {r.fp0 % 2**64}, True
        while more:
            new = {f for _, f in want if any((f ^ g).bit_count() <= 4 for g in reach)}
            more, reach = new != reach, new
        assert r.component_id == min((i for i, f in want if f in reach and i is not None), default=None)
    assert simhash.near_groups(simhash.fingerprints(empty, ["doc_id"]), "doc_id", 4).count() == 0


def test_one_of_each(docs, empty, spark):
    rows = simhash.one_of_each(docs).collect()
    left = Counter(r.text for r in rows)
    assert all(n == 1 for n in left.values())
    assert {"The sea is wide and the boats are small today.", "a b"} <= set(left) and not {LONG, LONG.replace("word17 ", "Word17 ")} <= set(left)
    assert simhash.one_of_each(empty).count() == 0 and simhash.one_of_each(docs).columns == docs.columns
    base = " ".join(f"t{i * 7919 % 997}" for i in range(400))
    near = [(i, base.replace(f" t{(i + 3) * 7919 % 997} ", " changed ")) for i in range(40)]
    far = [(100 + i, " ".join(f"q{(i * 1000 + k) * 31 % 99991}" for k in range(300))) for i in range(40)]
    stay = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(near + far, "doc_id long, text string")).collect()}
    assert stay == {0} | {i for i, _ in far}


def test_components(spark):
    draw = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    up = {x: x for p in links for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if x in got} and all(find(x) == x for x in up if x not in got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5 and 6 --------------------------------------------------------------------------------------

def test_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    field = htmltext.train(htmltext.sample_pages(table, "page_id", "html"))
    odd = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (3, "<article><p>One long sentence is here.</article>", 3)],
                                "page_id long, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.extract(odd, ["page_id"], field).collect())
    assert got == [(1, "", 0), (1, "", 0), (2, "", 0), (3, "One long sentence is here.", 26)]
    for r in htmltext.extract(table, ["page_id", "html"], field).collect():
        assert r.n_chars == len(r.text) > 0 and "track(" not in r.text
        assert r.html.split('<div class="ad">')[1].split("<")[0] not in r.text
    assert htmltext.extract(table.limit(0), ["page_id"], htmltext.train(htmltext.sample_pages(table.limit(0), "page_id", "html"))).count() == 0


@pytest.mark.parametrize("rows_a_range", [1, 3, 10**6])
def test_merkle(docs, empty, monkeypatch, rows_a_range):
    monkeypatch.setattr(merkle, "RANGE_ROWS", rows_a_range)
    rows = merkle.fingerprinted(docs).collect()
    tie = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -tie[r.text]))
    want = Counter()
    for one, after in zip(order, order[1:] + order[:1]):
        a, b = one.text or "", after.text or ""
        text = a[:len(a) - len(a) // 3] + b[:len(a) // 3]
        x, y, z = (merkle.Tree(t).fingerprint() for t in (a, text, b))
        want[(one.doc_id, len(a), hashlib.sha256(text.encode()).hexdigest(), x, y, merkle.likeness(x, y), merkle.likeness(x, z))] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert merkle.fingerprinted(empty).count() == 0


# --- 7 ------------------------------------------------------------------------------------------

def test_passages(docs, empty):
    rows = passages.without_repeats(docs).collect()
    tie = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    place = lambda r: (r.doc_id is None, r.doc_id or 0, tie[r.text])
    first = {}
    original = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda p: (p[0] is None, p[0] or 0, tie[p[1]]))
    for i, text in original:
        for k, (a, b, _) in enumerate(passages.units(text or "")):
            first.setdefault(passages.normalised(text[a:b])[0], (i, text, k))
    want = Counter()
    for r in docs.collect():
        later = [k for k, (a, b, _) in enumerate(passages.units(r.text or ""))
                 if first[passages.normalised(r.text[a:b])[0]] != (r.doc_id, r.text, k)]
        text, spans, n = passages.cleaned(r.text, later, passages.MIN_WORDS) if later else (r.text, [], 0)
        want[(r.doc_id, text, tuple(spans), n)] += 1
    assert Counter((r.doc_id, r.text, tuple((s.start, s.length) for s in r._llm_removed), r._llm_n_removed) for r in rows) == want
    text = {r.doc_id: r.text for r in rows}
    assert PASSAGE in text[12] and "goes on for a while" not in text[13] + text[14] and "Then a line." in text[14]
    assert text[20] == "a b c" and place is not None and passages.without_repeats(empty).count() == 0


# --- 8 ------------------------------------------------------------------------------------------

def test_lm_counts_and_base(docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_WORDS", 3000)
    monkeypatch.setattr(lm, "FREQUENT", 0.01)  # so that most words take the join
    held = F.col("doc_id").isin(4, 12)
    held = F.coalesce(held, F.lit(False))
    rows = lm.scored(docs, held).collect()
    c = Counter()
    for r in docs.collect():
        if r.doc_id not in (4, 12):
            c.update([*lm.words_of((r.text or "").encode()), b"\n"])
    n, v = c.total(), len(c)
    want = Counter()
    for r in docs.collect():
        t = [*lm.words_of((r.text or "").encode()), b"\n"]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[(r.doc_id, r.doc_id in (4, 12), len(t), sum(c[w] > 0 for w in t), n, round(base, 6))] += 1
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.scored(empty, F.lit(False)).count() == 0
    assert all(r.n_known == 0 and r.base_score == 0 for r in lm.scored(docs.filter("doc_id = 20"), F.lit(True)).collect())


def plain_log(model, given, wanted):
    """The log-probability of one id after those given, place by place in double precision."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = p["e"][given]
    own = x[-1] @ p["q"]
    seen = np.array([own @ (x[j] @ p["k"]) / math.sqrt(attention.WIDTH) + p["r"][len(x) - 1 - j] for j in range(len(x))])
    seen = np.exp(seen - seen.max())
    h = x[-1] + (seen / seen.sum()) @ (x @ p["v"])
    c, j = divmod(int(model.slot[wanted]), model.size)
    outer, inner = h @ p["uc"] + p["bc"], h @ p["uw"][c] + p["bw"][c]
    return outer[c] - np.log(np.exp(outer).sum()) + inner[j] - np.log(np.exp(inner).sum())


@pytest.mark.parametrize("learner_words", [400, 10**6])
def test_lm_scores_by_brute_force(docs, monkeypatch, learner_words):
    monkeypatch.setattr(lm, "SAMPLE_WORDS", 3000)
    monkeypatch.setattr(lm, "LEARNER_WORDS", learner_words)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    monkeypatch.setattr(lm, "FREQUENT", 0.01)
    held = F.coalesce(F.col("doc_id").isin(4, 12), F.lit(False))
    rows = {r.id: r.score for r in lm.scored(docs, held).collect() if r.id is not None}
    training, path = docs.filter(~held), attention.vocabulary_path()
    counts = lm.word_counts(training)
    c = {bytes(r.word): r.c for r in counts.collect()}
    n = sum(c.values())
    model, share = lm.train(training, counts, n, path, "doc_id", "text")
    subwords, step = attention.Subwords(path), attention.WINDOW - attention.OVERLAP
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:12] + [12]:
        words = lm.words_of((texts[i] or "").encode())
        stream = np.concatenate(([subwords.END], subwords.ids([words])[0]))
        logs = []
        for t in range(len(stream) - 1):
            first = max(0, -(-(t + 1 - attention.WINDOW) // step)) * step
            log = plain_log(model, stream[first:t + 1], stream[t + 1])
            logs = logs + [log] if subwords.begins[stream[t + 1]] else [*logs[:-1], logs[-1] + log]
        want = sum(math.log10(share * c.get(w, 0) / n + (1 - share) * math.exp(log)) for w, log in zip([*words, lm.END_WORD], logs, strict=True))
        assert rows[i] == pytest.approx(want, abs=1e-3 + 1e-5 * abs(want)), i


def test_lm_learns_from_every_training_document(docs, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_WORDS", 1)  # one pass, each round over its own part
    seen, real = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda parts: seen.append(sum(parts["n"].to_pylist())) or real(parts))
    path, counts = attention.vocabulary_path(), lm.word_counts(docs)
    n = counts.agg(F.sum("c")).first()[0]
    lm.train(docs, counts, n, path, "doc_id", "text")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1 << 40))
    texts = [lm.words_of(r.text.encode()) for r in docs.filter(draw % lm.ASIDE != 0).filter("text is not null").collect()]
    assert sum(seen) == len(attention.Subwords(path).ids(texts)[0])


def test_lm_learned_vocabulary_spells_all_words_in_fewer_ids():
    words = ["umbetzung", "mentaux,", "betz", "mentum", "zungaux."]
    counts = {w.encode(): 50 - k for k, w in enumerate(words)} | {bytes([b]): 1 for b in range(33, 127)}
    lines = attention.learned_vocabulary(counts)
    own, public = attention.Subwords(lines), attention.Subwords(attention.vocabulary_path())
    spelled = dict(enumerate(own._encoding.decode_single_token_bytes(i) for i in range(256)))
    assert sorted(spelled.values()) == [bytes([b]) for b in range(256)]
    for text in ([w.encode() for w in words], ["новое".encode(), "語".encode(), b"zzqx"], []):
        ids, sizes = own.ids([text])
        assert b"".join(own._encoding.decode_single_token_bytes(int(i)) for i in ids[:-1]) == b"".join(b" " + w for w in text)
        assert own.begins[ids].sum() == len(text) + 1 and sizes.tolist() == [len(ids)] and ids[-1] == own.END
    known = [[w.encode() for w in words]]
    assert 2 * len(own.ids(known)[0]) < len(public.ids(known)[0])
    assert len(attention.Subwords(attention.learned_vocabulary({})).ids([[b"ab"]])[0]) == 4
    assert attention.learned_vocabulary(dict(reversed(counts.items()))) == lines
    # a long word neither teaches merges nor takes the driver's memory by its count, and is spelled all the same
    long = b"ab" * 100_000
    assert attention.learned_vocabulary(counts | {long: 10**9}) == lines
    assert b"".join(own._encoding.decode_single_token_bytes(int(i)) for i in own.ids([[long]])[0][:-1]) == b" " + long


def test_lm_scores_with_its_own_vocabulary(docs, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_WORDS", 3000)
    monkeypatch.setattr(lm, "FREQUENT", 0.001)
    held = F.coalesce(F.col("doc_id").isin(4, 12), F.lit(False))
    counts = lm.word_counts(docs.filter(~held))
    c = {bytes(r.word): r.c for r in counts.collect()}
    n = sum(c.values())
    lines = attention.learned_vocabulary({w: k for w, k in c.items() if k > 0.001 * n and w != lm.END_WORD})
    model, share = lm.train(docs.filter(~held), counts, n, lines, "doc_id", "text")
    texts = {r.doc_id: [lm.words_of((r.text or "").encode())] for r in docs.collect() if r.doc_id is not None}
    for r in lm.scored(docs, held, own_vocabulary=True).filter("id is not null").collect():
        logs = lm.word_logs(model, attention.Subwords(lines), texts[r.id])
        want = sum(math.log10(share * c.get(w, 0) / n + (1 - share) * math.exp(log)) for w, log in zip([*texts[r.id][0], lm.END_WORD], logs, strict=True))
        assert r.score == pytest.approx(want, abs=1e-3 + 1e-5 * abs(want)), r.id
    assert lm.scored(docs.limit(0), F.lit(False), own_vocabulary=True).count() == 0


def test_lm_averages_weigh_by_ids():
    import pyarrow as pa

    rows = [{"learner": k, "n": float(k + 1), "weights": np.full(3, k, np.float32).tobytes()} for k in (2, 0, 1)]
    total, mean = lm.averaged(pa.Table.from_pylist(rows))
    assert total == 6 and np.frombuffer(mean, np.float32) == pytest.approx([(0 + 2 + 6) / 6] * 3)


# --- 9 and 10 -------------------------------------------------------------------------------------

def test_host_quality(spark, docs, empty):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.id: r for r in hostquality.quality(table, labels).collect()}
    good = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(got[i].kept == bool(q) for i, q in good.items()) / len(good) > 0.94
    n, k = len(good), sum(good.values())
    by = defaultdict(list)
    for r in table.collect():
        by[r.source].append(r.doc_id)
    for ids in by.values():  # a host's rate lies between its own share and that of all
        mine = [good[i] for i in ids if i in good]
        low, high = sorted((sum(mine) / len(mine), (k + 1) / (n + 2)))
        assert low - 1e-9 <= got[ids[0]].host_rate <= high + 1e-9
    few = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (8, None)], "doc_id long, quality int")
    assert hostquality.quality(docs, few).count() == docs.count()
    assert hostquality.quality(empty, few).count() == 0
    blank = hostquality.quality(docs, few.limit(0)).collect()
    assert all(r.p_quality == pytest.approx(0.5) for r in blank) and len(blank) == docs.count()


def test_prior_weight(spark):
    draw = np.random.default_rng(2)
    sizes = draw.integers(20, 60, 400)
    shares = draw.beta(8, 2, 400)
    rows = [(int(draw.binomial(n, p)), int(n)) for n, p in zip(sizes, shares)]
    assert 6 < hostquality.prior_weight(spark.createDataFrame(rows, "k long, n long"), "k", "n") < 16
    alike = [(int(draw.binomial(n, 0.8)), int(n)) for n in sizes]
    assert hostquality.prior_weight(spark.createDataFrame(alike, "k long, n long"), "k", "n") > 60


def repeat_words(w, k=5):
    seen = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return len({j for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for j in range(i, i + k)})


def test_rules(docs, empty):
    rows = rules.quality_verdicts(docs, ["doc_id"]).collect()
    want = Counter()
    for r in docs.collect():
        t, w = r.text or "", words(r.text)
        lines = [x for x in t.split("\n") if words(x)]
        n = len(w)
        rep = repeat_words(w)
        want[(r.doc_id, n, sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), rep,
              n < 10 or 100 * rep > 20 * n)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(r.kept == (not r.base_failed and r.p_good >= 0.5) for r in rows)
    assert rules.quality_verdicts(empty, ["doc_id"]).count() == 0
    kept = rules.good_only(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_rules_use_no_python(docs):
    plan = rules.rule_features(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_agree_with_labels(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.quality_verdicts(table, ["doc_id"]).join(labels, "doc_id").collect()
    assert sum(not r.kept for r in rows if r.quality == 0) / sum(r.quality == 0 for r in rows) > 0.9
    assert sum(r.kept for r in rows if r.quality == 1 and not r.base_failed) / sum(r.quality == 1 and not r.base_failed for r in rows) > 0.98


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline(spark, empty, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    total = out.agg(F.sum("length"), F.countDistinct("sequence_id"), F.max("length")).first()
    assert total[0] > 0 and total[2] <= 4096
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").columns == empty.columns
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# --- verified near-duplicates --------------------------------------------------------------------

def test_one_of_each_line(spark):
    """Only pairs of a five-word similarity of 0.8 count, and a failed pair hides none that reaches it."""
    from itertools import combinations

    draw = np.random.default_rng(11)
    rows = []
    for group in range(30):
        base = [f"g{group}w{i}" for i in range(200)]
        for change in (0, 1, 2, 4, 6, 8, 10):
            at = draw.choice(200, change, replace=False)
            rows.append((len(rows), " ".join(f"new{group}x{change}" if i in at else w for i, w in enumerate(base))))
    rows = [rows[i] for i in draw.permutation(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5), 3) for i, t in rows}
    root, failed = {i: i for i in sets}, 0
    for a, b in combinations(sorted(sets), 2):
        if any(((x ^ y) % 2**64).bit_count() <= 8 for x, y in zip(prints[a], prints[b])):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
            else:
                failed += 1
    assert failed > 20 and {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(root.values())


def test_dense_group_below_the_line_emits_no_pairs(spark, monkeypatch):
    """Many documents near in bits, no two of them similar enough: the compared pairs do not grow with the square."""
    base, n = [f"w{i}" for i in range(300)], 60
    rows = [(d, " ".join(f"own{d}x{i}" if i % 30 == d % 2 else w for i, w in enumerate(base))) for d in range(n)]
    prints = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5), 3) for _, t in rows]
    near = sum(any(((x ^ y) % 2**64).bit_count() <= 8 for x, y in zip(prints[a], prints[b])) for a in range(n) for b in range(a))
    compared, verified = [], simhash._verified

    def counting(pairs, count, *rest):
        compared.append(count)
        return verified(pairs, count, *rest)

    monkeypatch.setattr(simhash, "_verified", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == n and near > 5 * n and sum(compared) < 2 * n


def test_tries_dealt_in_rounds(spark, monkeypatch):
    """Rounds find what one deal of all tries finds, each holds its share of the rows, and their files go."""
    draw = np.random.default_rng(3)
    rows = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(200)]
        for change in (0, 1, 2, 5, 9):
            at = draw.choice(200, change, replace=False)
            rows.append((len(rows), " ".join(f"new{group}x{change}" if i in at else w for i, w in enumerate(base))))
    rows += [(0, rows[0][1]), (None, rows[0][1]), (None, "a b c d e f"), (None, "a b c d e f"), (None, None), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        groups = simhash.near_groups(simhash.fingerprints(docs.filter("doc_id < 60"), ["doc_id"]), "doc_id", 4).collect()
        return sorted(map(tuple, simhash.one_of_each(docs).collect()), key=str), sorted((r.doc_id, r.component_id) for r in groups)

    whole = found()
    labels, dealt, deal, saved = [], [], simhash._dealt, simhash.saved

    def counting(*args, **more):
        out = deal(*args, **more)
        dealt.append([r.count() for r in out[0]])
        return out

    monkeypatch.setattr(simhash, "ROUND_BYTES", 30_000)
    monkeypatch.setattr(simhash, "SHINGLE_BYTES", 0)
    monkeypatch.setattr(simhash, "PRINT_BYTES", 0)
    monkeypatch.setattr(simhash, "_dealt", counting)
    monkeypatch.setattr(simhash, "saved", lambda df, label: labels.append((label, saved(df, label))) or labels[-1][1])
    assert found() == whole and whole[0].count((None, "a b c d e f")) == 1 and len(whole[0]) < 60
    assert any(len(r) > 2 for r in dealt) and all(n * simhash.ROW_BYTES <= 30_000 for r in dealt for n in r)
    rounds = [df for label, df in labels if label == "round"]
    assert rounds and not any(os.path.exists(f.removeprefix("file://")) for df in rounds[:3] for f in df.inputFiles())


# --- passages word by word -----------------------------------------------------------------------

def removed_by_windows(rows, split, n=passages.MIN_WORDS):
    """What should stay of each (doc_id, text): an independent list of all windows of n words."""
    first, stay = set(), {}
    for i, text in sorted(rows):
        w = split(text)
        gone = set()
        for k in range(len(w) - n + 1):
            window = tuple(x.lower() for x in w[k:k + n])
            if window in first:
                gone |= set(range(k, k + n))
            first.add(window)
        stay[i] = [x for k, x in enumerate(w) if k not in gone]
    return stay


def test_passages_follow_one_text(spark):
    """Words that each occur earlier are no passage: names and capitalised words in another order stay."""
    draw = np.random.default_rng(5)
    names = [f"Name{i}" for i in range(60)]
    rows = [(i, " ".join(names[k] for k in draw.permutation(60))) for i in range(12)]
    rows.append((12, " ".join(rows[3][1].split()[10:40] + rows[5][1].split()[:15] + rows[7][1].split()[20:45])))
    out = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text.split() for r in out} == removed_by_windows(rows, str.split)
    assert len(next(r.text.split() for r in out if r.doc_id == 12)) == 15


def test_passages_word_by_word(spark):
    """Passages that begin and end inside units, and of scripts without spaces, go from their first to their last word."""
    import re

    draw = np.random.default_rng(8)
    word = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    shared = word("s", 25)
    han = "".join(chr(0x4E00 + int(k)) for k in draw.permutation(5000)[:60])
    thai = "".join(chr(0x0E01 + int(k)) for k in draw.integers(0, 46, 90))
    rows = [(0, f"{word(0, 30)} {shared} {word(1, 30)}"), (1, f"{word(2, 7)} {shared} {word(3, 7)}"),
            (2, f"One two. {word(1, 30).replace('w1x9 ', 'w1x9. ')} end"), (3, f"一{han}二。"), (4, f"三{han}四。"), (5, f"a {thai} b"),
            (6, f"c {thai}. d"), (7, f"{word(2, 7)} {word('s', 19)}"), (8, f"五{han[:19]}六")]
    out = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    split = lambda t: re.findall(r"[\u0e01-\u0e5b\u4e00-\u9fff]|[^\s\u0e01-\u0e5b\u4e00-\u9fff]+", t)
    assert {r.doc_id: split(r.text) for r in out} == removed_by_windows(rows, split)
    text = {r.doc_id: r.text for r in out}
    assert text[1] == f"{word(2, 7)} {word(3, 7)}" and text[4] == "三四。" and text[6] == "c . d" and text[8] == rows[8][1]
    assert [(s.start, s.length) for s in next(r for r in out if r.doc_id == 4)._llm_removed] == [(1, 60)]


def test_passages_in_many_contexts(spark):
    """Few distinct words, so that seeds recur in many contexts, at ends of texts and several times in one text."""
    draw = np.random.default_rng(21)
    phrases = [" ".join("abcd"[int(k)] for k in draw.integers(0, 4, int(n))) for n in draw.integers(8, 40, 10)]
    rows = []
    for i in range(60):
        words = " ".join(phrases[int(k)] for k in draw.integers(0, 10, 4)).split()
        for k in draw.integers(0, len(words), int(draw.integers(0, 3))):
            words[int(k)] = "e"
        rows.append((i, " ".join(words[int(draw.integers(0, 5)):])))
    rows += [(60, rows[0][1]), (61, "a " * 90 + "b"), (62, "c " + "a " * 70)]
    out = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text.split() for r in out} == removed_by_windows(rows, str.split)


def test_passages_leave_no_steps_behind(spark, tmp_path, monkeypatch):
    """What nothing reads any more is gone from the disk: steps, and the shuffle files of every step."""
    import time

    from tickframe import session
    from tickframe.llm import common

    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    shuffles = lambda: sum(f.getName().startswith("shuffle_") and f.getName().endswith(".data") for f in
                           spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
                               spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(0, f"a {text}"), (1, f"b {text} c"), (2, f"d {text.replace('w30', 'e')}")]
    before = shuffles()
    common.released(common.saved(spark.range(1000).repartition(7), "step"))
    end = time.time() + 20
    while shuffles() > before and time.time() < end:  # the request goes to the executors in the background
        time.sleep(0.1)
    assert shuffles() <= before
    out = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["later"]
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == "false"
    assert {r.doc_id: r.text for r in out.collect()} == {0: rows[0][1], 1: "b c", 2: "d e " + " ".join(f"w{k}" for k in range(31, 40))}
