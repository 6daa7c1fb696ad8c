"""Ranked search, spelling variants and the URL filter against plain versions, on small tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tickframe.llm import ranked, spelling, urlfilter

SCHEMA = "doc_id long, text string, score long, term string, `word.n` int, host string, label int"
SYLLABLES = ["an", "be", "ca", "do", "el", "fo", "ga", "hi", "ou", "st", "é", "ß"]


def _texts(seed, n):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(150)]
    return [" ".join(draw.choices(vocabulary, weights=[1 / (i + 1) for i in range(150)], k=draw.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts(1, 400) + [None, "", " \n ", "An, BE-ca? dO! É", "日本 an 日本", "stan " * 5000] + ["an be ca do el"] * 40
    rows = [(i if i != 7 else None, t, 1, "x", 2, "h", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:6], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11 ------------------------------------------------------------------------------------------

def _terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def _brute_search(docs, items, k):
    counted = [(d, Counter(_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = defaultdict(list)
    for item, terms in items.items():
        for d, c, n in counted:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                found[item].append((-score, d is None, d or 0))
    return {item: [(s, None if none else d) for s, none, d in sorted(rows)[:k]] for item, rows in found.items()}


@pytest.mark.parametrize("shard_terms", [300, 10**6])
def test_ranked_search_equals_scoring_all(spark, docs, shard_terms, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 8)
    asked = [(1, "an be zzz"), (2, "STAN stan é"), (3, None), (4, "!?"), (1, "ca"), (None, "日本 do"), (5, " ".join(_texts(2, 4)))]
    items = spark.createDataFrame(asked, "item_id long, text string")
    pooled = defaultdict(set)
    for item, text in asked:
        pooled[item] |= set(_terms(text))
    expected = _brute_search([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], pooled, 10)
    got = defaultdict(list)
    for r in ranked.search(ranked.index(docs, shard_terms=shard_terms), items).orderBy("rank").collect():
        got[r.item_id].append((-r.score, r.doc_id))
        assert r.rank == len(got[r.item_id])
    assert dict(got) == expected


def test_ranked_search_of_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "an")], "item_id long, text string")
    assert ranked.search(ranked.index(empty), items).count() == 0
    assert ranked.search(ranked.index(docs), items.limit(0)).count() == 0


def test_block_maxima_spare_blocks():
    """The frequent list is hardly unpacked once the rare one has set the line."""
    n_docs = 60_000
    lengths = np.full(n_docs, 50)
    rare = np.arange(0, n_docs, 400)
    every = np.arange(n_docs)
    packed = ranked.pack_lists(np.repeat([0, 1], [len(rare), n_docs]), np.concatenate((rare, every)), np.ones(len(rare) + n_docs, np.int64),
                               np.full(len(rare) + n_docs, 50), 2)
    norm = lambda n: 10 + 90 * n // 50
    lists = [ranked.PostingList(w, *(packed[c][i].as_py() for c in ("blocks", "pairs", "body")), norm, norm(lengths)) for i, w in enumerate((5000, 100))]
    found, scores = ranked.best_of(lists, n_docs, 10)
    assert found.tolist() == rare[:10].tolist() and len(set(scores.tolist())) == 1
    assert len(lists[1].open) < 0.2 * len(lists[1].ends)


def test_packed_lists_round_trip():
    draw = np.random.default_rng(3)
    doc = np.unique(np.concatenate((draw.integers(0, 300, 200), draw.integers(0, 5_000_000, 900))))
    tf = np.where(draw.random(len(doc)) < 0.01, 70_000, draw.integers(1, 9, len(doc)))
    lengths = draw.integers(1, 2000, 5_000_000)
    packed = ranked.pack_lists(np.zeros(len(doc), np.int64), doc, tf, lengths[doc], 1)
    norm = lambda n: 10 + n
    one = ranked.PostingList(7, *(packed[c][0].as_py() for c in ("blocks", "pairs", "body")), norm, norm(lengths))
    read = [one.block(k) for k in range(len(one.ends))]
    assert np.concatenate([d for d, _ in read]).tolist() == doc.tolist()
    assert np.concatenate([s for _, s in read]).tolist() == (7 * ((10**9 * tf) // (1000 * tf + 8 * norm(lengths[doc])))).tolist()
    assert [int(s.max()) for _, s in read] == one.most[:-1].tolist()


# --- 12 ------------------------------------------------------------------------------------------

def _brute_words(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


@pytest.mark.parametrize("cell", [12, 20_000])
def test_spelling_variants_equal_all_comparisons(docs, cell, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", cell)
    n = _brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(n) > 60
    near = {w: [v for v in n if v != w and _is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == {w: (form[w], root[w], n[w], len(near[w]), n.get(form[w])) for w in n}


def test_spelling_of_an_empty_table(empty):
    assert spelling.variants(empty).count() == 0


def test_cells_and_trees_find_every_near_word():
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("abcde", k=draw.randint(5, 7))).encode() for _ in range(3000)})
    for length in (5, 6, 7):
        home = [w for w in words if len(w) == length]
        n = np.array([draw.randint(3, 9) for _ in home])
        asked = [w for w in words if abs(len(w) - length) <= 1]
        n_near, best = spelling.near_in_cell(home, n, asked)
        for i in range(0, len(asked), 37):
            near = [h for h in range(len(home)) if _is_near(asked[i].decode(), home[h].decode())]
            assert n_near[i] == len(near)
            assert best[i] == min(near, key=lambda h: (-n[h], home[h]), default=-1)
        upper = spelling.Tree(spelling.letter_counts(home[::3]), 40, tight=False)
        counts = spelling.letter_counts(home)
        at = upper.home(counts)
        assert at.max() > 3
        seen = defaultdict(set)
        for node, some in upper.reach(counts, np.full(len(home), 2)):
            seen[upper.leaf_number[node]] |= set(some.tolist())
        assert all(i in seen[at[i]] for i in range(len(home)))
        for i in range(0, len(home), 41):
            assert all(i in seen[at[h]] for h in range(len(home)) if _is_near(home[i].decode(), home[h].decode()))


# --- 13 ------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x=1&y=2#z", "http://example.net/en", "http://net/", "http://notnet.org/fr/x",
    "https://b.example.com/de/5", "https://b.example.com/den", "https://Example.COM/de/", "ftp://u.org/fr/?", "http://u.org?/fr/", "http://x.net#/en/",
    "http://é-ü.net/en/1", "http://a.example.net/EN/", "http://h.com/" + "p/" * 4000, "http://😀.org/fr/😀",
]


def _plain_parts(url):
    _, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "own", 1) for i, u in enumerate(URLS + URLS[4:9])], "page_id long, url string, host string, label int")
    rows = {r.page_id: r for r in urlfilter.judge(pages, ("page_id",)).collect()}
    assert len(rows) == len(URLS) + 5
    for i, url in enumerate(URLS):
        host, path = _plain_parts(url)
        fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best.text if best else None)
        assert rows[i].verdict == (best.action if best else "block" if rows[i].p_block > 0.5 else "allow")
    assert urlfilter.judge(pages.limit(0), ("page_id",)).count() == 0
    plain = urlfilter.judge(pages.filter("url LIKE 'http://h.com%'"), ("page_id",)).collect()
    assert [r.verdict for r in plain] == ["allow"]


def test_url_trees_learn_what_the_labels_say(spark):
    """Hosts of one kind are blocked: unseen hosts of that kind are, others are not; the fit equals boosting row by row."""
    draw = random.Random(9)
    rows = []
    for i in range(1500):
        bad = i % 3 == 0
        host = f"{'x-' * 3 if bad else 'y'}{draw.randint(0, 10**6)}.{'biz' if bad else 'info'}"
        rows.append((i, f"http://{host}/{draw.randint(0, 99)}{'?a=1&b=2&c=3' if bad else ''}"))
    urls = spark.createDataFrame(rows, "page_id long, url string")
    rules = (urlfilter.Rule("block", "biz", "/1"), urlfilter.Rule("allow", "info", "/1"), urlfilter.Rule("block", "biz", "/2"))
    got = urlfilter.judge(urls, ("page_id",), rules=rules).filter("rule IS NULL").collect()
    assert len(got) > 500 and all((r.verdict == "block") == (r.page_id % 3 == 0) for r in got)

    featured = urlfilter.features(urls, "url", rules, ("page_id",))
    model = urlfilter.train(featured)
    table = featured.filter("label IS NOT NULL").toPandas()
    bins = np.column_stack([sum((table[name] >= b).astype(int) for b in bounds) for name, bounds in urlfilter.FEATURES])
    y = table["label"].to_numpy(float)
    score = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    assert model.start == pytest.approx(score[0])
    for tree in model.trees:
        p = 1 / (1 + np.exp(-score))
        node = sum((bins[:, f] >= b).astype(int) << level for level, (f, b) in enumerate(tree.splits))
        for v, value in enumerate(tree.values):
            g, h = (y - p)[node == v].sum(), (p * (1 - p))[node == v].sum()
            assert value == pytest.approx(urlfilter.RATE * g / (h + urlfilter.RIDGE), abs=1e-9)
        score += np.array(tree.values)[node]
    assert ((score > 0) == (y > 0)).mean() > 0.99


def test_url_filter_runs_no_python(spark):
    urls = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/fr/")], "page_id long, url string")
    plan = urlfilter.judge(urls, ("page_id",))._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("MapInArrow", "ArrowEval", "BatchEval", "FlatMapGroups", "PythonUDF"))
