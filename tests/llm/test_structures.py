"""The parts without Spark, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tickframe.llm import attention, htmltext, langid, lm, merkle, packing, passages, rules, simhash, tokens


# --- trie ---------------------------------------------------------------------------------------

def _roots(n, links):
    up = list(range(n))
    for a, b in links:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while up[i] != i:
            i = up[i]
        out.append(i)
    return out


@pytest.mark.parametrize("bits,seed", [(0, 1), (4, 2), (4, 3), (8, 4)])
def test_trie_links_have_the_components_of_all_pairs(bits, seed):
    draw = np.random.default_rng(seed)
    centres = draw.integers(0, 2**63, 30, dtype=np.uint64)
    fp = [int(c) for c in centres]
    for _ in range(600):
        x = int(centres[draw.integers(30)])
        for bit in draw.integers(0, 64, draw.integers(0, 7)):
            x ^= 1 << int(bit)
        fp.append(x)
    fp = np.unique(np.array(fp, np.uint64))
    a, b = simhash.trie_links(fp, np.array([0, len(fp)]), bits)
    assert len(a) < len(fp)  # a forest
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= bits).all()
    pairs = [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= bits]
    assert _roots(len(fp), zip(a.tolist(), b.tolist())) == _roots(len(fp), pairs)


@pytest.mark.parametrize("bits", [0, 4, 8])
@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_some_choice_of_blocks_agrees(bits, n):
    c, masks = simhash.blocks_for(bits, n)
    draw = random.Random(n + bits)
    for _ in range(300):
        difference = sum(1 << k for k in draw.sample(range(64), bits))
        assert any(difference & (m & (1 << 64) - 1) == 0 for m in masks)
    assert len(masks) <= 1000


@pytest.mark.parametrize("equal", [1, 400])
def test_every_near_pair_is_met_once(equal):
    """Also where nodes are compared block by block, and where many fingerprints are equal in all bits."""
    draw = np.random.default_rng(7)
    fp = np.concatenate([draw.integers(0, 2**63, 12, dtype=np.uint64)] * 40 + [np.full(equal, 5, np.uint64)])
    fp = np.sort(fp ^ (np.uint64(1) << draw.integers(0, 64, len(fp), dtype=np.uint64)) * (fp != 5))
    forest = simhash._Every(np.arange(len(fp)))
    met = [p for a, b in simhash._links(fp, np.array([0, len(fp)]), 2, forest) for p in zip(a.tolist(), b.tolist())]
    near = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp) <= 2, 1))
    assert len(met) > 4000 and sorted(met) == sorted(map(tuple, near.tolist()))
    a, _ = simhash.trie_links(np.full(3000, 9, np.uint64), np.array([0, 3000]), 8)
    assert len(a) == 2999


@pytest.mark.parametrize("n", [10**5, 2_300_000, 10**7, 10**9])
def test_rows_of_a_round_take_no_more_than_the_texts(n):
    """All tries are dealt, whatever their number, but the rows that lie on disk at once keep their share of 400 words a document."""
    tries = 3 * len(simhash.blocks_for(8, n)[1])
    text, room = 2400 * n, simhash.SHINGLE_BYTES * 400 * n // 2
    for row in (simhash.ROW_BYTES, simhash.ROW_BYTES + 320):
        rounds = simhash.rounds_for(tries, n * row, room)
        assert [t for r in rounds for t in r] == list(range(tries))
        assert all(len(r) * n * row <= max(0.5 * text, simhash.ROUND_BYTES) for r in rounds)
    assert tries <= 135 or n > 16_000_000
    assert simhash.rounds_for(5, 10**12, 1) == [range(i, i + 1) for i in range(5)] and simhash.rounds_for(27, 0, 0) == [range(27)]


def test_fingerprint_counts_bits():
    h = simhash.shingle_hashes("A b  C d\te".encode(), 4)
    assert len(h) == 2 and len(simhash.shingle_hashes(b"a b", 4)) == 1 and not len(simhash.shingle_hashes(b" \n", 4))
    assert simhash.fingerprint(h)[0] % 2**64 == int(h[0] & h[1])  # more than half of two is both
    assert simhash.fingerprint(np.empty(0, np.uint64)) == [0]


# --- packing ------------------------------------------------------------------------------------

def test_cuts_are_the_cheapest():
    draw = random.Random(5)
    for _ in range(60):
        at = np.array(sorted({0, *(draw.randrange(1, 60) for _ in range(14))}))
        penalty = np.array([draw.choice((0, 0, 2, 5)) for _ in at])
        limit, powers = 24, range(0, 4)
        if np.diff(at).max() > limit:
            continue

        def price(cuts):
            total, before = 0, 0
            for cut in cuts:
                w = cut - before
                total += (0 if w in (1, 2, 4, 8) else limit - w) + int(penalty[np.searchsorted(at, cut)])
                before = cut
            return total

        inner = at[1:-1].tolist()
        ways = ([*c, int(at[-1])] for k in range(len(inner) + 1) for c in itertools.combinations(inner, k))
        best = min(price(w) for w in ways if all(b - a <= limit for a, b in zip([0, *w], w)))
        found = packing.best_cuts(at, penalty, limit, powers)
        assert all(b - a <= limit for a, b in zip([0, *found], found)) and found[-1] == at[-1]
        assert price(found) == best


def test_stream_gives_every_token_once():
    draw = random.Random(8)
    ends = np.zeros(50, bool)
    ends[7] = True
    stream = packing._Stream(ends, 64, True, ["d"], pa.schema([("d", pa.int64())]))
    docs = [[draw.randrange(50) for _ in range(draw.choice((0, 3, 30, 500)))] + [2] for _ in range(80)]
    out = []
    for i, ids in enumerate(docs):
        stream.add((i,), np.array(ids, "<u4").tobytes())
        if stream.size > 900:
            out += stream.pack(False)
    out += stream.pack(True)
    rows = pa.Table.from_batches(out).to_pylist()
    for i, ids in enumerate(docs):
        pieces = [r for r in rows if r["d"] == i]
        assert [x for r in pieces for x in r["ids"]] == ids
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    for _, pieces in itertools.groupby(rows, lambda r: r["sequence_id"]):
        pieces = list(pieces)
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= 64


def test_word_ids_are_those_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    monkeypatch.setattr(tokens, "PASSING", 4)
    words = tokens.WordIds(tokens.vocabulary_path())
    texts = ["The sea, the SEA. It's 'll x_y-z!? ### $$$ 12a3 été Éá ß ñ…", "", " \n\t", "a\x1cb c\x85d e\xa0f x<|endoftext|>y",
             "Ａ ﬁ İstanbul ΣΑΣ é ́ a 日本 語", "² ª º µ × ÷ {a} [b]", "q" * 3000]
    for _ in range(3):
        for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == words._tokenizer.encode(text, add_special_tokens=False).ids
    assert words.encode([None]) == [b""]


# --- passages and trees -------------------------------------------------------------------------

def test_units_and_runs():
    text = "Alpha beta gamma. delta epsilon\nZeta eta theta iota"
    assert [text[a:b] for a, b, _ in passages.units(text)] == ["Alpha beta gamma.", "delta epsilon", "Zeta eta theta iota"]
    assert passages.cleaned(text, [1, 2], 6) == ("Alpha beta gamma. ", [(18, len(text) - 18)], 2)
    assert passages.cleaned(text, [0, 2], 6) == (text, [], 0)  # neither run is long enough
    assert list(passages.units("")) == [] and list(passages.units(" \n ")) == []


def test_tree():
    draw = random.Random(4)
    for _ in range(200):
        text = "".join(draw.choice(("a", "B", " ", ". ", "\n", "é", "!? ", "\r\n", " ")) for _ in range(draw.randrange(900)))
        assert "".join(x for p in merkle.paragraphs(text) for x in p) == text
        assert all(x for p in merkle.paragraphs(text) for x in p)
    a, b = merkle.Tree("One two. Three four.\nFive."), merkle.Tree("One two. Three 4.\nFive.")
    assert a.root != b.root and a.fingerprint() == merkle.Tree("One two. Three four.\nFive.").fingerprint()
    assert [a.text[s:e] for s, e in merkle.edits(a, b)] == ["Three four.\n"]
    assert merkle.edits(a, a) == [] and merkle.likeness(a.fingerprint(), b.fingerprint()) == pytest.approx(2 / 3)
    assert merkle.Tree(None).fingerprint() == merkle.Tree("").fingerprint() and merkle.edited("abcdef", "x") == "abcdx"


# --- random field -------------------------------------------------------------------------------

def _score(field, page, labels):
    s = field.scores(page)
    return sum(s[t] for t, y in enumerate(labels) if y) + sum(field.move[a][b] for a, b in zip(labels, labels[1:]))


def test_field_decodes_and_learns_the_likelihood():
    draw = random.Random(2)
    field = htmltext.Field()
    field.weight = {f"f{i}": draw.uniform(-2, 2) for i in range(6)}
    field.move = [[draw.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
    page = [[f"f{draw.randrange(6)}" for _ in range(3)] for _ in range(7)]
    ways = list(itertools.product((0, 1), repeat=7))
    assert tuple(field.decode(page)) == max(ways, key=lambda y: _score(field, page, y))
    labels = [0, 1, 1, 0, 1, 0, 0]

    def likelihood():
        return _score(field, page, labels) - float(np.logaddexp.reduce([_score(field, page, y) for y in ways]))

    start = likelihood()
    for _ in range(20):
        field.learn(page, labels, rate=0.05)
    assert likelihood() > start and field.decode([]) == []


def test_blocks_and_main_text():
    field = htmltext.train([])
    page = """<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>
    <div class="ad">Buy now and save a lot.</div><article><h1>On the &amp; sea</h1><p><b>It was a long way.<br><p>We  went
    on &eacute;arly, and nobody spoke for hours.</p><script>var t="</p>";</script></article><!-- <p>no</p> -->
    <div id="comments"><p>Great post, thank you.</p></div><footer>&copy; Someone</footer>"""
    assert htmltext.main_text(field, page) == "On the & sea It was a long way. We went on éarly, and nobody spoke for hours."
    assert htmltext.main_text(field, None) == "" and htmltext.main_text(field, "<p <b> </") is not None
    draw, good, said, there = random.Random(77), 0, 0, 0
    for _ in range(150):
        blocks = htmltext.leaf_blocks(htmltext.laid_out_page(draw, ["The road is long.", "A bird sang by the river that day.", "No."]))
        for b, state in zip(blocks, field.decode(htmltext.features(blocks))):
            good += len(b.text) * (state == 1 and b.label == "1")
            said += len(b.text) * state
            there += len(b.text) * (b.label == "1")
    assert good / said > 0.93 and good / there > 0.93


# --- language, attention, rules -----------------------------------------------------------------

def test_ngram_features():
    assert not len(langid.buckets_of(None)) and not len(langid.buckets_of("12 !?"))
    assert (langid.buckets_of("Ab,  1c") == langid.buckets_of(" aB c!")).all()
    assert langid.Model([], np.zeros((langid.BUCKETS, 0)), np.zeros(0), 1.0).predict("abc") == ("und", 0.0)


@pytest.fixture
def model():
    counts = np.ones(attention.IDS)
    counts[:300] = 50
    net = attention.Model(counts)
    draw = np.random.default_rng(1)
    for name, value in net.p.items():
        net.p[name] = value + (draw.standard_normal(value.shape) * 0.3).astype(np.float32)
    net.ready()
    return net


def test_windows_score_like_one_window_and_sum_to_one(model):
    texts = [np.array([5, 9, 300, 7]), np.array([], np.int64), np.arange(90) % 40, np.array([1])]
    ids = np.concatenate([np.concatenate((t, [attention.Subwords.END])) for t in texts]).astype(np.int64)
    logs = model.log_probabilities(ids, np.array([len(t) + 1 for t in texts]), chunk=2, group=3)
    for text, start in zip(texts, (0, 5, 6, 97)):
        stream = np.concatenate(([attention.Subwords.END], text, [attention.Subwords.END]))
        for t in range(len(text) + 1):
            turn = max(0, -(-(t + 1 - attention.WINDOW) // (attention.WINDOW - attention.OVERLAP)))
            first = turn * (attention.WINDOW - attention.OVERLAP)
            given = np.full((1, attention.WINDOW), attention.Subwords.END)
            given[0, :t + 1 - first] = stream[first:t + 1]
            state = model._states(given)[0, t - first]
            assert logs[start + t] == pytest.approx(float(model._log_of(state[None], stream[t + 1:t + 2])[0]), abs=2e-4)
    every = model._log_of(np.repeat(state[None], attention.IDS, 0), np.arange(attention.IDS))
    assert np.exp(every.astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


def test_gradients(model):
    draw = np.random.default_rng(3)
    given, wanted = draw.integers(0, 60, (2, 6)), draw.integers(0, 60, (2, 6))
    counted = np.ones((2, 6), bool)
    counted[1, 4:] = False
    for name in model.p:
        model.p[name] = model.p[name].astype(np.float64)
    _, g = model.gradients(given, wanted, counted)
    for name, value in model.p.items():
        at = np.unravel_index(int(np.abs(g[name]).argmax()), value.shape)
        before = value[at]
        value[at] = before + 1e-4
        high = model.gradients(given, wanted, counted)[0]
        value[at] = before - 1e-4
        low = model.gradients(given, wanted, counted)[0]
        value[at] = before
        assert (high - low) / 2e-4 == pytest.approx(float(g[name][at]), rel=2e-2, abs=1e-5), name


def test_mixing_share():
    assert lm.mixing_share(np.log([0.5] * 9), np.array([0.001] * 9)) < 0.01
    assert lm.mixing_share(np.log([0.001] * 9), np.array([0.5] * 9)) > 0.99
    assert lm.mixing_share(np.array([]), np.array([])) == 0


def test_estimates_find_the_rules_that_know():
    n = len(rules.RULES)
    good = tuple([1] * n)
    bad = tuple([-1] * 3 + [1] * (n - 3))
    share, right = rules.estimate([(good, 900), (bad, 100), (tuple([0] * n), 5)])
    assert 0.85 < share < 0.95 and right[0][1] > 0.9
    assert rules.posterior(bad, share, right) < 0.5 < rules.posterior(good, share, right)
    assert rules.estimate([])[0] == pytest.approx(0.5)


def test_hidden_elements_end():
    """Custom and self-closed elements hide nothing behind them; only script and style run on when they are not closed."""
    said = lambda html: " ".join(b.text for b in htmltext.leaf_blocks(html))
    for html in ('<svg-icon name="x"></svg-icon>', '<svg class="i"/>', '<svg class="i" />', "<video-js></video-js>", "<audio-player>", "<object-x/>",
                 "<math/>", "<svg viewBox='0 0 1 1'>", "<video src=x>", '<svg a=">"><title>no</title></svg>', '<svg/><svg><text>no</text></svg>',
                 "<script>no</script>", "<script-x></script-x>", "<svg\n>no</svg\n>", "<noscript>no</noscript>", '<script data-x="/">no</script>'):
        assert said(html + "<p>article text</p>") == "article text", html
    assert said("<p>seen</p><script>no <p>no</p>") == said("<p>seen</p><style>no") == "seen"


def test_heads_comments_and_links_end():
    said = lambda html: " ".join(b.text for b in htmltext.leaf_blocks(html))
    for html in ("<html><head><title>x</title><article><p>shown</p></article>", "<head><meta a=b><title>x</title>shown", "<title>x</title><p>shown",
                 "<html><head><title>x</title></head><body><p>shown", "<!--><p>shown</p><!-- no -->", "<!---><p>shown</p>", "<!-- no --!><p>shown",
                 "<head><title>x</title><link href=a><style>no</style><br>shown", "<!-- no <p>no</p> --><p>shown"):
        assert said(html) == "shown", html
    (block,) = htmltext.leaf_blocks("<p><a href=x><b><i><u><em><strong>linked</strong></em></u></i></b></a> not")
    assert block.text == "linked not" and block.linked == len("linked")
    blocks = htmltext.leaf_blocks("<ul><li><a href=x>one<li>two</ul>")
    assert [b.text for b in blocks] == ["one", "two"] and blocks[0].linked == 3


# --- parity sketches ------------------------------------------------------------------------------

def test_sketches_never_hide_a_link():
    draw = np.random.default_rng(5)
    sets = [np.empty(0, np.uint64)]
    for n in (1, 3, 40, 200, 260, 1030):
        base = draw.integers(0, 1 << 63, n).astype(np.uint64)
        for share in (0.0, 0.05, 0.1, 0.15, 0.3):
            keep = base[draw.random(n) >= share]
            sets.append(np.unique(np.concatenate((keep, draw.integers(0, 1 << 63, int(n * share)).astype(np.uint64)))))
    sketches = simhash.Sketches([simhash.parity_sketch(s).tobytes() for s in sets], np.array([len(s) for s in sets]), 0.8)
    a, b = np.triu_indices(len(sets), 1)
    said, passed_over = sketches.can_reach(a, b), 0
    assert (said == sketches.can_reach(b, a)).all()
    for x, y, reach in zip(a, b, said):
        union = len(np.union1d(sets[x], sets[y]))
        true = len(np.intersect1d(sets[x], sets[y])) / union if union else 1.0
        assert reach or true < 0.8
        if len(sets[x]) > 100 and true < 0.76:
            assert not reach
            passed_over += 1
    assert passed_over > 50


def test_passages_by_batches():
    """Hashes, seeds and places of many texts in one row are those of each text by itself."""
    draw = np.random.default_rng(4)
    pieces = ["a ", "Bc ", "d. ", "\n", "　", " E", "三", "ก", " é", "x!\t", "y" * 70 + " ", "İ", "\x1c"]
    texts = ["", "a", *["".join(pieces[int(k)] for k in draw.integers(0, len(pieces), 80)) for _ in range(60)]]
    assert all(passages._word_starts(t).tolist() == [m.start() for m in passages._TOKEN.finditer(t)] for t in texts)
    for t in texts:
        spans = sorted(draw.integers(0, len(t) + 1, 2).tolist())
        inside = sum(spans[0] <= a and b <= spans[1] for a, b, _ in passages.units(t))
        assert passages._whole_units(t, *spans) == inside
    words = sorted({w for t in texts for w in passages.tokens(t)} | {"z" * k for k in range(1, 100)})
    assert len(set(passages.word_hashes(words).tolist())) == len(words) and not len(passages.word_hashes([]))
    values = draw.integers(0, 9, 50)
    assert passages.first_least(values, 11).tolist() == [i + int(values[i:i + 11].argmin()) for i in range(40)]
    rows = passages._Words(texts, 10, 20)
    text, at, places, found = rows.seeds(20)
    digests = rows.digests(at, 20).to_pylist()
    windows = []
    for k, t in enumerate(texts):
        own = passages._Words([t])
        one = own.seeds(20)
        mine = text == k
        assert (at[mine] - rows.starts[k]).tolist() == one[1].tolist() and (places[mine] - rows.starts[k]).tolist() == one[2].tolist()
        assert found[mine].tolist() == one[3].tolist()
        w = passages.tokens(t)
        windows += [tuple(w[i:i + 20]) for i in one[1].tolist()]
    assert len(set(zip(windows, digests))) == len(set(windows)) == len(set(digests)) and len(windows) > 1000
